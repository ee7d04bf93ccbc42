"""Structured extraction: JSON, delimited text, key=value text, dates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import paths
from logweave.frame import EventFrame, Ref
from logweave.functions.text import quote_java
from logweave.operators.grok import grok
from logweave.pipeline import Operator, named


def json(
    source: str,
    target: str | None = None,
    fields: Mapping[str, str] | None = None,
    add_tag: str | Iterable[str] = (),
    rest: str | None = None,
) -> Operator:
    """Parse a JSON text.

    With ``target`` the whole value goes there as VARIANT, readable by path in later stages.
    Without it the declared ``fields`` (path → type) of a JSON object are merged into the event. The column set of a plan
    is fixed, so no key becomes a column undeclared; the whole value, with all of them, goes to ``rest`` (``<source>_json``
    if not given) as VARIANT and on to the sink. Bad JSON changes nothing.
    """
    tags = [add_tag] if isinstance(add_tag, str) else list(add_tag)
    whole = rest or f"{paths.leaf(source)}_json"

    def run(f: EventFrame) -> None:
        text = f.text(source)
        if text is None:
            return
        text = f.bind(text)
        parsed = f.bind(f.lift(F.try_parse_json, text, dtype="variant", cost=100, repeat=0))
        ok = f.bind(f.lift(lambda p: p.isNotNull(), parsed, dtype="boolean"))
        f.note("error", source, f.lift(lambda t, k: t.isNotNull() & ~k, text, ok, dtype="boolean"))
        if target is not None:
            f.note("fields_added", target, ok)
            f.put(target, parsed)
        else:
            for path, dtype in (fields or {}).items():
                where = "$" + "".join(f"['{p}']" for p in paths.parts(path))
                value = f.lift(
                    lambda p, w=where, t=dtype: F.try_variant_get(p, w, t),
                    parsed, dtype=dtype, cost=5,
                )
                _note_present(f, path, value)
                f.put(path, value)
            f.put(whole, parsed)
        for tag in tags:
            f.add_tag(tag, ok)

    return named("json", run)


_END = "\ufdd2"


def csv(source: str, columns: list[str], separator: str = ",", quote: str | None = '"') -> Operator:
    """Delimited text into named columns by position; missing trailing columns change nothing.

    With ``quote=None`` the text is split plainly, else quoted values may hold the separator, and a doubled quote stands
    for one. A blank cell is an empty text, quoted or not; blanks around a value stay.
    """

    def plain(c: Column) -> Column:
        return F.split(c, quote_java(separator))

    def quoted(c: Column) -> Column:
        # the parser reads blanks and missing cells alike; a mark behind the last cell tells them apart
        schema = ", ".join(f"c{i} STRING" for i in range(len(columns) + 1))
        row = F.from_csv(F.concat(c, F.lit(separator + _END)), schema, {"sep": separator, "quote": quote, "escape": quote, "mode": "PERMISSIVE"})
        cells = F.array(*[row[f"c{i}"] for i in range(len(columns) + 1)])
        end = F.array_position(cells, _END)
        there = F.when(end > 0, F.slice(cells, 1, (end - 1).cast("int"))).otherwise(cells)
        return F.transform(there, lambda x: F.coalesce(x, F.lit("")))

    def split(c: Column) -> Column:
        if quote is None:
            return plain(c)
        return F.when(c.contains(quote), quoted(c)).otherwise(plain(c))

    def run(f: EventFrame) -> None:
        text = f.text(source)
        if text is None:
            return
        arr = f.bind(f.lift(split, text, dtype="array<string>", cost=100, repeat=0))
        for i, column in enumerate(columns):
            value = f.lift(lambda a, i=i: F.get(a, i), arr, dtype="string")
            _note_present(f, column, value)
            f.put(column, value)

    return named("csv", run)


def dissect(source: str, mapping: str, tag_on_failure: str | Iterable[str] = ("_dissectfailure",)) -> Operator:
    """Cut a text at literal delimiters: ``"%{a} %{[b][c]}: %{rest}"``; ``%{}`` skips a piece.

    Runs on the grok path: the mapping becomes one anchored pattern. Every piece but the last ends
    at the first occurrence of its delimiter.
    """
    pieces = re.split(r"%\{([^}]*)\}", mapping)
    regex = "^" + quote_java(pieces[0])
    for i in range(1, len(pieces), 2):
        field, after = pieces[i], pieces[i + 1]
        body = "(?s:.*)" if i == len(pieces) - 2 and not after else "(?s:.*?)"
        regex += (f"(?<{field}>{body})" if field else f"(?:{body})") + quote_java(after)
    inner = grok(source, regex + ("$" if pieces[-1] else ""), tag_on_failure=tag_on_failure)
    return named("dissect", lambda f: inner(f))


def kv(
    source: str,
    keys: Iterable[str],
    target: str | None = None,
    field_split: str = " ",
    value_split: str = "=",
    rest: str | None = None,
) -> Operator:
    """``k=v`` pairs into fields, for the declared ``keys``; the last of a repeated key wins.

    All pairs, those of undeclared keys too, go as a map to ``rest`` (``<target or source>_pairs`` if not given).
    """
    wanted = list(keys)
    whole = rest or f"{paths.leaf(target or source)}_pairs"

    def pairs(c: Column) -> Column:
        return F.transform(
            F.filter(F.split(c, quote_java(field_split)), lambda p: p.contains(value_split)),
            lambda p: F.struct(
                F.substring_index(p, value_split, 1).alias("key"),
                p.substr(F.instr(p, value_split) + len(value_split), F.length(p)).alias("value"),
            ),
        )

    def run(f: EventFrame) -> None:
        text = f.text(source)
        if text is None:
            return
        found = f.bind(f.lift(pairs, text, dtype="pairs", cost=100, repeat=0))
        for key in wanted:
            field = f"{paths.leaf(target)}.{key}" if target else key
            value = f.lift(
                lambda p, k=key: F.get(F.reverse(F.filter(p, lambda e: e["key"] == k)), 0)["value"],
                found, dtype="string", cost=20,
            )
            _note_present(f, field, value)
            f.put(field, value)
        f.put(whole, f.lift(_last_of_each, found, dtype="map<string,string>", cost=20, repeat=0))

    return named("kv", run)


def _last_of_each(pairs: Column) -> Column:
    """Key and value pairs as a map; the last of a repeated key wins."""
    kept = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
    return F.when(F.size(kept) > 0, F.map_from_entries(kept))


# Strftime letters, the Spark datetime letters for them, and the text they stand for.
_STRFTIME = {
    "Y": ("yyyy", r"\d{4}"), "y": ("yy", r"\d{2}"), "m": ("MM", r"\d{1,2}"), "d": ("dd", r"\d{1,2}"),
    "H": ("HH", r"\d{1,2}"), "I": ("hh", r"\d{1,2}"), "M": ("mm", r"\d{1,2}"), "S": ("ss", r"\d{1,2}"),
    "f": ("SSSSSS", r"\d{6}"), "p": ("a", "[AaPp][Mm]"), "b": ("MMM", "[A-Za-z]{3}"),
    "B": ("MMMM", "[A-Za-z]+"), "a": ("E", "[A-Za-z]{3}"), "A": ("EEEE", "[A-Za-z]+"),
    "j": ("DDD", r"\d{3}"), "z": ("xx", r"[+-]\d{4}"), "Z": ("z", "[A-Za-z/_]+"),
}


def datetime_pattern(fmt: str) -> tuple[str, str]:
    """Spark datetime pattern for a strftime format, and a regex of the texts it can read.

    A number between separators may have one digit or two, else it has two.
    """
    out, shape, literal = "", "", ""

    def close() -> None:
        nonlocal out, literal
        if literal:
            plain = not re.search(r"[A-Za-z'\[\]{}#]", literal)
            out += literal if plain else "'" + literal.replace("'", "''") + "'"
            literal = ""

    pieces = re.findall(r"%.|[^%]", fmt, re.S)
    for i, piece in enumerate(pieces):
        if piece[0] != "%" or piece == "%%":
            literal += piece[-1]
            shape += quote_java(piece[-1])
            continue
        close()
        letters, text = _STRFTIME[piece[1]]
        tight = any(p[0] == "%" for p in pieces[max(i - 1, 0) : i] + pieces[i + 1 : i + 2])
        if text == r"\d{1,2}":
            letters, text = (letters, r"\d{2}") if tight else (letters[0], text)
        out += letters
        shape += text
    close()
    return out, shape


def date(source: str, fmt: str, target: str = "@timestamp", year: int | None = None) -> Operator:
    """Parse a time: ``ISO8601``, ``UNIX``, ``UNIX_MS`` or a strftime format.

    ``year`` supplies the year for formats that lack one (syslog headers). Times without a zone are
    read in the session time zone. A bad value changes nothing.
    """

    def parsed(c: Column) -> Column:
        if fmt == "ISO8601":
            iso = F.when(
                c.rlike(r"^\d{4}-\d{2}(-\d{2}([T ].*)?)?$|^\d{8}(T.*)?$|^\d{4}$"), c
            )
            return F.try_to_timestamp(iso)
        if fmt in ("UNIX", "UNIX_MS"):
            scale = 1_000_000 if fmt == "UNIX" else 1_000
            micros = F.round(c.try_cast("double") * F.lit(float(scale))).try_cast("bigint")
            return F.timestamp_micros(micros)
        pattern, shape = datetime_pattern(fmt)
        text = F.regexp_replace(c, " +", " ") if " " in fmt else c
        if year is not None:
            text, pattern = F.concat(F.lit(f"{year:04d} "), text), "yyyy " + pattern
        fits = c.rlike(f"^{shape.replace(quote_java(' '), ' +')}$")
        return F.when(fits, F.try_to_timestamp(text, F.lit(pattern)))

    def run(f: EventFrame) -> None:
        text = f.text(source)
        if text is None:
            return
        made = f.bind(f.lift(parsed, text, dtype="timestamp", cost=30))
        ok = f.bind(f.lift(lambda c: c.isNotNull(), made, dtype="boolean"))
        f.note("error", source, f.lift(lambda t, k: t.isNotNull() & ~k, text, ok, dtype="boolean"))
        if f.notes is not None:
            old = f.exists(target)
            f.note("fields_modified", target, f.both(ok, old))
            f.note("fields_added", target, f.both(ok, f.negate(old)))
        old = f.fields.get(paths.leaf(target))
        if old is not None and old.dtype == "string":
            made = f.lift(iso_text, made, dtype="string")
        f.put(target, made)

    return named("date", run)


def _note_present(f: EventFrame, field: str, value: Ref) -> None:
    if f.notes is not None:
        f.note("fields_added", field, f.lift(lambda c: c.isNotNull(), value, dtype="boolean"))


def iso_text(c: Column) -> Column:
    """A timestamp as ISO-8601 text: microseconds only when there are any, with the zone offset."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(
        whole,
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.date_format(c, "xxx"),
    )
