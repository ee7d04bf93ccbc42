"""Field mutations. The order inside one block is fixed, whatever order the arguments come in."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import paths
from logweave.frame import STRING_ARRAY, EventFrame, Ref
from logweave.functions.regex import replacement_to_java, to_java
from logweave.functions.text import quote_java, strip as strip_text, template
from logweave.pipeline import Operator, named

# Texts that convert to true.
TRUE_WORDS = ("true", "yes", "1", "on")


def _many(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def mutate(
    *,
    add_field: Mapping[str, Any] | None = None,
    replace: Mapping[str, str] | None = None,
    update: Mapping[str, str] | None = None,
    rename: Mapping[str, str] | None = None,
    remove_field: str | Iterable[str] | None = None,
    add_tag: str | Iterable[str] | None = None,
    remove_tag: str | Iterable[str] | None = None,
    copy: Mapping[str, str] | None = None,
    convert: Mapping[str, str] | None = None,
    lowercase: str | Iterable[str] | None = None,
    uppercase: str | Iterable[str] | None = None,
    strip: str | Iterable[str] | None = None,
    split: Mapping[str, str] | None = None,
    join: Mapping[str, str] | None = None,
    gsub: Iterable[tuple[str, str, str]] | None = None,
    merge: Mapping[str, str] | None = None,
) -> Operator:
    """Sixteen edits, applied in the order of the parameters above."""

    def run(f: EventFrame) -> None:
        for field, value in (add_field or {}).items():
            f.set(field, _value(f, value))
            f.note("fields_added", field)
        for field, value in (replace or {}).items():
            _note_write(f, field)
            f.set(field, _value(f, value))
        for field, value in (update or {}).items():
            if f.get(field) is not None:
                there = f.exists(field)
                f.note("fields_modified", field, there)
                f.set(field, _value(f, value), there)
        for old, new in (rename or {}).items():
            _rename(f, old, new)
        for field in _many(remove_field):
            f.note("fields_removed", field, f.exists(field) if f.notes is not None else None)
            f.remove(field)
        for tag in _many(add_tag):
            f.add_tag(tag)
        for tag in _many(remove_tag):
            f.remove_tag(tag)
        for source, target in (copy or {}).items():
            _move(f, source, target)
        for field, kind in (convert or {}).items():
            _convert(f, field, kind)
        for fields, fn in ((lowercase, F.lower), (uppercase, F.upper), (strip, strip_text)):
            for field in _many(fields):
                _edit_text(f, field, fn)
        for field, separator in (split or {}).items():
            _split(f, field, separator)
        for field, separator in (join or {}).items():
            _join(f, field, separator)
        for field, pattern, replacement in gsub or ():
            regex, text = to_java(pattern), replacement_to_java(replacement)
            _edit_text(
                f, field, lambda c, r=regex, t=text: F.regexp_replace(c, F.lit(r), F.lit(t)), cost=20
            )
        for target, source in (merge or {}).items():
            _merge(f, target, source)

    return named("mutate", run)


def _value(f: EventFrame, value: Any) -> Ref:
    if isinstance(value, bool):
        return f.literal(value, "boolean")
    if isinstance(value, int):
        return Ref(F.lit(value).cast("bigint"), "bigint")
    if isinstance(value, float):
        return f.literal(value, "double")
    return template(f, value)


def _present(f: EventFrame, ref: Ref) -> Ref:
    return f.lift(lambda c: c.isNotNull(), ref, dtype="boolean")


def _note_write(f: EventFrame, field: str) -> None:
    if f.notes is None:
        return
    there = f.bind(f.exists(field))
    f.note("fields_modified", field, there)
    f.note("fields_added", field, f.negate(there))


def _rename(f: EventFrame, old: str, new: str) -> None:
    """Move a field, or a whole subtree, where it is present."""
    _move(f, old, new, keep=False)
    prefix = paths.leaf(old)
    for child in f.children(old):
        if not (paths.leaf(new) + ".").startswith(prefix + "."):
            _move(f, child, paths.leaf(new) + child[len(prefix):], keep=False)


def _move(f: EventFrame, source: str, target: str, keep: bool = True) -> None:
    value = f.get(source)
    if value is None:
        return
    value = f.share(value)
    f.note("fields_added", target, _present(f, value))
    if not keep:
        f.note("fields_removed", source, _present(f, value))
        f.remove_leaf(source)
    f.put(target, value)


def _convert(f: EventFrame, field: str, kind: str) -> None:
    """Typed value where it converts; NULL otherwise, with the text kept in ``<field>_raw``."""
    value = f.get(field)
    if value is None:
        return
    if kind == "string":
        f.note("fields_modified", field, _present(f, value))
        f.set(field, f.as_text(value))
        return
    value = f.bind(value)
    if kind in ("integer", "int"):
        made = f.lift(_to_int, f.as_text(value), dtype="bigint", cost=4, repeat=0)
    elif kind == "float":
        made = f.lift(lambda c: c.try_cast("double"), f.as_text(value), dtype="double")
    elif kind in ("boolean", "bool"):
        made = f.lift(lambda c: F.lower(c).isin(*TRUE_WORDS), f.as_text(value), dtype="boolean")
    else:
        raise ValueError(f"cannot convert to {kind}")
    made = f.bind(made)
    f.note("fields_modified", field, _present(f, made))
    if made.dtype != "boolean" and value.dtype == "string":
        raw = f.lift(lambda v, m: F.when(m.isNull(), v), value, made, dtype="string")
        f.put(paths.leaf(field) + "_raw", raw)
    f.set(field, made)


def _to_int(c: Column) -> Column:
    """Whole numbers only; surrounding blanks are allowed, a decimal point is not."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("bigint"))


def _edit_text(f: EventFrame, field: str, fn, cost: int = 1) -> None:
    value = f.get(field)
    if value is None or value.dtype != "string":
        return
    f.note("fields_modified", field, _present(f, value))
    f.set(field, f.lift(fn, f.share(value), dtype="string", cost=cost))


def _split(f: EventFrame, field: str, separator: str) -> None:
    value = f.get(field)
    if value is None or value.dtype != "string":
        return
    f.note("fields_modified", field, _present(f, value))
    regex = quote_java(separator)
    made = f.lift(lambda c: F.split(c, regex), value, dtype=STRING_ARRAY, cost=30)
    f.set(field, f.bind(made))


def _join(f: EventFrame, field: str, separator: str) -> None:
    value = f.get(field)
    if value is None or not value.dtype.startswith("array<"):
        return
    f.note("fields_modified", field, _present(f, value))
    f.set(field, f.lift(lambda c: F.array_join(c, separator), value, dtype="string"))


def _merge(f: EventFrame, target: str, source: str) -> None:
    """Append an array to an array, or lay an object's leaves over another's; else nothing."""
    to, frm = f.get(target), f.get(source)
    if to is not None and frm is not None:
        if to.dtype.startswith("array<") and frm.dtype.startswith("array<"):
            both = f.bind(
                f.lift(lambda a, b: a.isNotNull() & b.isNotNull(), to, frm, dtype="boolean")
            )
            f.note("fields_modified", target, both)
            f.set(target, f.lift(lambda a, b: F.concat(a, b), to, frm, dtype=to.dtype), both)
        return
    if f.children(target) and f.children(source):
        both = f.bind(f.both(f.exists(target), f.exists(source)))
        f.note("fields_modified", target, both)
        prefix = paths.leaf(source)
        for child in f.children(source):
            value = f.fields[child]
            laid = f.lift(lambda b, v: F.when(b, v), both, value, dtype=value.dtype)
            f.put(paths.leaf(target) + child[len(prefix):], laid)
