"""Pattern extraction.

A grok expression is expanded when the plan is made into one Java regex with numbered groups. One
``regexp_replace`` per row rewrites the text to its captures joined by a separator, and ``split``
turns that into an array; all captures of a pattern cost one regex pass. Text that holds the
separator itself (a Unicode noncharacter) takes a slower exact route, group by group.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import paths
from logweave.frame import EventFrame, Ref
from logweave.functions.regex import required_text, starts_with_any, to_java
from logweave.patterns import library
from logweave.pipeline import Operator, named

SEPARATOR = "\ufdd0"
_LINE_START = r"(?s:.*?[\n\r\u0085\u2028\u2029])??"
_REFERENCE = re.compile(r"%\{(\w+)(?::([^}:]+))?(?::(\w+))?\}")
_NAMED_GROUP = re.compile(r"\(\?P?<(?![=!])([^>]+)>")
_TYPES = {"int": "bigint", "integer": "bigint", "float": "double"}


@dataclass(frozen=True)
class Capture:
    index: int
    field: str
    dtype: str
    optional: bool


@dataclass(frozen=True)
class Compiled:
    """A Java regex and what its groups mean."""

    regex: str
    captures: tuple[Capture, ...]

    @property
    def whole(self) -> str:
        """The regex for a whole text, from its first match on.

        A pattern that begins with ``.*`` matches from the start of a line if it matches from anywhere in it, so only
        line starts are tried: a text that does not match costs one pass and not one pass per character.
        """
        before = _LINE_START if starts_with_any(self.regex) else "(?s:.*?)"
        return f"^{before}(?:{self.regex})(?s:.*)$"

    def may_match(self, text: Column) -> Column | None:
        """A quick test that every match passes; None if there is none."""
        needed = required_text(self.regex)
        return text.contains(needed) if len(needed) > 1 else None

    def matches(self, text: Column) -> Column:
        quick = self.may_match(text)
        return text.rlike(self.whole) if quick is None else quick & text.rlike(self.whole)

    def array(self, text: Column, number: int = 0) -> Column:
        """``[number, capture 1, capture 2, …]`` on a match, one element or NULL otherwise."""
        n = max((c.index for c in self.captures), default=0)
        whole = self.whole
        marks = str(number) + SEPARATOR + SEPARATOR.join(f"${i}" for i in range(1, n + 1))
        fast = F.split(F.regexp_replace(text, F.lit(whole), F.lit(marks)), SEPARATOR)
        slow = F.when(
            text.rlike(whole),
            F.transform(
                F.sequence(F.lit(0), F.lit(max(n, 1))),
                lambda i: F.when(i > 0, _group(text, whole, i, n)).otherwise(F.lit(str(number))),
            ),
        )
        found = F.when(text.contains(SEPARATOR), slow).otherwise(fast)
        quick = self.may_match(text)
        return found if quick is None else F.when(quick, found)


def _group(text: Column, regex: str, index: Column, n: int) -> Column:
    return F.lit("") if n == 0 else F.call_function("regexp_extract", text, F.lit(regex), index)


def expand(pattern: str, definitions: dict[str, str], depth: int = 0) -> str:
    """Replace every ``%{NAME:field:type}`` by its definition in a named group."""
    if depth > 40:
        raise ValueError(f"pattern refers to itself: {pattern}")

    def one(m: re.Match) -> str:
        name, field, kind = m.groups()
        if name not in definitions:
            raise ValueError(f"unknown pattern {name}")
        body = expand(definitions[name], definitions, depth + 1)
        if field is None:
            return f"(?:{body})"
        return f"(?<{field}{':' + kind if kind else ''}>{body})"

    return _REFERENCE.sub(one, pattern)


def compile_pattern(pattern: str, extra: dict[str, str] | None = None) -> Compiled:
    return _compile(pattern, tuple(sorted((extra or {}).items())))


@lru_cache(maxsize=512)
def _compile(pattern: str, extra: tuple[tuple[str, str], ...]) -> Compiled:
    text = to_java(expand(pattern, {**library(), **dict(extra)}))
    out: list[str] = []
    groups = [{"field": None, "branches": False, "loose": False, "kids": []}]
    i, index, in_class = 0, 0, False
    captures: list[dict] = []
    while i < len(text):
        ch = text[i]
        if ch == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if in_class or ch == "[":
            in_class = ch != "]"
            out.append(ch)
            i += 1
            continue
        if ch == "(":
            group = {"field": None, "branches": False, "loose": False, "kids": []}
            m = _NAMED_GROUP.match(text, i)
            if m:
                index += 1
                group["field"] = {"index": index, "name": m.group(1), "optional": False}
                captures.append(group["field"])
                out.append("(")
                i = m.end()
            elif text.startswith("(?", i):
                group["loose"] = text.startswith("(?!", i) or text.startswith("(?<!", i)
                out.append("(?")
                i += 2
            else:
                out.append("(?:")
                i += 1
            groups.append(group)
            continue
        if ch == ")":
            group = groups.pop()
            nxt = text[i + 1 : i + 3]
            skippable = nxt[:1] in ("?", "*") or nxt.startswith("{0")
            inner = group["kids"]
            if group["branches"] or group["loose"] or skippable:
                for c in inner:
                    c["optional"] = True
            own = group["field"]
            if own is not None:
                own["optional"] = own["optional"] or skippable
                inner = [*inner, own]
            groups[-1]["kids"].extend(inner)
        elif ch == "|":
            groups[-1]["branches"] = True
        out.append(ch)
        i += 1
    if groups[0]["branches"]:
        for c in captures:
            c["optional"] = True
    return Compiled(
        "".join(out),
        tuple(_capture(c["index"], c["name"], c["optional"]) for c in captures),
    )


def _capture(index: int, name: str, optional: bool) -> Capture:
    field, _, kind = name.partition(":")
    return Capture(index, paths.leaf(field), _TYPES.get(kind, "string"), optional)


def captured(arr: Column, compiled: Compiled, field: str) -> Column:
    """Value of one field: its last group that took part; NULL when none did."""
    options = []
    for c in reversed([c for c in compiled.captures if c.field == field]):
        value = F.get(arr, c.index)
        options.append(F.nullif(value, F.lit("")) if c.optional else value)
    return options[0] if len(options) == 1 else F.coalesce(*options)


def first_match(text: Column, patterns: list[Compiled]) -> Column:
    """Capture array of the first pattern that matches; its first element is the pattern's number."""
    if len(patterns) == 1:
        return patterns[0].array(text)
    out = F.when(patterns[0].matches(text), patterns[0].array(text, 0))
    for i, c in enumerate(patterns[1:], 1):
        out = out.when(c.matches(text), c.array(text, i))
    return out


def _matched(arr: Column) -> Column:
    return F.coalesce(F.size(arr) > 1, F.lit(False))


def grok(
    source: str,
    patterns: str | Iterable[str],
    *,
    add_tag: str | Iterable[str] = (),
    tag_on_failure: str | Iterable[str] = ("_grokparsefailure",),
    definitions: dict[str, str] | None = None,
) -> Operator:
    """Search ``source`` for the patterns in order; the first that matches sets its captures.

    Captures overwrite. A missing source changes nothing. ``definitions`` adds pattern names.
    """
    compiled = [
        compile_pattern(p, definitions) for p in ([patterns] if isinstance(patterns, str) else patterns)
    ]
    on_match = [add_tag] if isinstance(add_tag, str) else list(add_tag)
    on_failure = [tag_on_failure] if isinstance(tag_on_failure, str) else list(tag_on_failure)

    def run(f: EventFrame) -> None:
        text = f.text(source)
        if text is None:
            return
        text = f.share(text)
        arr = f.bind(f.lift(
            lambda t: first_match(t, compiled), text, dtype="array<string>", cost=100, repeat=8
        ))
        hit = f.lift(_matched, arr, dtype="boolean")
        holders: dict[str, list[tuple[int, Compiled]]] = {}
        kinds: dict[str, str] = {}
        for number, c in enumerate(compiled):
            for capture in c.captures:
                places = holders.setdefault(capture.field, [])
                if (number, c) not in places:
                    places.append((number, c))
                if capture.dtype != "string":
                    kinds[capture.field] = capture.dtype
        for field, places in holders.items():

            def value(a: Column, field=field, places=places) -> Column:
                if len(compiled) == 1:
                    return captured(a, compiled[0], field)
                which = F.get(a, 0)
                out = None
                for number, c in places:
                    one = captured(a, c, field)
                    test = which == F.lit(str(number))
                    out = F.when(test, one) if out is None else out.when(test, one)
                return out

            got = f.lift(value, arr, dtype="string", cost=2 * len(places))
            dtype = kinds.get(field, "string")
            if dtype != "string":
                got = f.lift(lambda c, t=dtype: c.try_cast(t), got, dtype=dtype)
            _note(f, field, got)
            f.put(field, got, only_here=True)
        for tag in on_match:
            f.add_tag(tag, hit)
        if on_failure:
            miss = f.lift(lambda t, h: t.isNotNull() & ~h, text, hit, dtype="boolean")
            for tag in on_failure:
                f.add_tag(tag, miss)

    return named("grok", run)


def _note(f: EventFrame, field: str, got: Ref) -> None:
    """Nested captures always count as added; a top-level one that was there counts as modified."""
    if f.notes is None:
        return
    present = f.lift(lambda c: c.isNotNull(), got, dtype="boolean")
    if "." in field or field not in f.fields:
        f.note("fields_added", field, present)
    else:
        old = f.exists(field)
        f.note("fields_added", field, f.both(present, f.negate(old)))
        f.note("fields_modified", field, f.both(present, old))
