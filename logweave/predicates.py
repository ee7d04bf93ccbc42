"""Conditions on events.

Every condition is closed: it is true or false, never NULL, so a missing field behaves the same
everywhere. ``!=`` and ``!~`` hold for a missing field; every other comparison does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.frame import EventFrame, Ref
from logweave.functions.regex import search


class Condition:
    """A test built into a boolean expression when the plan is made. Combine with ``& | ~``."""

    def __init__(self, build: Callable[[EventFrame], Ref]):
        self.build = build

    def __and__(self, other: Condition) -> Condition:
        return Condition(
            lambda f: f.lift(lambda a, b: a & b, self.build(f), other.build(f), dtype="boolean")
        )

    def __or__(self, other: Condition) -> Condition:
        return Condition(
            lambda f: f.lift(lambda a, b: a | b, self.build(f), other.build(f), dtype="boolean")
        )

    def __invert__(self) -> Condition:
        return Condition(lambda f: f.negate(self.build(f)))


def _test(ref: str, fn: Callable[[Column], Column], missing: bool, cost: int = 1) -> Condition:
    def build(f: EventFrame) -> Ref:
        found = f.text(ref)
        if found is None:
            return f.literal(missing, "boolean")
        return f.lift(
            lambda c: F.coalesce(fn(c), F.lit(missing)), f.share(found), dtype="boolean", cost=cost
        )

    return Condition(build)


def exists(ref: str) -> Condition:
    """``[f]``: the field, or something under it, has a value. An empty string exists."""
    return Condition(lambda f: f.exists(ref))


def missing(ref: str) -> Condition:
    """``![f]``"""
    return ~exists(ref)


def eq(ref: str, value: str) -> Condition:
    return _test(ref, lambda c: c == F.lit(str(value)), False)


def ne(ref: str, value: str) -> Condition:
    return _test(ref, lambda c: c != F.lit(str(value)), True)


def matches(ref: str, pattern: str) -> Condition:
    """``[f] =~ /pattern/``: search anywhere in the text."""
    return _test(ref, lambda c: search(c, pattern), False, cost=12)


def not_matches(ref: str, pattern: str) -> Condition:
    return _test(ref, lambda c: ~search(c, pattern), True, cost=12)


def contains_text(ref: str, text: str) -> Condition:
    """``[f] =~ "text"``: plain substring; a missing field reads as the empty string."""
    return _test(ref, lambda c: c.contains(F.lit(text)), text == "")


def lacks_text(ref: str, text: str) -> Condition:
    return _test(ref, lambda c: ~c.contains(F.lit(text)), text != "")


def has(value: str, ref: str = "tags") -> Condition:
    """``"v" in [f]``: membership in an array field; anything but an array is false."""

    def build(f: EventFrame) -> Ref:
        if ref == "tags":
            return f.has_tag(value)
        found = f.get(ref)
        if found is None or not found.dtype.startswith("array<"):
            return f.literal(False, "boolean")
        return f.lift(
            lambda c: F.coalesce(F.array_contains(c, value), F.lit(False)), found, dtype="boolean"
        )

    return Condition(build)


def lacks(value: str, ref: str = "tags") -> Condition:
    """``"v" not in [f]``"""
    return ~has(value, ref)


def one_of(ref: str, values: list[str]) -> Condition:
    """``[f] in [...]``"""
    return _test(ref, lambda c: c.isin(*values), False)


def _number(ref: str, fn: Callable[[Column], Column]) -> Condition:
    return _test(ref, lambda c: fn(c.try_cast("double")), False)


def gt(ref: str, value: float) -> Condition:
    return _number(ref, lambda c: c > F.lit(float(value)))


def lt(ref: str, value: float) -> Condition:
    return _number(ref, lambda c: c < F.lit(float(value)))


def ge(ref: str, value: float) -> Condition:
    return _number(ref, lambda c: c >= F.lit(float(value)))


def le(ref: str, value: float) -> Condition:
    return _number(ref, lambda c: c <= F.lit(float(value)))
