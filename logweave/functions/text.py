"""Text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.frame import EventFrame, Ref

_FIELD = re.compile(r"%\{([^}]+)\}")


def strip(c: Column) -> Column:
    """Trim white space of every kind from both ends; most texts have none and skip the regex."""
    return F.when(c.rlike(r"^\s|\s$|\n"), F.regexp_replace(c, r"\A\s+|\s+\z", "")).otherwise(c)


def leading_int(c: Column) -> Column:
    """Leading integer of a text, 0 where there is none."""
    return F.coalesce(
        F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")
    )


def template(f: EventFrame, text: str, keep_unresolved: bool = False) -> Ref:
    """Expand ``%{field}`` references. A missing field reads as empty, or stays as it is written."""
    pieces: list[tuple[str, bool]] = []
    at = 0
    for m in _FIELD.finditer(text):
        if m.start() > at:
            pieces.append((text[at : m.start()], False))
        pieces.append((m.group(1), True))
        at = m.end()
    if at < len(text):
        pieces.append((text[at:], False))
    refs: list[Ref] = []
    build: list = []
    for piece, is_field in pieces:
        found = f.text(piece) if is_field else None
        unresolved = "%{" + piece + "}" if keep_unresolved else ""
        if not is_field:
            build.append(lambda cols, p=piece: F.lit(p))
        elif found is None:
            build.append(lambda cols, p=unresolved: F.lit(p))
        else:
            refs.append(found)
            build.append(
                lambda cols, i=len(refs) - 1, p=unresolved: F.coalesce(cols[i], F.lit(p))
            )
    if not build:
        return f.literal("", "string")

    def joined(*cols: Column) -> Column:
        made = [b(cols) for b in build]
        return made[0] if len(made) == 1 else F.concat(*made)

    return f.lift(joined, *refs, dtype="string", cost=2)


def quote_java(text: str) -> str:
    """A regex that matches ``text`` literally."""
    return "".join("\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch for ch in text)
