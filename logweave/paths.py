"""Field paths: ``[a][b][c]`` or ``a.b.c`` name one leaf, held as one flat column ``a.b.c``."""

from __future__ import annotations

import re

_BRACKET = re.compile(r"\[([^\]]+)\]")


def parts(ref: str) -> list[str]:
    """Split a reference into its path parts."""
    if "[" in ref:
        return _BRACKET.findall(ref)
    return ref.split(".")


def leaf(ref: str) -> str:
    """Flat column name of a reference."""
    return ".".join(parts(ref))


def bracketed(ref: str) -> str:
    """Bracket form of a reference, as shown in audit records; top-level names stay bare."""
    names = parts(ref)
    return names[0] if len(names) == 1 else "".join(f"[{n}]" for n in names)


def quoted(name: str) -> str:
    """Backtick-quoted column name, safe for names holding dots."""
    return "`" + name.replace("`", "``") + "`"
