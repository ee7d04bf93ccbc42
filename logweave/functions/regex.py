"""Plan-time translation of Ruby/Python-style regular expressions to Java ones."""

from __future__ import annotations

import re

from pyspark.sql import Column

_QUANTIFIER = re.compile(r"\{\d*,?\d*\}")
_PLAIN = re.compile(r"(\^?)([A-Za-z0-9_ /=\"'<>:;,-]+)(\$?)\Z")


def _class_end(regex: str, i: int) -> int:
    """Index after the character class that opens at ``i``, in Java's syntax as ``to_java`` writes it."""
    i += 2 if regex.startswith("[^", i) else 1
    while regex[i] != "]":
        i += 2 if regex[i] == "\\" else 1
    return i + 1


def _group_end(regex: str, i: int) -> tuple[int, bool]:
    """Index after the group that opens at ``i``, and whether it has branches of its own."""
    depth, branches = 0, False
    while True:
        if regex[i] == "\\":
            i += 2
            continue
        if regex[i] == "[":
            i = _class_end(regex, i)
            continue
        depth += {"(": 1, ")": -1}.get(regex[i], 0)
        branches = branches or (regex[i] == "|" and depth == 1)
        i += 1
        if not depth:
            return i, branches


def required_text(regex: str) -> str:
    """The longest text that every match of a Java regex surely contains; empty if none is found."""
    best = run = ""
    i = 0

    def close() -> None:
        nonlocal best, run
        best, run = max(best, run, key=len), ""

    if "(?i" in regex:
        return ""
    while i < len(regex):
        ch = regex[i]
        if ch == "|":
            return ""
        if ch == "(":
            end, branches = _group_end(regex, i)
            inner = regex[i + 3 : end - 1] if regex.startswith("(?:", i) else "" if regex.startswith("(?", i) else regex[i + 1 : end - 1]
            close()
            if inner and not branches and regex[end : end + 1] not in ("?", "*", "{"):
                best = max(best, required_text(inner), key=len)
            i = end
        elif ch == "[":
            close()
            i = _class_end(regex, i)
        elif ch in "*?{":
            run = run[:-1]
            close()
            i = regex.index("}", i) + 1 if ch == "{" else i + 1
        elif ch in ".^$+":
            close()
            i += 1
        elif ch == "\\":
            if regex[i + 1].isalnum():
                close()
            else:
                run += regex[i + 1]
            i += 2
        else:
            run += ch
            i += 1
    close()
    return best


def starts_with_any(regex: str) -> bool:
    """Whether every match of a Java regex begins with ``.*`` or ``.*?``."""
    while regex.startswith(("(?:", "(")) and (regex.startswith("(?:") or not regex.startswith("(?")):
        end, branches = _group_end(regex, 0)
        if branches or _has_branch(regex) or regex[end : end + 1] in ("?", "*", "{"):
            return False
        regex = regex[3 if regex.startswith("(?:") else 1 : end - 1]
    return regex.startswith(".*") and not _has_branch(regex)


def _has_branch(regex: str) -> bool:
    """Whether a Java regex has branches at its top."""
    return _group_end(f"({regex})", 0)[1]


def to_java(pattern: str) -> str:
    """Escape what Java reads differently: a bare ``{``, and ``[`` or ``&&`` inside a class."""
    out: list[str] = []
    i, in_class, class_start = 0, False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append({"Z": r"\z", "h": "[0-9a-fA-F]"}.get(nxt, ch + nxt) if not in_class else ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "[" and pattern.startswith("[:", i) and ":]" in pattern[i:]:
                end = pattern.index(":]", i)
                out.append(r"\p{" + pattern[i + 2 : end].capitalize() + "}")
                i = end + 2
                continue
            if ch == "[" or pattern.startswith("&&", i):
                out.append("\\" + ch)
            elif ch == "]" and i > class_start:
                in_class = False
                out.append(ch)
            elif ch == "]":
                out.append(r"\]")
            else:
                out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
            class_start = i
            continue
        if ch == "{":
            m = _QUANTIFIER.match(pattern, i)
            if m and m.group() not in ("{}", "{,}") and out:
                body = m.group()
                out.append("{0" + body[1:] if body.startswith("{,") else body)
                i = m.end()
                continue
            out.append(r"\{")
            i += 1
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def replacement_to_java(text: str) -> str:
    r"""Turn ``\1`` group references into ``$1`` and protect literal ``$``."""
    text = text.replace("$", r"\$")
    return re.sub(r"\\(\d)", r"$\1", text)


def search(value: Column, pattern: str) -> Column:
    """Unanchored search; a purely literal pattern becomes a plain string test."""
    plain = _PLAIN.match(pattern)
    if plain is None:
        return value.rlike(to_java(pattern))
    start, text, end = plain.groups()
    if start and end:
        return value.isin(text, text + "\n")
    if start:
        return value.startswith(text)
    if end:
        return value.endswith(text) | value.endswith(text + "\n")
    return value.contains(text)
