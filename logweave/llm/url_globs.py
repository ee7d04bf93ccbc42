"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one Shift-And automaton: every rule owns a run of bits, one for each of its states, and
the runs lie next to each other in words of 64 bits. One step per symbol moves all rules of all URLs of a batch at once.

Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one symbol, anything else itself. A glob must match the
whole canonical URL, which is the host, A-Z lower-cased, followed by the path.

Cases: a null, empty or relative URL (no ``://``) has an empty host and path, so it only meets globs that match the empty
text. Any length is taken: the work is linear in it. Repeated rows are judged alike. Of several rules that match, the
longest (then the first) wins. Columns of the input that have the name of an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import fresh, with_columns

SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
"""Host and path; a rule fits its host and all subdomains, if the path begins with the rule's."""

GLOBS = (
    ("block", "*cheap-pills*"), ("block", "*cheap-pills*/**"), ("block", "*spam-farm*"), ("block", "*spam-farm*/**"),
    ("block", "*casino*"), ("block", "*casino*/**"), ("block", "**.exe"), ("block", "**/ads/**"), ("block", "**/wp-login.php"),
)
"""For URLs without a site rule; what no glob matches is allowed."""


@dataclass(frozen=True)
class Automaton:
    """Masks of the packed globs: ``step[symbol]`` and ``stay[symbol]`` have one row of 64-bit words per symbol class."""

    symbols: np.ndarray
    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    final: list[tuple[int, int]]

    @staticmethod
    def of(globs: list[str]) -> Automaton:
        parsed = [re.findall(r"\*\*+|\*|\?|[^*?]", g, re.DOTALL) for g in globs]
        literal = sorted({ord(t) for p in parsed for t in p if t[0] not in "*?"} | {ord("/")})
        symbols = np.array(literal, np.uint32)
        classes = len(literal) + 1  # the last class: every symbol that no rule names
        slash = literal.index(ord("/"))
        bits = sum(1 + sum(t[0] != "*" for t in p) for p in parsed)
        words = max(1, -(-bits // 64))
        step, stay = np.zeros((classes, words), np.uint64), np.zeros((classes, words), np.uint64)
        start, final, at = np.zeros(words, np.uint64), [], 0

        def put(mask: np.ndarray, rows, bit: int) -> None:
            mask[rows, bit // 64] |= np.uint64(1 << (bit % 64))

        for p in parsed:
            start[at // 64] |= np.uint64(1 << (at % 64))
            for t in p:
                if t[0] == "*":
                    put(stay, slice(None) if len(t) > 1 else [c for c in range(classes) if c != slash], at)
                else:
                    at += 1
                    put(step, slice(None) if t == "?" else literal.index(ord(t)), at)
            final.append((at // 64, at % 64))
            at += 1
        return Automaton(symbols, step, stay, start, final)

    def matches(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        n = len(texts)
        coded = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        length = np.fromiter(map(len, coded), np.int64, n)
        order = np.argsort(-length, kind="stable")
        flat = np.concatenate([coded[i] for i in order]) if n else np.empty(0, np.uint32)
        found = np.searchsorted(self.symbols, flat)
        known = (found < len(self.symbols)) & (self.symbols[np.minimum(found, len(self.symbols) - 1)] == flat)
        flat = np.where(known, found, len(self.symbols)).astype(np.int32)
        begin = np.concatenate([[0], np.cumsum(length[order])])
        lengths = length[order]
        state = np.tile(self.start, (n, 1))
        active = n
        for t in range(int(lengths[0]) if n else 0):
            active = int(np.searchsorted(-lengths[:active], -t, side="left"))  # texts longer than t
            symbol, now = flat[begin[:active] + t], state[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[symbol]) | (now & self.stay[symbol])
        out = np.empty((n, len(self.final)), bool)
        for g, (word, bit) in enumerate(self.final):
            out[order, g] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    host, tail = (rest, "") if cut is None else (rest[: cut.start()], rest[cut.start() :])
    path = re.split(r"[?#]", tail, maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def judge_urls(
    df: DataFrame,
    url: str = "url",
    site_rules: tuple[tuple[str, str], ...] = SITE_RULES,
    globs: tuple[tuple[str, str], ...] = GLOBS,
    default: str = "allow",
) -> DataFrame:
    """``df`` with host, path, rule (the site rule that decided, else null), pattern (the glob that did, else null) and verdict."""
    patterns, owner = [], []
    for i, (_, site) in enumerate(site_rules):
        patterns += [f"{site}**", f"*.{site}**"]
        owner += [i, i]
    automaton = Automaton.of(patterns + [g for _, g in globs])
    by_length = sorted(range(len(site_rules)), key=lambda i: (-len(site_rules[i][1]), i))
    of_rule = {i: [c for c, o in enumerate(owner) if o == i] for i in by_length}
    glob_order = sorted(range(len(globs)), key=lambda i: (-len(globs[i][1]), i))

    @F.pandas_udf("host string, path string, rule string, pattern string, verdict string")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in parts:
            cut = [split_url(u if isinstance(u, str) else None) for u in urls]
            hit = automaton.matches([h + p for h, p in cut])
            rule, glob = np.full(len(cut), None, object), np.full(len(cut), None, object)
            verdict = np.full(len(cut), default, object)
            for i in reversed(glob_order):
                m = hit[:, len(owner) + i]
                glob[m], verdict[m] = globs[i][1], globs[i][0]
            for i in reversed(by_length):
                m = hit[:, of_rule[i]].any(axis=1)
                rule[m], verdict[m] = site_rules[i][1], site_rules[i][0]
            glob[rule != None] = None  # noqa: E711
            yield pd.DataFrame({"host": [h for h, _ in cut], "path": [p for _, p in cut], "rule": rule, "pattern": glob, "verdict": verdict}, dtype=object)

    tmp = fresh(df.columns, "judged")
    out = df.withColumn(tmp, judged(F.col(f"`{url}`")))
    return with_columns(out, {c: F.col(f"{tmp}.{c}") for c in ("host", "path", "rule", "pattern", "verdict")}).drop(tmp)
