"""Counts of a text that quality rules and classifiers start from, for whole batches at a time.

Words are runs without ASCII white space. A null text counts as empty; an empty text has zeros throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logweave.llm.common import MIX, binary, grams, owners, slices

SYMBOLS = b"#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_upper", "n_digits", "n_bangs", "n_stops", "n_commas", "n_upper_words", "n_short_words",
)
_DELETED = {
    "n_symbols": SYMBOLS, "n_upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_digits": b"0123456789", "n_bangs": b"!?", "n_stops": b".", "n_commas": b",;:",
}
_SPACE_AND_CONTINUED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))


def repeated_words(flat: np.ndarray, ends: np.ndarray, n: int = 3) -> np.ndarray:
    """For each text the number of words in n-word windows that the text has twice or more."""
    owner = owners(ends)
    runs = grams(flat, n)
    if not len(runs):
        return np.zeros(len(ends) - 1, np.int64)
    starts = np.flatnonzero(owner[: len(runs)] == owner[n - 1 :])
    keyed = (runs[starts] ^ (owner[starts].astype(np.uint64) + np.uint64(1)) * MIX)
    order = np.argsort(keyed, kind="stable")
    ranked = keyed[order]
    same = np.zeros(len(ranked), bool)
    if len(ranked) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    edges = np.zeros(len(flat) + 1, np.int64)
    twice = starts[order[same]]
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + n, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(ends) - 1)


def distinct_words(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    owner = owners(ends)
    order = np.lexsort((flat, owner))
    a, o = flat[order], owner[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(ends) - 1)


def text_counts(texts: list[bytes | None], names: tuple[str, ...] = COUNTS) -> dict[str, np.ndarray]:
    """The counts named, as arrays of 64-bit integers."""
    n, want = len(texts), set(names)
    out = {c: np.zeros(n, np.int64) for c in names}
    found = [t.split() if t else [] for t in texts]
    ends = np.cumsum([0, *map(len, found)])
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(found)), np.uint64, int(ends[-1]))
    out["n_words"] = np.diff(ends)
    deleted = [(c, chars) for c, chars in _DELETED.items() if c in want]
    for i, t in enumerate(texts):
        if not t:
            continue
        if "word_chars" in want:  # code points: bytes that do not continue a character
            out["word_chars"][i] = len(t.translate(None, _SPACE_AND_CONTINUED))
        for c, chars in deleted:
            out[c][i] = len(t) - len(t.translate(None, chars))
        if "n_lines" in want or "n_dup_lines" in want:
            lines = [x for x in t.split(b"\n") if x.strip()]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
        if "n_upper_words" in want:
            out["n_upper_words"][i] = sum(map(bytes.isupper, found[i]))
    if "n_short_words" in want:
        lengths = np.fromiter(map(len, chain.from_iterable(found)), np.int64, int(ends[-1]))
        out["n_short_words"] = np.bincount(owners(ends)[lengths <= 3], minlength=n)
    if "n_repeat_words" in want:
        out["n_repeat_words"] = repeated_words(flat, ends)
    if "n_distinct_words" in want:
        out["n_distinct_words"] = distinct_words(flat, ends)
    return {c: out[c] for c in names}


def counted(docs: DataFrame, text: str, names: tuple[str, ...] = COUNTS) -> DataFrame:
    """``docs`` with the counts in place of the text; columns of the names of counts give way."""
    others = [c for c in docs.columns if c != text and c not in names]
    schema = StructType([*(docs.schema[c] for c in others), *(StructField(c, LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                counts = text_counts(binary(batch.column(text)), names)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *map(pa.array, counts.values())], names=[*others, *names])

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, schema)
