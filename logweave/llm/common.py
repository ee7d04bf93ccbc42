"""Shared helpers: free column names, bounded slices of Arrow batches, shared intermediate tables, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from logweave.functions.shared import new_folder, removed, shared_table

SLICE_BYTES = 16 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)

LOWER = bytes(range(256)).lower()
SPACE_WORDS = LOWER
"""Byte map for words parted by ASCII white space; bytes.split() does the rest."""
LETTER_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in LOWER)
"""Byte map for words of digits, letters and everything beyond ASCII, lower-cased in A-Z."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], name: str) -> str:
    """A column name like ``name`` that is not taken, whatever the case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the columns added at the end; columns of the same name, in any case, give way."""
    names = {c.lower() for c in columns}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in names]
    return df.select(*kept, *(e.alias(c) for c, e in columns.items()))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; on a cluster, a session without one is an error."""
    return new_folder(spark, "llm")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` from a table in the shared folder: cuts the lineage, survives lost executors.

    The table stays for those who read it; ``removed`` takes away one whose ``path`` is known and that nobody reads any more.
    """
    return shared_table(df, path or shared_dir(df.sparkSession))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``most`` bytes of ``column`` each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system. A Python worker outlives its task, and idles beside the next stages of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim is not None:
        trim(0)


def binary(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def word_hashes(text: bytes | None, words: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order; ``words`` is one of the byte maps above."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.translate(words).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= MIX
        out += hashes[i : i + n]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def batch_hashes(texts: list[bytes | None], words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts in one array, and where each text begins and the last ends in it."""
    found = [t.translate(words).split() if t else [] for t in texts]
    ends = np.cumsum([0, *map(len, found)])
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(found)), np.uint64, int(ends[-1]))
    return flat, ends


def owners(ends: np.ndarray) -> np.ndarray:
    """The number of the text that each element of a batch belongs to."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))
