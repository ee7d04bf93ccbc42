"""Packing by best-fit decreasing into windows of a fixed number of tokens.

Documents become token ids with an end id. A document longer than a window is first cut into full windows; what is left,
a piece, goes to the open window that it fills best. A segment tree over remaining capacities finds that window: its
leaves are the capacities, an inner node holds how many open windows lie below it, so the tightest capacity that is large
enough takes one walk down.

Windows are packed per task: pieces are dealt to tasks by a hash of document and start, so that no source, language or
length gathers in one task, and sorted there by falling length; a task closes its windows after ``block`` pieces, which
bounds its memory. A task that runs again gets the same rows in the same order, so it returns the same windows.

Cases: strings of the tokenizer's added tokens in a text are those tokens, as the tokenizer has it when loaded, unless
``special_as_text`` asks for ordinary text. A null text counts as empty, and an empty text is the end id alone. A null document id is kept as it is. Repeated
rows are packed once each. Ties are broken by document id, start and checksum. An empty table packs to no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import shuffle_partitions, slices

WINDOW = 1024
END_ID = 0
SLICE = 2 << 20
"""Bytes of text that are encoded at once."""
CACHE_CHUNKS = 800_000
CACHE_IDS = 8_000_000
"""Chunks and ids that a Python worker keeps for its later batches and tasks. Beyond that, chunks that only one slice had go, which only costs time."""
BLOCK = 500_000

_UNSAFE = r"\s \s|\s \Z"


class Encoder:
    """Ids of whole texts as unsigned 32-bit numbers.

    The tokenizer splits a text before each space that no white space precedes, or that a visible character follows, so
    texts are cut at single spaces and each distinct chunk is encoded once. Texts with other white space, and those that hold
    an added token, go to it whole.
    The ids of chunks met before are kept, sorted by a 64-bit hash of the chunk. Words recur and most other chunks do not, so what
    a worker keeps between its tasks is thinned out to the chunks that a second slice had.
    """

    def __init__(self, tokenizer_path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsafe = re.compile(_UNSAFE)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.start, self.length, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.met = np.empty(0, bool)

    def _thin_out(self) -> None:
        """Only chunks met again since the last time stay, or none, if that would not free half of the room."""
        stay = np.flatnonzero(self.met)
        length = self.length[stay]
        size = int(length.sum())
        if 2 * len(stay) > CACHE_CHUNKS or 2 * size > CACHE_IDS:
            self._forget()
            return
        begin = np.cumsum(length) - length
        self.ids = self.ids[np.repeat(self.start[stay] - begin, length) + np.arange(size)]
        self.hashes, self.start, self.length, self.met = self.hashes[stay], begin, length, np.zeros(len(stay), bool)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids."""
        counts, ids = [], [np.empty(0, np.uint32)]
        for a in range(0, len(texts), 5_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + 5_000], add_special_tokens=False)]
            counts += map(len, found)
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        return np.array(counts, np.int64), np.concatenate(ids)

    def _lookup(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk, with a space before it, begin in ``self.ids``, and their number."""
        if len(self.hashes) > CACHE_CHUNKS or len(self.ids) > CACHE_IDS:
            self._thin_out()
        names = chunks.to_numpy(zero_copy_only=False).tolist()  # whole words at once, not a Python scalar for each
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(names), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        self.met[at[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            counts, ids = self._encode([" " + names[i] for i in new])
            begin = len(self.ids) + np.cumsum(counts) - counts
            merged = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(merged, kind="stable")
            self.hashes = merged[order]
            self.start, self.length = np.concatenate([self.start, begin])[order], np.concatenate([self.length, counts])[order]
            self.met = np.concatenate([self.met, np.zeros(len(new), bool)])[order]
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.hashes, hashes)
        return self.start[at], self.length[at]

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and where each text's ids end."""
        whole = [self.unsafe.search(t) is not None or any(a in t for a in self.added) for t in texts]
        heads = [t if w else t.partition(" ")[0] for t, w in zip(texts, whole, strict=True)]
        cut = pc.split_pattern(pa.array(["" if w else t for t, w in zip(texts, whole, strict=True)], pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        start, length = self._lookup(coded.dictionary)
        counts, ids = self._encode(heads)
        # a text's first chunk has no space before it; one more chunk at each end stands for the end id
        start = np.concatenate([start, len(self.ids) + np.cumsum(counts) - counts, [len(self.ids) + len(ids)]])
        length = np.concatenate([length, counts, [1]])
        source = np.concatenate([self.ids, ids, np.array([end_id], np.uint32)])
        index = coded.indices.to_numpy().astype(np.int64)
        index[ends[:-1]] = len(coded.dictionary) + np.arange(len(texts))
        index = np.insert(index, ends[1:], len(length) - 1)
        size = length[index]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(start[index] - (upto - size), size)
        at += np.arange(total)
        return source[at], upto[ends[1:] + np.arange(len(texts))]


def kept_encoder(tokenizer_path: str, special_as_text: bool = False) -> Encoder:
    """One encoder for the life of the Python worker, so that its chunks serve later tasks too."""
    kept = sys.modules.setdefault("llm_kept_encoders", types.ModuleType("llm_kept_encoders")).__dict__
    name = f"{tokenizer_path}:{special_as_text}"
    if name not in kept:
        kept[name] = Encoder(tokenizer_path, special_as_text)
    return kept[name]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, special_as_text: bool = False
) -> DataFrame:
    """Pieces of at most ``window`` tokens: doc_id, start, length, doc_tokens, ids (binary, little-endian 32 bits)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = kept_encoder(tokenizer_path, special_as_text)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, ends = encoder.encode([t or "" for t in batch.column("text").to_pylist()], end_id)
                total = np.diff(ends, prepend=0)
                number = -(-total // window)
                row = np.repeat(np.arange(len(total)), number)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * window
                length = np.minimum(window, total[row] - start)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4  # pieces lie one after the other
                held = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(total[row]), held.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


class OpenWindows:
    """Segment tree over the remaining capacities 0..window; node i has the number of open windows below it."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.count = [0] * (2 * self.half)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.half
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, which: int) -> None:
        self.at[capacity].append(which)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out an open window of the least capacity that is ``need`` or more: capacity and window."""
        i, count = need + self.half, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right neighbour holds windows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.half:  # down, to its least leaf
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.half
        which = self.at[capacity].pop()
        self._add(capacity, -1)
        return capacity, which


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; lengths must fall."""
    open_, where, offset, made = OpenWindows(window), [], [], 0
    for n in lengths:
        found = open_.tightest(n)
        if found is None:
            found, made = (window, made), made + 1
        capacity, which = found
        where.append(which)
        offset.append(window - capacity)
        if capacity > n:
            open_.put(capacity - n, which)
    return where, offset


def pack(pieces: DataFrame, window: int = WINDOW, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, start, length, any other columns) with sequence_id and offset."""
    n = partitions or shuffle_partitions(pieces.sparkSession)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rest = [c for c in columns if c not in ("doc_id", "start", "length")]
    dealt = (
        pieces.select(*(F.col(f"`{c}`") for c in columns))
        .repartition(n, F.xxhash64("doc_id", "start"))
        .sortWithinPartitions(F.col("length").desc(), "doc_id", "start", *(F.col(f"`{c}`") for c in rest))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal base
            if not held:
                return
            lengths = [x for b in held for x in b.column("length").to_pylist()]
            where, offset = best_fit(lengths, window)
            at = 0
            for b in held:
                ids = pa.array(np.array(where[at : at + b.num_rows], np.int64) + base)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, ids, pa.array(offset[at : at + b.num_rows], pa.int64())], names=[*b.schema.names, "sequence_id", "offset"]
                )
                at += b.num_rows
            base += max(where) + 1
            held.clear()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= block:
                yield from close()
        yield from close()

    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed_digest(docs: DataFrame, tokenizer_path: str, partitions: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Where every piece of every document lies, with a checksum in place of its ids; the ids themselves do not move."""
    pieces = token_pieces(docs, tokenizer_path, special_as_text=special_as_text)
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(digest, partitions=partitions)


def crc32_of(ids: list[int]) -> int:
    """Checksum of ids as this module states it."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
