"""Benchmark decontamination by winnowing.

A benchmark window is ``span`` consecutive words of an item; an item of fewer words is one window. Texts are cut into runs
of ``k`` words. Of every ``span - k + 1`` consecutive runs the least hash (the last one among equals) is kept: whatever
stands before or after, two texts that share ``span`` words keep the same run of them, so joining the kept runs of
documents and windows misses no shared window. Each joined pair says where in the document the whole window would start;
it is extended there and compared. Windows of short items are joined whole with all runs of that length.

The kept runs of the documents, a few per ten words, meet the windows in a join; the windows are broadcast only if their
number, which is counted, is at most ``broadcast_windows``, else both sides are shuffled by hash. Only hits are grouped.

Cases: null and wordless texts have no words and no hits. Documents of one id may be found through one another, but each
row is compared, counted and returned on its own; a null id is an id of its own. Items without an id make hits, but are
not listed. Repeated items are listed once. Empty documents give no rows, an empty benchmark no hits. Extra columns are
ignored by ``contamination`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import LETTER_WORDS, MIX, batch_hashes, binary, fresh, mixed, owners, slices, written

SPAN = 10
K = 4
BROADCAST_WINDOWS = 500_000


def _runs(flat: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each position on, the last n - 1 positions aside; the length is part of the hash."""
    m = max(len(flat) - n + 1, 0)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out *= MIX
        out += flat[i : i + m]
    return mixed(out)


def _windows(flat: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Starts of all spans that lie within one text."""
    m = max(len(flat) - span + 1, 0)
    return np.flatnonzero(owner[:m] == owner[span - 1 : span - 1 + m])


def _kept(runs: np.ndarray, starts: np.ndarray, span: int, k: int) -> np.ndarray:
    """For each span the position of the run that winnowing keeps."""
    best, at = runs[starts], np.zeros(len(starts), np.int64)
    for j in range(1, span - k + 1):
        here = runs[starts + j]
        better = here <= best
        at[better] = j
        np.minimum(best, here, out=best)
    return starts + at


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def benchmark_windows(items: DataFrame, item_id: str, text: str, span: int, k: int) -> DataFrame:
    """A row per item and window: item_id, witness (the kept run), at (its place in the window), whole (the window), words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                flat, ends = batch_hashes(binary(batch.column("text")), LETTER_WORDS)
                owner, n = owners(ends), np.diff(ends)
                starts = _windows(flat, owner, span)
                runs = _runs(flat, k)
                kept = _kept(runs, starts, span, k)
                item, witness, at, full = [owner[starts]], [runs[kept]], [kept - starts], [_runs(flat, span)[starts]]
                words = [np.full(len(starts), span)]
                for i in np.flatnonzero((n > 0) & (n < span)):
                    own = _runs(flat[ends[i] : ends[i + 1]], int(n[i]))
                    item.append(np.array([i]))
                    witness.append(own)
                    at.append(np.array([0]))
                    full.append(own)
                    words.append(n[i : i + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(np.concatenate(item))), _signed(np.concatenate(witness)), pa.array(np.concatenate(at).astype(np.int32)),
                     _signed(np.concatenate(full)), pa.array(np.concatenate(words).astype(np.int32))],
                    names=["item_id", "witness", "at", "whole", "words"],
                )

    rows = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(cut, "item_id string, witness long, at int, whole long, words int").distinct()


def document_runs(docs: DataFrame, kind: str, span: int, k: int, short: list[int]) -> DataFrame:
    """Runs that winnowing keeps of each document, and all runs of the lengths that short items have: doc_id, witness, pos."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                flat, ends = batch_hashes(binary(batch.column("text")), LETTER_WORDS)
                owner = owners(ends)
                runs = _runs(flat, k)
                kept = np.unique(_kept(runs, _windows(flat, owner, span), span, k))
                found = [(kept, runs[kept])]
                for n in short:
                    starts = _windows(flat, owner, n)
                    found.append((starts, _runs(flat, n)[starts]))
                for at, h in found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(owner[at])), _signed(h), pa.array((at - ends[owner[at]]).astype(np.int32))],
                        names=["doc_id", "witness", "pos"],
                    )

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, witness long, pos int")


def _extended(candidates: DataFrame, kind: str) -> DataFrame:
    """Compares whole windows where they would start: doc_id, n_words, n_hit and the windows found, for each row."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                flat, ends = batch_hashes(binary(batch.column("text")), LETTER_WORDS)
                n_hit, found = [], []
                for i, spots in enumerate(batch.column("spots").to_pylist()):
                    if not spots:
                        n_hit.append(0)
                        found.append([])
                        continue
                    words = flat[ends[i] : ends[i + 1]]
                    edges, seen = np.zeros(len(words) + 1, np.int64), set()
                    start, length = np.array([s["start"] for s in spots]), np.array([s["words"] for s in spots])
                    wanted = np.array([s["whole"] for s in spots], np.int64)
                    for n in np.unique(length):
                        own = _runs(words, int(n)).view(np.int64)
                        m = (length == n) & (start >= 0) & (start < len(own))
                        s, w = start[m], wanted[m]
                        equal = own[s] == w
                        np.add.at(edges, s[equal], 1)
                        np.add.at(edges, s[equal] + n, -1)
                        seen.update(w[equal].tolist())
                    n_hit.append(int((np.cumsum(edges) > 0).sum()))
                    found.append(sorted(seen))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "n_hit", "windows"],
                )

    return candidates.mapInArrow(check, f"doc_id {kind}, n_words long, n_hit long, windows array<long>")


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = SPAN, k: int = K, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit (words inside windows), items (sorted list of item ids), contaminated."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    windows = written(benchmark_windows(benchmark, item_id, item_text, span, k))
    wanted = windows.select("witness", "at", "whole", "words").distinct()
    short = [r.words for r in windows.filter(F.col("words") < span).select("words").distinct().collect()]  # below span values
    small = windows.count() <= broadcast_windows
    sized = F.broadcast if small else lambda df: df
    hits = (
        document_runs(rows, kind, span, k, sorted(short))
        .join(sized(wanted), "witness")
        .select("doc_id", (F.col("pos") - F.col("at")).alias("start"), "whole", "words")
        .groupBy(F.col("doc_id").alias("hit_id"))
        .agg(F.collect_set(F.struct("start", "whole", "words")).alias("spots"))
    )
    candidates = rows.join(hits, rows["doc_id"].eqNullSafe(F.col("hit_id")), "left").select("doc_id", "text", "spots")
    checked = written(_extended(candidates, kind))
    listed = (
        checked.filter(F.size("windows") > 0).select("doc_id", "windows").distinct()
        .withColumn("whole", F.explode("windows"))
        .join(sized(windows.select("whole", "item_id").distinct()), "whole")
        .groupBy(F.col("doc_id").alias("own_id"), F.col("windows").alias("own_windows"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("windows") == F.col("own_windows"))
    return checked.join(listed, same, "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", most_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without the documents of which more than ``most_share`` of the words stand in benchmark windows.

    Of documents with one id, the share is that of the worst.
    """
    judged = contamination(docs, benchmark, doc_id, **options)
    bad_id = fresh(docs.columns, "bad_id")
    bad = judged.filter(F.col("n_hit") > most_share * F.col("n_words")).select(F.col("doc_id").alias(bad_id)).distinct()
    return docs.join(bad, F.col(f"`{doc_id}`").eqNullSafe(F.col(bad_id)), "left_anti")
