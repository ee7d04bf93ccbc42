"""N-gram Jaccard join: documents whose sets of word shingles reach a Jaccard similarity, as classes of linked documents.

1. Every text becomes a set of shingle hashes. Texts with equal sets are one class from here on.
2. Shingles are dealt to buckets by hash and counted there. Linked documents share at least 80 of 100 shingles of either, so
   a document of which fewer stand in some other document has no link. Most documents end here. Bucket rows hold the
   shingles of a whole slice of documents, so common shingles weigh on a bucket no more than rare ones.
3. Sets of what is left are counted once more among themselves, exactly. With shingles ordered from rare to common, linked
   documents share one of the first 20 of 100 (prefix filter); documents that share such a shingle are put together. The
   connected groups of that relation are the units of work, and no link leaves its unit. A unit above ``unit_shingles`` is cut
   into blocks, and every pair of blocks becomes a unit.
4. In a unit, every document searches the others by T-occurrence with DivideSkip: of the inverted lists of its shingles the
   longest are set aside, the short ones are merged by a heap (by counting, when they hold many entries), and documents
   found often enough are looked up in the long lists by binary search, until they reach the overlap or cannot any more.
   Documents already in the searcher's component are passed over, so a unit returns a spanning forest of its links, never
   all pairs.
5. Components of those links give the result. Every link between different sets was found or is implied by a path of links.

Cases: a null, empty or wordless text has an empty set and no link. A text of fewer words than a shingle is one shingle.
Rows without an id get their own set size and no component. Repeated rows are equal sets; rows of one id with different
texts are judged on their own. Ties in size and count are broken by hash. An empty table gives no rows. Extra columns are
ignored by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import SPACE_WORDS, batch_hashes, binary, fresh, give_back, grams, shuffle_partitions, slices, written
from logweave.llm.graph import components

WORDS = 5
SIMILARITY = 80
"""Per cent of the union that the intersection must have."""
UNIT_SHINGLES = 1_500_000
SLICE = 1 << 20
HOT_SETS = 1000
"""Sets of which at least one in so many documents is a copy are not dealt by their set; there are no more of them than that."""
MERGE_BY_HEAP = 64
MU = 0.0085
"""DivideSkip's constant: how many long lists to set aside for a threshold and a longest list."""


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of n words of each text."""
    flat, ends = batch_hashes(texts, SPACE_WORDS)
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(grams(flat[a:b], n)))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[a:b].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _dealt(sets: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """For each bucket: how many shingles each set has there, and their low 32 bits."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket * len(sets) + owner, minlength=buckets * len(sets)).reshape(buckets, len(sets)).astype("<u4")
    low = flat[order].astype("<u4")
    ends = np.cumsum(counts.sum(axis=1))
    for b in range(buckets):
        if counts[b].any():
            yield b, counts[b].tobytes() + low[ends[b] - int(counts[b].sum()) : ends[b]].tobytes()


_DEALT = "bucket int, slice long, documents int, payload binary, ids array<{kind}>, sizes array<int>, keys array<binary>"


def _deal(docs: DataFrame, kind: str, buckets: int, n: int) -> DataFrame:
    """Rows of shingles for the buckets, and a directory row for each slice of documents, which goes to any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(binary(batch.column("text")), n)
                rows = list(_dealt(sets, buckets))
                m = len(rows)
                kinds = batch.schema.field("doc_id").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows] + [buckets + at % buckets], pa.int32()), pa.array([at] * (m + 1), pa.int64()),
                     pa.array([len(sets)] * (m + 1), pa.int32()), pa.array([p for _, p in rows] + [None], pa.binary()),
                     pa.array([None] * m + [batch.column("doc_id").to_pylist()], pa.list_(kinds)),
                     pa.array([None] * m + [[len(s) for s in sets]], pa.list_(pa.int32())),
                     pa.array([None] * m + [[set_key(s) if len(s) else None for s in sets]], pa.list_(pa.binary()))],
                    names=["bucket", "slice", "documents", "payload", "ids", "sizes", "keys"],
                )
                at += 1

    return docs.mapInArrow(run, _DEALT.format(kind=kind))


def _count_shared(group: pa.Table) -> pa.Table:
    """For each slice of a bucket, how many shingles of each document stand in another document too."""
    payloads, documents = group.column("payload").to_pylist(), group.column("documents").to_pylist()
    held = [i for i, p in enumerate(payloads) if p is not None]
    low = [np.frombuffer(payloads[i], "<u4")[documents[i] :] for i in held]
    if held:
        flat = np.concatenate(low)
        _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[place] > 1
        at = 0
        for i, own in zip(held, low, strict=True):
            owner = np.repeat(np.arange(documents[i]), np.frombuffer(payloads[i], "<u4")[: documents[i]])
            payloads[i] = np.bincount(owner[shared[at : at + len(own)]], minlength=documents[i]).astype("<u4").tobytes()
            at += len(own)
    del low
    give_back()
    return group.set_column(group.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary()))


def _gather(group: pa.Table) -> pa.Table:
    """The documents of a slice with their number of shared shingles."""
    documents = group.column("documents")[0].as_py()
    shared = np.zeros(documents, np.int64)
    directory = None
    for i, payload in enumerate(group.column("payload").to_pylist()):
        if payload is None:
            directory = i
        else:
            shared += np.frombuffer(payload, "<u4")
    row = group.slice(directory, 1)
    return pa.table(
        [row.column("ids").combine_chunks().flatten(), row.column("sizes").combine_chunks().flatten().cast(pa.int64()),
         row.column("keys").combine_chunks().flatten(), pa.array(shared)],
        names=["doc_id", "n", "key", "shared"],
    )


def signatures(docs: DataFrame, kind: str, n: int = WORDS, buckets: int | None = None) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n, key (of its set; null if empty), shared (shingles that others have too)."""
    buckets = buckets or max(64, shuffle_partitions(docs.sparkSession))
    dealt = _deal(docs, kind, buckets, n)
    counted = dealt.groupBy("bucket").applyInArrow(_count_shared, dealt.schema)
    return counted.groupBy("slice").applyInArrow(_gather, f"doc_id {kind}, n long, key binary, shared long")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """no (a number of its own), key, n and shingles of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = [s for s in shingle_sets(binary(batch.column("text")), n) if len(s)]
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + np.arange(len(sets))), pa.array([set_key(s) for s in sets], pa.binary()), pa.array(size), held],
                    names=["no", "key", "n", "shingles"],
                )
                at += len(sets)

    return docs.select("text").mapInArrow(run, "no long, key binary, n long, shingles array<long>")


def _least_overlap(n, m):
    """Shingles that sets of n and m must share: 100 * o >= SIMILARITY * (n + m - o)."""
    return -(-SIMILARITY * (n + m) // (100 + SIMILARITY))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The numbers of each row of a list column."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _deal_again(sets: DataFrame, buckets: int) -> DataFrame:
    """As ``_deal``, for whole shingles of numbered sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                own = _lists(part.column("shingles"))
                flat = np.concatenate(own)
                owner = np.repeat(np.arange(len(own)), [len(s) for s in own])
                bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows] + [buckets + at % buckets], pa.int32()), pa.array([at] * (len(rows) + 1), pa.int64()),
                     pa.array([owner[o].astype("<u4").tobytes() for _, o in rows] + [None], pa.binary()),
                     pa.array([flat[o].tobytes() for _, o in rows] + [None], pa.binary()),
                     pa.array([None] * len(rows) + [part.column("no").to_pylist()], pa.list_(pa.int64()))],
                    names=["bucket", "slice", "owners", "payload", "numbers"],
                )
                at += 1

    return sets.select("no", "shingles").mapInArrow(run, "bucket int, slice long, owners binary, payload binary, numbers array<long>")


def _frequencies(group: pa.Table) -> pa.Table:
    """How many sets of the whole table have each shingle of a bucket, after the shingles themselves."""
    payloads = group.column("payload").to_pylist()
    held = [i for i, p in enumerate(payloads) if p is not None]
    if held:
        own = [np.frombuffer(payloads[i], np.uint64) for i in held]
        _, place, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        df = count[place].astype("<u4")
        at = 0
        for i, o in zip(held, own, strict=True):
            payloads[i] += df[at : at + len(o)].tobytes()
            at += len(o)
        del own, place, count, df
    give_back()
    return group.set_column(group.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary()))


def _rare(group: pa.Table) -> pa.Table:
    """For the sets of a slice the rare shingles by which they meet others."""
    owners, shingles, dfs, numbers = [], [], [], []
    for o, p, n in zip(*(group.column(c).to_pylist() for c in ("owners", "payload", "numbers")), strict=True):
        if p is None:
            numbers = n
            continue
        owners.append(np.frombuffer(o, "<u4"))
        shingles.append(np.frombuffer(p[: 8 * len(owners[-1])], np.uint64))
        dfs.append(np.frombuffer(p[8 * len(owners[-1]) :], "<u4"))
    owner, shingle, df = (np.concatenate(x) for x in (owners, shingles, dfs))
    order = np.lexsort((shingle, df, owner))
    owner, shingle, df = owner[order], shingle[order], df[order]
    size = np.bincount(owner, minlength=len(numbers))
    rank = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    least = -(-SIMILARITY * size // 100)  # of either set, so many must be shared
    shared = np.bincount(owner[df > 1], minlength=len(numbers))
    meet = (df > 1) & (rank <= (size - least)[owner]) & (shared >= least)[owner]
    return pa.table([pa.array(np.array(numbers, np.int64)[owner[meet]]), pa.array(shingle[meet].view(np.int64))], names=["no", "shingle"])


def _units(sets: DataFrame, most: int) -> DataFrame:
    """Sets with the unit of work they belong to; those that can have no link are gone."""
    buckets = max(64, shuffle_partitions(sets.sparkSession))
    dealt = _deal_again(sets, buckets)
    counted = dealt.groupBy("bucket").applyInArrow(_frequencies, dealt.schema)
    rare = written(counted.groupBy("slice").applyInArrow(_rare, "no long, shingle long"))
    hubs = rare.groupBy(F.col("shingle").alias("s")).agg(F.min("no").alias("hub"))
    near = rare.join(hubs, rare["shingle"] == hubs["s"]).filter("no != hub").select(F.col("no").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(near)
    sizes = sets.select("no", "n").join(groups, F.col("no") == F.col("node")).groupBy(F.col("component").alias("c")).agg(F.ceil(F.sum("n") / most).alias("blocks"))
    placed = groups.join(sizes, groups["component"] == sizes["c"]).select("node", "component", "blocks")  # numbers only; the sets meet their units by their own
    block = F.pmod(F.xxhash64("no"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    return (
        sets.join(placed, sets["no"] == placed["node"]).withColumn("block", block)
        .select("component", "no", "n", "shingles", "block", F.explode(pairs).alias("unit"))
        .select("component", "unit.i", "unit.j", "no", "n", "shingles", "block")
    )


def _merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that stand in ``least`` of the lists at least, and in how many."""
    total = sum(map(len, lists))
    if total <= MERGE_BY_HEAP:
        found, last, times = [], -1, 0
        for d in heapq.merge(*(x.tolist() for x in lists)):
            if d != last:
                if times >= least:
                    found.append((last, times))
                last, times = d, 0
            times += 1
        if times >= least:
            found.append((last, times))
        return np.array([d for d, _ in found], np.int64), np.array([t for _, t in found], np.int64)
    docs, times = np.unique(np.concatenate(lists), return_counts=True)
    return docs[times >= least], times[times >= least]


def unit_links(no: np.ndarray, sets: list[np.ndarray], block: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; where there are two blocks, between sets of different blocks."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.lexsort((no, n))
    no, block, n = no[order], block[order], n[order]
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(n)), n)
    _, token = np.unique(flat, return_inverse=True)
    ranked = np.argsort(token, kind="stable")
    postings = owner[ranked]  # lists of documents, in order of size
    list_end = np.cumsum(np.bincount(token))
    place = np.empty(len(flat), np.int64)
    place[ranked] = np.arange(len(flat))
    after, end = place + 1, list_end[token]
    begin = np.cumsum(n) - n
    across = len(np.unique(block)) > 1
    component, members, out = np.arange(len(n)), {}, []
    for a in range(len(n) - 1):
        least = int(_least_overlap(n[a], n[a]))  # of a set that is as large or larger
        own = slice(begin[a], begin[a] + n[a])
        starts, lengths = after[own], end[own] - after[own]
        if np.count_nonzero(lengths) < least:
            continue
        by_length = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[by_length], lengths[by_length]
        longest = int(lengths[0])
        aside = min(least - 1, int(least / (MU * np.log2(max(longest, 2)) + 1)))
        lists = [postings[s : s + m] for s, m in zip(starts.tolist(), lengths.tolist(), strict=True) if m]
        short, long = lists[aside:], lists[:aside][::-1]
        found, times = _merged(short, least - aside) if short else (np.empty(0, np.int64),) * 2
        limit = np.searchsorted(n, n[a] * 100 // SIMILARITY, side="right")
        fit = (found < limit) & (component[found] != component[a])
        if across:
            fit &= block[found] != block[a]
        found, times = found[fit], times[fit]
        need = _least_overlap(n[a], n[found])
        for left, held in zip(range(len(long), 0, -1), long, strict=True):
            alive = times + left >= need
            if not alive.all():
                found, times, need = found[alive], times[alive], need[alive]
            if not len(found):
                break
            at = np.searchsorted(held, found)
            times = times + ((at < len(held)) & (held[np.minimum(at, len(held) - 1)] == found))
        for b in found[times >= need].tolist():
            if component[b] != component[a]:
                out.append((int(no[a]), int(no[b])))
                large, small = int(component[a]), int(component[b])
                if len(members.get(small, ())) > len(members.get(large, ())):
                    large, small = small, large
                moved = members.pop(small, [small])
                component[moved] = large
                members.setdefault(large, [large]).extend(moved)
    return out


def _unit(group: pa.Table) -> pa.Table:
    sets = [s for chunk in group.column("shingles").chunks for s in _lists(chunk)]
    found = unit_links(group.column("no").to_numpy(), sets, group.column("block").to_numpy())
    give_back()
    return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, unit_shingles: int = UNIT_SHINGLES, buckets: int | None = None
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the least doc_id that links reach), set_key (null: empty)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = written(signatures(rows, kind, words, buckets))
    classes = marks.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("shared").alias("shared"), F.count("*").alias("copies"))
    classes = written(classes)
    maybe = classes.filter(F.col("shared") * 100 >= SIMILARITY * F.col("n")).select(F.col("rep").alias("maybe")).distinct()
    # by shuffle at every size: the list of survivors grows with the table
    left = rows.join(maybe.hint("merge"), rows["doc_id"] == maybe["maybe"], "left_semi")
    sets = written(_sets(left, words))
    links = _units(sets, unit_shingles).groupBy("component", "i", "j").applyInArrow(_unit, "a long, b long")
    found = components(links)
    named = sets.select("no", "key").join(found, F.col("no") == F.col("node")).join(classes.select(F.col("key").alias("k"), "rep"), F.col("key") == F.col("k"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "component").select(F.col("key").alias("k"), "component_id").distinct()
    of_class = classes.select(F.col("key").alias("c"), "rep", "copies").join(labels, F.col("c") == F.col("k"), "left")
    of_class = of_class.select("c", "copies", F.coalesce("component_id", "rep").alias("found"))
    return _named(marks, of_class).select("doc_id", F.col("n").alias("n_shingles"), F.col("own").alias("component_id"), F.col("key").alias("set_key"))


def _named(marks: DataFrame, of_class: DataFrame) -> DataFrame:
    """``marks`` with the class's smallest document in ``own``; ``of_class`` has a row (c, copies, found) for each set.

    Sets that more than a thousandth of all documents have, a thousand at most, are broadcast; those documents, and the
    ones without a set, stay where they are. Only the others are dealt by their set.
    """
    total = of_class.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(of_class.filter(F.col("copies") * HOT_SETS > total).select("c", "found"))
    held = marks.filter("key IS NOT NULL")
    of_hot = held.join(hot, held["key"] == hot["c"])
    others = held.join(hot, held["key"] == hot["c"], "left_anti")
    of_others = others.join(of_class.select("c", "found"), others["key"] == F.col("c"), "left")
    empty = marks.filter("key IS NULL").withColumn("found", F.lit(None).cast(marks.schema["doc_id"].dataType))
    columns = ["doc_id", "n", "key", "found"]
    joined = of_hot.select(columns).union(of_others.select(columns)).union(empty.select(columns))
    return joined.withColumn("own", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Of each class of linked documents the one with the least id; rows without an id stay, repeated rows become one."""
    found = near_duplicates(docs, doc_id, text, **options)
    gone_id = fresh(docs.columns, "gone_id")
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    kept = docs.join(gone, F.col(f"`{doc_id}`") == F.col(gone_id), "left_anti")
    return kept.dropDuplicates([doc_id, text])
