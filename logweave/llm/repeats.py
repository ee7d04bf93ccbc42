"""Suffix-array dedup: bytes covered by long strings that also start in a document with a smaller id are removed.

1. Every 50-byte window of a text has an anchor, the run of ``K`` bytes with the least hash in it, the first among equals.
   Equal windows have equal anchors, so only windows of one anchor need comparing. Neighbouring windows mostly share their
   anchor; together they are a piece of less than 100 bytes.
2. Hashes of anchors and 128-bit digests of the bytes of pieces are dealt to buckets, many documents to a row. A piece that
   stands in a document with a smaller id is removed whole. Anchors that only one document has are done with. What is left
   are first occurrences of pieces whose anchor stands in other surroundings in other documents: the edges of repeated
   passages.
3. Those pieces, with their bytes, are indexed bucket by bucket. The multi-document Burrows-Wheeler transform is built
   column by column (Bauer, Cox and Rosone 2013): each round inserts, for every piece, the suffix that is one symbol longer; the
   transform and the suffixes' places are updated in one sequential pass over the round before. The common prefixes of
   neighbours are counted after the last round: kept up to date in every round they took two thirds of the time. Where
   neighbours share 50 bytes they form an interval; windows in it go if it holds a smaller id.
4. Removed windows return to their documents as spans.

A bucket holds a bounded share of all anchors, whatever the texts. An anchor with more than ``HOT_PIECES`` different pieces
(the edge of a passage that a great many documents hold) is not indexed in one bucket: its windows are spread by their
bytes and compared by a grouped minimum instead, which finds the same. The streams that a round reads and writes stay in the
task's memory, as executors' own disks are not to be used. Text is shuffled twice, to meet the answers of steps 2 and 3.

Cases: a null text counts as empty; texts under 50 bytes lose nothing. Ids must be integers. Rows of one id never remove
from each other, and repeated rows lose the same. Rows without an id neither lose nor take anything. Empty tables give no
rows. Extra columns are ignored by ``repeated_spans`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from logweave.llm.common import binary, give_back, mixed, shuffle_partitions, slices, written

SPAN = 50
K = 24
SLICE = 1 << 19
_BYTE = np.random.default_rng(50).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of ``K`` bytes from each position on, to choose anchors by; positions that reach beyond the end hold anything."""
    n = len(b)

    def join(left: np.ndarray, right: np.ndarray, at: int, odd: np.uint64) -> np.ndarray:
        out = left * odd
        out[: n - at] += right[at:]
        return out

    h1 = _BYTE[b]
    h2 = join(h1, h1, 1, _ODD[0])
    h4 = join(h2, h2, 2, _ODD[1])
    h8 = join(h4, h4, 4, _ODD[2])
    h16 = join(h8, h8, 8, _ODD[3])
    return mixed(join(h16, h8, 16, _ODD[4]))


def _first_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each position the distance to the first least of the ``width`` values from there on."""
    n = len(h)
    value, at, have = h.copy(), np.zeros(n, np.uint8), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:]
        smaller = right < value[: n - step]
        moved = at[step:] + np.uint8(step)
        at = at.copy()
        np.copyto(at[: n - step], moved, where=smaller)
        value = value.copy()
        np.copyto(value[: n - step], right, where=smaller)
        have += step
    return at


def pieces(texts: list[bytes], digests: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last window (from the document's start), anchor's place in the piece, anchor hash and digest.

    The digest is of all bytes of the piece, 128 bits as a row of four numbers; without ``digests`` there are no rows.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    kind = np.int32 if size.sum() < 1 << 31 else np.int64
    joined = b"".join(texts) + bytes(2 * SPAN)
    anchor = _hashes(np.frombuffer(joined, np.uint8))
    windows = np.maximum(size - SPAN + 1, 0)
    doc = np.repeat(np.arange(len(texts), dtype=kind), windows)
    at = np.arange(len(doc), dtype=kind) + np.repeat((begin - np.cumsum(windows) + windows).astype(kind), windows)
    place = at + _first_least(anchor, SPAN - K + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    f, l, p = at[first].astype(np.int64), at[last].astype(np.int64), place[first].astype(np.int64)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(joined[s:e]) for s, e in zip(f.tolist(), (l + SPAN).tolist(), strict=True)]) if digests else b""
    return doc[first], f - begin[doc[first]], l - begin[doc[first]], p - f, anchor[p], np.frombuffer(raw, "<u4").reshape(-1, 4)


def _bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of an anchor. Anchors are least hashes, so small ones are the rule: mixed again, they spread evenly."""
    return ((mixed(anchor) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_GONE, _ASK = 1, 2
_SEVERAL = -1 << 63
_STEPS = (0, 7, 13, 20, SPAN - K)
_SIDES = [(left, SPAN - K - more) for left, more in zip(_STEPS, _STEPS[1:], strict=False)]
"""Bytes on the left and on the right of an anchor: a window with any split of the rest has one of these pairs."""


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 0 and above in as few bytes each as all of them fit in, that width first."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind.newbyteorder("<")).tobytes()


def _unpacked(payload: bytes, count: int, at: int = 0) -> tuple[np.ndarray, int]:
    """``count`` numbers from ``at`` on, and where they end."""
    return np.frombuffer(payload, f"<u{payload[at]}", count, at + 1), at + 1 + count * payload[at]


def _deal(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of anchors and pieces for the buckets, and a directory row for each slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                doc, _, _, _, anchor, piece = pieces([t or b"" for t in binary(batch.column("text"))])
                bucket = _bucket_of(anchor, buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                entries = np.concatenate([anchor[order].astype("<u4")[:, None], piece[order]], axis=1)
                ids = batch.column("doc_id").to_numpy().astype("<i8")
                named = ids.min().tobytes() + _packed((ids - ids.min()).view(np.uint64))
                rows = []
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    counts = np.bincount(doc[order[ends[b] : ends[b + 1]]], minlength=len(ids))
                    rows.append((b, named + _packed(counts) + entries[ends[b] : ends[b + 1]].tobytes()))
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in rows] + [buckets + at % buckets], pa.int32()), pa.array([at] * (m + 1), pa.int64()),
                     pa.array([len(ids)] * (m + 1), pa.int32()), pa.array([p for _, p in rows] + [None], pa.binary()),
                     pa.array([None] * m + [ids.tolist()], pa.list_(pa.int64())),
                     pa.array([None] * m + [batch.column("row").to_pylist()], pa.list_(pa.int64()))],
                    names=["bucket", "slice", "documents", "payload", "ids", "rows"],
                )
                at += 1

    return docs.mapInArrow(run, "bucket int, slice long, documents int, payload binary, ids array<long>, rows array<long>")


def _opened(payload: bytes, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, number of entries of each document, and entries."""
    above, at = _unpacked(payload, documents, 8)
    counts, at = _unpacked(payload, documents, at)
    return above.astype(np.uint64).view(np.int64) + np.frombuffer(payload, "<i8", 1), counts, np.frombuffer(payload, "<u4", offset=at).reshape(-1, 5)


def _judge(group: pa.Table) -> pa.Table:
    """A code for each entry of a bucket: gone with its piece, to be asked for its bytes, or neither."""
    payloads, documents = group.column("payload").to_pylist(), group.column("documents").to_pylist()
    held = [i for i, p in enumerate(payloads) if p is not None]
    if held:
        opened = [_opened(payloads[i], documents[i]) for i in held]
        doc = np.concatenate([np.repeat(ids, counts) for ids, counts, _ in opened])
        entries = np.concatenate([e for _, _, e in opened])
        key = entries[:, 0].astype(np.uint64) << np.uint64(32) | entries[:, 1]
        middle, rest = entries[:, 2].astype(np.uint64) << np.uint64(32) | entries[:, 3], entries[:, 4]
        order = np.lexsort((doc, rest, middle, key))
        key, middle, rest, d = key[order], middle[order], rest[order], doc[order]
        new_piece, new_anchor = np.ones(len(key), bool), np.ones(len(key), bool)
        new_piece[1:] = (key[1:] != key[:-1]) | (middle[1:] != middle[:-1]) | (rest[1:] != rest[:-1])
        new_anchor[1:] = key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)
        starts = np.flatnonzero(new_anchor)
        of_piece, of_anchor = np.cumsum(new_piece) - 1, np.cumsum(new_anchor) - 1
        first = d[new_piece][of_piece]
        several = np.bincount(of_anchor[new_piece])[of_anchor] > 1
        shared = (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts))[of_anchor]
        code = np.empty(len(key), np.uint8)
        code[order] = np.where(d > first, _GONE, np.where(several & shared, _ASK, 0))
        at = 0
        for i, (_, counts, own) in zip(held, opened, strict=True):
            payloads[i] = _packed(counts) + code[at : at + len(own)].tobytes()
            at += len(own)
        del opened, doc, entries, key, middle, rest, order, d, first, code
    give_back()
    return group.set_column(group.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary()))


def _gather(group: pa.Table) -> pa.Table:
    """Codes of each document of a slice that has any, bucket after bucket."""
    owners, codes, ids, rows = [], [], [], []
    table = group.select(["bucket", "documents", "payload", "ids", "rows"]).to_pylist()
    for r in sorted(table, key=lambda r: r["bucket"]):
        if r["payload"] is None:
            ids, rows = r["ids"], r["rows"]
            continue
        counts, at = _unpacked(r["payload"], r["documents"])
        owners.append(np.repeat(np.arange(len(counts)), counts))
        codes.append(np.frombuffer(r["payload"], np.uint8, offset=at))
    owner = np.concatenate([np.empty(0, np.int64), *owners])
    code = np.concatenate([np.empty(0, np.uint8), *codes])
    order = np.argsort(owner, kind="stable")
    code, ends = code[order], np.searchsorted(owner[order], np.arange(len(ids) + 1))
    own = [(i, code[a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if code[a:b].any()]
    return pa.table(
        [pa.array([ids[i] for i, _ in own], pa.int64()), pa.array([rows[i] for i, _ in own], pa.int64()), pa.array([c.tobytes() for _, c in own], pa.binary())],
        names=["code_id", "code_row", "codes"],
    )


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joined spans of bytes that windows from first to last cover; in order."""
    if not len(first):
        return first, last
    end = np.maximum.accumulate(last + SPAN)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    starts = np.flatnonzero(new)
    return first[starts], end[np.append(starts[1:], len(first)) - 1]


_STAGED = "doc_id long, row long, start int, end int, anchor long, at int, piece binary"


def _answered(docs: DataFrame, buckets: int) -> DataFrame:
    """Spans of pieces that are gone, and the pieces that were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts, codes = binary(batch.column("text")), batch.column("codes").to_pylist()
                doc, first, last, place, anchor, _ = pieces(texts, digests=False)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                bucket = _bucket_of(anchor, buckets)
                out: dict[str, list] = {"i": [], "start": [], "end": [], "anchor": [], "at": [], "piece": []}
                for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                    code = np.empty(b - a, np.uint8)
                    code[np.argsort(bucket[a:b], kind="stable")] = np.frombuffer(codes[i], np.uint8)
                    gone, ask = np.flatnonzero(code == _GONE) + a, np.flatnonzero(code == _ASK) + a
                    for s, e in zip(*(x.tolist() for x in _spans(first[gone], last[gone])), strict=True):
                        out["i"].append(i), out["start"].append(s), out["end"].append(e), out["anchor"].append(None), out["at"].append(None), out["piece"].append(None)
                    for s, e, p, h in zip(first[ask].tolist(), (last[ask] + SPAN).tolist(), place[ask].tolist(), anchor[ask].view(np.int64).tolist(), strict=True):
                        out["i"].append(i), out["start"].append(s), out["end"].append(e), out["anchor"].append(h), out["at"].append(p), out["piece"].append(texts[i][s:e])
                take = pa.array(out["i"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(out["start"], pa.int32()), pa.array(out["end"], pa.int32()),
                     pa.array(out["anchor"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["piece"], pa.binary())],
                    names=["doc_id", "row", "start", "end", "anchor", "at", "piece"],
                )

    return docs.mapInArrow(run, _STAGED)


def collection_index(texts: list[bytes], most: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a collection in order: text, start, preceding symbol (0: none) and common prefix with the one before.

    Round by round the suffix that is one symbol longer is inserted for each text. A suffix stands where the transform of
    the round before has its first symbol, counted among the equal symbols before it; so one stable pass by symbol gives
    the new order. Common prefixes of neighbours, up to ``most``, are counted when the last round is done. End marks differ
    from each other and from all symbols.
    """
    m = len(texts)
    size = np.fromiter(map(len, texts), np.int64, m)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    used, symbol = np.unique(flat, return_inverse=True)  # UTF-8 leaves more than one value unused
    kind = np.uint8 if len(used) < 256 else np.uint16
    # a slot for each suffix of each text, the empty one last: its first symbol, and the symbol before it
    end = (np.cumsum(size + 1) - 1).astype(np.int32)
    owner = np.repeat(np.arange(m, dtype=np.int32), size + 1)
    inner = np.ones(len(owner), bool)
    inner[end] = False
    here, before = np.zeros(len(owner), kind), np.zeros(len(owner), kind)
    here[inner] = symbol + 1
    before[1:] = here[:-1]
    slot = end
    for _ in range(int(size.max()) if m else 0):
        bwt = before[slot]
        ranked = np.argsort(bwt, kind="stable")
        slot = np.concatenate([end, slot[ranked[np.count_nonzero(bwt == 0) :]] - 1])
    lcp = np.zeros(len(slot), np.uint8)
    alive = np.arange(1, len(slot))
    for k in range(most):
        left = here[slot[alive - 1] + k]
        alive = alive[(left != 0) & (left == here[slot[alive] + k])]
        lcp[alive] += 1
    text = owner[slot]
    return text, slot - (end - size)[text].astype(np.int64), before[slot], lcp


def repeated_windows(texts: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of every window that a text of a smaller document has too."""
    text, start, _, lcp = collection_index(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    long = size[text] - start >= SPAN
    # a suffix of SPAN bytes or more shares them with its neighbour, so shorter suffixes never stand within an interval
    text, start = text[long], start[long]
    new = lcp[long] < SPAN
    if not len(new):
        return text, start
    new[0] = True
    begin = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[text], begin)[np.cumsum(new) - 1]
    gone = doc[text] > least
    return text[gone], start[gone]


def _met(texts: list[bytes], anchor: list[int], at: list[int], doc: list[int]) -> list[int]:
    """Pieces that can share a window with one of another document.

    A window is its anchor with SPAN - K bytes around it, some on the left, the rest on the right. Pieces that share one
    agree on the anchor and, for one of the ``_SIDES``, on that many bytes on either side.
    """
    owner: dict[tuple, int] = {}
    keys: list[list[tuple]] = []
    for t, h, p, d in zip(texts, anchor, at, doc, strict=True):
        own = [(h, i, t[p - left : p + K + right]) for i, (left, right) in enumerate(_SIDES) if p >= left and len(t) >= p + K + right]
        keys.append(own)
        for k in own:
            if owner.setdefault(k, d) != d:
                owner[k] = _SEVERAL
    return [i for i, own in enumerate(keys) if any(owner[k] == _SEVERAL for k in own)]


def _indexed(group: pa.Table) -> pa.Table:
    """Spans that go from the pieces of a bucket."""
    group = group.take(pa.array(_met(*(group.column(c).to_pylist() for c in ("piece", "anchor", "at", "doc_id"))), pa.int64()))
    doc, row, first = (group.column(c).to_numpy() for c in ("doc_id", "row", "start"))
    text, start = repeated_windows(group.column("piece").to_pylist(), doc)
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > start[:-1] + SPAN)
    starts = np.flatnonzero(new)
    owner = text[starts]
    end = start[np.append(starts[1:], len(text))[: len(starts)] - 1] + SPAN
    give_back()
    return pa.table(
        [pa.array(doc[owner]), pa.array(row[owner]), pa.array((first[owner] + start[starts]).astype(np.int32)), pa.array((first[owner] + end).astype(np.int32))],
        names=["doc_id", "row", "start", "end"],
    )


PIECE_BYTES = 2 << 20
"""Bytes of pieces that a bucket of step 3 holds on average."""
HOT_PIECES = 100_000
"""Different pieces of one anchor above which they are not indexed in one bucket but spread by their windows."""


def _spread(pieces_: DataFrame) -> DataFrame:
    """Spans that go from pieces of anchors that too many different pieces have: each window on its own, by its bytes."""
    shift = F.sequence(F.lit(0), F.length("piece") - SPAN)
    windows = pieces_.select("doc_id", "row", "start", "piece", F.explode(shift).alias("shift")).select(
        "doc_id", "row", (F.col("start") + F.col("shift")).alias("start"), F.substring("piece", F.col("shift") + 1, F.lit(SPAN)).alias("window")
    )
    least = windows.groupBy("window").agg(F.min("doc_id").alias("least"))
    gone = windows.join(least, "window").filter(F.col("doc_id") > F.col("least"))
    return gone.select("doc_id", "row", "start", (F.col("start") + SPAN).alias("end"))


def repeated_spans(docs: DataFrame, buckets: int | None = None, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """``docs`` (doc_id long, row, text) to (doc_id, row, start, end): bytes to remove; spans of a document may overlap."""
    spark = docs.sparkSession
    buckets = buckets or max(128, shuffle_partitions(spark))
    dealt = _deal(docs.filter("doc_id IS NOT NULL"), buckets)
    judged = dealt.groupBy("bucket").applyInArrow(_judge, dealt.schema)
    codes = judged.groupBy("slice").applyInArrow(_gather, "code_id long, code_row long, codes binary").dropDuplicates(["code_id", "code_row"])
    asked = docs.join(codes, (docs["doc_id"] == codes["code_id"]) & (docs["row"] == codes["code_row"])).select("doc_id", "row", "text", "codes")
    staged = written(_answered(asked, buckets))
    gone = staged.filter("piece IS NULL").select("doc_id", "row", "start", "end")
    left = staged.filter("piece IS NOT NULL").select("doc_id", "row", "start", "anchor", "at", "piece")
    total = left.agg(F.sum(F.length("piece"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), total // PIECE_BYTES)
    hot = written(left.groupBy("anchor").count().filter(F.col("count") > hot_pieces).select("anchor"))
    if not hot.isEmpty():
        gone = gone.unionByName(_spread(left.join(hot, "anchor")))
        left = left.join(hot, "anchor", "left_anti")
    found = left.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts))).groupBy("part").applyInArrow(_indexed, "doc_id long, row long, start int, end int")
    return gone.unionByName(found)


def _cut(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept, bytes or else their whole characters, in place of text and spans."""
    others = [c for c in docs.columns if c not in ("text", "spans")]
    schema = StructType([*(docs.schema[c] for c in others), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", StringType() if as_text else BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                texts, spans = [t or b"" for t in binary(batch.column("text"))], batch.column("spans").to_pylist()
                n_removed, n_spans, kept = [], [], []
                for t, own in zip(texts, spans, strict=True):
                    out, upto, removed, number = [], 0, 0, 0
                    for s, e in sorted((x["start"], x["end"]) for x in own or ()):
                        if s > upto or number == 0:
                            out.append(t[upto:s])
                            number += 1
                            removed += e - s
                            upto = e
                        elif e > upto:
                            removed += e - upto
                            upto = e
                    out.append(t[upto:])
                    n_removed.append(removed)
                    n_spans.append(number)
                    left = b"".join(out)
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                new = [pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *new], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carried: dict[str, str] | None = None, buckets: int | None = None, hot_pieces: int = HOT_PIECES, as_text: bool = False) -> DataFrame:
    """A row per document: doc_id, row (hash of the text), n_bytes, n_removed, n_spans, kept (the remaining bytes).

    ``carried`` names columns of ``docs`` to return too, and what to call them. With ``as_text`` kept is text, without the
    characters of which only some bytes are left.
    """
    if docs.schema[doc_id].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{doc_id} must be an integer, which says what document comes first")
    named = [F.col(f"`{c}`").alias(n) for c, n in (carried or {}).items()]
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *named).withColumn("row", F.xxhash64("text"))
    spans = repeated_spans(whole.select("doc_id", "row", "text"), buckets, hot_pieces)
    per_doc = spans.groupBy(F.col("doc_id").alias("span_id"), F.col("row").alias("span_row")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    same = (F.col("doc_id") == F.col("span_id")) & (F.col("row") == F.col("span_row"))
    return _cut(whole.join(per_doc, same, "left").drop("span_id", "span_row"), as_text)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, buckets: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the texts; documents of which no visible character is left are gone.

    Characters of which only some bytes are left go as well. ``length`` names a column to hold the new number of characters.
    Documents that were blank before stay.
    """
    others = [c for c in docs.columns if c not in (doc_id, text)]
    found = deduplicated(docs, doc_id, text, {c: f"carried_{i}" for i, c in enumerate(others)}, buckets, as_text=True)
    left = found.withColumnRenamed("kept", "decoded").filter((F.col("n_removed") == 0) | F.col("decoded").rlike(r"[^\x00-\x20]"))
    names = {doc_id: F.col("doc_id").cast(docs.schema[doc_id].dataType), text: F.col("decoded"), **{c: F.col(f"carried_{i}") for i, c in enumerate(others)}}
    if length in names:
        names[length] = F.length("decoded").cast(docs.schema[length].dataType)
    return left.select(*(names[c].alias(c) for c in docs.columns))
