"""Alignment of the tokens that two tokenizers make of the same text.

Both token lists spell the same bytes, a space and the text. The byte offset after each token is its cumulative end; a
dictionary per list leads from an end to the token's index. The ends that both dictionaries hold, sorted, slice both
lists into groups: the least stretches that both tokenizers cut out whole. In a slice no token is empty, so just its last
two tokens end together: that pair is its link.

Neither tokenizer joins a visible character with a space after it (checked for the pieces when the model is loaded), so
texts are cut at such spaces and each distinct segment is encoded and aligned once; a segment's end is an end in both
lists. What is kept of segments met before is bounded by their number.

How often a pair of ids is linked in all texts takes one more look at each text's links. Texts are handled in blocks of
a few megabytes; a block sends each of its distinct pairs once, with its number there, gets back the count over all
blocks, and the texts of the block meet these answers by the block's number. So a pair that stands in every text is a row
per block, not a row per text, and no group is larger than a block.

Cases: a null or empty text, and one whose tokens spell other bytes (the pieces' own space sign in the text), has no
tokens, zeros and empty groups. Strings of the tokenizers' own signs within a text are plain text. Repeated rows and
repeated or null ids are rows of their own, and count as often. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
import uuid
from collections.abc import Iterator
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import slices, written

BLOCK_BYTES = 2 << 20
"""Bytes of text in a block; a longer text is a block of its own."""
KEPT_SEGMENTS = 240_000
"""Segments that a Python worker keeps for its later batches; beyond that those met just once are forgotten, which only costs time."""
RUN = 1000
"""Segments that are encoded together."""
SPACE_SIGN = "▁"
_UNSAFE = re.compile(r"(?:\A|\s) | \Z")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others, in order, have the letters from U+0100 on.
    """
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def groups_of(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int]]:
    """Where the groups of two token lists end: the byte, and the number of tokens of each list up to there."""
    a_at, b_at = dict(zip(a_ends, count(1))), dict(zip(b_ends, count(1)))
    return [(end, a_at[end], b_at[end]) for end in sorted(a_at.keys() & b_at.keys())]


def segments(text: str) -> list[str]:
    """A text cut at the spaces after a visible character, those spaces left out."""
    parts = text.split(" ")
    if _UNSAFE.search(text) is None:
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        before = out[-1]
        if before == "" or before[-1].isspace():
            out[-1] = f"{before} {part}"
        else:
            out.append(part)
    if len(out) > 1 and out[-1] == "":
        out[-2:] = [f"{out[-2]} "]
    return out


class Aligner:
    """Aligned segments, by their text; per segment its numbers, the text of its groups and its linked pairs."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.names = [str(i) for i in range(max(*self.a_bytes, len(pieces)) + 1)]
        self.cuttable = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)
        self._clear()

    def _forget(self) -> None:
        """Keep what was met more than once, half of the room at most; all that is met again later is learned again."""
        if not getattr(self, "groups", None):
            self._clear()
            return
        often = np.flatnonzero(self.uses > 1)
        if len(often) > KEPT_SEGMENTS // 2:
            often = np.sort(often[np.argsort(-self.uses[often], kind="stable")[: KEPT_SEGMENTS // 2]])
        names, groups, n = list(self.at), self.groups, self.counts[often, 2]
        self.at = {names[i]: k for k, i in enumerate(often.tolist())}
        self.groups = [groups[i] for i in often.tolist()]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        self.pairs = self.pairs[np.repeat(self.begin[often] - (upto - n), n) + np.arange(total)]
        self.counts, self.begin, self.uses = self.counts[often], upto - n, np.minimum(self.uses[often] - 1, 8)

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.uses = np.empty(0, np.int64)
        self.counts = np.empty((0, 4), np.int64)
        """Per segment: tokens of each list, groups, and whether both lists spell it."""
        self.groups: list[str] = []
        self.begin = np.empty(0, np.int64)
        self.pairs = np.empty(0, np.int64)

    def tokens(self, text: str) -> tuple[list[int], list[int], list[tuple[int, int, int]]] | None:
        """Both lists of a text with a space before it, and their groups; None where a list spells something else."""
        a, b, whole = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.b.encode(text), f" {text}".encode()
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            return None
        return a, b, groups_of(accumulate(map(len, a_parts)), accumulate(map(len, b_parts)))

    def _learn(self, parts: list[str]) -> None:
        """Encode and align new segments, many in one run: a run's lists are those of its segments, one after the other."""
        plain = [s for s in parts if self.cuttable and s and not s[-1].isspace() and SPACE_SIGN not in s]
        alone = list(set(parts) - set(plain))
        runs = [plain[i : i + RUN] for i in range(0, len(plain), RUN)] + [[s] for s in alone]
        counts, begin, pairs, at = [self.counts], [self.begin], [self.pairs], len(self.pairs)
        for run in runs:
            found = self.tokens(" ".join(run))
            if found is None and len(run) > 1:  # one of them spells something else: each by itself
                runs.extend([s] for s in run)
                continue
            a, b, groups = found or ([], [], [])
            ends, p, q = np.array(groups, np.int64).reshape(-1, 3).T
            texts = self._texts(a, b, p, q)
            # where the groups of each segment end, and the tokens there
            upto = np.searchsorted(ends, np.cumsum([len(s.encode()) + 1 for s in run]), side="right") if found else np.zeros(1, np.int64)
            last = np.concatenate([[0], upto])
            self.at.update(zip(run, count(len(self.groups)), strict=False))
            self.groups += [";".join(texts[g:h]) for g, h in zip(last.tolist(), upto.tolist(), strict=False)]
            tokens = [np.diff(np.concatenate([[0], x])[last]) for x in (p, q)]
            counts.append(np.stack([*tokens, np.diff(last), np.full(len(run), found is not None)], axis=1))
            begin.append(at + last[:-1])
            pairs.append(np.array(a, np.int64)[p - 1] << 32 | np.array(b, np.int64)[q - 1])
            at += len(p)
        self.counts, self.begin, self.pairs = np.concatenate(counts), np.concatenate(begin), np.concatenate(pairs)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.begin) - len(self.uses), np.int64)])

    def _texts(self, a: list[int], b: list[int], p: np.ndarray, q: np.ndarray) -> list[str]:
        """Each group's ids as text."""
        a_names, b_names = [self.names[x] for x in a], [self.names[x] for x in b]
        texts = [f"{a_names[i]}|{b_names[j]}" for i, j in zip((p - 1).tolist(), (q - 1).tolist(), strict=True)]
        i, j = np.concatenate([[0], p])[:-1], np.concatenate([[0], q])[:-1]
        several = np.flatnonzero((p - i > 1) | (q - j > 1))
        for k, i0, i1, j0, j1 in zip(*(x.tolist() for x in (several, i[several], p[several], j[several], q[several])), strict=True):
            texts[k] = f"{','.join(a_names[i0:i1])}|{','.join(b_names[j0:j1])}"
        return texts

    def cut(self, text: str | None) -> list[str]:
        return [] if not text else segments(text) if self.cuttable else [text]

    def block(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text the numbers of tokens and groups and the digest of its groups; all links as the text's number and the pair."""
        if len(self.at) > KEPT_SEGMENTS:
            self._forget()
        cut = [self.cut(t) for t in texts]
        new = list({s for parts in cut for s in parts} - self.at.keys())
        if new:
            self._learn(new)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        index = np.fromiter(map(self.at.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        self.uses += np.bincount(index, minlength=len(self.uses))
        texts_of = [self.groups[i] for i in index.tolist()]
        owner = np.repeat(np.arange(len(cut)), sizes)
        bad = np.zeros(len(cut), bool)
        bad[owner[self.counts[index, 3] == 0]] = True
        bad |= sizes == 0
        good = ~bad[owner]
        index, owner = index[good], owner[good]
        numbers = np.zeros((len(cut), 3), np.int64)
        for c in range(3):
            numbers[:, c] = np.bincount(owner, self.counts[index, c], len(cut)).astype(np.int64)
        digests, ends = [], np.cumsum(sizes)
        for a, b, no in zip((ends - sizes).tolist(), ends.tolist(), bad.tolist(), strict=True):
            text = "" if no else ";".join(texts_of[a:b])
            digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        links = self.counts[index, 2]
        upto = np.cumsum(links)
        total = int(upto[-1]) if len(upto) else 0
        pairs = self.pairs[np.repeat(self.begin[index] - (upto - links), links) + np.arange(total)]
        return numbers, digests, np.repeat(owner, links), pairs


def kept_aligner(byte_path: str, piece_path: str) -> Aligner:
    """One aligner for the life of the Python worker."""
    kept = sys.modules.setdefault("llm_kept_aligners", types.ModuleType("llm_kept_aligners")).__dict__
    name = f"{byte_path}:{piece_path}"
    if name not in kept:
        kept[name] = Aligner(byte_path, piece_path)
    return kept[name]


def token_groups(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each group of each text: doc_id, group (from 0), start and stop (bytes, the space before the text included), a and b (ids)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_aligner(byte_path, piece_path)
        for batch in batches:
            for key, value in zip(batch.column("doc_id"), batch.column("text").to_pylist(), strict=True):
                found = aligner.tokens(value) if value else None
                if found is None:
                    continue
                a_ids, b_ids, groups = found
                out, start, i, j = [], 0, 0, 0
                for end, p, q in groups:
                    out.append((start, end, a_ids[i:p], b_ids[j:q]))
                    start, i, j = end, p, q
                if out:
                    begin, stop, a, b = map(list, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(out), key.type), pa.array(range(len(out)), pa.int64()), pa.array(begin, pa.int64()),
                         pa.array(stop, pa.int64()), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))],
                        ["doc_id", "group", "start", "stop", "a", "b"],
                    )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(align, f"doc_id {kind}, group long, start long, stop long, a array<int>, b array<int>")


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, kind: str) -> DataFrame:
    """Rows of two kinds: texts with their distinct links, numbered within the block, and the block's distinct pairs."""
    schema = (
        f"block string, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, link array<int>, times array<int>, at int, pair long, n long"
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_aligner(byte_path, piece_path)
        for whole in batches:
            for part in slices(whole, "text", BLOCK_BYTES):
                rows = part.num_rows
                numbers, digests, owner, pairs = aligner.block(part.column("text").to_pylist())
                distinct, local = np.unique(pairs, return_inverse=True)
                both, times = np.unique(owner * max(len(distinct), 1) + local, return_counts=True)
                text, link = np.divmod(both, max(len(distinct), 1))
                offsets = pa.array(np.searchsorted(text, np.arange(rows + 1)), pa.int32())
                name = uuid.uuid4().hex
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * rows), part.column("doc_id"), *(pa.array(numbers[:, c]) for c in range(3)), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(link, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names=NAMES,
                )
                m = len(distinct)
                counts = np.bincount(local, minlength=m) if m else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * m, pa.string()), pa.nulls(m, part.column("doc_id").type), *(pa.nulls(m, pa.int64()) for _ in range(3)),
                     pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.list_(pa.int32())),
                     pa.array(np.arange(m), pa.int32()), pa.array(distinct, pa.int64()), pa.array(counts, pa.int64())], names=NAMES,
                )

    return docs.mapInArrow(align, schema)


NAMES = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "link", "times", "at", "pair", "n"]


def pair_counts(pairs: DataFrame) -> DataFrame:
    """From pairs and their numbers: pair, total, and whether the total is the greatest of the pairs of its second id."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    best = totals.groupBy(second.alias("b")).agg(F.max("total").alias("top"))  # as many rows as the vocabulary at most
    return totals.withColumn("b", second).join(F.broadcast(best), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def alignment_digest(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = written(_blocks(rows, byte_path, piece_path, kind))
    pairs = blocks.filter("at IS NOT NULL").select("block", "at", "pair", "n")
    answers = pairs.join(pair_counts(pairs), "pair").select(F.col("block").alias("of"), "at", "total", "best")
    texts = blocks.filter("at IS NULL").select(*NAMES[:8])
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def summed(texts: pa.Table, answers: pa.Table) -> pa.Table:
        at = answers.column("at").to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], best[at] = answers.column("total").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
        lists = texts.column("link").combine_chunks()
        link, times = lists.flatten().to_numpy(), texts.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)

        def per_text(values: np.ndarray) -> pa.Array:
            upto = np.concatenate([[0], np.cumsum(values)])
            return pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())

        columns = {"n_links": per_text(times), "n_best": per_text(times * best[link]), "count_sum": per_text(times * total[link])}
        kept = {c: texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
        order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return pa.table({c: (kept | columns)[c] for c in order})

    return texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(summed, schema)
