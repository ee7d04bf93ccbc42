"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs: a word is the sum of what it is and how it is spelt, the vector of the word itself if the training vocabulary has
it, next to the mean vector of its hashed character trigrams. A text is read in windows of ``LENGTH`` words that start
every ``STRIDE`` words, half a window, so that every passage of up to ``LENGTH - STRIDE + 1`` words lies whole in some window. A forward and a backward
network read a window; attention weighs their states; a logistic unit scores the sum. A text scores as its worst window.

Training: a bounded sample of labelled rows, at most ``sample`` toxic and twice as many clean texts, of either kind those
of all labels with the least hash of their id. First
random windows are learnt with the label of their text; then, as a toxic text need not be toxic throughout, the window of
each text that now scores highest, with a random one for clean texts. Scoring reads every window of every text; the gates' inputs
are computed once for each distinct word of a batch.

Cases: null and wordless texts score 0. Labels that are null, and labelled ids without a document, are left out. A null id
is not held out and never learnt from. Repeated rows get the same score. With labels of one kind or none, all texts score
0.5, or 0 without words. Empty documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import LETTER_WORDS, binary, slices
from logweave.llm.rule_ensemble import held_out, training_labels

LENGTH, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
VOCABULARY, TRIGRAMS = 4096, 4096
SAMPLE = 1000
"""Toxic texts to learn from at most; of clean ones twice as many."""
WARM, ROUNDS, BATCH, RATE = 5, 9, 256, 0.01
LEAST_SEEN = 5
DROPPED = 0.15
DECAY = 0.02
"""Against learning texts by heart: words of the vocabulary must stand in so many texts, some are left out at random in
each step, and their vectors shrink by this share of the rate."""
THRESHOLD = 0.7
SEED = 11
AT_ONCE = 2048
"""Windows that are scored at a time."""

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Words:
    """Distinct words: their place in the vocabulary (its size: not in it), and their trigrams."""

    known: np.ndarray
    trigrams: np.ndarray
    begin: np.ndarray

    @staticmethod
    def of(words: list[bytes], vocabulary: np.ndarray) -> Words:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        at = np.searchsorted(vocabulary, hashes)
        inside = np.minimum(at, max(len(vocabulary) - 1, 0))
        known = np.where((at < len(vocabulary)) & (vocabulary[inside] == hashes), at, len(vocabulary)) if len(vocabulary) else np.zeros(len(words), np.int64)
        raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.int64) if words else np.empty(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(lengths) - lengths  # a word of n bytes has n trigrams, with its marks
        starts = np.arange(int(lengths.sum())) + np.repeat(2 * np.arange(len(words)), lengths)
        code = raw[starts] * 65536 + raw[starts + 1] * 256 + raw[starts + 2] if len(starts) else starts
        return Words(known, (code * 2654435761 >> 7) % TRIGRAMS, begin)

    def vectors(self, p: Params) -> np.ndarray:
        if not len(self.known):
            return np.empty((0, WORD_DIM + CHAR_DIM), np.float32)
        count = np.diff(np.append(self.begin, len(self.trigrams)))
        spelt = np.add.reduceat(p["char"][self.trigrams], self.begin) / count[:, None].astype(np.float32)
        return np.concatenate([p["word"][self.known], spelt], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _fresh_params(rng: np.random.Generator, vocabulary: int) -> Params:
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def some(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"word": some(vocabulary + 1, WORD_DIM, scale=0.3), "char": some(TRIGRAMS, CHAR_DIM, scale=0.3), "A": some(2 * h, ATTENTION, scale=0.3),
         "a": some(ATTENTION, scale=0.01), "v": some(ATTENTION, scale=0.5), "u": some(2 * h, scale=0.5), "c": np.zeros(1, np.float32)}
    for way in "fb":
        p |= {f"W{way}": some(d, 3 * h, scale=0.3), f"b{way}": np.zeros(3 * h, np.float32), f"U{way}": some(h, 3 * h, scale=0.3)}
    return p


def _read(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: bool):
    """States of one direction, (window, step, hidden); with ``keep`` also what the gradients need."""
    n, length = index.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((n, length, HIDDEN), np.float32)
    kept = []
    for t in reversed(range(length)) if backward else range(length):
        g = gates[index[:, t]]
        q = h @ u
        zr = _sigmoid(g[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(g[:, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
        m = mask[:, t, None]
        out = (new + z * (h - new)) * m
        if keep:
            kept.append((t, h, z, r, new, q[:, 2 * HIDDEN :], m))
        h = out
        states[:, t] = h
    return states, kept


def _forward(p: Params, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows; ``index`` has the words' rows in ``x``, the last row of which stands for no word."""
    sides = [_read(x @ p[f"W{w}"] + p[f"b{w}"], index, mask, p[f"U{w}"], w == "b", keep) for w in "fb"]
    states = np.concatenate([sides[0][0], sides[1][0]], axis=2)
    bent = np.tanh(states @ p["A"] + p["a"])
    weight = bent @ p["v"]
    weight = np.where(mask > 0, weight, -1e9)
    weight = np.exp(weight - weight.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = (weight[:, None, :] @ states)[:, 0]
    logit = pooled @ p["u"] + p["c"]
    return (logit, (sides, states, bent, weight, pooled)) if keep else logit


def _gradients(p: Params, words: Words, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> Params:
    x = np.vstack([words.vectors(p), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
    logit, (sides, states, bent, weight, pooled) = _forward(p, x, index, mask, keep=True)
    g: Params = {}
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g["u"], g["c"] = d @ pooled, d.sum(keepdims=True)
    d_pooled = d[:, None] * p["u"]
    d_states = weight[:, :, None] * d_pooled[:, None, :]
    d_weight = np.einsum("nth,nh->nt", states, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("nt,nta->a", d_score, bent)
    d_bent = d_score[:, :, None] * p["v"] * (1 - bent**2)
    g["A"], g["a"] = np.einsum("nth,nta->ha", states, d_bent), d_bent.sum(axis=(0, 1))
    d_states = d_states + d_bent @ p["A"].T
    seen = x[index]
    d_x = np.zeros_like(seen)
    for side, way in enumerate("fb"):
        u = p[f"U{way}"]
        d_gates = np.zeros((*index.shape, 3 * HIDDEN), np.float32)
        d_u, carried = np.zeros_like(u), np.zeros((len(index), HIDDEN), np.float32)
        for t, before, z, r, new, q, m in reversed(sides[side][1]):
            d_h = (d_states[:, t, side * HIDDEN : (side + 1) * HIDDEN] + carried) * m
            d_new = d_h * (1 - z) * (1 - new**2)
            d_z = d_h * (before - new) * z * (1 - z)
            d_r = d_new * q * r * (1 - r)
            d_gates[:, t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_q = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_u += before.T @ d_q
            carried = d_h * z + d_q @ u.T
        g[f"U{way}"], g[f"b{way}"] = d_u, d_gates.sum(axis=(0, 1))
        g[f"W{way}"] = np.einsum("ntd,ntg->dg", seen, d_gates)
        d_x += d_gates @ p[f"W{way}"].T
    per_word = np.zeros_like(x)
    np.add.at(per_word, index.ravel(), d_x.reshape(-1, x.shape[1]))
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], words.known, per_word[:-1, :WORD_DIM])
    count = np.diff(np.append(words.begin, len(words.trigrams)))
    np.add.at(g["char"], words.trigrams, np.repeat(per_word[:-1, WORD_DIM:] / count[:, None], count, axis=0))
    return g


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word of each window: every ``STRIDE`` words, until one reaches the end."""
    number = np.where(n_words > 0, -(-np.maximum(n_words - LENGTH, 0) // STRIDE) + 1, 0)
    text = np.repeat(np.arange(len(n_words)), number)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * STRIDE


class Read:
    """Texts as rows of distinct words, and their windows."""

    def __init__(self, texts: list[bytes | None], vocabulary: np.ndarray):
        found = [t.translate(LETTER_WORDS).split() if t else [] for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(found))
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        self.n_words = np.fromiter(map(len, found), np.int64, len(found))
        self.flat = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64, int(self.n_words.sum()))
        self.words = Words.of(list(distinct), vocabulary)
        self.begin = np.cumsum(self.n_words) - self.n_words
        self.text, self.first = windows(self.n_words)

    def some(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word rows and mask of the chosen windows."""
        at = self.first[chosen][:, None] + np.arange(LENGTH)
        inside = at < self.n_words[self.text[chosen]][:, None]
        at = np.where(inside, at + self.begin[self.text[chosen]][:, None], 0)
        return np.where(inside, self.flat[at], len(self.words.known)), inside.astype(np.float32)

    def logits(self, p: Params) -> np.ndarray:
        x = np.vstack([self.words.vectors(p), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
        out = np.empty(len(self.text), np.float32)
        for a in range(0, len(out), AT_ONCE):
            index, mask = self.some(np.arange(a, min(a + AT_ONCE, len(out))))
            out[a : a + AT_ONCE] = _forward(p, x, index, mask)
        return out


@dataclass(frozen=True)
class Network:
    vocabulary: np.ndarray
    params: Params | None

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        read = Read(texts, self.vocabulary)
        worst = np.full(len(texts), -np.inf, np.float32)
        if self.params is None:
            worst[read.n_words > 0] = 0
        else:
            np.maximum.at(worst, read.text, read.logits(self.params))
        with np.errstate(over="ignore"):
            return _sigmoid(worst.astype(np.float64))


def _parts(read: Read, chosen: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The chosen windows with only their own words."""
    index, mask = read.some(chosen)
    own, index = np.unique(index, return_inverse=True)
    index = index.reshape(mask.shape)
    total = len(read.words.known)
    real = own[own < total]
    count = np.diff(np.append(read.words.begin, len(read.words.trigrams)))[real]
    begin = np.cumsum(count) - count
    take = np.repeat(read.words.begin[real] - begin, count) + np.arange(int(count.sum()))
    return Words(read.words.known[real], read.words.trigrams[take], begin), index, mask


def fit(texts: list[bytes], y: np.ndarray, seed: int = SEED) -> Network:
    """Trains the network on texts and labels 0 or 1."""
    if len(y) == 0 or y.min() == y.max():
        return Network(np.empty(0, np.uint64), None)
    rng = np.random.default_rng(seed)
    seen: dict[bytes, int] = {}
    for t in texts:
        for w in set(t.translate(LETTER_WORDS).split()):
            seen[w] = seen.get(w, 0) + 1
    common = sorted((w for w, n in seen.items() if n >= LEAST_SEEN), key=lambda w: (-seen[w], w))[:VOCABULARY]
    vocabulary = np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in common], np.uint64))
    read = Read(texts, vocabulary)
    p = _fresh_params(rng, len(vocabulary))
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    number = np.bincount(read.text, minlength=len(texts))
    begin = np.cumsum(number) - number
    usable = np.flatnonzero(number > 0)
    step = 0
    for turn in range(WARM + ROUNDS):
        any_ = begin[usable] + (rng.random(len(usable)) * number[usable]).astype(np.int64)
        if turn < WARM:
            chosen = any_
        else:
            logit = read.logits(p)
            order = np.lexsort((-logit, read.text))
            worst = order[begin[usable]]
            chosen = np.concatenate([worst, any_[y[usable] == 0]])
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), BATCH):
            part = chosen[a : a + BATCH]
            words, index, mask = _parts(read, part)
            mask *= (rng.random(mask.shape) >= DROPPED) | (np.arange(LENGTH) == 0)  # never all words
            grads = _gradients(p, words, index, mask, y[read.text[part]].astype(np.float32))
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                if k in ("word", "char"):
                    p[k] *= np.float32(1 - RATE * DECAY)
                p[k] -= (RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(vocabulary, p)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Network:
    kind = F.col(f"`{label}`").cast("int")
    toxic, clean = (training_labels(labels.filter(kind == y), label, most, doc_id) for y, most in ((1, sample), (0, 2 * sample)))
    first = toxic.unionByName(clean)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = rows.join(F.broadcast(first), "doc_id").filter(F.col("text").isNotNull()).toPandas()
    found = found.sort_values(["doc_id", "y", "text"], kind="stable")
    return fit([t.encode() for t in found["text"]], found["y"].to_numpy())


def scored(docs: DataFrame, model: Network, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(binary(batch.column("text"))))], names=["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
