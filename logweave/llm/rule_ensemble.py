"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow regression trees, boosted on the labelled sample, give candidate rules: every path from a root to a node is a
conjunction of thresholds. A logistic regression with an L1 penalty then weighs the rules and leaves few. The rules that
stay become one Spark column expression, so scoring is a projection over the statistics of each text.

The model is fitted on at most ``sample`` labelled rows, those with the least hash of their id: a fixed, documented bound
at any size of the table. Statistics, scores and predictions cover every row and the whole of each text.

Cases: null and empty texts have zero statistics and get a score like any other. Labels that are null, and labelled ids
without a document, are left out. Labels that contradict each other count as so many rows. A null id is not held out and
never learnt from. Repeated rows get the same score. With no labels every score is 0.5, with labels of one kind all
scores are alike. Empty documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.text_stats import counted

SAMPLE = 20_000
TREES = 40
DEPTH = 3
BINS = 32
RATE = 0.2
PENALTY = 2e-3
STEPS = 400
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_bangs", "n_stops", "n_commas")


FEATURES = ("words", "word_length", "symbols", "same_lines", "same_words", "distinct", "capitals", "digits", "bangs", "stops", "commas")


def features() -> dict[str, Column]:
    """Statistics that the rules test; all are shares or means, but for the number of words."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    found = (
        F.col("n_words").cast("double"), F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_dup_lines") / lines,
        F.col("n_repeat_words") / words, F.col("n_distinct_words") / words, F.col("n_upper") / chars, F.col("n_digits") / chars,
        F.col("n_bangs") / words, F.col("n_stops") / words, F.col("n_commas") / words,
    )
    return dict(zip(FEATURES, found, strict=True))


@dataclass(frozen=True)
class Test:
    """``feature > bound`` if above, else ``feature <= bound``."""

    feature: int
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.bound if self.above else x[:, self.feature] <= self.bound

    def column(self) -> Column:
        c = F.col(FEATURES[self.feature])
        return c > self.bound if self.above else c <= self.bound


Rule = frozenset[Test]


@dataclass(frozen=True)
class RuleEnsemble:
    base: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Score of a row that has the columns of ``features``."""
        total = F.lit(self.base)
        for rule, weight in self.rules:
            held = None
            for t in sorted(rule, key=lambda t: (t.feature, t.above, t.bound)):
                held = t.column() if held is None else held & t.column()
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _bounds(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds to try for each feature."""
    out = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[:-1]))
        out.append(values[:-1] if len(values) > 1 and values[-1] == x[:, f].max() else values)
    return out


def _tree(codes: np.ndarray, bounds: list[np.ndarray], residual: np.ndarray, least: int) -> tuple[np.ndarray, list[Rule]]:
    """Fits a tree to the residuals: its value for each row, and a rule for each node."""
    value, rules = np.zeros(len(residual)), []

    def grow(rows: np.ndarray, rule: Rule, depth: int) -> None:
        r = residual[rows]
        value[rows] = r.mean()
        if depth == DEPTH or len(rows) < 2 * least:
            return
        best = (1e-9, -1, -1)
        for f, b in enumerate(bounds):
            if not len(b):
                continue
            n = np.cumsum(np.bincount(codes[rows, f], minlength=len(b) + 1))[:-1]
            s = np.cumsum(np.bincount(codes[rows, f], weights=r, minlength=len(b) + 1))[:-1]
            m = len(rows) - n
            gain = np.where((n >= least) & (m >= least), s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(m, 1) - r.sum() ** 2 / len(rows), 0)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        _, f, at = best
        if f < 0:
            return
        low = codes[rows, f] <= at
        for above, part in ((False, rows[low]), (True, rows[~low])):
            more = rule | {Test(f, above, float(bounds[f][at]))}
            rules.append(more)
            grow(part, more, depth + 1)

    grow(np.arange(len(residual)), frozenset(), 0)
    return value, rules


def _lasso(held: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal steps."""
    n, m = held.shape
    a = np.ascontiguousarray(held, np.float32)
    power = np.ones(m + 1, np.float32)
    for _ in range(20):  # the largest curvature sets the step
        power = np.append(a.T @ (a @ power[:-1] + power[-1]), (a @ power[:-1] + power[-1]).sum())
        size = float(np.linalg.norm(power))
        power /= max(size, 1e-9)
    step = 4 * n / max(size, 1e-9)
    w, b = np.zeros(m, np.float32), float(np.log(y.mean() / (1 - y.mean())))
    u, c, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(a @ u + c)))
        gap = (p - y).astype(np.float32)
        moved = u - step * (a.T @ gap) / n
        w_new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        b_new = c - step * float(gap.mean())
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return b, w


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, penalty: float = PENALTY) -> RuleEnsemble:
    """Fits the ensemble to rows of features and labels 0 or 1."""
    if not len(y):
        return RuleEnsemble(0.0, ())
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    bounds = _bounds(x)
    codes = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)], axis=1)
    raw, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-raw))
        value, found = _tree(codes, bounds, residual, least=max(5, len(y) // 1000))
        raw += RATE * value / max(float(np.mean(np.abs(residual))), 0.05)
        rules.update(dict.fromkeys(found))
    ordered = list(rules)
    if not ordered:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    held = np.stack([np.logical_and.reduce([t.holds(x) for t in r]) for r in ordered], axis=1)
    base, weights = _lasso(held, y, penalty)
    return RuleEnsemble(base, tuple((r, float(w)) for r, w in zip(ordered, weights, strict=True) if abs(w) > 1e-4))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label: str, sample: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``sample`` labelled ids, those with the least hash, that may be learnt from: doc_id, y."""
    rows = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    return rows.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> RuleEnsemble:
    chosen = F.broadcast(training_labels(labels, label, sample, doc_id))  # at most ``sample`` pairs of numbers
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(chosen, "doc_id")
    found = counted(rows, "text", COUNTS).select("y", *(c.alias(n) for n, c in features().items())).toPandas()
    found = found.sort_values(list(found.columns), kind="stable")  # the order of rows must not matter
    return fit(found[list(FEATURES)].to_numpy(float), found["y"].to_numpy(float))


def scored(docs: DataFrame, model: RuleEnsemble, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stats = counted(rows, "text", COUNTS).select("doc_id", *(c.alias(n) for n, c in features().items()))
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
