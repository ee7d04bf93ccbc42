"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics. For every language and source a minimum covariance determinant
estimate describes the clean bulk: starting from medians and quartiles, the share ``h`` of rows nearest to the centre
gives the next centre and covariance (a concentration step, which never raises the determinant). A row whose squared
Mahalanobis distance lies beyond the chi-square quantile is an outlier and rejected, as are rows that fail plain rules.
Sources with fewer than ``least_rows`` usable rows take their language's estimate, languages the whole table's.

The statistics are a small table; every step is two grouped sums over it with partial sums in each task. Order statistics
come from counts in fixed bins, not from sorted groups, so no group is ever collected. Estimates are joined to rows by
language and source; that table has a row per source, and Spark broadcasts it only while it is small.

Cases: a null text counts as empty and fails the plain rules. A null language or source is a group of its own. Repeated
rows count as often as they occur and are judged alike. Statistics that do not vary are held apart by ``FLOORS``, the
least standard deviations. An empty table gives no rows; without usable rows only the plain rules decide. Extra columns
are ignored by ``judged`` and kept by ``without_outliers``.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import fresh, written
from logweave.llm.text_stats import counted

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_stops")
FLOORS = (0.05, 0.1, 0.15, 0.15, 0.05, 0.1, 0.1, 0.08)
H = 0.75
STEPS = 5
REJECT = 5e-5
LEAST_ROWS = 200
BINS = 64
"""Bins of an order statistic: per unit for statistics (times 16), per doubling for distances."""


def statistics() -> list[Column]:
    """Word length, symbols, repeated lines, repeated words, capitals, exclamations, digits and full stops, as roots or logs."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return [
        F.log(chars / words), F.sqrt(F.col("n_symbols") / words), F.col("n_dup_lines") / lines, F.sqrt(F.col("n_repeat_words") / words),
        F.sqrt(F.col("n_upper") / chars), F.sqrt(F.col("n_bangs") / words), F.sqrt(F.col("n_digits") / chars), F.sqrt(F.col("n_stops") / words),
    ]


D = len(FLOORS)
X = [f"x{i}" for i in range(D)]
MU = [f"m{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
LOW = [f"w{i}_{j}" for i, j in PAIRS]
KEY = ["level", "g_lang", "g_source"]


def chi2_quantile(p: float, d: int) -> float:
    """By the cube-root approximation."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def chi2_share(q: float, d: int) -> float:
    return NormalDist().cdf(((q / d) ** (1 / 3) - 1 + 2 / (9 * d)) / (2 / (9 * d)) ** 0.5)


def _levels(rows: DataFrame) -> DataFrame:
    """Each row once for its source, once for its language and once for the whole table."""
    none = F.lit(None).cast("string")
    keys = [(0, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (2, none, none)]
    one = F.array(*(F.struct(F.lit(n).alias("level"), a.alias("g_lang"), b.alias("g_source")) for n, a, b in keys))
    return rows.select(F.inline(one), *X)


def _same_key(a: DataFrame, b: DataFrame) -> Column:
    return (a["level"] == b["level"]) & a["g_lang"].eqNullSafe(b["g_lang"]) & a["g_source"].eqNullSafe(b["g_source"])


def _joined(rows: DataFrame, estimates: DataFrame, values: list[str]) -> DataFrame:
    return rows.join(estimates, _same_key(rows, estimates)).select(*(rows[c] for c in KEY + X), *(estimates[c] for c in values))


def distance2() -> Column:
    """Squared Mahalanobis distance, from the whitening matrix of the estimate."""
    total = None
    for i in range(D):
        part = None
        for j in range(i + 1):
            term = F.col(f"w{i}_{j}") * (F.col(X[j]) - F.col(MU[j]))
            part = term if part is None else part + term
        total = part * part if total is None else total + part * part
    return total


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + F.lit(1e-9)) * BINS).cast("int")


def _reaches(counts: DataFrame, by: list[str], share: float) -> DataFrame:
    """The least bin up to which ``share`` of the group's rows lie."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    up = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return up.filter(F.col("upto") >= share * F.col("total")).groupBy(*by).agg(F.min("bin").alias("bin"))


def _estimate_schema() -> str:
    return "level int, g_lang string, g_source string, n long, " + ", ".join(f"{c} double" for c in MU + LOW)


def _whitened(parts: Iterator[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    """Centre and whitening matrix from sums, a row per group."""
    floor = np.diag(np.square(FLOORS))
    for pdf in parts:
        n = np.maximum(pdf["n"].to_numpy(float), 1)
        mean = pdf[[f"s{i}" for i in range(D)]].to_numpy(float) / n[:, None]
        out = pdf[[*KEY, "n"]].copy()
        out[MU] = mean
        rows = np.empty((len(pdf), len(PAIRS)))
        for r in range(len(pdf)):
            cov = np.zeros((D, D))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = pdf[f"p{i}_{j}"].iloc[r] / n[r] - mean[r, i] * mean[r, j]
            value, vector = np.linalg.eigh(cov)
            cov = vector @ np.diag(np.maximum(value, 0)) @ vector.T  # rounding may leave tiny negative directions
            low = np.linalg.inv(np.linalg.cholesky(cov * factor + floor))
            rows[r] = [low[i, j] for i, j in PAIRS]
        out[LOW] = rows
        yield out


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each statistic, from counts in fixed bins."""
    wide = rows.select(*KEY, F.posexplode(F.array(*(F.floor(F.col(c) * 16 * BINS).cast("int") for c in X))).alias("dim", "bin"))
    counts = written(wide.groupBy(*KEY, "dim", "bin").agg(F.count("*").alias("n")))
    found = None
    for name, share in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        part = _reaches(counts, [*KEY, "dim"], share).withColumn("which", F.lit(name))
        found = part if found is None else found.unionByName(part)
    value = (F.col("bin") + 0.5) / (16 * BINS)
    wanted = [F.max(F.when((F.col("dim") == i) & (F.col("which") == q), value)).alias(f"{q}_{i}") for i in range(D) for q in ("q1", "q2", "q3")]
    quartiles = found.groupBy(*KEY).agg(*wanted)
    scale = [F.sqrt(F.pow((F.col(f"q3_{i}") - F.col(f"q1_{i}")) / 1.349, 2) + FLOORS[i] ** 2) for i in range(D)]
    low = [((1 / scale[i]) if i == j else F.lit(0.0)).alias(f"w{i}_{j}") for i, j in PAIRS]
    return quartiles.select(*KEY, F.lit(0).cast("long").alias("n"), *(F.col(f"q2_{i}").alias(MU[i]) for i in range(D)), *low)


def estimates(rows: DataFrame, h: float = H, steps: int = STEPS) -> DataFrame:
    """Minimum covariance determinant estimates of all sources, languages and the whole: level, g_lang, g_source, n, centre, whitening."""
    rows = _levels(rows)
    now = written(_start(rows))
    factor = h / chi2_share(chi2_quantile(h, D), D + 2)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}_{j}") for i, j in PAIRS]
    for _ in range(steps):
        counts = _joined(rows, now, MU + LOW).select(*KEY, _bin(distance2()).alias("bin")).groupBy(*KEY, "bin").agg(F.count("*").alias("n"))
        limit = _reaches(counts, KEY, h).withColumnRenamed("bin", "limit")
        limited = written(now.join(limit, _same_key(now, limit)).select(*(now[c] for c in [*KEY, *MU, *LOW]), "limit"))
        near = _joined(rows, limited, [*MU, *LOW, "limit"]).withColumn("near", _bin(distance2()) <= F.col("limit"))
        moments = near.filter("near").groupBy(*KEY).agg(F.count("*").alias("n"), *sums)
        now = written(moments.mapInPandas(lambda parts: _whitened(parts, factor), _estimate_schema()))
    return now


def _for_sources(sources: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """For each language and source the estimate of the first level that rests on enough rows."""
    none = F.lit(None).cast("string")
    out = sources
    for level, lang, source in ((0, F.col("lang"), F.col("source")), (1, F.col("lang"), none), (2, none, none)):
        part = found.filter(F.col("level") == level).select(
            F.col("g_lang").alias("pl"), F.col("g_source").alias("ps"), F.struct("n", *MU, *LOW).alias(f"e{level}")
        )
        out = out.join(part, lang.eqNullSafe(F.col("pl")) & source.eqNullSafe(F.col("ps")), "left").drop("pl", "ps")
    enough = [F.when(F.col(f"e{i}.n") >= least, F.col(f"e{i}")) for i in (0, 1)]
    return out.select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), F.coalesce(*enough, F.col("e2")).alias("e"))


def judged(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    h: float = H, steps: int = STEPS, reject: float = REJECT, least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """A row per document: doc_id, key (of the row), the counts, base_failed, distance2 (null without estimate), kept."""
    named = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"),
        F.col(f"`{text}`").cast("string").alias("text"),
    ).withColumn("key", F.xxhash64("text", "lang", "source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(counted(named, "text", COUNTS).withColumns({"base_failed": failed, **dict(zip(X, statistics(), strict=True))}))
    usable = stats.filter("NOT base_failed")
    found = estimates(usable, h, steps)
    per_source = written(_for_sources(stats.select("lang", "source").distinct(), found, least_rows * h))
    same = F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    scored = stats.join(per_source, same, "left").select("doc_id", "key", *COUNTS, "base_failed", *X, *(F.col(f"e.{c}").alias(c) for c in MU + LOW))
    out = scored.select("doc_id", "key", *COUNTS, "base_failed", distance2().alias("distance2"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= chi2_quantile(1 - reject, D)))


def without_outliers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """``docs`` without the rejected rows."""
    bad_id, bad_key, key = (fresh(docs.columns, n) for n in ("bad_id", "bad_key", "row_key"))
    bad = judged(docs, doc_id, text, lang, source, **options).filter("NOT kept").select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct()
    own = docs.withColumn(key, F.xxhash64(F.col(f"`{text}`").cast("string"), F.col(f"`{lang}`").cast("string"), F.col(f"`{source}`").cast("string")))
    return own.join(bad, F.col(f"`{doc_id}`").eqNullSafe(F.col(bad_id)) & (F.col(key) == F.col(bad_key)), "left_anti").drop(key)
