"""Bottom-k fingerprints of documents, with DataFrame functions only.

A document's shingles are its distinct runs of five words (a document of fewer words has one, the whole sequence); words
are runs of digits, letters and everything beyond ASCII, A-Z lower-cased. Each shingle gets a 64-bit hash, the first 16
hex digits of its MD5; the fingerprint is the sorted list of the k least hashes. Equal texts have equal fingerprints.

The k least hashes of a union are among the k least of its parts, so fingerprints merge: ``merged`` unites those of all
rows of a group, ``united`` two of one row. The hashes of a set are as good as drawn at random from the range, so the k
least of a union are a sample of it: the share that both sides hold estimates the resemblance, the k-th least hash tells
how many distinct shingles there are, and both together the containment. Sets of fewer than k shingles are held whole,
and their figures are exact.

Where a document stands in the order of ids is found without one task that sees them all: ids are cut into many ranges,
even by approximate quantiles, the rows of a range meet in one task, and the first row of each range is sent a second
time, to the range before it. Only that one shuffle carries texts.

Cases: a null text counts as empty; texts without words have no shingles and an empty fingerprint; two empty
fingerprints are alike (1.0), an empty and another one are not (0.0). Repeated ids stand in the order of their texts, a
null id before all others. An empty table gives no rows. Extra columns are left out by ``edited_digest``, and kept by
``fingerprinted``, in which a column of the result's name gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import fresh, shuffle_partitions, with_columns

K = 128
WORDS = 5
DIGITS = 16
"""Hex digits of a hash."""
SEGMENTS = 256
"""Quantiles of the ids that are looked up; each is cut further, evenly by value."""
RANGES_PER_TASK = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of digits, letters and everything beyond ASCII, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _PARTING), "")


def shingles_of(words: Column, n: int = WORDS) -> Column:
    """All runs of n words in order, with repeats; the whole sequence if it is shorter, nothing without words."""
    size = F.size(words)
    runs = F.greatest(size - (n - 1), F.lit(0))
    beside = F.arrays_zip(*(F.slice(words, i + 1, runs).alias(f"w{i}") for i in range(n)))
    joined = F.transform(beside, lambda s: F.concat(*[part for i in range(n) for part in (F.lit(" "), s[f"w{i}"])][1:]))
    return (
        F.when(size == 0, F.array().cast("array<string>"))
        .when(size < n, F.array(F.concat_ws(" ", words)))
        .otherwise(joined)
    )


def fingerprint_of(shingles: Column, k: int = K) -> Column:
    """The k least distinct hashes, sorted, as an array of hex texts."""
    hashes = F.transform(shingles, lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def united(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union that both sets hold, from 0 to 1; 1 for two empty sets."""
    union = united(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    last = F.conv(F.element_at(a, k), 16, 10).cast("double")
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / ((last + 1) / float(16**DIGITS)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second holds, from 0 to 1; 1 for an empty first set."""
    shared = resemblance(a, b, k) * distinct_count(united(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def fingerprinted(docs: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, words: int = WORDS) -> DataFrame:
    """``docs`` with the fingerprint of each text, an array of hex texts.

    The words stand in a column of their own first: a function over the elements of an array makes anew, for each
    element, whatever expression it reads beside them.
    """
    kept = fresh(docs.columns, "__words")
    split = docs.select("*", words_of(F.col(f"`{text}`")).alias(kept))
    return with_columns(split, {out: fingerprint_of(shingles_of(F.col(kept), words), k)}).drop(kept)


def merged(rows: DataFrame, by: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each group of rows: the columns ``by`` and ``fingerprint``.

    Each task sends the k least hashes of a group at most, however many rows of it there are.
    """
    keys = [F.col(f"`{c}`") for c in by]
    each = rows.select(*keys, F.explode_outer(f"`{fingerprint}`").alias("__hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__hash").asc_nulls_last()))
    least = each.withColumn("__rank", rank).filter(F.col("__rank") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(fingerprint))


def in_ranges(docs: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` with columns ``__range`` and ``__guest``: rows by ranges of ids, each range ended by copies of what comes first after it."""
    spark = docs.sparkSession
    ids = docs.select(F.col(f"`{doc_id}`").alias("id"))
    ranges = RANGES_PER_TASK * shuffle_partitions(spark)
    segments = min(SEGMENTS, ranges)
    each = -(-ranges // segments)
    cuts = ids.agg(F.min("id"), F.max("id"), F.percentile_approx("id", [i / segments for i in range(1, segments)], 10_000) if segments > 1 else F.lit(None)).first()
    edges = sorted({cuts[0], *(cuts[2] or []), cuts[1]}) if cuts[0] is not None else [0]
    number = F.coalesce(_range(F.col(f"`{doc_id}`"), edges, each), F.lit(-1).cast("bigint"))
    firsts = (
        docs.select(number.alias("range"), F.col(f"`{doc_id}`").alias("first"))
        .groupBy("range").agg(F.min(F.struct("first")).alias("least"))
        .select("range", F.col("least.first").alias("first"))
    )
    # one row per range, their number is set by the partitions of a shuffle
    whole = Window.partitionBy(F.lit(0)).orderBy("range")
    edge = firsts.select("range", "first", F.coalesce(
        F.lag("range").over(whole), F.last("range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).alias("before"))
    edge = edge.select(F.col("range").alias("__of"), F.col("before").alias("__before"), "first")
    placed = docs.withColumn("__own", number)
    found = placed.join(F.broadcast(edge), (F.col("__own") == F.col("__of")) & F.col(f"`{doc_id}`").eqNullSafe(F.col("first")), "left")
    places = F.when(F.col("__before").isNull(), F.array(_place("__own", False))).otherwise(F.array(_place("__own", False), _place("__before", True)))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), F.inline(places))


def _place(range_: str, guest: bool) -> Column:
    return F.struct(F.col(range_).alias("__range"), F.lit(guest).alias("__guest"))


def _range(value: Column, edges: list[int], each: int) -> Column:
    """Number of the range: the edge at or below the value, then ``each`` even parts up to the next edge; never falls as the value grows."""
    known = F.array(*(F.lit(e) for e in edges))
    at = F.greatest(F.size(F.filter(known, lambda e: e <= value)), F.lit(1))
    low = F.element_at(known, at).cast("double")
    width = F.coalesce(F.get(known, at).cast("double") - low, F.lit(1.0))
    part = F.floor((value.cast("double") - low) / width * each).cast("bigint")
    return at.cast("bigint") * each + F.least(F.greatest(part, F.lit(0)), F.lit(each - 1))


def edited_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, of which the second half is the start of the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, distinct_shingles,
    held: the estimated share of the edited text's shingles that the text has.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    dealt = fingerprinted(in_ranges(rows, "doc_id").repartition("__range"), k=k)
    order = Window.partitionBy("__range").orderBy("__guest", F.col("doc_id").asc_nulls_first(), "text")
    seen = dealt.select(
        "doc_id", "text", "__guest", "fingerprint", F.lead("text").over(order).alias("next"), F.lead("fingerprint").over(order).alias("next_print")
    ).filter("NOT __guest")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = seen.select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_print",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)).alias("edited"),
    )
    prints = fingerprinted(edited, "edited", "edited_print", k)
    return prints.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.concat_ws("", "fingerprint").alias("fingerprint"), F.concat_ws("", "edited_print").alias("edited_fingerprint"),
        resemblance(F.col("fingerprint"), F.col("edited_print"), k).alias("near_edited"),
        resemblance(F.col("fingerprint"), F.col("next_print"), k).alias("near_next"),
        distinct_count(F.col("fingerprint"), k).alias("distinct_shingles"),
        containment(F.col("edited_print"), F.col("fingerprint"), k).alias("held"),
    )
