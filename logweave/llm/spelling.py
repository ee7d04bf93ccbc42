"""Groups of spelling variants, by permuterm rotations.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased. A word is marked with
a terminator and all rotations of the marked word are sorted. What differs in one letter agrees in all the others, so
some rotation of it begins with the same letters, the differing one last or gone:

* a rotation without its last letter is a prefix range that skips this letter: all words of the range that are one letter
  longer than the range's prefix differ from each other by one replaced letter;
* the word of which the prefix is a whole rotation lacks just that letter.

So each range holds words that differ at one place, and at most one word without that place: no more words than there are
letters. It is scanned once for its two most frequent words, and a row per word goes out, not a row per pair. A letter that
can be dropped at several places (one of two equal neighbours) counts at the first of them.

A word's form is the near word found most often, if that is at least twice as often as the word itself; forms are followed
to their last word by doubling the steps, each round in a table of the shared folder, so a chain of n steps takes about
log2(n) rounds. Counts are summed per text, then per task, then by word.

Cases: a null text has no words. Repeated rows and ids count as often as they stand; a null id is written as an empty
text before the colon. Letters beyond A-Z keep their case. Tables without frequent words, or empty ones, give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import removed, shared_dir, slices, written

LEAST_LETTERS = 5
LEAST_COUNT = 3
DAMAGED = 97
"""A word of a text whose checksum this number divides loses a letter."""
END = "$"
"""The terminator; no letter of a word."""
HELD = 200_000
"""Distinct words that a task sums before it sends them on."""

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: str | None, damaged: int | None = DAMAGED) -> Counter[str]:
    """The words of a text and their numbers, some of them without a letter, as their checksums have it."""
    if not text:
        return Counter()
    found = Counter(_RUNS.findall(text.encode().lower().decode()))
    if damaged is None:
        return found
    out: Counter[str] = Counter()
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), head)
        if h % damaged == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def word_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damaged: int | None = DAMAGED, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT
) -> DataFrame:
    """Words of at least ``letters`` letters that occur at least ``least`` times in all texts: word, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for whole in batches:
            for part in slices(whole, "text"):
                for key, value in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for word, n in words_of(key, value, damaged).items():
                        if len(word) >= letters:
                            held[word] += n
                    if len(held) > HELD:
                        yield sent()
        yield sent()

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """Rows ``key, word, n, longer, first`` of words (word, n): rotations of the marked word.

    ``longer`` tells that the rotation goes on for one letter, which the key skips; ``first``, that the letter before the
    skipped one is another letter. The key of other rows is the whole rotation.
    """
    size = F.length("word")

    def turned(i: Column, skip: int) -> Column:
        """The marked word from the letter after place i (from 1) on, up to the letter before it, or that one too."""
        after = F.substring(F.col("word"), i + 1, size)
        return F.concat(after, F.lit(END), F.substring(F.col("word"), F.lit(1), i - skip))

    places = F.sequence(F.lit(1), size)
    skipping = F.transform(places, lambda i: F.struct(
        turned(i, 1).alias("key"), F.lit(True).alias("longer"),
        ((i == 1) | (F.substring(F.col("word"), i, F.lit(1)) != F.substring(F.col("word"), i - 1, F.lit(1)))).alias("first"),
    ))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(i, 0).alias("key"), F.lit(False).alias("longer"), F.lit(False).alias("first")))
    return words.select("word", "n", F.inline(F.concat(skipping, whole))).select("key", "word", "n", "longer", "first")


def near_words(words: DataFrame) -> DataFrame:
    """Of each word that has near ones: word, n_near, and the most frequent of them (the first in order among equals): best, best_n.

    Ranges are scanned in the order of their rotations: the best two words of the longer ones, the best of those that the
    shorter word counts, and the shorter word.
    """
    turned = rotations(words)
    rank = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    all_ = Window.partitionBy("key").orderBy("longer", F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer, first = F.col("longer"), F.col("longer") & F.col("first")
    scanned = turned.select(
        "key", "word", "n", "longer", "first", rank.alias("rank"),
        F.count(F.when(longer, 1)).over(all_).alias("m"),
        F.count(F.when(first, 1)).over(all_).alias("m_first"),
        F.min(F.when(~longer, rank)).over(all_).alias("short"),
        F.min(F.when(longer, rank)).over(all_).alias("top"),
        F.min(F.when(first, rank)).over(all_).alias("top_first"),
        F.nth_value(F.when(longer, rank), 2, ignoreNulls=True).over(all_).alias("second"),
    )
    others = F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top"))
    shorter = F.when(first, F.col("short"))
    met = scanned.select(
        "word",
        F.when(longer, F.col("m") - 1 + shorter.isNotNull().cast("long")).otherwise(F.col("m_first")).alias("met"),
        F.when(longer, F.least(others, shorter)).otherwise(F.col("top_first")).alias("best"),
    ).filter("met > 0")
    found = met.groupBy("word").agg(F.sum("met").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """From words and their forms (word, form; a form has rows of its own) to the last form of each: word, root."""
    spark = forms.sparkSession
    path = shared_dir(spark)
    now = written(forms.select("word", F.coalesce("form", "word").alias("root")), path)
    while True:
        onward = now.filter("root <> word").select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = now.join(onward, now["root"] == onward["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        old, path = path, shared_dir(spark)
        after = written(moved, path)
        removed(spark, old)
        now = after.select("word", "root")
        if after.filter("went").isEmpty():
            return now


def spelling_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damaged: int | None = DAMAGED, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT
) -> DataFrame:
    """Of each word: word, form, root, n, n_near, form_n."""
    words = written(word_counts(docs, doc_id, text, damaged, letters, least))
    joined = words.join(near_words(words), "word", "left")
    better = F.col("best_n") >= 2 * F.col("n")
    known = written(joined.select(
        "word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best_n")).alias("form_n"),
    ))
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")
