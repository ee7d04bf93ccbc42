"""Dictionary files: two-column CSV, key and value."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: Iterable[tuple], columns: Iterable[str]) -> DataFrame:
    """A small table of text and numbers kept inside the plan itself."""
    names = list(columns)
    made = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    if not made:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in names])
    return spark.range(1).select(F.inline(F.array(*made)))


def read_dictionary(
    spark: SparkSession, path: str, header: bool = False, missing_ok: bool = False
) -> DataFrame:
    """``key, value`` rows, one per key: both trimmed, a later line replaces an earlier one.

    A header line is an ordinary entry unless ``header`` is set. Lines with one column are left
    out. With ``missing_ok`` an absent file reads as an empty dictionary.
    """
    if missing_ok and not _exists(spark, path):
        return literal_table(spark, [], ["key", "value"])
    raw = (
        spark.read.schema("key string, value string, short string")
        .option("header", header)
        .option("columnNameOfCorruptRecord", "short")
        .csv(path)
    )
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return (
        raw.withColumn("place", place)
        .filter("value IS NOT NULL OR short IS NULL")
        .groupBy(F.trim(F.coalesce("key", F.lit(""))).alias("key"))
        .agg(F.max_by(F.trim(F.coalesce("value", F.lit(""))), "place").alias("value"))
    )


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
