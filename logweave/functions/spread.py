"""Numbers to spread rows by, from what the rows hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.paths import quoted

SPREAD = 1 << 20


ROW_TAG = "@metadata.row_tag"
"""Column of numbers that a source may give its rows; see ``tag_rows``."""


def tag_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Give the rows of a source their numbers, from the columns named (such as file and offset), for lookups to spread by."""
    return df.withColumn(ROW_TAG, F.xxhash64(*(F.col(quoted(c)) for c in columns)))


def source_tag(df: DataFrame) -> Column:
    """A number per row from one column of a source: its own numbers, else the raw line, else its first plain column.

    Just one column is read, however wide the rows become later, and a task that runs again gets the same numbers.
    """
    plain = [name for name, kind in df.dtypes if not kind.startswith(("variant", "map<", "struct<", "array<"))]
    if ROW_TAG in plain:
        return F.col(quoted(ROW_TAG))
    if not plain:
        return F.lit(0).cast("bigint")
    return F.xxhash64(F.col(quoted("message" if "message" in plain else plain[0])))


def row_spread(df: DataFrame) -> Column:
    """A number per row that depends on its values only.

    A task that runs again, on whatever order of rows a shuffle gives it, gets the same numbers. Rows that are equal in
    all plain columns share theirs.
    """
    plain = [F.col(quoted(name)) for name, kind in df.dtypes if not kind.startswith(("variant", "map<", "struct<", "array<"))]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")
