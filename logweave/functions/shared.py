"""Tables between jobs, in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    A session on one machine (a local master, as in tests) that names none gets a temporary one; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL:
        made = tempfile.TemporaryDirectory(prefix="logweave-", ignore_cleanup_errors=True)
        atexit.register(made.cleanup)
        _LOCAL.append(made)
    return _LOCAL[0].name


_LOCAL: list[tempfile.TemporaryDirectory] = []


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A name below the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once and read back: one short plan for all who use it, which lost executors do not touch."""
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
