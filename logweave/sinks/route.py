"""Routing by dataset and namespace, and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.frame import flatten, to_nested
from logweave.functions.spread import row_spread
from logweave.paths import quoted
from logweave.plans.fixed import FALLBACK_DATASET, FALLBACK_NAMESPACE, STREAM_TYPE

ROUTE = ("stream_type", "stream_dataset", "stream_namespace")
BATCH = "batch"


def route(df: DataFrame) -> DataFrame:
    """Add the three route columns; rows lacking dataset or namespace go to the fallback route."""
    df = flatten(df)

    def leaf(name: str):
        return F.col(quoted(name)) if name in df.columns else F.lit(None).cast("string")

    dataset, namespace = leaf("data_stream.dataset"), leaf("data_stream.namespace")
    routed = dataset.isNotNull() & namespace.isNotNull()
    return df.withColumns(
        {
            "stream_type": F.lit(STREAM_TYPE),
            "stream_dataset": F.when(routed, dataset).otherwise(FALLBACK_DATASET),
            "stream_namespace": F.when(routed, namespace).otherwise(FALLBACK_NAMESPACE),
        }
    )


def _nested(df: DataFrame, spread: int | None = None) -> DataFrame:
    routed = route(df)
    if spread is not None:  # from the flat columns, all of which count
        routed = routed.withColumn("__spread", F.pmod(row_spread(routed), F.lit(spread)))
    body = [c for c in routed.columns if c not in ROUTE]
    return to_nested(routed.select(*[F.col(quoted(c)) for c in (*body, *ROUTE)]))


def write_routed(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "append",
    files_per_route: int | None = None,
    max_records_per_file: int = 5_000_000,
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery | None:
    """Write nested records under type / dataset / namespace folders, batch or stream.

    Without ``files_per_route`` nothing is shuffled and each task writes to the routes it holds.
    With it, every route is spread over that many tasks, so one route with most of the rows does
    not end up in one task. A stream takes what there is and ends, or runs on under ``trigger``, such as
    ``{"processingTime": "10 seconds"}``.
    """
    out = _nested(df, files_per_route)
    if files_per_route is not None:
        out = out.repartition(*ROUTE, "__spread").drop("__spread")
    if df.isStreaming:
        writer = out.writeStream.format(fmt).partitionBy(*ROUTE).trigger(**(trigger or {"availableNow": True}))
        return writer.option("path", path).option("checkpointLocation", checkpoint).start()
    (
        out.write.format(fmt).mode(mode).partitionBy(*ROUTE)
        .option("maxRecordsPerFile", max_records_per_file).save(path)
    )
    return None


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet", files_per_route: int | None = None) -> None:
    """Write one batch under ``batch`` / type / dataset / namespace folders, for ``foreachBatch`` or a dated batch job.

    What an earlier try of the same batch has left is replaced, whatever routes it wrote, so a batch that is delivered
    again is there once.
    """
    write_routed(df, f"{path.rstrip('/')}/{BATCH}={batch_id}", fmt, mode="overwrite", files_per_route=files_per_route)


def read_routed(spark: SparkSession, path: str, fmt: str = "parquet", dataset: str | None = None) -> DataFrame:
    """What ``write_routed`` or ``write_batch`` wrote, with the route (and batch) from the folders; ``dataset`` reads that folder alone."""
    found = spark.read.option("mergeSchema", True).format(fmt).load(path)
    return found if dataset is None else found.filter(F.col("stream_dataset") == dataset)


def export_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON lines, empty fields left out."""
    to_nested(flatten(df)).write.mode(mode).json(path)
