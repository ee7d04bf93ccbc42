"""Running chains on streams.

Chains are stateless, so ``chain.apply(stream)`` is a streaming DataFrame like any other and lookups
become stream-static joins. This module adds dictionaries that are read again while a stream runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Hashable, Iterable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.operators.lookup import Lookup
from logweave.pipeline import Chain
from logweave.plans.audit import change_totals

# Seconds after which each dictionary is read again.
REFRESH_SECONDS = {"rule_names": 60, "port_names": 300, "private_hosts": 600}


class RefreshingTable:
    """A lookup that is built again when it is older than ``seconds``."""

    def __init__(self, build: Callable[[], Lookup], seconds: float):
        self._build, self._seconds = build, seconds
        self._made: Lookup | None = None
        self._at = 0.0

    def current(self) -> Lookup:
        if self._made is None or time.monotonic() - self._at >= self._seconds:
            self._made, self._at = self._build(), time.monotonic()
        return self._made


class VersionedTable:
    """A lookup over a table of which new versions are published while a stream runs; built once for each version.

    ``version`` is asked before each micro-batch: a number, a file name, the time of a commit; anything that can be compared.
    """

    def __init__(self, version: Callable[[], Hashable], build: Callable[[], Lookup]):
        self.version, self._build = version, build
        self._made: tuple[Hashable, Lookup] | None = None

    def current(self) -> Lookup:
        now = self.version()
        if self._made is None or self._made[0] != now:
            self._made = (now, self._build())
        return self._made[1]


class _NewVersion(Exception):
    pass


def stream_versions(
    stream: Callable[[], DataFrame],
    chain: Callable[[], Chain],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    tables: Iterable[VersionedTable],
    available_now: bool = False,
    every: str = "10 seconds",
) -> int:
    """Run ``chain()`` on ``stream()`` with tables that change between micro-batches; returns how many plans that took.

    The chain is planned once, as a stream, and serves all batches until a table has a new version. The batch that finds one
    is not written: the query ends, and goes on from the same checkpoint, with that batch, under a plan with the new version.
    Chains hold no state, so a checkpoint fits every version. Blocks until the source is exhausted or the query is stopped.
    """
    listed, plans = list(tables), 0
    while True:
        planned = [t.version() for t in listed]
        plans += 1
        swapped: list[bool] = []

        def one(batch: DataFrame, batch_id: int, planned=planned, swapped=swapped) -> None:
            if [t.version() for t in listed] != planned:
                swapped.append(True)
                raise _NewVersion
            write(batch, batch_id)

        writer = chain().apply(stream()).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not swapped:
                raise
            continue
        return plans


def stream_totals(audited: DataFrame, path: str, checkpoint: str, available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Keep ``change_totals`` of a stream with audit records: each batch writes the totals that it changed.

    The sums are state of the stream, a row for each stage; ``latest_totals`` reads them.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    writer = change_totals(audited).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The last totals of each stage that ``stream_totals`` wrote."""
    written = spark.read.parquet(path)
    body = [c for c in written.columns if c not in ("stage", "batch")]
    last = written.groupBy("stage").agg(F.max_by(F.struct(*body), "batch").alias("last"))
    return last.select("stage", "last.*")


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """Folder for a stream's progress under the shared folder the cluster names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{root.rstrip('/')}/{name}"


def stream_chain(
    stream: DataFrame,
    chain: Callable[[], Chain],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
    every: str = "10 seconds",
    tables: Iterable[RefreshingTable] = (),
) -> StreamingQuery:
    """Run ``chain()`` on a stream and hand each micro-batch of the result to ``write(batch, batch_id)``.

    Without ``tables`` the chain is built once, for the whole stream. With them it is built for each batch, so that what
    they refreshed takes effect; choose ``every`` longer than building takes. A batch may be delivered again after a
    failure: ``write`` must replace what an earlier try of the same id left.
    """
    fresh = bool(list(tables))

    def one(batch: DataFrame, batch_id: int) -> None:
        write(chain().apply(batch) if fresh else batch, batch_id)

    writer = (stream if fresh else chain().apply(stream)).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
