"""Streams of landed payloads and of reading-state transitions.

A batch run re-reads an overlap and relies on ids to import everything once. As a stream,
the checkpoint remembers what was read, and a batch that is repeated after a failure finds
its ids already there. Rules with a bound per source (the window, the undated baseline,
tombstones) are applied inside the batch: one global watermark cannot express them.

Windows, first syncs and states do not depend on how files are cut into batches: all batches
of a drain count from the cursors it started with, and of two transitions the later one
counts. Which source an item belongs to is decided by the first batch that brings it.
"""

import hashlib

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.collect import RunResult, collect_run
from ..plans.reading import change_states
from ..plans.store import DRAIN, Store
from ..schemas import WINDOW_HOURS
from ..session import ROWS_A_TASK, evenly_parallel


def file_stream(spark: SparkSession, folder: str, schema: StructType | str,
                pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with an explicit schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def first_within_overlap(rows: DataFrame, key: list[str], time: str,
                         hours: int = WINDOW_HOURS) -> DataFrame:
    """Rows of a key that follow one within the overlap are dropped, state beyond it as well.

    A key is sure to be dropped for ``hours`` after its first row and may come back later;
    which of several rows stays is the order of arrival. Files are expected in rough order
    of ``time``: what is older than the watermark is late and dropped.
    """
    return rows.withWatermark(time, f"{hours} hours").dropDuplicatesWithinWatermark(key)


def _drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str
           ) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _drains(spark: SparkSession, root: str) -> DataFrame:
    """Versions that drains began from, with when they began and whether they have ended."""
    try:
        return spark.read.schema(DRAIN).parquet(f"{root}/_drains")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], DRAIN)


def _start_version(spark: SparkSession, root: str, drain: str) -> tuple[int, int]:
    """``(number of the drain, version it began from)``; one that died is gone on with."""
    last = _drains(spark, root).where(F.col("drain") == drain).groupBy("began").agg(
        F.max("version").alias("version"), F.max("ended").alias("ended")).orderBy(F.desc("began")).first()
    if last and not last["ended"]:
        return last["began"], last["version"]
    began, version = (last["began"] + 1 if last else 0), Store(spark, root).version
    _mark(spark, root, drain, began, version, False)
    return began, version


def _mark(spark: SparkSession, root: str, drain: str, began: int, version: int, ended: bool) -> None:
    (spark.createDataFrame([(drain, began, version, ended)], _drains(spark, root).schema)
     .coalesce(1).write.mode("append").parquet(f"{root}/_drains"))


def collect_stream(root: str, payloads: DataFrame, sources: DataFrame, references: DataFrame,
                   now: Callable[[int], str], checkpoint: str,
                   report: Callable[[RunResult], None] = lambda result: None,
                   **options) -> StreamingQuery:
    """One gated run per micro-batch of all that has landed; ``now`` is asked per batch.

    Returns when the backlog is drained. Until then a source stays as far as it was at the
    start: one without a cursor is on its first sync in every batch, and windows begin where
    they would for a single batch. A drain that fails goes on from the same start when it is
    called again.
    """
    spark, drain = payloads.sparkSession, hashlib.sha256(checkpoint.encode()).hexdigest()
    began, version = _start_version(spark, root, drain)

    def each(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, root)
        since = Store(batch.sparkSession, root).refresh(version).read("cursors")
        report(collect_run(store, batch, sources, references, now(batch_id), since=since, **options))

    query = _drain(payloads, each, checkpoint)
    query.awaitTermination()
    _mark(spark, root, drain, began, version, True)
    return query


def transition_stream(root: str, transitions: DataFrame, checkpoint: str) -> StreamingQuery:
    """Fold reading-state transitions into the store, one version per micro-batch.

    A large batch is folded in more tasks, so that what one of them holds does not grow with it.
    Items ignored by a batch are listed as removed; of transitions that come later only
    those from before they were ignored still count.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession  # of the stream alone
        tasks = -(-batch.count() // ROWS_A_TASK)
        if tasks > int(own.conf.get("spark.sql.shuffle.partitions")):
            own.conf.set("spark.sql.shuffle.partitions", str(tasks))
        # A partial fold sorts what its task scans, all rows of a row group.
        change_states(Store(own, root), evenly_parallel(batch) if tasks > 1 else batch)

    return _drain(transitions, each, checkpoint)
