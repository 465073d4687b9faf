"""Incremental forms of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shared import shared_path


#: Keeps state on the executors' disks, so that it may exceed their memory; a checkpoint stays with the kind it began with.
ON_DISK = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def finished(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None, conf: Mapping[str, str] | None = None) -> DataFrame:
    """Runs a stream over all there is now, into Parquet (append) or by whole batches (update), and reads the result.

    With the `folder` of an earlier run, the stream goes on from its checkpoint and adds to its result.  conf: settings of this stream alone.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        return _finished(stream, name, mode, folder)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _finished(stream: DataFrame, name: str, mode: str, folder: str | None) -> DataFrame:
    spark = stream.sparkSession
    folder = folder or shared_path(spark, name)
    out, state = f"{folder}/out", f"{folder}/state"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).start().awaitTermination()  # a replay overwrites
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.parquet(out).withColumn("epoch", F.col("epoch").cast("long"))


def ingested(spark: SparkSession, folder: str, file: str, schema: str, max_files: int = 1, max_bytes: int | None = None) -> DataFrame:
    """A resumable scan of a folder: the checkpoint remembers the files that have been read.  A batch has max_files files or, if given, about max_bytes."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", max_files) if max_bytes is None else reader.option("maxBytesPerTrigger", max_bytes)).parquet(folder)


def ingest_once(spark: SparkSession, inbox: str, file: str, schema: str, uid: str, folder: str, max_bytes: int = 256 << 20) -> DataFrame:
    """All rows of the inbox's files so far, each uid once, whatever file it comes in again and however often the scan is started.

    The file checkpoint skips files that have been read, the state knows the uids that were in them, and the sink's log names the files
    of finished batches, so a batch that was cut off adds nothing twice.  State is an entry a uid for ever, by uid over all
    tasks and on disk.  Null is a uid like others.
    """
    once = ingested(spark, inbox, file, schema, max_bytes=max_bytes).dropDuplicates([uid])
    return finished(once, "ingest", folder=folder, conf=ON_DISK)


def deduplicated(stream: DataFrame, uid: str, ts: str, within: str = "400 days") -> DataFrame:
    """The first row of each uid; its state goes when the watermark has passed."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([uid])


def capped(stream: DataFrame, key: str, most: int) -> DataFrame:
    """The rows of each key that arrive first, `most` in all; the state is one counter per key, kept over restarts."""

    def passed(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else 0
        for batch in batches:
            part = batch.iloc[: max(0, most - had)]
            had += len(part)
            if len(part):
                yield part
        state.update((had,))

    return stream.groupBy(key).applyInPandasWithState(passed, stream.schema.simpleString()[7:-1].replace(":", " "), "n long", "append", GroupStateTimeout.NoTimeout)


def scored_once(stream: DataFrame, uid: str, score: Callable[[DataFrame], DataFrame], error: str, out: str, done: DataFrame | None = None) -> None:
    """Scores rows whose uid is in no result yet, and adds results to out/ok and failures to out/failed, a folder an epoch.

    What is done is read from the results written by earlier epochs (`done`: results from before the stream).  A replayed epoch
    looks at the same earlier ones and overwrites its own folder, so nothing is written twice.
    """
    spark = stream.sparkSession

    def write(scored: DataFrame, epoch: int) -> None:
        scored = scored.persist()
        scored.where(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(f"{out}/ok/epoch={epoch}")
        scored.where(F.col(error).isNotNull()).write.mode("overwrite").parquet(f"{out}/failed/epoch={epoch}")
        scored.unpersist()

    def each(batch: DataFrame, epoch: int) -> None:
        earlier = [spark.read.parquet(f"{out}/{kind}").where(F.col("epoch") < epoch).select(uid) for kind in ("ok", "failed")]
        write(score(batch.dropDuplicates([uid]).join(earlier[0].unionByName(earlier[1]), uid, "left_anti")), epoch)

    started = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ok/epoch=-1")
    if not started.getFileSystem(spark._jsc.hadoopConfiguration()).exists(started):
        empty = score(spark.createDataFrame([], stream.schema))
        write(empty if done is None else empty.unionByName(done, allowMissingColumns=True), -1)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def rate(stream: DataFrame, ts: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Rows per kind in sliding windows of 30 minutes, every 5; rows later than the watermark are dropped."""
    windowed = stream.withWatermark(ts, late).groupBy(F.window(ts, "30 minutes", "5 minutes"), kind).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("window.start").alias("start"), kind, "n")


def bursts(stream: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """Rows per key in windows of 14 days on a grid of one day: never above the exact count of any 14 days."""
    windowed = stream.withWatermark(ts, late).groupBy(F.window(ts, "14 days", "1 day"), key).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("window.start").alias("start"), key, "n")
