"""Structured Streaming twins of the event queries."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.session import shared_folder


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream over Parquet files of a folder; its ts is a timestamp, so that it can carry a watermark."""
    rows = spark.readStream.schema(like.schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, every: str, keys: tuple[str, ...] = ("event_type",), late: str = "1 day") -> DataFrame:
    """(window_start, keys, n, total): tumbling windows; the watermark bounds the state of a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    counts = marked.groupBy(F.window("ts", every), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n", F.round(F.col("total").cast("double"), 2).alias("total"))


def first_in_ttl(events: DataFrame, keys: list[str], ttl: str) -> DataFrame:
    """A stream's events without those that repeat a key within its time to live."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(user_id, started, ended, n): runs of a user's events with gaps under ``gap``."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    runs = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def stream_folder(spark: SparkSession, name: str, folder: str | None) -> str:
    """The folder of a stream's state and results. Given again it goes on where it was; by default each call has its own."""
    return folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def batches_of(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the batches that a stream has written, in this run and the ones before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def run_available(stream: DataFrame, name: str, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Run a stream over what is there and new into Parquet in its folder, one folder a batch, and read the result: all
    batches, or the last one where it is complete by itself. A batch that is run again overwrites its folder, and a stream
    that is given its folder again goes on after the last batch, so results are exact after a restart."""
    spark = stream.sparkSession
    base = stream_folder(spark, name, folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = batches_of(spark, base)
    paths = [f"{base}/out/batch={n}" for n in (done[-1:] if mode == "complete" else done)]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


SEEN = T.StructType([T.StructField("seen", T.BooleanType())])


def poll_new(stream: DataFrame, key: str, order: tuple[str, ...], name: str, folder: str | None = None) -> DataFrame:
    """The rows of a stream whose key no earlier batch has brought, of each key the first in order. What is known of a key is
    one bit of state, so a batch costs its own rows, however many came before. A null key is a key."""

    def step(_, frames, state):
        if state.exists:
            for _ in frames:
                pass
            return
        first = None
        for rows in frames:
            here = rows.sort_values(list(order)).iloc[:1]
            first = here if first is None else pd.concat([first, here]).sort_values(list(order)).iloc[:1]
        state.update((True,))
        yield first

    news = stream.groupBy(key).applyInPandasWithState(step, stream.schema, SEEN, "append", "NoTimeout")
    return run_available(news, name, "append", folder)


def without_deleted(archive: DataFrame, deletions: DataFrame, key: str, name: str, folder: str | None = None) -> DataFrame:
    """The rows of an archive that no event of the stream of deletions (key) has named."""
    gone = poll_new(deletions, key, (key,), name, folder).select(F.col(key).alias("gone"))
    return archive.join(gone, F.col(key) == F.col("gone"), "left_anti")
