"""Stateful processes over streams of events and conversation turns.

All functions take streaming or batch frames where the engine allows both.
Sinks write below the shared checkpoint folder, so a restarted query goes on
where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.runtime import ensure_checkpoint_dir


def replay(spark: SparkSession, path: str, *, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files below a path as a stream, with their own schema."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent()))  # a stream reads folders


def drain(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into files of the shared folder, and read these."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def sessions(events: DataFrame, *, key: str, at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): activity of each key split where it pauses for `gap` or longer; a session comes out once the watermark has passed it."""
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    e = e.withWatermark("_at", late) if events.isStreaming else e
    return e.groupBy(F.session_window("_at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def gap_sessions(events: DataFrame, *, key: str, at: str, seconds: float) -> DataFrame:
    """(key, session, start, end, n) of a batch: a pause longer than `seconds` begins a new session. `at` is in microseconds."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > seconds * 1_000_000).cast("int"), F.lit(0))
    numbered = events.select(key, at).withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))


def first_of_each(events: DataFrame, keys: list[str], *, at: str, late: str = "1 day") -> DataFrame:
    """Events whose keys were not seen before (within the watermark, on a stream)."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")


def sliding(events: DataFrame, *, at: str, length: str, step: str, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total): sliding windows of counts and sums."""
    e = events.withColumn("_at", F.col(at).cast("timestamp"))
    e = e.withWatermark("_at", late) if events.isStreaming else e
    return e.groupBy(F.window("_at", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


_STATE = "last int, n_turns int, n_changed int"
_OUT = "session_id string, last int, n_turns int, n_changed int"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, n, changed = state.get if state.exists else (0, 0, 0)
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["received_at", "request_id"], kind="stable")
    for t in rows["turn_index"].fillna(0).astype(int):
        if t <= 0:
            last, n = last + 1, n + 1
        elif t > last:
            last, n = t, n + 1
        else:
            changed += 1
    state.update((last, n, changed))
    newest = int(rows["received_at"].max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(newest + 1_800_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(key[0], last, n, changed)], columns=["session_id", "last", "n_turns", "n_changed"])


def session_buffer(turns: DataFrame) -> DataFrame:
    """(session_id, last, n_turns, n_changed) after each batch, from a stream of turns (session_id, turn_index, request_id, received_at).

    A missing or non-positive index goes after the last one; an index that is
    not beyond the last counts as a change of a turn. The state of a session is
    three numbers and is given up when the watermark is half an hour past its
    last turn.
    """
    t = turns.select("session_id", "turn_index", "request_id", F.col("received_at").cast("timestamp").alias("received_at")).where("session_id is not null and received_at is not null").withWatermark("received_at", "1 hour")
    return t.groupBy("session_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def count_into(stream: DataFrame, *, key: str, path: str, checkpoint: str, every: str = "30 seconds", once: bool = False):
    """Start a query that adds each micro-batch's counts per key, as one small file, to a table at `path`; sum them to read."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is tried again replaces itself

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
