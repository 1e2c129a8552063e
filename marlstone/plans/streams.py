"""Streams replayed to their end over the tables, and their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.registry import Registry
from marlstone.runtime import ensure_checkpoint_dir, table
from marlstone.sources import files
from marlstone.streaming import sessions as T

R = Registry()


def _us(c: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


@R.add("""
SELECT user_id, session, min(t) AS "start", max(t) AS "end", count(*) AS n FROM (
  SELECT user_id, t, CAST(sum(CASE WHEN t - p > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
  FROM (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS p FROM events)) GROUP BY ALL""")
def t9_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.gap_sessions(table(spark, d, "events").withColumn("t", _us("ts")), key="user_id", at="t", seconds=1800)


@R.add()
def t3_session_stream(spark: SparkSession, d: str) -> DataFrame:
    return T.drain(T.sessions(T.replay(spark, f"{d}/events.parquet"), key="user_id", at="ts", gap="30 minutes"))


@R.add()
def t1_session_buffer(spark: SparkSession, d: str) -> DataFrame:
    turns = T.replay(spark, f"{d}/mem_ingest_request.parquet")
    spark_dir = f"{ensure_checkpoint_dir(spark)}/buffer-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{spark_dir}/out/batch={number}")

    stream = T.session_buffer(turns)
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{spark_dir}/state").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(*files.children(spark, f"{spark_dir}/out"))
    return seen.groupBy("session_id").agg(F.max_by(F.struct("last", "n_turns", "n_changed"), "batch").alias("s")).select("session_id", "s.*")


@R.add("SELECT request_id, count(DISTINCT content) AS n FROM mem_ingest_request GROUP BY 1")
def t10_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries again are dropped on the way; what is left is each request once."""
    r = T.replay(spark, f"{d}/mem_ingest_request.parquet").select("request_id", "received_at")
    once = T.drain(T.first_of_each(r, ["request_id"], at="received_at", late="1000 days"))
    return once.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


@R.add("""
SELECT epoch_us(w) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 29 DAY, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), INTERVAL 1 DAY)) AS w FROM events) GROUP BY ALL""")
def t7_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = T.sliding(table(spark, d, "events").withColumn("_utc", F.timestamp_micros(_us("ts"))), at="_utc", length="30 days", step="1 day")
    return e.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def t6_counted_batches(spark: SparkSession, d: str) -> DataFrame:
    base = f"{ensure_checkpoint_dir(spark)}/counts-{uuid.uuid4().hex}"
    T.count_into(T.replay(spark, f"{d}/events.parquet"), key="user_id", path=f"{base}/out", checkpoint=f"{base}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.sum("n").alias("n"))


QUERIES, SQL = R.queries, R.sql
