"""Queries on request logs: streams driven over what is there, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.registry import query
from corvane.session import shared_folder, table
from corvane.streaming import budget


MINUTES = """WITH w AS (SELECT user_id, value, unnest([time_bucket(INTERVAL 30 SECONDS, ts), time_bucket(INTERVAL 30 SECONDS, ts) - INTERVAL 30 SECONDS]) AS start FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS requests, round(sum(value), 4) AS tokens FROM w GROUP BY 1, 2"""


CLOSED = MINUTES.replace("GROUP BY 1, 2", "GROUP BY ALL").replace("FROM w", "FROM w WHERE start + INTERVAL 60 SECONDS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES")


@query(CLOSED)
def streamed_usage(spark: SparkSession, d: str) -> DataFrame:
    """Sliding minutes as a stream into files: the windows that the watermark (10 minutes) has closed."""
    events = budget.request_log(spark, d, glob="events.parquet")
    return budget.run_once(budget.minute_usage(events), shared_folder(spark, "stream")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(MINUTES)
def sliding_usage(spark: SparkSession, d: str) -> DataFrame:
    return budget.minute_usage(table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""")
def trailing_usage(spark: SparkSession, d: str) -> DataFrame:
    return budget.trailing_usage(table(spark, d, "events")).select("event_id", "requests", "tokens")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def streamed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user by an incremental load into snapshots."""
    place = shared_folder(spark, "stream")
    stream = budget.request_log(spark, d, glob="events.parquet")
    budget.incremental_upsert(stream, f"{place}/snapshots", ["user_id"], F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")), f"{place}/log").awaitTermination()
    return spark.read.parquet(f"{place}/snapshots").groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("""WITH e AS (SELECT *, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400e6)::INT AS day FROM events),
t AS (SELECT event_id, day, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens, round(sum(value) OVER d, 4) AS day_tokens FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id, day ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT *, CASE WHEN tokens > 60 * 1.5 OR requests > 2 * 1.5 THEN 2.0 ELSE 0.0 END AS pause FROM t""")
def tracked_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage recorded without blocking, with a pause where a minute is far over its limits."""
    return budget.tracked(table(spark, d, "events"), tokens=60, requests=2).select("event_id", "day", "requests", "tokens", "day_tokens", "pause")


@query()
def admitted_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests admitted within a token budget of each user's trailing minute, as a stream into files."""
    admitted = budget.admissions(budget.request_log(spark, d, glob="events.parquet"), limit=100.0)
    return budget.run_once(admitted, shared_folder(spark, "stream"))
