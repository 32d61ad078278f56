"""Request budgets and incremental loads as structured streams; each has a batch form with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from corvane import schemas


def request_log(spark: SparkSession, path: str, files_per_trigger: int = 1, glob: str = "*.parquet") -> DataFrame:
    """A stream of request events from the Parquet files in a folder, a bounded number per trigger."""
    return spark.readStream.schema(schemas.REQUEST_LOG).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def minute_usage(events: DataFrame, slide: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """(start, user_id, requests, tokens) over sliding minutes; events later than ``late`` are dropped on streams only."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", "60 seconds", slide).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 4).alias("tokens")).select(F.col("w.start").alias("start"), "user_id", "requests", "tokens")


def trailing_usage(events: DataFrame, key: str = "user_id", seconds: int = 60) -> DataFrame:
    """Adds requests and tokens of the trailing window up to each event, per key."""
    w = Window.partitionBy(key).orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("requests", F.count(F.lit(1)).over(w)).withColumn("tokens", F.round(F.sum("value").over(w), 4))


def tracked(events: DataFrame, tokens: float, requests: int, key: str = "user_id", over: float = 1.5, pause: float = 2.0) -> DataFrame:
    """The tracker that never blocks: adds requests and tokens of the trailing minute, the tokens of the day so far, and the pause.

    A pause of ``pause`` seconds follows where the minute exceeds ``over`` times one of the limits. Days are periods of 24 hours
    from the key's first event; their tokens are recorded and not limited.
    """
    at = F.col("ts").cast("timestamp").cast("double")
    day = F.floor((at - F.min(at).over(Window.partitionBy(key))) / 86400).cast("int")
    out = trailing_usage(events.withColumn("day", day), key)
    so_far = F.sum("value").over(Window.partitionBy(key, "day").orderBy(at).rangeBetween(Window.unboundedPreceding, 0))
    paused = (F.col("tokens") > tokens * over) | (F.col("requests") > requests * over)
    return out.withColumn("day_tokens", F.round(so_far, 4)).withColumn("pause", F.when(paused, pause).otherwise(0.0))


class _Admission(StatefulProcessor):
    """Per key: the admitted events of the last minute; an event is admitted if it fits below the limit."""

    limit, seconds = 100.0, 60.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at double, tokens double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = [(float(a), float(t)) for a, t in self.recent.get()]
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for r in batch.itertuples():
            now = r.ts.timestamp()
            held = [(a, t) for a, t in held if a > now - self.seconds]
            admitted = sum(t for _, t in held) + r.value <= self.limit
            if admitted:
                held.append((now, float(r.value)))
            out.append((r.event_id, key[0], admitted))
        if held:
            self.recent.put(held)
        else:
            self.recent.clear()
        yield pd.DataFrame(out, columns=["event_id", "user_id", "admitted"])

    def close(self) -> None:
        pass


def admissions(events: DataFrame, limit: float = 100.0, seconds: float = 60.0) -> DataFrame:
    """(event_id, user_id, admitted): admission control with a token budget per key and trailing window, headroom included in ``limit``."""
    # keyed state needs column families, which the default store lacks
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = type("Admission", (_Admission,), {"limit": float(limit), "seconds": float(seconds)})()
    return events.groupBy("user_id").transformWithStateInPandas(processor, "event_id bigint, user_id bigint, admitted boolean", "append", "none")


def incremental_upsert(stream: DataFrame, target: str, key: list[str], order: Column, checkpoint: str):
    """Start a stream that keeps the last row of each key in snapshot folders under ``target``; exactly once by batch id."""
    from corvane.operators.consolidate import first_of

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(p.getPath().getName().split("=")[1]) for p in fs.listStatus(hadoop) if "snapshot=" in p.getPath().getName()) if fs.exists(hadoop) else []
        before = [n for n in done if n < number]
        rows = batch
        if before:
            old = spark.read.parquet(f"{target}/snapshot={before[-1]}")
            rows = old.join(batch.select(*key).distinct(), key, "left_anti").unionByName(batch)
        first_of(rows, key, order).write.mode("overwrite").parquet(f"{target}/snapshot={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, place: str) -> DataFrame:
    """Drive a stream over what is there now into Parquet files below ``place``, exactly once; what the watermark holds back comes with
    later input."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")


def event_schema() -> StructType:
    return StructType.fromDDL(schemas.REQUEST_LOG)
