"""The event feed of a conversion as streams.

State is bounded by watermarks: an id is remembered, and a page waits for its late zones, no longer than the delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """JSON files of a folder as they arrive; ``ts`` (epoch seconds) becomes a timestamp."""
    return spark.readStream.schema(schema).json(path).withColumn("at", F.timestamp_seconds("ts"))


def once_per_id(log: DataFrame, ident: str, at: str = "at", delay: str = "1 hour") -> DataFrame:
    return log.withWatermark(at, delay).dropDuplicatesWithinWatermark([ident])


def with_late_zones(read: DataFrame, zones: DataFrame, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """Pages joined with the zones that arrive after them, or with none once the delay is over. Both have ``at``."""
    a, b = read.withWatermark("at", delay).alias("a"), zones.withWatermark("at", delay).withColumnRenamed("at", "zone_at").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("b.zone_at") >= F.col("a.at"), F.col("b.zone_at") <= F.col("a.at") + F.expr(f"INTERVAL {delay}")]
    return a.join(b, on, "left_outer").select("a.*", *[F.col(f"b.{c}").alias(f"zone_{c}") for c in zones.columns if c not in (*key, "at")], "b.zone_at")


def sessions(log: DataFrame, key: list[str], at: str = "at", gap: str = "600 seconds", delay: str = "1 hour") -> DataFrame:
    """Work sessions: events of a key without a longer pause."""
    w = F.session_window(at, gap)
    return log.withWatermark(at, delay).groupBy(*key, w).agg(F.count("*").alias("events")).select(*key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def progress(log: DataFrame, key: list[str]) -> DataFrame:
    """Per key: events done, the total announced, and seconds since the first."""
    return log.groupBy(*key).agg(F.sum((F.col("type") == "page_read").cast("int")).alias("done"), F.max("total").alias("total"), (F.max("ts") - F.min("ts")).alias("elapsed"))


def last_success(log: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """For each key the reading that holds so far: the last success, else the last failure. One small state per key, dropped after the delay."""
    out = "key string, ts double, success boolean, raw string"

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        for f in frames:
            for r in f.sort_values("ts").itertuples(index=False):
                now = (float(r.ts), bool(r.success), r.raw)
                if best is None or (now[1], now[0]) >= (best[1], best[0]):
                    best = now
        state.update(best)
        state.setTimeoutTimestamp(max(int(best[0] * 1000), state.getCurrentWatermarkMs() + 1) + 3_600_000)
        yield pd.DataFrame([(k[0], *best)], columns=["key", "ts", "success", "raw"])

    rows = log.withWatermark("at", delay).select(F.col(key).alias("key"), "at", F.unix_micros("at").cast("double").alias("us"), "success", "raw").withColumn("ts", F.col("us") / 1e6)
    return rows.groupBy("key").applyInPandasWithState(update, out, "ts double, success boolean, raw string", "update", "EventTimeTimeout")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what has arrived and stop; the next run goes on from the checkpoint."""
    stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
