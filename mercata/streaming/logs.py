"""The log operators on streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StructType

from mercata.operators.logs import admit


def windowed_route_metrics(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean duration by window and route; rows later than ``late`` are dropped by the watermark."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", window).alias("w"), "route").agg(
        F.count("*").alias("requests"), F.avg("duration").alias("avg_duration"), F.count_if("is_error").alias("errors")
    )
    return out.select(F.col("w.start").alias("start"), "route", "requests", "avg_duration", "errors")


def session_stream(log: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"))
    return out.select("key", F.col("w.start").alias("start"), "requests")


class Limiter(StatefulProcessor):
    """State of a key: the times of its allowed hits in the window, at most ``limit``; it goes when the window after the last has passed."""

    def __init__(self, limit: int, micros: int):
        self.limit, self.micros = limit, micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hits", "at array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        hits = deque(held[0] if held else ())
        for row in sorted(rows, key=lambda r: r["_t"]):
            allowed = admit(hits, row["_t"], self.limit, self.micros)
            values = {k: v for k, v in row.asDict().items() if k != "_t"}
            yield Row(**values, allowed=allowed, remaining=self.limit - len(hits))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if hits:
            self.state.update((list(hits),))
            self.handle.registerTimer((hits[-1] + self.micros) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def limiter_stream(log: DataFrame, limit: int = 30, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """``log`` plus allowed and remaining as hits come: what ``operators.logs.limiter`` tells, if batches come in order of time; rows of null key or ts are left out.

    The session's state store must be RocksDB. Hits of a batch are taken by ts; later than ``late`` they are dropped by the watermark.
    """
    timed = log.where("key IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = StructType(list(timed.schema.fields)).add("allowed", BooleanType()).add("remaining", IntegerType())
    timed = timed.withColumn("_t", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithState(statefulProcessor=Limiter(limit, seconds * 1_000_000), outputStructType=out, outputMode="Append", timeMode="EventTime")
