"""Counters, timers and gauges of the engine."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTERS = (
    "ingest.accepted.records", "ingest.accepted.bytes", "ingest.rejected", "persist.records", "persist.bytes", "flush.by.size", "flush.by.age", "flush.failures", "blocks.published",
    "search.blocks.candidates", "search.blocks.scanned", "search.blocks.pruned", "search.blocks.skipped", "search.queries.timed_out", "search.queries.rejected",
)
TIMERS = ("flush.duration", "search.duration")
GAUGES = ("queue.bytes", "buffer.bytes", "search.queries.active", "search.scan_permits.free", "catalog.unavailable")


class Metrics:
    def __init__(self):
        self._lock = threading.Lock()
        self._values: dict[str, float] = defaultdict(float, dict.fromkeys([*COUNTERS, *GAUGES], 0.0))

    def add(self, name: str, n: float = 1) -> None:
        with self._lock:
            self._values[name] += n

    def gauge(self, name: str, value: float) -> None:
        with self._lock:
            self._values[name] = value

    def time(self, name: str, ms: float) -> None:
        self.add(f"{name}.count")
        self.add(f"{name}.ms", ms)

    def values(self) -> dict[str, float]:
        with self._lock:
            return dict(self._values)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in sorted(self.values().items())], "name string, value double")

    def save(self, spark: SparkSession, root: str) -> None:
        """Appends what is counted so far, with the time, to the metrics table under root."""
        self.frame(spark).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/metrics")
