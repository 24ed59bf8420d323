"""Admission, buffering and publishing.

Ingestor takes small batches by call: whole batches are admitted or refused, buffered per tenant, and published as
blocks by size, by age, or at the end. stream_ingest() does the same for a stream of files. Whatever was accepted is
counted as persisted or lost in the end.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import defaultdict, deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import functions as X
from tidemark.operators.cutting import cut
from tidemark.plans.request import batch_errors, instant_ms
from tidemark.schema import INPUT, InvalidRequest, Limits, Overloaded, Unavailable
from tidemark.sources.blocks import BlockStore
from tidemark.streaming.budget import ByteBudget
from tidemark.streaming.metrics import Metrics


def record_bytes(message: str, tags: dict[str, str]) -> int:
    return 18 + len(message.encode()) + sum(4 + len(k.encode()) + len(v.encode()) for k, v in tags.items())


@dataclass
class _Buffer:
    rows: list[tuple] = field(default_factory=list)
    size: int = 0
    since: float = 0.0


class Ingestor:
    """`clock` gives seconds. Batches may come from several threads: each reserves its bytes of the queue's budget (its
    tenant's share and the whole) and queues; one thread at a time moves what is queued to the tenants' buffers, whose
    budget takes the bytes over, and publishes blocks."""

    def __init__(self, store: BlockStore, clock=time.monotonic, metrics: Metrics | None = None):
        self.store, self.limits, self.clock, self.metrics = store, store.limits, clock, metrics or Metrics()
        self.queued = ByteBudget(self.limits.queue_bytes, self.limits.tenant_queue_bytes)
        self.held = ByteBudget(self.limits.buffer_bytes)
        self.queue: deque[tuple[str, list[tuple], list[int]]] = deque()
        self.buffers: dict[str, _Buffer] = defaultdict(_Buffer)
        self.healthy, self.closed = True, False
        self.accepted_records = self.accepted_bytes = self.persisted_records = self.persisted_bytes = self.lost_records = 0
        # The first is held by the one thread that moves and publishes, the second only to count.
        self._moving, self._counting = threading.RLock(), threading.Lock()

    @property
    def buffered_bytes(self) -> int:
        return self.held.in_use

    def ingest(self, tenant_id: str | None, records: list[dict] | None, drain: bool = True) -> dict:
        """Takes a whole batch, or raises InvalidRequest, Overloaded or Unavailable and takes none of it. Without `drain` it stays queued until drain()."""
        if errors := batch_errors(tenant_id, records, self.limits):
            raise InvalidRequest(errors)
        rows = []
        for r in records:
            try:
                rows.append((instant_ms(r["timestamp"]), dict(r.get("tags") or {}), r["message"]))
            except ValueError:
                raise InvalidRequest([f"Invalid timestamp: {r['timestamp']}"]) from None
        sizes = self._admit(tenant_id, rows)
        with self._counting:
            self.accepted_records += len(rows)
            self.accepted_bytes += sum(sizes)
        self.metrics.add("ingest.accepted.records", len(rows))
        self.metrics.add("ingest.accepted.bytes", sum(sizes))
        self.queue.append((tenant_id, rows, sizes))
        self.metrics.gauge("queue.bytes", self.queued.in_use)
        if drain:
            self.drain()
        return {"accepted_records": len(rows), "durability": "buffered"}

    def _admit(self, tenant_id: str, rows: list[tuple]) -> list[int]:
        """In this order: shutting down, unhealthy, catalog full, a record too large, the tenant's share and the queue's budget, which are reserved."""
        if self.closed:
            raise Unavailable("shutting down")
        if not self.healthy:
            self.metrics.add("ingest.rejected")
            raise Unavailable("persistence is unhealthy")
        if self.store.is_full():
            self.metrics.add("ingest.rejected")
            raise Overloaded("the catalog is full")
        sizes = [record_bytes(m, t) for _, t, m in rows]
        if max(sizes) > self.limits.max_record_bytes:
            raise InvalidRequest([f"Record exceeds maximum size: {self.limits.max_record_bytes} bytes"])
        if not self.queued.reserve(sum(sizes), tenant_id):
            self.metrics.add("ingest.rejected")
            raise Overloaded(f"the queue budget is used up: {self.queued.of_tenant(tenant_id)} of {self.queued.per_tenant} bytes by the tenant, {self.queued.in_use} of {self.queued.capacity} in all")
        return sizes

    def drain(self) -> None:
        """Moves what is queued to the buffers, unless another thread is at it (which then moves this too)."""
        while self.queue and self._moving.acquire(blocking=False):
            try:
                while self.queue:
                    tenant_id, rows, sizes = self.queue.popleft()
                    try:
                        for row, size in zip(rows, sizes, strict=True):
                            self._add(tenant_id, row, size)
                    finally:
                        self.queued.release(sum(sizes), tenant_id)
                        self.metrics.gauge("queue.bytes", self.queued.in_use)
                        self.metrics.gauge("buffer.bytes", self.held.in_use)
            finally:
                self._moving.release()

    def _add(self, tenant_id: str, row: tuple, size: int) -> None:
        b = self.buffers[tenant_id]
        if b.rows and b.size + size > self.limits.flush_bytes:
            self._flush(tenant_id, "size")
        if not self.held.reserve(size):
            self._flush(tenant_id, "size")
            if not self.held.reserve(size):
                # No room even so: the record is lost, and that is said.
                self.lost_records += 1
                self.healthy = False
                self.metrics.add("flush.failures")
                return
        b = self.buffers[tenant_id]
        b.since = b.since if b.rows else self.clock()
        b.rows.append(row)
        b.size += size

    def tick(self) -> None:
        """Publishes what has been buffered for too long; to be called every second or so."""
        self.drain()
        with self._moving:
            for tenant_id, b in list(self.buffers.items()):
                if b.rows and self.clock() - b.since >= self.limits.flush_age_s:
                    self._flush(tenant_id, "age")

    def close(self) -> None:
        """Publishes what is queued and every buffer; nothing is taken afterwards."""
        self.closed = True
        with self._moving:
            self.drain()
            for tenant_id in list(self.buffers):
                self._flush(tenant_id, "size")

    def _flush(self, tenant_id: str, reason: str) -> None:
        b = self.buffers.pop(tenant_id, None)
        if not b or not b.rows:
            return
        began, block_id = self.clock(), str(uuid.uuid4())
        rows = [(tenant_id, block_id, n, ts, tags, message) for n, (ts, tags, message) in enumerate(b.rows)]
        try:
            self.store.write(self.store.spark.createDataFrame(rows, "tenant_id string, block_id string, ordinal int, ts_ms long, tags map<string,string>, message string"))
        except Exception:  # noqa: BLE001  whatever keeps a block from being written
            self.healthy = False
            self.lost_records += len(rows)
            self.metrics.add("flush.failures")
            return
        finally:
            self.held.release(b.size)
            self.metrics.gauge("buffer.bytes", self.held.in_use)
        self.persisted_records += len(rows)
        self.persisted_bytes += b.size
        for name, n in (("persist.records", len(rows)), ("persist.bytes", b.size), (f"flush.by.{reason}", 1), ("blocks.published", 1)):
            self.metrics.add(name, n)
        self.metrics.gauge("catalog.unavailable", self.store.n_unavailable())
        self.metrics.time("flush.duration", (self.clock() - began) * 1000)

    def status(self, active_queries: int = 0) -> DataFrame:
        """One row of the engine's state."""
        row = ("healthy" if self.healthy else "degraded", self.accepted_records, self.persisted_records, self.lost_records, self.accepted_bytes, self.persisted_bytes, self.store.n_blocks(), self.store.n_unavailable(), active_queries, self.held.in_use, self.queued.in_use, self.healthy)
        frame = self.store.spark.createDataFrame([row], "status string, accepted_records long, persisted_records long, lost_records long, accepted_bytes long, persisted_bytes long, published_blocks int, unavailable_blocks int, active_queries int, held long, queued long, persistence_healthy boolean")
        pressure = F.greatest(X.usage_percent(F.col("held"), F.lit(self.held.capacity)), X.usage_percent(F.col("queued"), F.lit(self.queued.capacity)))
        return frame.withColumn("buffer_usage_pct", pressure).drop("held", "queued")


# Batches as DataFrames.


def problems(limits: Limits = Limits()) -> Column:
    """An array of what is wrong with each record of INPUT; empty for none. Nothing in it depends on other records."""
    tags, tenant = F.col("tags"), F.col("tenant_id")
    pairs = F.coalesce(F.map_entries(tags), F.array().cast("array<struct<key:string,value:string>>"))
    any_pair = lambda test: F.exists(pairs, test)
    checks = [
        (X.is_blank(tenant), "tenant_id is required"),
        (X.utf8_bytes(tenant) > limits.max_tenant_bytes, "tenant_id exceeds maximum length"),
        (X.is_blank(F.col("message")), "message is required"),
        (X.is_blank(F.col("timestamp")), "timestamp is required"),
        (~X.is_blank(F.col("timestamp")) & X.instant_ms(F.col("timestamp")).isNull(), "Invalid timestamp"),
        (X.tag_count(tags) > limits.max_tags, f"exceeds max tags: {limits.max_tags}"),
        (any_pair(lambda e: F.octet_length(e["key"]) > limits.max_tag_key_bytes), f"tag key exceeds max length: {limits.max_tag_key_bytes}"),
        (any_pair(lambda e: F.coalesce(F.octet_length(e["value"]) > limits.max_tag_value_bytes, F.lit(False))), f"tag value exceeds max length: {limits.max_tag_value_bytes}"),
        (any_pair(lambda e: e["value"].isNull()), "tag value must not be null"),
        (X.encoded_size(F.col("message"), tags) > limits.max_record_bytes, f"Record exceeds maximum size: {limits.max_record_bytes} bytes"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for c, text in checks]))


def batch_verdicts(batch: DataFrame, keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """A row per batch (tenant_id and keys): records, bytes, and whether the whole batch is accepted."""
    pairs = F.aggregate(F.coalesce(F.map_entries("tags"), F.array().cast("array<struct<key:string,value:string>>")), F.lit(0), lambda a, e: a + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0)))
    size = F.coalesce(F.octet_length("message"), F.lit(0)) + F.coalesce(F.octet_length("timestamp"), F.lit(0)) + pairs
    n, total, bad = F.count(F.lit(1)), F.sum(size), F.sum((F.size(problems(limits)) > 0).cast("long"))
    return batch.groupBy("tenant_id", *keys).agg(n.alias("records"), total.alias("bytes"), bad.alias("bad_records"), ((n <= limits.max_batch_records) & (total <= limits.max_batch_bytes) & (bad == 0)).alias("accepted"))


def publish_batch(store: BlockStore, batch: DataFrame, batch_id: int, ledger: str | None = None, keys: list[str] | None = None) -> dict:
    """Validates, cuts and publishes a micro-batch of INPUT; records that are not valid are counted, not stored.

    With `keys`, columns that tell a tenant's batches apart, a batch is taken whole or not at all, as batch_verdicts()
    has it. Block ids follow from batch_id: the same micro-batch again replaces its blocks, whatever it was cut to.
    """
    if keys:
        verdicts = batch_verdicts(batch, keys, store.limits).select(F.col("tenant_id").alias("tm_tenant"), *(F.col(k).alias(f"tm_{k}") for k in keys), "accepted")
        on = F.col("tenant_id").eqNullSafe(F.col("tm_tenant"))
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"tm_{k}"))
        batch = batch.join(verdicts, on).withColumn("tm_refused", ~F.col("accepted"))
    else:
        batch = batch.withColumn("tm_refused", F.lit(False))
    prefix = f"{batch_id:08d}-"
    store.drop(prefix)
    judged = batch.withColumn("bad", F.col("tm_refused") | (F.size(problems(store.limits)) > 0)).persist()
    try:
        counts = judged.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
        good = judged.where(~F.col("bad")).select("tenant_id", X.instant_ms(F.col("timestamp")).alias("ts_ms"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), "message", F.monotonically_increasing_id().alias("seq"))
        blocks = cut(good, store.limits.flush_bytes).withColumn("block_id", F.concat(F.lit(prefix), F.substring(F.md5("tenant_id"), 1, 12), F.lit("-"), F.lpad(F.col("block_no").cast("string"), 6, "0")))
        made = store.write(blocks.select("tenant_id", "block_id", "ordinal", "ts_ms", "tags", "message"), f"batch-{batch_id:08d}")
        stored = made.agg(F.coalesce(F.sum("record_count"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("raw_bytes"), F.lit(0))).first()
    finally:
        judged.unpersist()
    row = {"batch_id": batch_id, "received": counts["n"], "rejected": counts["bad"] or 0, "accepted": counts["n"] - (counts["bad"] or 0), "persisted": stored[0], "blocks": stored[1], "bytes": stored[2]}
    row["lost"] = row["accepted"] - row["persisted"]
    if ledger:
        schema = "batch_id long, received long, rejected long, accepted long, persisted long, blocks long, bytes long, lost long"
        store.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
    return row


def stream_ingest(spark: SparkSession, source: str, store: BlockStore, checkpoint: str, files_per_trigger: int = 16, available_now: bool = True) -> StreamingQuery:
    """JSON lines of INPUT that arrive in a folder, published micro-batch by micro-batch; no watermark, so nothing late is dropped.

    The trigger interval stands for the age at which a buffer is published, files_per_trigger for the byte budget.
    """
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_trigger).json(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: publish_batch(store, df, n, f"{store.root}/ledger"))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{store.limits.flush_age_s} seconds")).start()
