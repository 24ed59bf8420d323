"""The log store's registered queries, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import functions as X
from tidemark.operators import records, reports, summaries
from tidemark.operators.cutting import cut
from tidemark.plans.request import Query, batch_errors, search_query
from tidemark.plans.search import SearchEngine
from tidemark.schema import InvalidRequest, Limits
from tidemark.shared import shared_path
from tidemark.sources import synthetic, views
from tidemark.sources.blocks import BlockStore
from tidemark.streaming.budget import ByteBudget
from tidemark.streaming.ingest import batch_verdicts, problems, publish_batch, stream_ingest

Run = Callable[[SparkSession, str], DataFrame]

DAY = 86_400_000
JAN1 = 1_704_067_200_000
FROM, TO = JAN1, JAN1 + 14 * DAY
TENANT, TAGS, TEXT = "tenant-1", {"type": "error"}, '"k": 6'
FLUSH = 5_000

#: The events table as logs, N rows to a block.
LOGS = """WITH base AS (
  SELECT 'tenant-' || (user_id % 4) AS tenant_id, epoch_us(ts) // 1000 AS ts_ms, event_type AS type,
         json_extract_string(props, '$.k') AS k, event_type || ' ' || props AS message, event_id FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY event_id) - 1 AS rn FROM base),
logs AS (SELECT *, tenant_id || '-' || lpad((rn // {n})::VARCHAR, 5, '0') AS block_id, (rn % {n})::INTEGER AS ordinal FROM numbered)
"""
ISO = "strftime(make_timestamp({t} * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {t} % 1000 = 0 THEN 'Z' ELSE '.' || lpad(({t} % 1000)::VARCHAR, 3, '0') || 'Z' END"
SIZE = "(18 + strlen(message) + 8 + strlen('type') + strlen(type) + strlen('k') + strlen(k))"
COLUMNS = "tenant_id, block_id, ordinal, ts_ms, type, k, message"


def _spark(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _logs(spark: SparkSession, sf_dir: str, n: int | None = 256) -> DataFrame:
    return views.events(_spark(spark), sf_dir, n)


def _flat(df: DataFrame) -> DataFrame:
    """Tags as columns, so that rows can be compared."""
    return df.select("tenant_id", "block_id", F.col("ordinal").cast("int").alias("ordinal"), "ts_ms", F.col("tags")["type"].alias("type"), F.col("tags")["k"].alias("k"), "message")


def _scan(where: Callable[[DataFrame], DataFrame]) -> Run:
    return lambda spark, sf_dir: _flat(where(_logs(spark, sf_dir)))


def _scan_sql(where: str) -> str:
    return LOGS.format(n=256) + f"SELECT {COLUMNS} FROM logs WHERE {where}"


_ALL = f"tenant_id = '{TENANT}' AND ts_ms >= {FROM} AND ts_ms < {TO} AND type = 'error' AND contains(message, '\"k\": 6')"


def _search(limit: int, text: str | None = TEXT, tags: dict[str, str] | None = TAGS) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = records.earliest(records.matching(_logs(spark, sf_dir), TENANT, FROM, TO, tags, text), limit)
        return _flat(hits).withColumn("timestamp", X.iso(F.col("ts_ms")))

    return run


def _search_sql(limit: int, where: str = _ALL) -> str:
    return LOGS.format(n=256) + f"SELECT {COLUMNS}, {ISO.format(t='ts_ms')} AS timestamp FROM logs WHERE {where} ORDER BY ts_ms, block_id, ordinal LIMIT {limit}"


search_tag_text = _search(Limits.default_limit)


def hits_total_and_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return records.matching(_logs(spark, sf_dir), TENANT, FROM, TO, TAGS).agg(n.alias("total_hits"), F.least(n, F.lit(100)).alias("returned_count"), (n > 100).alias("truncated"))


def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of a day share one timestamp."""
    hits = records.earliest(records.of_tenant(views.orders(_spark(spark), sf_dir), "O"), 50)
    return hits.select("ts_ms", "block_id", "ordinal", X.iso(F.col("ts_ms")).alias("timestamp"))


def block_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.catalog(_logs(spark, sf_dir)).select("block_id", "tenant_id", "min_ts", "max_ts", "record_count", "raw_bytes", "tags_saturated")


def block_tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.col("tag_summary")
    return summaries.catalog(_logs(spark, sf_dir, 32)).select("block_id", "tags_saturated", *[F.coalesce(F.array_join(tags[k], ","), F.lit("")).alias(f"{k}_values") for k in ("type", "k")])


def block_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.catalog(_logs(spark, sf_dir, 64)).select("block_id", "tags_saturated", F.size("tag_summary").alias("n_keys"))


PRUNE = (TENANT, JAN1 + 3 * DAY, JAN1 + 10 * DAY, {"type": "error", "k": "6"})
_BLOCKS = LOGS.format(n=32) + """, pairs AS (SELECT DISTINCT block_id, 'type' AS key, type AS v FROM logs UNION SELECT DISTINCT block_id, 'k', k FROM logs),
pair_counts AS (SELECT block_id, count(*) AS pairs FROM pairs GROUP BY block_id),
blocks AS (SELECT l.block_id, any_value(tenant_id) AS tenant_id, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS record_count,
  bool_or(type = 'error') AS has_type, bool_or(k = '6') AS has_k, any_value(p.pairs) > 64 AS saturated
  FROM logs l JOIN pair_counts p ON p.block_id = l.block_id GROUP BY l.block_id),
judged AS (SELECT *, tenant_id = 'tenant-1' AS tenant_ok, max_ts >= {f} AND min_ts < {t} AS time_ok, saturated OR (has_type AND has_k) AS tag_ok FROM blocks)
""".replace("{f}", str(PRUNE[1])).replace("{t}", str(PRUNE[2]))  # fmt: skip


def _pruned(where: Callable) -> Run:
    return lambda spark, sf_dir: where(summaries.catalog(_logs(spark, sf_dir, 32))).select("block_id", "tenant_id", "min_ts", "max_ts", "record_count")


def prune_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.prune_counts(summaries.catalog(_logs(spark, sf_dir, 32)), *PRUNE)


def prune_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the scan of candidate blocks only; the SQL scans them all."""
    logs = _logs(spark, sf_dir, 32)
    kept = summaries.candidates(summaries.catalog(logs), *PRUNE).select("block_id")
    return _flat(records.matching(logs.join(kept, "block_id", "left_semi"), *PRUNE))


def iso_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds and others."""
    rows = _logs(spark, sf_dir, None).select("event_id", "ts_ms").union(_logs(spark, sf_dir, None).select("event_id", (F.floor(F.col("ts_ms") / 1000) * 1000).alias("ts_ms")))
    return rows.select("event_id", "ts_ms", X.iso(F.col("ts_ms")).alias("timestamp"))


def blank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return docs.groupBy("doc_id").agg(F.sum(X.is_blank(F.col("line")).cast("long")).alias("blank_lines"), F.count(F.lit(1)).alias("lines"))


def validate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a batch: the first thing that is wrong with each record."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batch = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("source")).alias("tenant_id"), F.when(F.col("doc_id") % 5 == 0, "not-a-time").otherwise("2024-01-01T00:00:00Z").alias("timestamp"), F.create_map(F.lit("lang"), "lang").alias("tags"), F.col("text").alias("message"))
    return batch.select("doc_id", F.array_join(problems(), "; ").alias("errors"))


def batch_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole batches of documents, by source, accepted or not."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batch = docs.select(F.col("source").alias("tenant_id"), (F.col("doc_id") % 3).alias("batch"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.create_map(F.lit("lang"), "lang").alias("tags"), F.col("text").alias("message"))
    return batch_verdicts(batch, ["batch"])


def flush_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of events, cut at FLUSH bytes."""
    rows = cut(_logs(spark, sf_dir, None), FLUSH, order="event_id")
    return rows.groupBy("tenant_id", "block_no").agg(F.count(F.lit(1)).alias("records"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.sum(X.encoded_size(F.col("message"), F.col("tags"))).alias("raw_bytes"))


FLUSH_SQL = f"""WITH RECURSIVE base AS (
  SELECT 'tenant-' || (user_id % 4) AS tenant_id, event_type AS type, json_extract_string(props, '$.k') AS k, event_type || ' ' || props AS message, event_id FROM events),
sized AS MATERIALIZED (SELECT tenant_id, event_id, {SIZE} AS size, row_number() OVER (PARTITION BY tenant_id ORDER BY event_id) AS rn FROM base),
walk AS (
  SELECT tenant_id, event_id, size, rn, 0 AS block_no, size AS held FROM sized WHERE rn = 1
  UNION ALL
  SELECT s.tenant_id, s.event_id, s.size, s.rn, CASE WHEN w.held + s.size > {FLUSH} THEN w.block_no + 1 ELSE w.block_no END,
         CASE WHEN w.held + s.size > {FLUSH} THEN s.size ELSE w.held + s.size END
  FROM walk w JOIN sized s ON s.tenant_id = w.tenant_id AND s.rn = w.rn + 1)
SELECT tenant_id, block_no::BIGINT AS block_no, count(*) AS records, min(event_id) AS first_event, max(event_id) AS last_event, sum(size)::BIGINT AS raw_bytes
FROM walk GROUP BY tenant_id, block_no"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("cls"), F.floor(F.col("value") * 10).cast("long").alias("ms"), F.col("event_id").alias("at"))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.percentiles(_samples(spark, sf_dir), "ms", "cls")


def class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.class_summary(_samples(spark, sf_dir), "cls", "ms")


def memory_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.samples(_samples(spark, sf_dir), "ms", "at").withColumn("mean", F.round("mean", 6))


def prune_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = summaries.catalog(_logs(spark, sf_dir, 32))
    return summaries.verdicts(blocks, *PRUNE).agg(F.round(reports.prune_percent(F.count(F.lit(1)), F.sum((F.col("verdict") == "candidate").cast("long"))), 6).alias("prune_percent"))


def docs_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = records.matching(views.documents(spark, sf_dir), "src3", None, None, {"lang": "fr"}, "é")
    return hits.select("ordinal", "ts_ms", "message")


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = records.matching(views.conversations(spark, sf_dir), "user", None, None, {"turn": "0"}, "the")
    return hits.select("ordinal", "ts_ms", "message")


# Without SQL: files, streams and damage. These write to a folder of their own.


def _root(spark: SparkSession) -> str:
    return shared_path(spark, "store")


def _stored(spark: SparkSession, sf_dir: str, n: int = 256) -> BlockStore:
    store = BlockStore(spark, _root(spark))
    store.write(_logs(spark, sf_dir, n).drop("event_id"))
    return store


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over blocks written and read back."""
    found = SearchEngine(_stored(spark, sf_dir)).search(Query(TENANT, FROM, TO, TAGS, TEXT, timeout_ms=Limits.max_timeout_ms))
    return spark.createDataFrame([(h["timestamp"], h["tags"]["type"], h["tags"]["k"], h["message"]) for h in found.results], "timestamp string, type string, k string, message string")


def store_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search says of its own completeness, on a healthy store."""
    r = SearchEngine(_stored(spark, sf_dir)).search(Query(TENANT, FROM, TO, TAGS, timeout_ms=Limits.max_timeout_ms))
    return spark.createDataFrame([(r.returned_count, r.partial, r.truncated, r.timed_out, r.skipped_blocks, r.unavailable_blocks, r.candidate_blocks, r.scanned_blocks)], "returned_count int, partial boolean, truncated boolean, timed_out boolean, skipped_blocks int, unavailable_blocks int, candidate_blocks int, scanned_blocks int")


def corrupt_block_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches of a store one of whose blocks was removed after publishing: first skipped, then unavailable."""
    store = _stored(spark, sf_dir)
    victim = store.catalog().where(F.col("tenant_id") == TENANT).orderBy("min_ts").first()
    store._fs().delete(store._path(victim["path"]), True)
    engine, rows = SearchEngine(store), []
    for n in (1, 2):
        r = engine.search(Query(TENANT, FROM, TO, timeout_ms=Limits.max_timeout_ms))
        rows.append((n, r.partial, r.skipped_blocks, r.unavailable_blocks, r.candidate_blocks - r.scanned_blocks))
    return spark.createDataFrame(rows, "search int, partial boolean, skipped_blocks int, unavailable_blocks int, not_scanned int")


def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compression(_stored(spark, sf_dir).catalog())


def _input(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir, None)
    return logs.select("tenant_id", X.iso(F.col("ts_ms")).alias("timestamp"), "tags", F.when(F.col("event_id") % 100 == 0, " ").otherwise(F.col("message")).alias("message"))


def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = BlockStore(spark, _root(spark), Limits(flush_bytes=100_000))
    row = publish_batch(store, _input(spark, sf_dir), 0)
    return spark.createDataFrame([(row["received"], row["rejected"], row["accepted"], row["persisted"], row["lost"])], "received long, rejected long, accepted long, persisted long, lost long")


INGEST_SQL = """SELECT count(*) AS received, count(*) FILTER (WHERE event_id % 100 = 0) AS rejected, count(*) FILTER (WHERE event_id % 100 <> 0) AS accepted,
count(*) FILTER (WHERE event_id % 100 <> 0) AS persisted, 0::BIGINT AS lost FROM events"""


def stream_ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of files."""
    root = _root(spark)
    _input(spark, sf_dir).repartition(4).write.json(f"{root}/in")
    store = BlockStore(spark, f"{root}/store", Limits(flush_bytes=100_000))
    stream_ingest(spark, f"{root}/in", store, f"{root}/checkpoint", files_per_trigger=2).awaitTermination()
    ledger = spark.read.parquet(f"{root}/store/ledger")
    return ledger.agg(*[F.sum(c).alias(c) for c in ("received", "rejected", "accepted", "persisted", "lost")])


def batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in batches of a tenant's records of 50 ids: one bad record refuses its whole batch."""
    logs = _logs(spark, sf_dir, None)
    batch = logs.select("tenant_id", X.iso(F.col("ts_ms")).alias("timestamp"), "tags", F.when(F.col("event_id") % 997 == 0, " ").otherwise(F.col("message")).alias("message"), F.floor(F.col("event_id") / 50).alias("batch"))
    row = publish_batch(BlockStore(spark, _root(spark), Limits(flush_bytes=100_000)), batch, 0, keys=["batch"])
    return spark.createDataFrame([(row["received"], row["rejected"], row["accepted"], row["persisted"], row["lost"])], "received long, rejected long, accepted long, persisted long, lost long")


BATCH_SQL = """WITH e AS (SELECT 'tenant-' || (user_id % 4) AS tenant_id, event_id // 50 AS batch, event_id % 997 = 0 AS bad FROM events),
b AS (SELECT tenant_id, batch, count(*) AS n, bool_or(bad) AS refused FROM e GROUP BY ALL)
SELECT sum(n)::BIGINT AS received, coalesce(sum(n) FILTER (WHERE refused), 0)::BIGINT AS rejected, coalesce(sum(n) FILTER (WHERE NOT refused), 0)::BIGINT AS accepted,
coalesce(sum(n) FILTER (WHERE NOT refused), 0)::BIGINT AS persisted, 0::BIGINT AS lost FROM b"""

_OK = {"tenant_id": "t", "from": "2024-01-01T00:00:00Z", "to": "2024-01-02T00:00:00Z"}
_RECORD = {"timestamp": "2024-01-01T00:00:00Z", "message": "m"}
#: Requests by name; what each gives is in CASES_SQL.
SEARCHES = {
    "plain": _OK, "tenant blank": _OK | {"tenant_id": " "}, "from blank": _OK | {"from": ""}, "to missing": {k: v for k, v in _OK.items() if k != "to"}, "from is to": _OK | {"to": _OK["from"]}, "bad time": _OK | {"to": "not-a-time"},
    "limit 0": _OK | {"limit": 0}, "limit 1000": _OK | {"limit": 1000}, "limit 1001": _OK | {"limit": 1001}, "timeout 30001": _OK | {"timeout_ms": 30_001}, "all wrong": {"limit": -1, "timeout_ms": 0}, "null tag": _OK | {"tags": {"a": None}},
}
BATCHES = {
    "good": ("t", [_RECORD]), "tenant null": (None, [_RECORD]), "tenant 257": ("x" * 257, [_RECORD]), "tenant 256": ("x" * 256, [_RECORD]), "none": ("t", []), "1001": ("t", [_RECORD] * 1001), "1000": ("t", [_RECORD] * 1000),
    "message blank": ("t", [_RECORD, _RECORD | {"message": " "}]), "17 tags": ("t", [_RECORD | {"tags": {str(k): "" for k in range(17)}}]), "long tag": ("t", [_RECORD | {"tags": {"k" * 257: "v" * 257}}]), "5000001 bytes": ("t", [_RECORD | {"message": "m" * 5_000_001}]),
}


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said to searches and batches that are wrong, and the limit and timeout of those that are not."""

    def searched(request: dict) -> str:
        try:
            q = search_query(request)
            return f"limit {q.limit}, timeout {q.timeout_ms}"
        except InvalidRequest as e:
            return "; ".join(e.errors)

    rows = [("search", name, searched(r)) for name, r in SEARCHES.items()] + [("batch", name, "; ".join(batch_errors(*b))) for name, b in BATCHES.items()]
    return spark.createDataFrame(rows, "kind string, name string, answer string")


CASES_SQL = """SELECT * FROM (VALUES
('search', 'plain', 'limit 100, timeout 5000'), ('search', 'tenant blank', 'tenant_id is required'), ('search', 'from blank', 'from is required'), ('search', 'to missing', 'to is required'),
('search', 'from is to', 'from must be before to'), ('search', 'bad time', 'Invalid timestamp format'), ('search', 'limit 0', 'limit must be between 1 and 1000'), ('search', 'limit 1000', 'limit 1000, timeout 5000'),
('search', 'limit 1001', 'limit must be between 1 and 1000'), ('search', 'timeout 30001', 'timeout_ms must be between 1 and 30000'),
('search', 'all wrong', 'tenant_id is required; from is required; to is required; limit must be between 1 and 1000; timeout_ms must be between 1 and 30000'), ('search', 'null tag', 'tag values must not be null'),
('batch', 'good', ''), ('batch', 'tenant null', 'tenant_id is required'), ('batch', 'tenant 257', 'tenant_id exceeds maximum length'), ('batch', 'tenant 256', ''), ('batch', 'none', 'records must not be empty'),
('batch', '1001', 'Too many records: max 1000'), ('batch', '1000', ''), ('batch', 'message blank', 'records[1].message is required'), ('batch', '17 tags', 'records[0] exceeds max tags: 16'),
('batch', 'long tag', 'records[0] tag key exceeds max length: 256; records[0] tag value exceeds max length: 256'), ('batch', '5000001 bytes', 'Batch exceeds maximum size: 5000000 bytes')) AS t(kind, name, answer)"""


def budget_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's budget under each event type's first records as batches of its own tenant: what is reserved, refused and held after a release."""
    sizes = _logs(spark, sf_dir, None).select(F.col("tags")["type"].alias("type"), X.encoded_size(F.col("message"), F.col("tags")).alias("size"), F.row_number().over(Window.partitionBy(F.col("tags")["type"]).orderBy("event_id")).alias("n")).where("n <= 20").orderBy("n", "type").collect()
    budget, rows = ByteBudget(4_000, 1_000), []
    for r in sizes:
        taken = budget.reserve(r["size"], r["type"])
        rows.append((r["type"], r["n"], taken, budget.of_tenant(r["type"]), budget.in_use))
        if taken and r["n"] % 4 == 0:
            budget.release(r["size"], r["type"])
    return spark.createDataFrame(rows, "type string, n int, taken boolean, of_tenant long, in_use long")


BUDGET_SQL = f"""WITH RECURSIVE e AS (SELECT event_id, event_type AS type, json_extract_string(props, '$.k') AS k, event_type || ' ' || props AS message FROM events),
s AS (SELECT type, {SIZE} AS size, row_number() OVER (PARTITION BY type ORDER BY event_id) AS n FROM e),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n, type) AS k FROM s WHERE n <= 20),
names AS (SELECT list(DISTINCT type ORDER BY type) AS names FROM o),
w AS (SELECT 0 AS k, ''::VARCHAR AS type, 0::BIGINT AS n, false AS taken, 0::BIGINT AS of_tenant, 0::BIGINT AS in_use, list_transform(names, lambda x: 0::BIGINT) AS held FROM names
UNION ALL SELECT k, type, n, taken, mine + CASE WHEN taken THEN size ELSE 0 END, total + CASE WHEN taken THEN size ELSE 0 END,
  list_transform(held, lambda x, i: x + CASE WHEN i = here AND taken AND n % 4 <> 0 THEN size ELSE 0 END)
  FROM (SELECT o.k, o.type, o.n, o.size, held, list_position(names, o.type) AS here, held[list_position(names, o.type)] AS mine, list_sum(held)::BIGINT AS total,
    held[list_position(names, o.type)] + o.size <= 1000 AND list_sum(held) + o.size <= 4000 AS taken FROM w JOIN o ON o.k = w.k + 1, names))
SELECT type, n::INTEGER AS n, taken, of_tenant, in_use FROM w WHERE k > 0"""


def synthetic_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated records by level and service."""
    return synthetic.logs(spark, "demo-shop", 50_000).groupBy(F.col("tags")["level"].alias("level"), F.col("tags")["service"].alias("service")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("message").contains("%").cast("int")).alias("unexpanded"))


def queries() -> dict[str, Run]:
    return {
        "tenant_filter": _scan(lambda d: records.of_tenant(d, TENANT)),
        "time_range": _scan(lambda d: records.in_range(d, FROM, TO)),
        "time_edge_inclusive_from": _scan(lambda d: records.in_range(d, EDGE, None)),
        "time_edge_exclusive_to": _scan(lambda d: records.in_range(d, None, EDGE)),
        "tag_and_one": _scan(lambda d: records.with_tags(d, {"type": "error"})),
        "tag_and_two": _scan(lambda d: records.with_tags(d, {"type": "click", "k": "6"})),
        "tag_absent_key": lambda spark, sf_dir: _logs(spark, sf_dir, None).select("event_id", *(X.tags_match(F.col("tags"), t).alias(n) for n, t in (("absent", {"absent": "x"}), ("one_absent", {"type": "error", "absent": "x"}), ("present", {"type": "error"})))),
        "tag_no_match": _scan(lambda d: d.where(~X.tags_match(F.col("tags"), {"type": "error", "absent": "x"}))),
        "text_contains": _scan(lambda d: records.with_text(d, TEXT)),
        "text_special_chars": lambda spark, sf_dir: records.with_text(views.documents(spark, sf_dir), "%%% ").select("ordinal", "ts_ms"),
        "text_case": lambda spark, sf_dir: _logs(spark, sf_dir, None).select("event_id", X.contains(F.col("message"), "error").alias("lower"), X.contains(F.col("message"), "Error").alias("title")),
        "text_empty": _scan(lambda d: records.with_text(d, "")),
        "search_tag_text": search_tag_text,
        "search_full": _search(1000, None, None),
        "topk_earliest": _search(5, None, None),
        "topk_ties": topk_ties,
        "hits_total_and_truncated": hits_total_and_truncated,
        "block_catalog": block_catalog,
        "block_tag_summary": block_tag_summary,
        "block_saturation": block_saturation,
        "prune_tenant": _pruned(lambda c: c.where(summaries.tenant_fits(TENANT))),
        "prune_time": _pruned(lambda c: c.where(summaries.time_fits(*PRUNE[1:3]))),
        "prune_tag": _pruned(lambda c: c.where(summaries.tags_fit(PRUNE[3]))),
        "prune_candidates": _pruned(lambda c: summaries.candidates(c, *PRUNE)),
        "prune_counts": prune_counts,
        "prune_rate": prune_rate,
        "prune_soundness": prune_soundness,
        "iso_render": iso_render,
        "epoch_floor": lambda spark, sf_dir: _logs(spark, sf_dir, None).select("event_id", "ts_ms"),
        "blank_check": blank_check,
        "utf8_bytes": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.utf8_bytes(F.col("text")).cast("long").alias("bytes"), F.length("text").cast("long").alias("chars")),
        "encoded_size": lambda spark, sf_dir: _logs(spark, sf_dir, None).select("event_id", X.encoded_size(F.col("message"), F.col("tags")).alias("encoded_size")),
        "validate_batch": validate_batch,
        "batch_admission": batch_admission,
        "flush_cut": flush_cut,
        "percentiles": percentiles,
        "class_rollup": class_rollup,
        "memory_samples": memory_samples,
        "docs_text_search": docs_text_search,
        "conversation_search": conversation_search,
        "store_search": store_search,
        "store_completeness": store_completeness,
        "corrupt_block_completeness": corrupt_block_completeness,
        "compression_report": compression_report,
        "ingest_ledger": ingest_ledger,
        "stream_ingest": stream_ingest_query,
        "synthetic_logs": synthetic_logs,
        "synthetic_totals": lambda spark, sf_dir: synthetic_logs(spark, sf_dir).agg(F.sum("records").alias("records"), F.sum("unexpanded").alias("unexpanded")),
        "batch_ledger": batch_ledger,
        "request_checks": request_checks,
        "budget_checks": budget_checks,
    }


#: The millisecond of an event of the tables at scale 0.01 and above, or near one.
EDGE = JAN1 + 10 * DAY


COMPLETE_SQL = LOGS.format(n=256) + f"""SELECT least(hits, 100)::INTEGER AS returned_count, false AS partial, hits > 100 AS truncated, false AS timed_out, 0::INTEGER AS skipped_blocks, 0::INTEGER AS unavailable_blocks,
  blocks::INTEGER AS candidate_blocks, blocks::INTEGER AS scanned_blocks
FROM (SELECT count(*) AS hits FROM logs WHERE tenant_id = '{TENANT}' AND ts_ms >= {FROM} AND ts_ms < {TO} AND type = 'error'),
(SELECT count(*) AS blocks FROM (SELECT block_id FROM logs WHERE tenant_id = '{TENANT}' GROUP BY block_id
  HAVING max(ts_ms) >= {FROM} AND min(ts_ms) < {TO} AND (bool_or(type = 'error') OR count(DISTINCT type) + count(DISTINCT k) > 64)))"""


def oracle_sql() -> dict[str, str]:
    plain = "SELECT {c} FROM judged WHERE {w}"
    blocks = "block_id, tenant_id, min_ts, max_ts, record_count"
    one = {"prune_tenant": "tenant_ok", "prune_time": "time_ok", "prune_tag": "tag_ok", "prune_candidates": "tenant_ok AND time_ok AND tag_ok"}
    wanted = f"tenant_id = '{TENANT}' AND ts_ms >= {PRUNE[1]} AND ts_ms < {PRUNE[2]} AND type = 'error' AND k = '6'"
    tenant = f"tenant_id = '{TENANT}' AND ts_ms >= {FROM} AND ts_ms < {TO}"
    cls = "SELECT event_type AS cls, floor(value * 10)::BIGINT AS ms, event_id AS seen_at FROM events"
    agg = ", ".join(f"quantile_disc(ms, {p / 100}) AS p{p}" for p in (50, 95, 99))
    pairs = "(SELECT DISTINCT block_id, 'type' AS key, type AS v FROM logs UNION SELECT DISTINCT block_id, 'k', k FROM logs)"
    return {
        "tenant_filter": _scan_sql(f"tenant_id = '{TENANT}'"),
        "time_range": _scan_sql(f"ts_ms >= {FROM} AND ts_ms < {TO}"),
        "time_edge_inclusive_from": _scan_sql(f"ts_ms >= {EDGE}"),
        "time_edge_exclusive_to": _scan_sql(f"ts_ms < {EDGE}"),
        "tag_and_one": _scan_sql("type = 'error'"),
        "tag_and_two": _scan_sql("type = 'click' AND k = '6'"),
        "tag_absent_key": "SELECT event_id, false AS absent, false AS one_absent, event_type = 'error' AS present FROM events",
        "tag_no_match": _scan_sql("true"),
        "text_contains": _scan_sql("contains(message, '\"k\": 6')"),
        "text_special_chars": "SELECT doc_id AS ordinal, 1700000000000 + doc_id * 1000 AS ts_ms FROM documents WHERE contains(text, '%%% ')",
        "text_case": "SELECT event_id, contains(event_type || ' ' || props, 'error') AS lower, contains(event_type || ' ' || props, 'Error') AS title FROM events",
        "text_empty": _scan_sql("true"),
        "search_tag_text": _search_sql(Limits.default_limit),
        "search_full": _search_sql(1000, tenant),
        "topk_earliest": _search_sql(5, tenant),
        "topk_ties": f"SELECT *, {ISO.format(t='ts_ms')} AS timestamp FROM (SELECT epoch_us(o_orderdate) // 1000 AS ts_ms, o_orderstatus AS block_id, o_orderkey AS ordinal FROM orders WHERE o_orderstatus = 'O') ORDER BY ts_ms, block_id, ordinal LIMIT 50",
        "hits_total_and_truncated": LOGS.format(n=256) + f"SELECT count(*) AS total_hits, least(count(*), 100) AS returned_count, count(*) > 100 AS truncated FROM logs WHERE {tenant} AND type = 'error'",
        "block_catalog": LOGS.format(n=256) + f", c AS (SELECT block_id, count(*) AS pairs FROM {pairs} GROUP BY block_id) SELECT l.block_id, any_value(tenant_id) AS tenant_id, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, count(*) AS record_count, sum({SIZE})::BIGINT AS raw_bytes, any_value(c.pairs) > 64 AS tags_saturated FROM logs l JOIN c ON c.block_id = l.block_id GROUP BY l.block_id",
        "block_tag_summary": LOGS.format(n=32) + f", c AS (SELECT block_id, count(*) AS pairs FROM {pairs} GROUP BY block_id) SELECT l.block_id, any_value(c.pairs) > 64 AS tags_saturated, CASE WHEN any_value(c.pairs) > 64 THEN '' ELSE string_agg(DISTINCT type, ',' ORDER BY type) END AS type_values, CASE WHEN any_value(c.pairs) > 64 THEN '' ELSE string_agg(DISTINCT k, ',' ORDER BY k) END AS k_values FROM logs l JOIN c ON c.block_id = l.block_id GROUP BY l.block_id",
        "block_saturation": LOGS.format(n=64) + f"SELECT block_id, count(*) > 64 AS tags_saturated, CASE WHEN count(*) > 64 THEN 0 ELSE count(DISTINCT key) END::INTEGER AS n_keys FROM {pairs} GROUP BY block_id",
        **{k: _BLOCKS + plain.format(c=blocks, w=w) for k, w in one.items()},
        "prune_counts": _BLOCKS + "SELECT count(*) FILTER (WHERE tenant_ok AND time_ok AND tag_ok) AS candidate_blocks, count(*) FILTER (WHERE NOT tenant_ok) AS pruned_tenant, count(*) FILTER (WHERE tenant_ok AND NOT time_ok) AS pruned_time, count(*) FILTER (WHERE tenant_ok AND time_ok AND NOT tag_ok) AS pruned_tag FROM judged",
        "prune_rate": _BLOCKS + "SELECT round(100.0::DOUBLE * (count(*) - count(*) FILTER (WHERE tenant_ok AND time_ok AND tag_ok)) / count(*), 6) AS prune_percent FROM judged",
        "prune_soundness": LOGS.format(n=32) + f"SELECT {COLUMNS} FROM logs WHERE {wanted}",
        "iso_render": f"SELECT event_id, ts_ms, {ISO.format(t='ts_ms')} AS timestamp FROM (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events UNION ALL SELECT event_id, epoch_us(ts) // 1000000 * 1000 FROM events)",
        "epoch_floor": "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events",
        "blank_check": r"SELECT doc_id, (count(*) FILTER (WHERE regexp_full_match(line, '[\x09-\x0D\x1C-\x1F\x20]*')))::BIGINT AS blank_lines, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
        "utf8_bytes": "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents",
        "encoded_size": f"SELECT event_id, {SIZE}::BIGINT AS encoded_size FROM (SELECT event_id, event_type AS type, json_extract_string(props, '$.k') AS k, event_type || ' ' || props AS message FROM events)",
        "validate_batch": f"SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 7 = 0 THEN 'tenant_id is required' END, CASE WHEN trim(text) = '' THEN 'message is required' END, CASE WHEN doc_id % 5 = 0 THEN 'Invalid timestamp' END, CASE WHEN 18 + strlen(text) + 8 + strlen(lang) > {Limits.max_record_bytes} THEN 'Record exceeds maximum size: {Limits.max_record_bytes} bytes' END) AS errors FROM documents",
        "batch_admission": f"SELECT source AS tenant_id, doc_id % 3 AS batch, count(*) AS records, sum(strlen(text) + 24 + strlen(lang))::BIGINT AS bytes, (count(*) FILTER (WHERE trim(text) = '' OR 18 + strlen(text) + 8 + strlen(lang) > {Limits.max_record_bytes}))::BIGINT AS bad_records, count(*) <= 1000 AND sum(strlen(text) + 24 + strlen(lang)) <= 5000000 AND count(*) FILTER (WHERE trim(text) = '' OR 18 + strlen(text) + 8 + strlen(lang) > {Limits.max_record_bytes}) = 0 AS accepted FROM documents GROUP BY source, doc_id % 3",
        "flush_cut": FLUSH_SQL,
        "percentiles": f"SELECT cls, count(*) AS n, {agg} FROM ({cls}) GROUP BY cls",
        "class_rollup": f"SELECT CASE WHEN grouping(cls) = 1 THEN 'overall' ELSE cls END AS cls, count(*) AS n, floor(sum(ms)::DOUBLE / count(*))::BIGINT AS mean, {agg} FROM ({cls}) GROUP BY ROLLUP (cls)",
        "memory_samples": f"SELECT min(ms) AS min, max(ms) AS max, round(avg(ms), 6) AS mean, arg_max(ms, seen_at) AS last FROM ({cls})",
        "docs_text_search": "SELECT doc_id AS ordinal, 1700000000000 + doc_id * 1000 AS ts_ms, text AS message FROM documents WHERE source = 'src3' AND lang = 'fr' AND contains(text, 'é')",
        "conversation_search": "SELECT conv_id AS ordinal, 1700000000000 + conv_id * 60000 + turn * 1000 AS ts_ms, text AS message FROM conversations WHERE role = 'user' AND turn = 0 AND contains(text, 'the')",
        "store_search": LOGS.format(n=256) + f"SELECT {ISO.format(t='ts_ms')} AS timestamp, type, k, message FROM logs WHERE {_ALL} ORDER BY ts_ms, block_id, ordinal LIMIT 100",
        "ingest_ledger": INGEST_SQL,
        "stream_ingest": INGEST_SQL,
        "store_completeness": COMPLETE_SQL,
        "corrupt_block_completeness": "SELECT n::INTEGER AS search, true AS partial, (2 - n)::INTEGER AS skipped_blocks, (n - 1)::INTEGER AS unavailable_blocks, (2 - n)::INTEGER AS not_scanned FROM (VALUES (1), (2)) AS t(n)",
        "synthetic_totals": "SELECT 50000::BIGINT AS records, 0::BIGINT AS unexpanded",
        "batch_ledger": BATCH_SQL,
        "request_checks": CASES_SQL,
        "budget_checks": BUDGET_SQL,
    }
