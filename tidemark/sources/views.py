"""Other tables seen as log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.shared import shared_path, written

EVENTS = "ts_ms long, tags map<string,string>, message string, event_id long, block_id string, ordinal int, tenant_id string"


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with `name`: the number, from 0, of each in its tenant's rows in the given order.

    Rows are dealt by ranges of tenant and order, so that a large tenant is spread over many tasks; each range numbers
    its own, and the ranges' counts, a few rows each, are added up. Written in between: a second evaluation might deal otherwise.
    """
    dealt = rows.repartitionByRange("tenant_id", order).sortWithinPartitions("tenant_id", order)
    marked = written(dealt.withColumns({"tm_id": F.monotonically_increasing_id(), "tm_range": F.spark_partition_id()}), "numbered")
    ranges = marked.groupBy("tenant_id", "tm_range").agg(F.min("tm_id").alias("tm_first"), F.count(F.lit(1)).alias("tm_n"))
    before = F.coalesce(F.sum("tm_n").over(Window.partitionBy("tenant_id").orderBy("tm_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("tenant_id", "tm_range", (before - F.col("tm_first")).alias("tm_offset"))
    return marked.join(offsets, ["tenant_id", "tm_range"]).withColumn(name, F.col("tm_id") + F.col("tm_offset")).drop("tm_id", "tm_range", "tm_offset")


def blocked(rows: DataFrame, order: str, rows_per_block: int) -> DataFrame:
    """rows with block_id and ordinal: each tenant's rows in the given order, so many to a block."""
    rn = F.col("tm_rn")
    return numbered(rows, order, "tm_rn").withColumns({"block_id": F.format_string("%s-%05d", "tenant_id", F.floor(rn / rows_per_block).cast("int")), "ordinal": (rn % rows_per_block).cast("int")}).drop("tm_rn")


_blocks: dict[tuple, str] = {}


def event_blocks(spark: SparkSession, sf_dir: str, rows_per_block: int) -> DataFrame:
    """The events table cut to blocks, stored once per application and size: a folder per tenant, in order of time, so that a search reads its tenant's files and of those the row groups of its time."""
    key = (spark.sparkContext.applicationId, sf_dir, rows_per_block)
    if key not in _blocks:
        rows = blocked(events(spark, sf_dir, None), "event_id", rows_per_block)
        path = shared_path(spark, f"events-{rows_per_block}")
        rows.repartitionByRange("tenant_id", "ts_ms").sortWithinPartitions("tenant_id", "ts_ms").write.partitionBy("tenant_id").option("compression", "zstd").parquet(path)
        _blocks[key] = path
    return spark.read.schema(EVENTS).parquet(_blocks[key])


def events(spark: SparkSession, sf_dir: str, rows_per_block: int | None = 256) -> DataFrame:
    """The events table as records, in blocks if they have a size. The session's zone must be UTC."""
    if rows_per_block:
        return event_blocks(spark, sf_dir, rows_per_block)
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    return df.select(F.concat(F.lit("tenant-"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"), millis(F.col("ts")).alias("ts_ms"), F.create_map(F.lit("type"), "event_type", F.lit("k"), k).alias("tags"), F.concat_ws(" ", "event_type", "props").alias("message"), "event_id")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(F.col("source").alias("tenant_id"), (F.lit(1_700_000_000_000) + F.col("doc_id") * 1000).alias("ts_ms"), F.create_map(F.lit("lang"), "lang").alias("tags"), F.col("text").alias("message"), F.col("source").alias("block_id"), F.col("doc_id").alias("ordinal"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return df.select(F.col("role").alias("tenant_id"), (F.lit(1_700_000_000_000) + F.col("conv_id") * 60_000 + F.col("turn") * 1000).alias("ts_ms"), F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("tags"), F.col("text").alias("message"), F.col("role").alias("block_id"), F.col("conv_id").alias("ordinal"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.select(F.col("o_orderstatus").alias("tenant_id"), millis(F.col("o_orderdate")).alias("ts_ms"), F.create_map(F.lit("priority"), "o_orderpriority").alias("tags"), F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("message"), F.col("o_orderstatus").alias("block_id"), F.col("o_orderkey").alias("ordinal"))
