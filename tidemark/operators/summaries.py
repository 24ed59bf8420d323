"""Block summaries, and what they rule out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import functions as X
from tidemark.schema import Limits


def catalog(logs: DataFrame, max_tag_pairs: int = Limits.max_tag_pairs) -> DataFrame:
    """A row per block: its tenant, time range, record count, bytes, and its tag values if they are few enough."""
    base = logs.groupBy("block_id").agg(
        F.min("tenant_id").alias("tenant_id"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"), F.count(F.lit(1)).alias("record_count"), F.sum(X.encoded_size(F.col("message"), F.col("tags"))).alias("raw_bytes")
    )
    return base.join(tag_summary(logs, max_tag_pairs), "block_id", "left").select(*base.columns, F.coalesce("tag_summary", F.create_map().cast("map<string,array<string>>")).alias("tag_summary"), F.coalesce("tags_saturated", F.lit(False)).alias("tags_saturated"))


def tag_summary(logs: DataFrame, max_tag_pairs: int = Limits.max_tag_pairs) -> DataFrame:
    """Per block with tags: the union of its values by key, or nothing but `tags_saturated` beyond max_tag_pairs pairs.

    Of each block at most one pair more than that is looked at, in order, so no group holds more. One shuffle puts equal
    pairs together, one a block's pairs; the count and the map come from the latter.
    """
    pairs = logs.select("block_id", F.explode("tags").alias("k", "v")).distinct()
    first = pairs.withColumn("tm_nth", F.row_number().over(Window.partitionBy("block_id").orderBy("k", "v"))).where(F.col("tm_nth") <= max_tag_pairs + 1)
    blocks = first.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("kv"))
    keys = F.array_distinct(F.col("kv.k"))
    values = lambda k: F.transform(F.filter("kv", lambda e: (e["k"] == k) & e["v"].isNotNull()), lambda e: e["v"])
    saturated = F.size("kv") > max_tag_pairs
    return blocks.select("block_id", F.when(~saturated, F.map_from_arrays(keys, F.transform(keys, values))).alias("tag_summary"), saturated.alias("tags_saturated"))


def tenant_fits(tenant_id: str) -> Column:
    return F.coalesce(F.col("tenant_id") == F.lit(tenant_id), F.lit(False))


def time_fits(from_ms: int, to_ms: int) -> Column:
    return (F.col("max_ts") >= F.lit(from_ms).cast("long")) & (F.col("min_ts") < F.lit(to_ms).cast("long"))


def tags_fit(tags: dict[str, str] | None) -> Column:
    """A key that the summary lacks rules nothing out; nor does a saturated summary."""
    one = lambda k, v: F.col("tags_saturated") | ~F.map_contains_key("tag_summary", F.lit(k)) | F.coalesce(F.array_contains(F.element_at("tag_summary", F.lit(k)), v), F.lit(False))
    return reduce(lambda a, b: a & b, [one(k, v) for k, v in (tags or {}).items()], F.lit(True))


def verdicts(blocks: DataFrame, tenant_id: str, from_ms: int, to_ms: int, tags: dict[str, str] | None = None) -> DataFrame:
    """blocks with `verdict`: unavailable, tenant, time or tag (the first that rules the block out), else candidate."""
    out = F.when(~tenant_fits(tenant_id), "tenant").when(~time_fits(from_ms, to_ms), "time").when(~tags_fit(tags), "tag").otherwise("candidate")
    return blocks.withColumn("verdict", F.when(~F.col("available"), "unavailable").otherwise(out) if "available" in blocks.columns else out)


def candidates(blocks: DataFrame, *query) -> DataFrame:
    return verdicts(blocks, *query).where("verdict = 'candidate'").drop("verdict")


def prune_counts(blocks: DataFrame, *query) -> DataFrame:
    """One row, one pass: candidates, and blocks ruled out by tenant, time and tag."""
    n = lambda what: F.coalesce(F.sum((F.col("verdict") == what).cast("long")), F.lit(0))
    return verdicts(blocks, *query).agg(n("candidate").alias("candidate_blocks"), n("tenant").alias("pruned_tenant"), n("time").alias("pruned_time"), n("tag").alias("pruned_tag"))
