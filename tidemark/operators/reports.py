"""Reports on measurements: nearest-rank percentiles, grouped summaries, compression, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(value: str, percent: float) -> Column:
    """The whole number at index ceil(n * p / 100) - 1 of the sorted values."""
    return F.expr(f"cast(percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{value}`) AS long)")


def percentiles(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n"), *(nearest_rank(value, p).alias(f"p{p}") for p in (50, 95, 99))]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def truncated_mean(value: str) -> Column:
    return F.when(F.count(value) > 0, F.floor(F.sum(value) / F.count(value))).otherwise(0)


def class_summary(df: DataFrame, cls: str, value: str) -> DataFrame:
    """A row per class and one over all, whose class is `overall`."""
    return df.rollup(cls).agg(F.grouping(cls).alias("g"), F.count(F.lit(1)).alias("n"), truncated_mean(value).alias("mean"), *(nearest_rank(value, p).alias(f"p{p}") for p in (50, 95, 99))).select(F.when(F.col("g") == 1, "overall").otherwise(F.col(cls)).alias("cls"), "n", "mean", "p50", "p95", "p99")


def prune_percent(total: Column, mean_candidates: Column) -> Column:
    return F.when(total > 0, 100.0 * (total - mean_candidates) / total).otherwise(0.0)


def compression(blocks: DataFrame) -> DataFrame:
    """Raw over file bytes, and the sizes of the files; blocks: raw_bytes, file_bytes."""
    raw, disk = F.sum("raw_bytes"), F.sum("file_bytes")
    return blocks.agg(F.count(F.lit(1)).alias("blocks"), raw.alias("raw_bytes"), disk.alias("file_bytes"), F.when(disk > 0, raw / disk).alias("ratio"), F.min("file_bytes").alias("min_file_bytes"), F.max("file_bytes").alias("max_file_bytes"), truncated_mean("file_bytes").alias("mean_file_bytes"))


def samples(df: DataFrame, value: str, at: str) -> DataFrame:
    """Least, largest, mean and last of samples over time."""
    return df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.max_by(value, at).alias("last"))
