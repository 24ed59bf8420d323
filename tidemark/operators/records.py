"""Filters, projection and top-K over records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import functions as X

#: The total order of hits.
ORDER = ("ts_ms", "block_id", "ordinal")


def of_tenant(logs: DataFrame, tenant_id: str) -> DataFrame:
    return logs.where(F.col("tenant_id") == F.lit(tenant_id))


def in_range(logs: DataFrame, from_ms: int | None, to_ms: int | None) -> DataFrame:
    """from <= ts < to."""
    if from_ms is not None:
        logs = logs.where(F.col("ts_ms") >= F.lit(from_ms).cast("long"))
    return logs if to_ms is None else logs.where(F.col("ts_ms") < F.lit(to_ms).cast("long"))


def with_tags(logs: DataFrame, tags: dict[str, str] | None) -> DataFrame:
    return logs.where(X.tags_match(F.col("tags"), tags)) if tags else logs


def with_text(logs: DataFrame, text: str | None) -> DataFrame:
    return logs.where(X.contains(F.col("message"), text)) if text else logs


def matching(logs: DataFrame, tenant_id: str, from_ms: int | None = None, to_ms: int | None = None, tags: dict[str, str] | None = None, text: str | None = None) -> DataFrame:
    """All records of a search, cheap conditions first."""
    return with_text(with_tags(in_range(of_tenant(logs, tenant_id), from_ms, to_ms), tags), text)


def earliest(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits of the total order: a bounded heap per task, merged on the driver (TakeOrderedAndProject)."""
    return hits.orderBy(*ORDER).limit(limit)


def as_hits(hits: DataFrame) -> DataFrame:
    return hits.select(X.iso(F.col("ts_ms")).alias("timestamp"), "tags", "message")
