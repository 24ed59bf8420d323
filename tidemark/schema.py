"""Schemas, limits and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: A batch record as it arrives: the time is an ISO string.
INPUT = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("message", T.StringType()),
])
#: A stored record. block_id is the directory's name.
LOGS = T.StructType([
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("ts_ms", T.LongType(), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("block_id", T.StringType(), False),
])
CATALOG = T.StructType([
    T.StructField("block_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("min_ts", T.LongType()),
    T.StructField("max_ts", T.LongType()),
    T.StructField("record_count", T.LongType()),
    T.StructField("raw_bytes", T.LongType()),
    T.StructField("tag_summary", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("tags_saturated", T.BooleanType()),
    T.StructField("file_bytes", T.LongType()),
    T.StructField("file_crc", T.LongType()),
    #: When the row was made, in nanoseconds: of several rows of a block the latest counts.
    T.StructField("published", T.LongType()),
])


@dataclass(frozen=True)
class Limits:
    """Defaults that equal the documented ones."""

    max_batch_records: int = 1_000
    max_batch_bytes: int = 5_000_000
    max_record_bytes: int = 65_536
    max_tags: int = 16
    max_tag_key_bytes: int = 256
    max_tag_value_bytes: int = 256
    max_tenant_bytes: int = 256
    flush_bytes: int = 5_000_000
    flush_age_s: float = 5.0
    max_blocks: int = 10_000
    default_limit: int = 100
    max_limit: int = 1_000
    default_timeout_ms: int = 5_000
    max_timeout_ms: int = 30_000
    max_active_queries: int = 4
    queue_bytes: int = 64 << 20
    buffer_bytes: int = 64 << 20
    tenant_queue_bytes: int = 16 << 20
    """0: as much as queue_bytes."""
    max_tag_pairs: int = 64
    scan_permits: int = 4
    #: Blocks whose whole-file checksum is remembered as compared.
    verified_blocks: int = 100_000


class InvalidRequest(ValueError):
    """Status 400; `errors` lists everything that is wrong."""

    status = 400

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


class Overloaded(RuntimeError):
    """Status 429: a budget is used up, or the catalog is full. Nothing of the batch was taken."""

    status = 429


class Unavailable(RuntimeError):
    """Status 503: a flush failed, or the engine shuts down."""

    status = 503
