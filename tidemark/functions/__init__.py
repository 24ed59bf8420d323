"""Scalar expressions of the log store, all built from Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, T, time with seconds and up to nine digits of a fraction, then Z or an offset.
INSTANT = r"^[+-]?\d{4,9}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{0,9})?([Zz]|[+-]\d{2}(:\d{2}(:\d{2})?)?)$"


def contains(text: Column, literal: str | None) -> Column:
    """Literal, case-sensitive; nothing asked for matches all."""
    return text.contains(F.lit(literal)) if literal else F.lit(True)


def is_blank(text: Column) -> Column:
    """Only Java white space (a no-break space is none), or null."""
    return F.coalesce(text.rlike(r"^\p{javaWhitespace}*$"), F.lit(True))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def instant_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO instant, floored; null if it is none."""
    return F.when(text.rlike(INSTANT), F.unix_millis(F.try_to_timestamp(F.upper(text))))


def iso(ts_ms: Column) -> Column:
    """ISO instant of epoch milliseconds; whole seconds have no fraction. The session's zone must be UTC."""
    at = F.timestamp_millis(ts_ms)
    return F.when(F.pmod(ts_ms, F.lit(1000)) == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def tag(tags: Column, key: str) -> Column:
    """The value, or null where there is no such key."""
    return F.element_at(tags, F.lit(key))


def tags_match(tags: Column, wanted: dict[str, str] | None) -> Column:
    """Every wanted pair is there, exactly; never null, so that it can be negated."""
    return reduce(lambda a, b: a & b, [F.coalesce(tag(tags, k) == F.lit(v), F.lit(False)) for k, v in (wanted or {}).items()], F.lit(True))


def tag_count(tags: Column) -> Column:
    return F.when(tags.isNull(), 0).otherwise(F.size(tags))


def encoded_size(message: Column, tags: Column) -> Column:
    """Bytes that a record counts for: 18, its message, and 4 more than key and value for each tag."""
    pairs = F.aggregate(F.map_entries(tags), F.lit(0), lambda a, e: a + 4 + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return (18 + F.octet_length(message) + F.coalesce(pairs, F.lit(0))).cast("long")


def crc32(data: Column) -> Column:
    return F.crc32(data)


def usage_percent(used: Column, cap: Column) -> Column:
    return F.when(cap > 0, 100.0 * used / cap).otherwise(0.0)


def to_json(record: Column) -> Column:
    """Fields that are null are left out."""
    return F.to_json(record, {"ignoreNullFields": "true"})
