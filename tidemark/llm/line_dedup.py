"""Line dedup by site-relative frequency: a line that too large a share of a host's pages carry is boilerplate.

The share of a line is the number of the host's pages that contain it over the host's page total; a line goes from all
pages of the host if its share exceeds `ratio` and at least `min_pages` pages have it. Lines are compared after
trimming blanks; blank lines stay. A null host is a host of its own; a null text stays null and counts as a page
without lines; equal rows count as pages each; an empty table gives an empty table; other columns pass through. A text
of which every line goes becomes empty. Lines are told apart by a 64-bit hash of host and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, fresh, materialize

RATIO, MIN_PAGES = 0.05, 3
#: Stands for a null host; no host name holds this character.
NO_HOST = "\x00"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(host: Column, line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.when(trimmed != "", F.xxhash64(host, trimmed))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host that has any: tm_host, and tm_lines, the hashes of its boilerplate lines.

    A host of average m lines a page has at most m / ratio of them, so that the array is bounded by the rule itself.
    Only hashes are shuffled, counted per task first.
    """
    pages = docs.select(F.coalesce(F.col(host), F.lit(NO_HOST)).alias("tm_host"), F.col(text).alias("tm_text"))
    totals = pages.groupBy("tm_host").agg(F.count(F.lit(1)).alias("tm_total"))
    keys = F.array_distinct(F.transform(_lines(F.col("tm_text")), lambda x: _key(F.col("tm_host"), x)))
    counts = pages.select("tm_host", F.explode(keys).alias("tm_key")).where("tm_key is not null").groupBy("tm_host", "tm_key").agg(F.count(F.lit(1)).alias("tm_pages"))
    often = counts.where(F.col("tm_pages") >= min_pages).join(totals, "tm_host").where(F.col("tm_pages") > ratio * F.col("tm_total"))
    return often.groupBy("tm_host").agg(F.collect_set("tm_key").alias("tm_lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs without their boilerplate lines; `counts` names two more columns, for lines in all and lines dropped.

    The table of boilerplate is written first, so that the planner joins by its true size: a broadcast below
    spark.sql.autoBroadcastJoinThreshold, else a shuffle whose hot hosts AQE splits.
    """
    found = materialize(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    key, hit, bad = fresh(docs, "tm_host_key", "tm_hit", "tm_bad")
    found = found.select(F.col("tm_host").alias(key), F.col("tm_lines").alias(bad))
    out = docs.withColumn(key, F.coalesce(F.col(host), F.lit(NO_HOST))).join(found, key, "left")
    lines, keyed = _lines(F.col(text)), lambda x: _key(F.col(key), x)
    # What of the host's boilerplate this page has: most pages have little, and their lines are compared with that only.
    out = out.withColumn(hit, F.array_intersect(F.transform(lines, keyed), F.col(bad)))
    some = F.size(hit) > 0
    stays = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(hit), keyed(x)), F.lit(False)))
    new = F.when(some, F.array_join(stays, "\n")).otherwise(F.col(text))
    columns = [new.alias(c) if c == text else F.col(c) for c in docs.columns]
    if counts:
        n, gone = F.coalesce(F.size(lines), F.lit(0)), F.when(some, F.size(lines) - F.size(stays)).otherwise(0)
        columns += [F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias(counts[0]), gone.cast("long").alias(counts[1])]
    return out.select(*columns)
