"""The block store: immutable Parquet files, one per block, and a catalog of what each holds.

    <root>/logs/block_id=<id>/part-*.parquet    tenant_id, ordinal, ts_ms, tags, message
    <root>/catalog/publish=<key>/               rows of what was published together; a block exists once its row does, and
                                                the latest of its rows counts. Nothing but a publish of the same key
                                                (a retried micro-batch) is ever written over.
    <root>/unavailable/                         ids of blocks found missing or damaged
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import summaries
from tidemark.schema import CATALOG, LOGS, Limits


class BlockStore:
    def __init__(self, spark: SparkSession, root: str, limits: Limits = Limits()):
        self.spark, self.root, self.limits = spark, root.rstrip("/"), limits
        # Ids are text, whatever they look like; a damaged page must raise, not decode to something else.
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.sparkContext._jsc.hadoopConfiguration().set("parquet.page.verify-checksum.enabled", "true")
        # Blocks whose files' checksums were compared, oldest first; and how many blocks there are, as far as this store knows.
        self._verified: OrderedDict[str, int] = OrderedDict()
        self._lock = threading.Lock()
        self._counts: dict[str, int] = {}

    # Files, by Hadoop's interface, so that any store will do.

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs().exists(self._path(path))

    def _listed(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs().listStatus(self._path(path))] if self.exists(path) else []

    # Writing.

    def write(self, records: DataFrame, key: str | None = None) -> DataFrame:
        """Publishes records (tenant_id, block_id, ordinal, ts_ms, tags, message) and returns their catalog rows.

        The same block_ids again replace what is there; the same key again replaces what was published by it.
        """
        # Read twice, for the files and for their ids; spills to disk where memory is short.
        rows = records.select(*[F.col(f.name).cast(f.dataType) for f in LOGS]).persist()
        (
            rows.repartition("block_id").sortWithinPartitions("block_id", "ordinal").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("compression", "zstd").partitionBy("block_id").parquet(f"{self.root}/logs")
        )
        ids = [r[0] for r in rows.select("block_id").distinct().collect()]
        rows.unpersist()
        return self._publish(ids, key)

    def _publish(self, ids: list[str], key: str | None = None) -> DataFrame:
        """Catalog rows of what is on disk, read back from there."""
        if not ids:
            return self.spark.createDataFrame([], CATALOG)
        paths = [f"{self.root}/logs/block_id={i}" for i in ids]
        made = summaries.catalog(self.read(paths), self.limits.max_tag_pairs).join(self._files(paths), "block_id").withColumn("published", F.lit(time.time_ns()))
        path = f"{self.root}/catalog/publish={key or uuid.uuid4().hex}"
        made.select(*CATALOG.names).coalesce(1).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(CATALOG).parquet(path)
        # What was just summed up needs no comparison.
        self._remember({r["block_id"]: r["file_crc"] for r in out.select("block_id", "file_crc").collect()})
        self._counts.clear()
        return out

    def drop(self, prefix: str) -> None:
        """Blocks whose ids start so, from disk; their rows go when their key is published again."""
        found = self._fs().globStatus(self._path(f"{self.root}/logs/block_id={prefix}*"))
        for status in found or []:
            self._fs().delete(status.getPath(), True)

    def compact(self) -> None:
        """One file for the whole catalog; the rows that it replaces go after it is there."""
        old = [n for n in self._listed(f"{self.root}/catalog") if n.startswith("publish=")]
        if len(old) > 1:
            self._rows().coalesce(1).write.mode("overwrite").parquet(f"{self.root}/catalog/publish=compact-{uuid.uuid4().hex}")
            for name in old:
                self._fs().delete(self._path(f"{self.root}/catalog/{name}"), True)

    def _files(self, paths: list[str]) -> DataFrame:
        """block_id, path, file_bytes and file_crc (CRC-32 of the whole file) of what can be listed."""
        df = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths)
        return df.select(F.regexp_extract("path", "block_id=([^/]*)/", 1).alias("block_id"), "path", F.col("length").alias("file_bytes"), F.crc32("content").alias("file_crc"))

    # Reading.

    def read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], LOGS)
        return self.spark.read.schema(LOGS).option("basePath", f"{self.root}/logs").parquet(*paths)

    def _rows(self) -> DataFrame:
        """Of each block its latest row."""
        if not self.exists(f"{self.root}/catalog"):
            return self.spark.createDataFrame([], CATALOG)
        rows = self.spark.read.schema(CATALOG).parquet(f"{self.root}/catalog")
        # Of the latest publish; a map is no part of an order.
        return rows.groupBy("block_id").agg(F.max_by(F.struct(*CATALOG.names[1:]), "published").alias("row")).select("block_id", "row.*")

    def catalog(self) -> DataFrame:
        """Published blocks with `available`. Blocks without a row that stand on disk are found by discover()."""
        bad = self.unavailable()
        return self._rows().join(bad.select("block_id", F.lit(True).alias("bad")), "block_id", "left").select(*CATALOG.names, F.col("bad").isNull().alias("available"))

    def _count(self, what: str, rows: Callable[[], DataFrame]) -> int:
        if what not in self._counts:
            self._counts[what] = rows().count()
        return self._counts[what]

    def n_blocks(self) -> int:
        """Published blocks, counted once after each publish of this store."""
        return self._count("blocks", self._rows)

    def n_unavailable(self) -> int:
        return self._count("unavailable", self.unavailable)

    def unavailable(self) -> DataFrame:
        path = f"{self.root}/unavailable"
        return (self.spark.read.schema("block_id string, reason string").parquet(path) if self.exists(path) else self.spark.createDataFrame([], "block_id string, reason string")).dropDuplicates(["block_id"])

    def mark_unavailable(self, blocks: dict[str, str]) -> None:
        """blocks: reason by id. Marked once is marked for good."""
        known = {r[0] for r in self.unavailable().select("block_id").collect()}
        if new := [(i, why) for i, why in sorted(blocks.items()) if i not in known]:
            self.spark.createDataFrame(new, "block_id string, reason string").coalesce(1).write.mode("append").parquet(f"{self.root}/unavailable")
            self._counts.pop("unavailable", None)

    def _remember(self, verified: dict[str, int]) -> None:
        with self._lock:
            for i, crc in verified.items():
                self._verified[i] = crc
                self._verified.move_to_end(i)
            while len(self._verified) > self.limits.verified_blocks:
                self._verified.popitem(last=False)

    def unverified(self, blocks: list) -> list:
        """Those of the catalog rows given whose files this store has not compared yet, or no longer remembers."""
        with self._lock:
            return [b for b in blocks if self._verified.get(b["block_id"]) != b["file_crc"]]

    def health(self, blocks: list) -> dict[str, str]:
        """ok, missing or corrupt for each catalog row given, by the checksum of the whole file, in one job."""
        with self._lock:
            for b in blocks:
                self._verified.pop(b["block_id"], None)
        there = [b for b in blocks if self.exists(b["path"])]
        found = {r["block_id"]: r["file_crc"] for r in self._files([b["path"] for b in there]).collect()} if there else {}
        out = {b["block_id"]: "missing" if b["block_id"] not in found else "ok" if found[b["block_id"]] == b["file_crc"] else "corrupt" for b in blocks}
        self._remember({b["block_id"]: b["file_crc"] for b in blocks if out[b["block_id"]] == "ok"})
        return out

    def discover(self) -> dict[str, int]:
        """Start-up: takes in blocks on disk that the catalog lacks, and marks those that cannot be read.

        Anything but block directories is ignored. One that cannot be read never ends the search for others.
        """
        on_disk = {n.removeprefix("block_id=") for n in self._listed(f"{self.root}/logs") if n.startswith("block_id=")}
        rows = {r["block_id"]: r for r in self.catalog().collect()}
        bad = {i: "missing" for i in rows if i not in on_disk and rows[i]["available"]}
        bad |= self._take_in(sorted(on_disk - rows.keys()))
        self.mark_unavailable(bad)
        return {"blocks": len(on_disk | rows.keys()), "unavailable": self.unavailable().count()}

    def _take_in(self, ids: list[str]) -> dict[str, str]:
        """Publishes blocks that stand on disk, all in one job if all can be read, else by halves; what cannot be read, and why."""
        if not ids:
            return {}
        try:
            self._publish(ids)
        except Exception as e:  # noqa: BLE001  whatever is wrong with one file
            if len(ids) == 1:
                return {ids[0]: f"unreadable: {type(e).__name__}"}
            return self._take_in(ids[: len(ids) // 2]) | self._take_in(ids[len(ids) // 2 :])
        return {}

    def is_full(self) -> bool:
        return self.n_blocks() >= self.limits.max_blocks
