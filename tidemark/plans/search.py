"""Searching the block store, with an account of how complete the answer is."""

from __future__ import annotations

import heapq
import json
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from tidemark import functions as X
from tidemark.operators import records, summaries
from tidemark.plans.request import Query
from tidemark.sources.blocks import BlockStore
from tidemark.streaming.metrics import Metrics


@dataclass
class Response:
    results: list[dict] = field(default_factory=list)
    returned_count: int = 0
    partial: bool = False
    truncated: bool = False
    timed_out: bool = False
    skipped_blocks: int = 0
    unavailable_blocks: int = 0
    candidate_blocks: int = 0
    scanned_blocks: int = 0
    elapsed_ms: int = 0
    #: Besides: unavailable blocks whose tenant is known to be the query's, and blocks ruled out.
    unavailable_of_tenant: int = 0
    pruned_blocks: int = 0

    def to_json(self) -> str:
        """The answer as a document; fields that are null are left out."""
        hits = [{k: v for k, v in h.items() if v is not None} for h in self.results]
        return json.dumps({k: v for k, v in vars(self).items() if v is not None} | {"results": hits}, ensure_ascii=False)


class SearchEngine:
    """At most max_active_queries at once. Candidate blocks are scanned in groups, earliest first, scan_permits groups at a
    time; a search that runs out of time returns what the groups that are done have found.

    A file's checksum is compared before its first scan by this store; later scans rely on the pages' checksums. A group
    that cannot be scanned is looked at block by block: damaged or missing blocks are marked unavailable, and whatever
    else fails costs its own block only, which counts as skipped.
    """

    def __init__(self, store: BlockStore, group: int = 16, metrics: Metrics | None = None):
        self.store, self.group, self.metrics = store, group, metrics or Metrics()
        self._permits = threading.BoundedSemaphore(store.limits.max_active_queries)
        self._scans = threading.BoundedSemaphore(store.limits.scan_permits)
        self._lock = threading.Lock()
        self.active = self.scanning = 0

    def _count(self, active: int = 0, scanning: int = 0) -> None:
        with self._lock:
            self.active += active
            self.scanning += scanning
            self.metrics.gauge("search.queries.active", self.active)
            self.metrics.gauge("search.scan_permits.free", self.store.limits.scan_permits - self.scanning)

    def search(self, query: Query) -> Response:
        began = time.monotonic()
        if not self._permits.acquire(blocking=False):
            self.metrics.add("search.queries.rejected")
            return Response(partial=True, unavailable_blocks=self.store.n_unavailable(), elapsed_ms=int((time.monotonic() - began) * 1000))
        self._count(active=1)
        try:
            out = self._search(query, began + query.timeout_ms / 1000)
        finally:
            self._count(active=-1)
            self._permits.release()
        out.elapsed_ms = int((time.monotonic() - began) * 1000)
        m = self.metrics
        for name, n in (("blocks.candidates", out.candidate_blocks), ("blocks.scanned", out.scanned_blocks), ("blocks.pruned", out.pruned_blocks), ("blocks.skipped", out.skipped_blocks), ("queries.timed_out", int(out.timed_out))):
            m.add(f"search.{name}", n)
        m.gauge("catalog.unavailable", self.store.n_unavailable())
        m.time("search.duration", out.elapsed_ms)
        return out

    def _search(self, query: Query, deadline: float) -> Response:
        spark, store = self.store.spark, self.store
        out, name = Response(), f"tidemark-search-{uuid.uuid4().hex}"
        stopped = threading.Event()

        def stop() -> None:
            stopped.set()
            spark.sparkContext.cancelJobGroup(name)

        timer = threading.Timer(max(0.0, deadline - time.monotonic()), stop)
        timer.daemon = True
        timer.start()
        total, best = 0, []
        try:
            spark.sparkContext.setJobGroup(name, "search", True)
            judged = summaries.verdicts(store.catalog(), query.tenant_id, query.from_ms, query.to_ms, query.tags).select("block_id", "path", "tenant_id", "min_ts", "file_crc", "verdict").collect()
            blocks = sorted((b for b in judged if b["verdict"] == "candidate"), key=lambda b: (b["min_ts"], b["block_id"]))
            bad = [b for b in judged if b["verdict"] == "unavailable"]
            out.candidate_blocks, out.pruned_blocks = len(blocks), len(judged) - len(blocks) - len(bad)
            # Before the scan: what this search itself finds damaged counts as skipped.
            out.unavailable_blocks = store.n_unavailable()
            out.unavailable_of_tenant = sum(b["tenant_id"] == query.tenant_id for b in bad)
            groups = [blocks[k : k + self.group] for k in range(0, len(blocks), self.group)]

            def scan(group: list) -> tuple[list[tuple], int, int] | None:
                """First hits, their number, and blocks scanned; None if time ran out."""
                if stopped.is_set() or time.monotonic() >= deadline:
                    return None
                with self._scans:
                    self._count(scanning=1)
                    spark.sparkContext.setJobGroup(name, "search", True)
                    try:
                        return self._group(query, group, stopped)
                    except Exception:
                        if stopped.is_set():
                            return None
                        raise
                    finally:
                        self._count(scanning=-1)

            if len(groups) <= 1:
                done = map(scan, groups)
            else:
                pool = ThreadPoolExecutor(store.limits.scan_permits)
                done = pool.map(scan, groups)
                pool.shutdown(wait=False)
            for group, found in zip(groups, done, strict=True):
                if found is None:
                    out.timed_out = True
                    continue
                hits, n, scanned = found
                total += n
                best = heapq.nsmallest(query.limit, best + hits, key=lambda h: h[0])
                out.scanned_blocks += scanned
                out.skipped_blocks += len(group) - scanned
        except Exception:
            if not stopped.is_set():
                raise
            out.timed_out = True
        finally:
            timer.cancel()
            spark.sparkContext._jsc.sc().clearJobGroup()
        out.results = [h[1] for h in best]
        out.returned_count = len(best)
        out.truncated = total > len(best)
        out.partial = out.timed_out or out.skipped_blocks > 0 or out.unavailable_blocks > 0 or out.scanned_blocks < out.candidate_blocks
        return out

    def _group(self, query: Query, group: list, stopped: threading.Event) -> tuple[list[tuple], int, int]:
        new = self.store.unverified(group)
        good = self._healthy(group, new) if new else group
        try:
            return *self._scan(query, [b["path"] for b in good]), len(good)
        except Exception:
            if stopped.is_set():
                raise
        # Something in it cannot be scanned.
        hits, total, scanned = [], 0, 0
        for b in self._healthy(good, good):
            try:
                found, n = self._scan(query, [b["path"]])
            except Exception:  # noqa: BLE001  whatever it is, it costs this block only
                if stopped.is_set():
                    raise
                continue
            hits, total, scanned = hits + found, total + n, scanned + 1
        return hits, total, scanned

    def _healthy(self, group: list, looked_at: list) -> list:
        """group without the blocks that are found damaged, which are marked."""
        state = self.store.health(looked_at)
        damaged = {i: s for i, s in state.items() if s != "ok"}
        if damaged:
            self.store.mark_unavailable(damaged)
        return [b for b in group if b["block_id"] not in damaged]

    def _scan(self, query: Query, paths: list[str]) -> tuple[list[tuple], int]:
        """The group's first hits, and how many there are in all, in one job."""
        from pyspark.sql import Observation

        if not paths:
            return [], 0
        seen = Observation()
        found = records.matching(self.store.read(paths), query.tenant_id, query.from_ms, query.to_ms, query.tags, query.text).observe(seen, F.count(F.lit(1)).alias("n"))
        rows = records.earliest(found, query.limit).select(*records.ORDER, X.iso(F.col("ts_ms")).alias("timestamp"), "tags", "message").collect()
        return [((r["ts_ms"], r["block_id"], r["ordinal"]), {"timestamp": r["timestamp"], "tags": r["tags"], "message": r["message"]}) for r in rows], seen.get["n"]
