"""Blocks, searches and their completeness, ingest and streams, after the behaviour the engine must keep."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tests.damage import flip
from tidemark import functions as X
from tidemark.operators import summaries
from tidemark.operators.cutting import cut
from tidemark.plans.request import Query, batch_errors, from_form, from_parsed, instant_ms, is_blank, search_query
from tidemark.plans.search import SearchEngine
from tidemark.schema import InvalidRequest, Limits, Overloaded, Unavailable
from tidemark.sources import synthetic
from tidemark.sources.blocks import BlockStore
from tidemark.streaming.budget import ByteBudget
from tidemark.streaming.ingest import Ingestor, problems, publish_batch, record_bytes

ROW = "tenant_id string, block_id string, ordinal int, ts_ms long, tags map<string,string>, message string"
BASIC = [("tenant-a", "b1", 0, 1000, {"env": "prod"}, "payment failed for user 42"), ("tenant-a", "b1", 1, 2000, {"env": "staging"}, "payment succeeded"), ("tenant-a", "b1", 2, 3000, {"env": "prod"}, "unrelated log entry")]
LONG = Limits.max_timeout_ms


def store_of(spark, tmp_path, rows, limits=Limits()):
    store = BlockStore(spark, str(tmp_path / "store"), limits)
    if rows:
        store.write(spark.createDataFrame(rows, ROW))
    return store


def find(store, *args, **more):
    return SearchEngine(store).search(Query(*args, **({"timeout_ms": LONG} | more)))


def test_basic_isolation_and_order(spark, tmp_path):
    store = store_of(spark, tmp_path, [*BASIC, ("tenant-a", "b2", 0, 1001, {}, "later"), ("tenant-a", "b2", 1, 1000, {}, "tie")])
    r = find(store, "tenant-a", 0, 10_000, {"env": "prod"}, "payment")
    assert [h["message"] for h in r.results] == ["payment failed for user 42"] and not r.partial
    assert r.results[0]["timestamp"] == "1970-01-01T00:00:01Z"
    assert find(store, "tenant-b", 0, 10_000).candidate_blocks == 0
    r = find(store, "tenant-a", 0, 10_000, limit=2)
    assert [h["message"] for h in r.results] == ["payment failed for user 42", "tie"] and r.truncated
    assert find(store, "tenant-a", 2500, 10_000).candidate_blocks == 1
    assert find(store, "tenant-a", 5000, 5000).results == []


def test_corrupt_block_gives_nothing_and_is_told(spark, tmp_path):
    store = store_of(spark, tmp_path, [*BASIC, ("tenant-a", "b2", 0, 1500, {"env": "prod"}, "payment other")])
    flip(store.catalog().where("block_id = 'b2'").first()["path"], 20)
    r = find(store, "tenant-a", 0, 10_000, {"env": "prod"}, "payment")
    assert len(r.results) == 1 and r.partial and (r.candidate_blocks, r.scanned_blocks, r.skipped_blocks, r.unavailable_blocks) == (2, 1, 1, 0)
    r = find(store, "tenant-a", 0, 10_000)
    assert r.partial and (r.candidate_blocks, r.skipped_blocks, r.unavailable_blocks) == (1, 0, 1)
    assert find(store, "tenant-z", 0, 10).partial


def test_timeout_and_active_limit(spark, tmp_path):
    store = store_of(spark, tmp_path, BASIC)
    r = find(store, "tenant-a", 0, 10_000, timeout_ms=1)
    assert r.timed_out and r.partial
    engine = SearchEngine(store)
    for _ in range(store.limits.max_active_queries):
        engine._permits.acquire()
    r = engine.search(Query("tenant-a", 0, 10_000))
    assert r.partial and r.candidate_blocks == 0 and not r.results


def test_discovery(spark, tmp_path):
    store = store_of(spark, tmp_path, [*BASIC, ("tenant-b", "007", 0, 5, {}, "x")])
    assert {r["block_id"] for r in store.catalog().collect()} == {"b1", "007"}
    (tmp_path / "store/logs/notes.txt").write_text("no block")
    (tmp_path / "store/logs/block_id=bad").mkdir()
    (tmp_path / "store/logs/block_id=bad/part-0.parquet").write_bytes(b"abc")
    again = BlockStore(spark, store.root)
    assert again.discover() == {"blocks": 3, "unavailable": 1}
    assert find(again, "tenant-a", 0, 10_000).returned_count == 3
    # A catalog that was lost is made anew from the blocks.
    import shutil

    shutil.rmtree(tmp_path / "store/catalog")
    again.discover()
    assert find(again, "tenant-b", 0, 10).returned_count == 1


def test_search_equals_a_naive_scan(spark, tmp_path):
    r = random.Random(1234)
    rows = [(f"t{t}", f"t{t}-{b}", i, 1_700_000_000_000 + b * 100_000 + i * 1000, {"env": r.choice(["prod", "staging"]), "service": r.choice(["checkout", "inventory", "search"])}, f"{r.choice(['payment', 'timeout', 'slow', 'ok'])} event {i}") for t in range(2) for b in range(2) for i in range(40)]
    store = store_of(spark, tmp_path, rows)
    for _ in range(6):
        lo = 1_700_000_000_000 + r.randrange(100_000)
        hi, tags, text = lo + r.randrange(1, 140_000), r.choice([{}, {"env": "prod"}, {"env": "prod", "service": "search"}, {"absent": "x"}]), r.choice([None, "slow", "event 1"])
        want = sorted((x[3], x[1], x[2], x[5]) for x in rows if x[0] == "t1" and lo <= x[3] < hi and all(x[4].get(k) == v for k, v in tags.items()) and (text or "") in x[5])
        got = find(store, "t1", lo, hi, tags, text, limit=1000)
        assert [h["message"] for h in got.results] == [w[3] for w in want]


def test_same_blocks_again_replace(spark, tmp_path):
    store = store_of(spark, tmp_path, BASIC)
    store.write(spark.createDataFrame(BASIC, ROW))
    assert store.catalog().count() == 1 and find(store, "tenant-a", 0, 10_000).returned_count == 3


@pytest.mark.parametrize(("pairs", "saturated"), [(64, False), (65, True)])
def test_saturation(spark, pairs, saturated):
    logs = spark.createDataFrame([("t", "b", i, i, {"k": str(i)}, "m") for i in range(pairs)], ROW)
    blocks = summaries.catalog(logs)
    row = blocks.first()
    assert row.tags_saturated is saturated and len(row.tag_summary.get("k", [])) == (0 if saturated else 64)
    # A saturated summary or a key that it lacks rules nothing out.
    assert blocks.where(summaries.tags_fit({"k": "none"})).count() == int(saturated)
    assert blocks.where(summaries.tags_fit({"other": "x"})).count() == 1


def test_literal_text_and_blanks(spark):
    df = spark.createDataFrame([("50%_a\\b",), ("50x_a\\b",)], "message string")
    for text, n in (("%_", 1), ("a\\b", 2), ("", 2), ("A", 0)):
        assert df.where(X.contains(F.col("message"), text)).count() == n
    blanks = ["", " ", "\t\n", " ", " ", "x", "\x1c"]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in blanks], "s string").select(X.is_blank(F.col("s"))).collect()]
    assert got == [True, True, True, True, False, False, True] == [is_blank(b) for b in blanks]


def test_instants(spark):
    cases = {"2024-01-01T00:00:00Z": 1_704_067_200_000, "2024-01-01T00:00:00.0019Z": 1_704_067_200_001, "1969-12-31T23:59:59.9999Z": -1, "2024-01-01T01:00:00+01:00": 1_704_067_200_000, "2024-01-01": None, "not-a-time": None, "2024-01-01T00:00Z": None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in cases], "s string").select("s", X.instant_ms(F.col("s"))).collect()}
    assert got == cases
    for text, want in cases.items():
        if want is None:
            with pytest.raises(ValueError):
                instant_ms(text)
        else:
            assert instant_ms(text) == want


def test_search_validation():
    with pytest.raises(InvalidRequest) as e:
        search_query({"tenant_id": " ", "to": "x", "limit": 0, "timeout_ms": 30_001})
    assert e.value.errors == ["tenant_id is required", "from is required", "limit must be between 1 and 1000", "timeout_ms must be between 1 and 30000"]
    ok = {"tenant_id": "t", "from": "2024-01-01T00:00:00Z", "to": "2024-01-01T00:00:00.0001Z"}
    q = search_query(ok)
    assert q.from_ms == q.to_ms and (q.limit, q.timeout_ms) == (100, 5000)
    with pytest.raises(InvalidRequest, match="from must be before to"):
        search_query(ok | {"to": ok["from"]})
    with pytest.raises(InvalidRequest, match="Invalid timestamp format"):
        search_query(ok | {"to": "not-a-time"})
    with pytest.raises(InvalidRequest):
        search_query(ok | {"tags": {"a": None}})


def test_batch_validation(spark):
    good = {"timestamp": "2024-01-01T00:00:00Z", "message": "m", "tags": {"a": "b"}}
    assert batch_errors("t", [good]) == []
    bad = [{"message": " "}, good | {"tags": {str(i): "v" for i in range(17)}}, good | {"tags": {"k" * 257: "v" * 257}}]
    assert batch_errors("é" * 129, bad) == ["tenant_id exceeds maximum length", "records[0].message is required", "records[0].timestamp is required", "records[1] exceeds max tags: 16", "records[2] tag key exceeds max length: 256", "records[2] tag value exceeds max length: 256"]
    assert batch_errors("t", [good] * 1001)[0] == "Too many records: max 1000"
    df = spark.createDataFrame([("t", r.get("timestamp"), r.get("tags"), r["message"]) for r in [good, *bad]], "tenant_id string, timestamp string, tags map<string,string>, message string")
    assert [len(r[0]) for r in df.select(problems()).collect()] == [0, 2, 1, 2]


def test_forms():
    q = from_form(" t ", "2024-01-01T00:00", "2024-01-02T00:00:00Z", [(" a ", " 1 "), ("a", "2"), ("", "x")], "  hi ")
    assert q == {"tenant_id": "t", "from": "2024-01-01T00:00:00.000Z", "to": "2024-01-02T00:00:00.000Z", "tags": {"a": "2"}, "text": "hi"}
    parsed = {"tenant_id": "t", "from": "2024-01-01T00:00:00Z", "to": "2024-01-02T00:00:00Z", "limit": 5, "junk": 1}
    assert from_parsed(parsed) == {k: v for k, v in parsed.items() if k != "junk"}
    for broken in ("x", parsed | {"tenant_id": " "}, parsed | {"from": "?"}, parsed | {"to": parsed["from"]}):
        with pytest.raises(ValueError):
            from_parsed(broken)


def test_cut_is_greedy(spark):
    sizes = [10, 60, 30, 200, 1, 99, 50]
    rows = [("t", i, {}, "x" * (s - 18) if s > 18 else "") for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "tenant_id string, seq long, tags map<string,string>, message string")
    want, held, block = [], 0, 0
    for _, _, tags, message in rows:
        size = record_bytes(message, tags)
        if held and held + size > 100:
            block, held = block + 1, 0
        held += size
        want.append(block)
    assert [r.block_no for r in cut(df, 100).orderBy("seq").collect()] == want


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def batch(n, size=100):
    return [{"timestamp": f"2024-01-01T00:00:{i % 60:02d}Z", "message": "m" * size, "tags": {}} for i in range(n)]


def test_ingest_flushes_by_size_age_and_close(spark, tmp_path):
    clock = Clock()
    store = store_of(spark, tmp_path, [], Limits(flush_bytes=200))
    ing = Ingestor(store, clock)
    assert ing.ingest("t", batch(2, 150)) == {"accepted_records": 2, "durability": "buffered"}
    assert ing.persisted_records == 1
    clock.now = 6
    ing.tick()
    assert ing.persisted_records == 2
    ing.ingest("u", batch(1))
    ing.close()
    assert ing.accepted_records == ing.persisted_records + ing.lost_records == 3
    with pytest.raises(Unavailable):
        ing.ingest("t", batch(1))
    m = ing.metrics.values()
    assert (m["flush.by.size"], m["flush.by.age"], m["blocks.published"]) == (2, 1, 3)
    row = ing.status().first()
    assert row.status == "healthy" and row.published_blocks == 3 and row.accepted_records == 3
    r = find(store, "t", 0, 2**50)
    assert r.returned_count == 2 and '"partial": false' in r.to_json()
    ing.metrics.save(spark, store.root)
    assert spark.read.parquet(f"{store.root}/metrics").where("name = 'persist.records'").first().value == 3


def test_ingest_refuses_whole_batches(spark, tmp_path):
    ing = Ingestor(store_of(spark, tmp_path, [], Limits(queue_bytes=4096, tenant_queue_bytes=300)))
    with pytest.raises(Overloaded):
        ing.ingest("t", batch(1, 400))
    assert ing.ingest("t", batch(1, 80))["accepted_records"] == 1
    with pytest.raises(InvalidRequest, match="Invalid timestamp"):
        ing.ingest("t", [*batch(1, 10), {"timestamp": "not-a-time", "message": "m"}])
    assert ing.accepted_records == 1
    full = Ingestor(store_of(spark, tmp_path / "x", BASIC, Limits(max_blocks=1)))
    with pytest.raises(Overloaded):
        full.ingest("t", batch(1))


def test_a_failed_flush_is_counted(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    ing = Ingestor(BlockStore(spark, str(tmp_path / "file" / "store")))
    ing.store.is_full = lambda: False
    ing.ingest("t", batch(2))
    ing.close()
    assert not ing.healthy and ing.lost_records == 2 == ing.accepted_records
    ing.closed = False
    with pytest.raises(Unavailable):
        ing.ingest("t", batch(1))


def test_synthetic_is_repeatable(spark):
    a, b = (synthetic.logs(spark, "demo", 500, seed=7).orderBy("seq").collect() for _ in range(2))
    assert a == b and not any("%" in r.message for r in a)
    assert {r.tags["level"] for r in a} <= {"INFO", "WARN", "ERROR"}


def test_searches_in_threads(spark, tmp_path):
    store = store_of(spark, tmp_path, BASIC)
    engine, out = SearchEngine(store), []
    threads = [threading.Thread(target=lambda: out.append(engine.search(Query("tenant-a", 0, 10_000, timeout_ms=LONG)))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r.returned_count for r in out] == [3, 3, 3]


def test_a_block_that_cannot_be_scanned_costs_itself_only(spark, tmp_path, monkeypatch):
    rows = [("tenant-a", f"b{k}", 0, 1000 + k, {}, f"m{k}") for k in range(5)]
    store = store_of(spark, tmp_path, rows)
    engine = SearchEngine(store, group=3)
    paths = {r["block_id"]: r["path"] for r in store.catalog().collect()}
    # Gone between the checksum and the scan.
    store._fs().delete(store._path(paths["b1"]), True)
    r = engine.search(Query("tenant-a", 0, 10_000, timeout_ms=LONG))
    assert [h["message"] for h in r.results] == ["m0", "m2", "m3", "m4"] and (r.skipped_blocks, r.scanned_blocks, r.unavailable_blocks) == (1, 4, 0) and r.partial
    # An error that is no damage: skipped, and not marked.
    read = store.read
    monkeypatch.setattr(store, "read", lambda p: read([*p, str(tmp_path / "none")]) if paths["b3"] in p else read(p))
    for _ in range(2):
        r = engine.search(Query("tenant-a", 0, 10_000, timeout_ms=LONG))
        assert [h["message"] for h in r.results] == ["m0", "m2", "m4"] and (r.skipped_blocks, r.unavailable_blocks, r.candidate_blocks) == (1, 1, 4)
    for _ in range(store.limits.max_active_queries):
        engine._permits.acquire()
    refused = engine.search(Query("tenant-a", 0, 10_000))
    assert refused.partial and not refused.results and refused.unavailable_blocks == 1
    m = engine.metrics.values()
    assert m["catalog.unavailable"] == 1 and m["search.queries.active"] == 0 and m["search.scan_permits.free"] == store.limits.scan_permits and m["search.queries.rejected"] == 1


def test_hits_up_to_the_deadline(spark, tmp_path, monkeypatch):
    import time

    store = store_of(spark, tmp_path, [("t", f"b{k}", 0, 1000 + k, {}, f"m{k}") for k in range(4)], Limits(scan_permits=1))
    engine = SearchEngine(store, group=1)
    scan, began = engine._scan, time.monotonic()

    def slow(query, paths):
        out = scan(query, paths)
        if "block_id=b2" in paths[0]:
            time.sleep(max(0.0, 13 - (time.monotonic() - began)))
        return out

    monkeypatch.setattr(engine, "_scan", slow)
    r = engine.search(Query("t", 0, 10_000, timeout_ms=12_000))
    assert r.timed_out and r.partial and [h["message"] for h in r.results][:2] == ["m0", "m1"] and r.scanned_blocks < 4


def test_verified_files_are_remembered_up_to_a_number(spark, tmp_path):
    store = store_of(spark, tmp_path, [("t", f"b{k}", 0, k, {}, "m") for k in range(4)], Limits(verified_blocks=2))
    assert len(store._verified) == 2 and len(store.unverified(store.catalog().collect())) == 2
    assert find(store, "t", 0, 10).returned_count == 4 and len(store._verified) == 2


def test_budgets_add_up_and_are_given_back(spark, tmp_path):
    b = ByteBudget(100, 60)
    assert b.reserve(50, "a") and not b.reserve(20, "a") and b.reserve(50, "b") and not b.reserve(1, "c")
    assert (b.in_use, b.of_tenant("a"), b.of_tenant("c")) == (100, 50, 0)
    b.release(50, "a")
    assert b.reserve(40, "c") and b.in_use == 90
    with pytest.raises(ValueError):
        b.release(41, "c")
    ing = Ingestor(store_of(spark, tmp_path, [], Limits(queue_bytes=1000, tenant_queue_bytes=400)))
    ing.ingest("t", batch(3, 100), drain=False)
    with pytest.raises(Overloaded, match="354 of 400"):
        ing.ingest("t", batch(1, 100), drain=False)
    ing.ingest("u", batch(3, 100), drain=False)
    with pytest.raises(Overloaded):
        ing.ingest("v", batch(3, 100), drain=False)
    status = ing.status().first()
    assert status.buffer_usage_pct == pytest.approx(70.8) and ing.metrics.values()["queue.bytes"] == 708
    ing.drain()
    assert ing.queued.in_use == 0 and ing.buffered_bytes == 708 and ing.ingest("t", batch(3, 100))["accepted_records"] == 3
    ing.close()
    assert ing.held.in_use == 0 and ing.persisted_records == 9 and ing.metrics.values()["ingest.rejected"] == 2
    ing.closed, ing.healthy = False, False
    with pytest.raises(Unavailable):
        ing.ingest("t", batch(1))
    assert ing.metrics.values()["ingest.rejected"] == 3


def test_writers_in_threads_lose_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path, [], Limits(flush_bytes=20_000))
    ing = Ingestor(store)
    work = lambda w: [ing.ingest(f"t{w % 2}", batch(25)) for _ in range(10)]
    threads = [threading.Thread(target=work, args=(w,)) for w in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ing.close()
    assert ing.accepted_records == ing.persisted_records == 1500 and ing.lost_records == 0 and ing.queued.in_use == ing.held.in_use == 0
    assert store.catalog().agg(F.sum("record_count")).first()[0] == 1500


def test_a_retried_batch_leaves_nothing_behind(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path / "store"), Limits(flush_bytes=300))
    frame = lambda n: spark.createDataFrame([("t", f"2024-01-01T00:00:{i:02d}Z", {}, "m" * 100) for i in range(n)], "tenant_id string, timestamp string, tags map<string,string>, message string")
    assert publish_batch(store, frame(10), 3)["blocks"] == 5
    assert publish_batch(store, frame(4), 3)["blocks"] == 2
    assert store.catalog().count() == 2 and store.discover() == {"blocks": 2, "unavailable": 0}
    publish_batch(store, frame(2), 4)
    store.compact()
    assert store.catalog().count() == 3 and len([n for n in store._listed(f"{store.root}/catalog") if n.startswith("publish=")]) == 1
