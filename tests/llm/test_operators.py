"""Each text operator against a brute-force version, a round trip or held-out labels, and on awkward inputs."""

import base64
import collections
import gzip
import hashlib
import html
import io
import itertools
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import bktree, components, decontam, html_text, line_dedup, mixing, pii, quality_rules, queries, simhash, suffix_dedup, toxicity, warc
from tidemark.llm.common import table

#: A null, an empty text, blanks, a very long one, ties and repeated rows.
AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "word " * 30_000), (5, "same text of a few words"), (6, "same text of a few words"), (7, "x" * 50_000), (7, "x" * 50_000), (8, "ünï çødé \U0001f600 " * 40), (None, "no id")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("en"), "s": F.lit(1), "TM_TEXT": F.lit(2), "shard": F.lit(3), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    # Nulls stay nulls as Python's values.
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(", ".join(columns)).fetchall()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_give_every_row(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


# 1


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_simhash(spark, texts):
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps, 3)


def test_simhash_links_chains_of_bits(spark):
    r = random.Random(5)
    fps, f = {}, r.getrandbits(63)
    for i in range(60):
        for b in r.sample(range(63), r.choice([1, 3, 4])):
            f ^= 1 << b
        fps[i] = f
    distinct = spark.createDataFrame([(v, k) for k, v in fps.items()], "fp long, rep long")
    got = {r.node: r.component for r in components.components(simhash.links(simhash.shards(distinct, 3), 3)).collect()}
    want = brute_components(fps, 3)
    assert got == {i: c for i, c in want.items() if c != i}


def test_simhash_awkward(spark, awkward):
    got = {r.doc_id: r for r in simhash.near_duplicates(awkward).collect()}
    assert [got[i].fp for i in (1, 2, 3)] == [0, 0, 0] and {got[i].component_id for i in (1, 2, 3)} == {1}
    assert got[6].component_id == 5 and got[None].component_id is None
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0
    kept = simhash.drop_near_copies(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 7, 7, 8]
    assert kept.where("doc_id is null").count() == 1


def test_bktree_finds_what_a_scan_finds():
    r = np.random.default_rng(1)
    values = np.unique(np.concatenate([r.integers(0, 2**63, 200, dtype=np.uint64), np.uint64(1) << r.integers(0, 63, 60, dtype=np.uint64)]))
    for radius in (0, 2, 20):
        got = {(int(a), int(b)) for x, y in bktree.BKTree(values).within(values, radius, chunk=37) for a, b in zip(x, y, strict=True)}
        assert got == {(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= radius).tolist()}


def test_near_copies(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    base = [[r.choice(vocabulary) for _ in range(150)] for _ in range(8)]
    rows, near = [], {}
    for k, b in enumerate(base):
        for n in range(5):
            w = list(b)
            if n:
                w[20 * n] = "changed"  # 5 of 146 shingles
            rows.append((10 * k + n, " ".join(w)))
            near.setdefault(k, []).append(10 * k + n)
    rows += [(1000 + k, " ".join(r.choice(vocabulary) for _ in range(150))) for k in range(20)]
    half = base[0][:75] + [r.choice(vocabulary) for _ in range(75)]
    rows.append((2000, " ".join(half)))
    out = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in out.collect()) == sorted([g[0] for g in near.values()] + [1000 + k for k in range(20)] + [2000])


def test_near_copies_whatever_repeats(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        w = [f"w{r.randrange(50_000)}" for _ in range(r.choice((30, 100, 400)))]
        # A run of one word, and the last words replaced: sets alike, or just not.
        for n in (0, len(w) // 3, len(w) // 4):
            out = w + ["-"] * n
            for at in range(r.randrange(3) * len(w) // 12 if n else 0):
                out[at] = f"x{r.randrange(50_000)}"
            rows.append((len(rows), " ".join(out)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    stay = {x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(like(a, b) for a in stay for b in stay if b < a)
    assert len(stay) < len(rows) - 60 and all(any(like(a, b) for b in range(a)) for a in set(range(len(rows))) - stay)


def test_near_copies_are_seldom_lost(spark):
    """Of pairs of similarity 0.858, bands that do not hang together lose one in millions."""
    r = random.Random(21)
    rows = []
    for k in range(4000):
        w = [f"w{r.randrange(50_000)}" for _ in range(200)]
        rows.append((2 * k, " ".join(w)))
        for at in (20, 90, 160):
            w[at] = "changed"  # 15 of 196 shingles in all
        rows.append((2 * k + 1, " ".join(w)))
    stay = {x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert stay == set(range(0, 8000, 2))


def test_bands_are_independent():
    """Two sets share a band with a chance of similarity ** 4, and hardly ever none."""
    r = np.random.default_rng(22)
    equal = []
    for _ in range(10_000):
        h = r.integers(0, 2**64, 216, dtype=np.uint64)
        equal.append((simhash.bands(h[:200]) == simhash.bands(h[16:])).sum())
    assert abs(np.mean(equal) / 20 - (184 / 216) ** 4) < 0.01 and min(equal) > 0


def brute_stays(texts, similarity=0.8):
    """In order of id, each goes that is similar to one that stays."""
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    out = []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[k]) >= similarity * len(sets[i] | sets[k]) - 1e-9 for k in out):
            out.append(i)
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_near_copies_by_brute_force(spark, block):
    """Chains of texts, each a little unlike the one before, whose ends are not alike: whatever the blocks, none is lost."""
    r = random.Random(9)
    word = lambda: f"w{r.randrange(50_000)}"
    texts = {}
    for _ in range(6):
        w = [word() for _ in range(120)]
        for _ in range(14):
            w = list(w)
            at = r.randrange(115)
            w[at : at + r.choice((1, 3))] = [word() for _ in range(r.choice((1, 2, 4)))]
            texts[r.randrange(10**6)] = " ".join(w)
    stay = sorted(x.doc_id for x in simhash.drop_near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=block).collect())
    assert stay == brute_stays(texts) and 12 < len(stay) < len(texts) - 12


def test_near_copies_link_by_fingerprint(spark):
    """All within 3 bits; within the wider radius those that share a band and are of like size; no others, band or not."""
    r = random.Random(13)
    rows, seen = [], set()
    for _ in range(120):
        f, shared = r.getrandbits(64), r.getrandbits(60)
        for _ in range(r.choice((2, 3, 8))):
            g = f
            for b in r.sample(range(64), r.choice((1, 2, 3, 5, 20, 26, 27, 40))):
                g ^= 1 << b
            if g not in seen:  # of equal ones the tree knows the least and the largest size
                rows.append((len(rows), r.choice((40, 45, 50, 70)), g - (g >> 63 << 64), [r.choice((shared, r.getrandbits(60))), r.getrandbits(60)]))
                seen.add(g)
    apart = lambda x, y: ((x[2] ^ y[2]) & (1 << 64) - 1).bit_count()
    label = list(range(len(rows)))
    for x, y in itertools.combinations(rows, 2):
        banded = bool(set(x[3]) & set(y[3])) and min(x[1], y[1]) >= 0.8 * max(x[1], y[1])
        if apart(x, y) <= (26 if banded else 3):
            a, b = sorted((label[x[0]], label[y[0]]))
            label = [a if c == b else c for c in label]
    found = spark.createDataFrame(rows, "doc_id long, size long, fp long, bands array<long>")
    got = {x.node: x.component for x in components.components(simhash.copy_links(found, 0.8)).collect()}
    assert got == {i: c for i, c in enumerate(label) if c != i} and len(set(label)) > 60 and len(got) > 60


def test_radius_holds_near_copies():
    """Fingerprints of sets whose similarity is at its bound, 0.8 or as near above it as their sizes allow."""
    r = np.random.default_rng(14)
    most = 0
    for shared in [*range(4, 60)] * 40:
        own = int(shared / 0.8 + 1e-9) - shared
        h = r.integers(0, 2**64, shared + own, dtype=np.uint64)
        k = shared + int(r.integers(0, own + 1))
        most = max(most, (simhash.fingerprint(h[:k]) ^ simhash.fingerprint(np.append(h[:shared], h[k:]))).bit_count())
    assert 15 < most <= simhash.COPY_RADIUS


def test_bktree_spreads_over_components():
    r = np.random.default_rng(15)
    bits = lambda n, most: np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, most), replace=False)) for _ in range(n)], dtype=np.uint64)
    values = np.unique(np.concatenate([r.integers(0, 2**63, 40, dtype=np.uint64)[:, None] ^ bits(8, 14)[None, :], r.integers(0, 2**63, (40, 1), dtype=np.uint64)], axis=1).ravel())
    for radius in (0, 6, 12, 18):
        for pairs in (1, 300, 1 << 20):
            tree = bktree.BKTree(values)
            assert (tree.spread(radius, lambda a, b: a >= 0, pairs) == bktree.forest(values, radius)).all()
    odd = bktree.BKTree(values).spread(64, lambda a, b: a % 2 == b % 2)
    assert (odd == np.arange(len(values)) % 2).all()
    # A large group costs no square of its size.
    group = np.unique(r.integers(0, 2**63, dtype=np.uint64) ^ bits(60_000, 9))
    began = time.process_time()
    assert (bktree.BKTree(group).spread(26, lambda a, b: a >= 0) == 0).all() and time.process_time() - began < 20


def test_kept_sets_are_not_alike():
    r = np.random.default_rng(6)
    kept, sets = simhash.Kept(0.8), []
    for _ in range(600):
        own = np.unique(r.choice(30, r.integers(1, 12), replace=False)).astype(np.uint64)
        alike = any(len(np.intersect1d(own, s)) >= 0.8 * len(np.union1d(own, s)) for s in sets)
        assert kept.takes(own) is not alike
        sets += [] if alike else [own]
    assert len(sets) > 100


# 2

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_by_pattern(texts):
    r = random.Random(2)
    tricky = ["a@b@c.de f@g.h.i@j.k", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 0000001.2.3.4", "4111 1111-1111 1111 4111111111111111", "+1 (017) 555-7713. +12 +1((((2", "@x.y a@-.-", "é1.2.3.4é"]
    tricky += ["".join(r.choice("a1.@+ -(9") for _ in range(60)) for _ in range(400)]
    for text in [*texts.values(), *tricky]:
        assert pii.base_spans(text) == brute_spans(text), text


def test_field_adds_and_keeps(spark, awkward):
    held_out = pii.labelled_table(150, seed=99)
    found = pii.all_spans([t for t, _ in held_out], pii.default_field())
    wanted = sum(len([s for s in spans if pii.passes(s[0], t[s[1] : s[2]])]) for t, spans in held_out)
    right = sum(len(set(a) & set(s)) for (_, s), (_, a) in zip(held_out, found, strict=True))
    wrong = sum(len(set(a) - set(s)) for (_, s), (_, a) in zip(held_out, found, strict=True))
    assert right >= 0.95 * wanted and wrong <= 0.02 * wanted
    assert all(set(b) <= set(a) for b, a in found)
    assert pii.find(awkward).count() == len(AWKWARD)


def test_field_reads_spelled_out_addresses_without_a_number_near():
    lead = "a long and quiet sentence without any sign that goes on for more than sixty characters "
    cases = {"write to jane at example dot com": "jane at example dot com", "please mail Jane AT Example DOT Org today": "Jane AT Example DOT Org", "ask bob.smith at mail dot example dot net": "bob.smith at mail dot example dot net", "she works at the school": None, "we looked at the wall and the dot on it": None}
    for text, want in cases.items():
        for t in (text, lead + text + " " + lead):
            assert [t[a:b] for _, a, b in pii.all_spans([t], pii.default_field())[0][1]] == ([want] if want else []), t
    held_out = pii.spelled_table(300, seed=98)
    pairs = [({(k, a + len(lead), b + len(lead)) for k, a, b in spans}, set(pii.all_spans([lead + t + " " + lead], pii.default_field())[0][1])) for t, spans in held_out]
    wanted = sum(len(want) for want, _ in pairs)
    assert sum(len(want & got) for want, got in pairs) >= 0.95 * wanted and sum(len(got - want) for want, got in pairs) <= 0.02 * wanted


def test_long_windows(spark):
    """Texts full of numbers are decoded in sequences of a bounded length, without losing what a short window shows."""
    import time
    import tracemalloc

    r = random.Random(6)
    field = pii.default_field()
    parts = [f"call ({r.randrange(100, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)} on day {r.randrange(99)}" for _ in range(3000)]
    text = " ".join(parts)
    alone = [s for p in parts for s in pii.all_spans([p], field)[0][1]]
    assert len(pii.windows(text)) == 1 and len(alone) > 2900
    together = pii.all_spans([text], field)[0][1]
    assert abs(len(together) - len(alone)) <= 0.01 * len(alone)
    assert all(a[2] - a[1] == b[2] - b[1] for a, b in zip(together, alone, strict=False)) or len(together) != len(alone)
    for texts in ([" ".join(str(r.randrange(10**6)) for _ in range(100_000))], ["1 2"] * 2000):
        tracemalloc.start()
        began = time.process_time()
        pii.all_spans(texts, field)
        assert time.process_time() - began < 60 and tracemalloc.get_traced_memory()[1] < 500_000_000
        tracemalloc.stop()
    assert pii.find(spark.createDataFrame([(1, "7 " * 100_000), (2, "9 8")], "doc_id long, text string")).count() == 2


# 3


def test_decontamination(spark, docs, awkward):
    items = {i: decontam.tokens(t) for i, t in table(spark, SF, "benchmark").select("item_id", "text").collect()}
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, table(spark, SF, "benchmark")).collect()}
    whole = {(d, i) for d, t in docs.select("doc_id", "text").collect() for i, w in items.items() if (" " + " ".join(w) + " ") in (" " + " ".join(decontam.tokens(t)) + " ")}
    assert whole and whole <= got
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    w = item.split()
    swap = lambda ks: "before " + " ".join("other" if k in ks else x for k, x in enumerate(w)) + " after"
    rows = [(1, swap({3, 10})), (2, swap({2, 7, 11, 16})), (3, swap(set(range(0, 20, 3)))), (4, " ".join(w[:8])), (5, "a b"), (6, "only a short item here")]
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "")], "item_id long, text string")
    for block in (decontam.MAX_BLOCK_CHARS, 60):
        found = decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), bench, max_block_chars=block)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1), (6, 2)}
    assert decontam.find(docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(awkward, bench).count() == len(AWKWARD)


def test_decontamination_counts_the_whole_item(spark):
    r = random.Random(4)
    items, rows, near = [], [], set()
    for n in (16, 20, 30, 45, 100):
        for _ in range(30):
            w, i = [f"w{r.randrange(10**6)}" for _ in range(n)], len(items)
            items.append((i, " ".join(w)))
            few = n // 5
            burst = r.randrange(n - few + 1)
            for gone in (range(burst, burst + few), r.sample(range(n), few), {1, n - 2}, r.sample(range(n), few + 1)):
                copy = ["other" if k in set(gone) else x for k, x in enumerate(w)]
                # What no mask finds is another matter.
                seeded = any(all(copy[k + o] == w[k + o] for o in mask) for mask in decontam.MASKS for k in range(n - mask[-1]))
                if seeded and sum(a == b for a, b in zip(copy, w, strict=True)) >= 0.8 * n:
                    near.add((len(rows), i))
                rows.append((len(rows), "before " + " ".join(copy) + " after"))
            # Two words put in, and the last but one of each half replaced.
            copy = w[: n // 2 - 2] + ["other", w[n // 2 - 1], "put", "in"] + w[n // 2 : -2] + ["other", w[-1]]
            near.add((len(rows), i))
            rows.append((len(rows), " ".join(copy)))
    assert len(near) > 500
    found = decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == near


def test_decontamination_of_short_items(spark):
    r = random.Random(8)
    items, rows, near = [], [], set()
    for n in range(6, 16):
        w, i = [f"w{r.randrange(10**6)}" for _ in range(n)], len(items)
        items.append((i, " ".join(w)))
        for gone in [{k} for k in range(n)] + [set(r.sample(range(n), n // 5 + k % 2)) for k in range(30)]:
            if n - len(gone) >= 0.8 * n:
                near.add((len(rows), i))
            rows.append((len(rows), r.choice(("", "before ")) + " ".join("other" if k in gone else x for k, x in enumerate(w)) + " after"))
        # Pieces apart are no copy.
        rows.append((len(rows), " ".join(w[: n // 2]) + " and " * 20 + " ".join(w[n // 2 :]) if n < 12 else ""))
    found = decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == near


def test_decontamination_recall():
    """Items with tokens substituted at random places, as many as the similarity of 0.8 bears, half as many, and bursts."""
    r = random.Random(1)
    for n in (6, 7, 9, 12, 15, 16, 18, 20, 25, 30, 40, 50, 100):
        items = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(n))) for i in range(100)]
        index, found, total = decontam.Index(items), 0, 0
        for i, t in items:
            burst = r.randrange(n - n // 5 + 1)
            for gone in (r.sample(range(n), n // 5), r.sample(range(n), n // 10), range(burst, burst + n // 5)):
                words = ["before"] * 12 + ["other" if k in set(gone) else x for k, x in enumerate(t.split())] + ["after"] * 12
                ids = np.array([index.vocabulary.get(x, 0) for x in words], dtype=np.int32)
                found += any(x[1] == i for x in index.search(ids, np.array([0, len(ids)]), decontam.SIMILARITY))
                total += 1
        assert found >= 0.98 * total, n


# 4


def brute_dedup(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if (w := b[p : p + 100]) in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, texts, monkeypatch):
    r = random.Random(1)
    base = ["".join(r.choice("abé \n") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(100):
        b, a = r.choice(base), r.randrange(300)
        x = "".join(c if r.random() > 0.004 else "Z" for c in b[a : a + r.randrange(400)])
        rows.append((10_000 + i, r.choice(["", "pre ", "ab" * 150, x]) + x + r.choice(["", "tail", x, "Wher. " * 60])))
    rows += [(1, None), (2, ""), (3, "a" * 1000), (4, "a" * 999 + "b"), *((20_000 + i, t) for i, t in texts.items())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_dedup(rows)
    assert {x[0]: tuple(x[1:]) for x in suffix_dedup.dedup(frame).collect()} == want
    # Anchors of more than two contexts are split, and the most frequent ones count as hot; then texts are cut into pieces, and pieces collapse one by one.
    monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda docs, size, real=suffix_dedup.hot_anchors: np.unique(np.append(real(docs, size), np.array([r.key for r in suffix_dedup.judged(suffix_dedup.anchors(docs, real(docs, size))).where("key % 3 = 0").collect()], dtype=np.int64).view(np.uint64))))
    assert {x[0]: tuple(x[1:]) for x in suffix_dedup.dedup(frame, crowd=2).collect()} == want


def test_suffix_dedup_in_pieces(spark):
    """In one process, with pieces far shorter than the texts, and batches that part groups."""
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    texts = {k: "".join(c if r.random() > 0.003 else "Z" for c in base[r.randrange(500) : r.randrange(1000, 3000)]) for k in range(12)}
    docs = pa.record_batch({"uid": pa.array(list(texts), pa.int64()), "text": pa.array(list(texts.values()))})

    class Frame:
        """What mapInArrow does, with batches of three rows."""

        def __init__(self, table):
            self.table = table

        def select(self, *names):
            return Frame(self.table.select(list(names)))

        def repartition(self, name):
            return self

        def sortWithinPartitions(self, *names):
            return Frame(self.table.sort_by([(n, "ascending") for n in names]))

        def mapInArrow(self, run, ddl):
            return Frame(pa.Table.from_batches(list(run(iter(self.table.to_batches(max_chunksize=3))))))

    old = suffix_dedup.PIECE, suffix_dedup.HELD
    try:
        for piece, held in ((200, 30), (1 << 18, 1 << 19)):
            suffix_dedup.PIECE, suffix_dedup.HELD = piece, held
            rows = suffix_dedup.anchors(Frame(pa.Table.from_batches([docs])), np.zeros(0, dtype=np.uint64))
            found = suffix_dedup.judged(rows).table.to_pylist()
            needs = collections.defaultdict(list)
            for x in found:
                if x["key"] is not None:
                    needs[x["uid"]].append({k: x[k] for k in ("first", "last", "key")})
            packed = [{"uid": u, "size": len(texts[u]), "packed": pa.compress(texts[u].encode(), "zstd", asbytes=True), "needs": n} for u, n in needs.items()]
            late = suffix_dedup.merged(suffix_dedup.transforms(Frame(pa.Table.from_pylist(packed)), 3)).table.to_pylist()
            gone = {u: set() for u in texts}
            for x in [*(x for x in found if x["key"] is None), *late]:
                gone[x["uid"]] |= set(range(x["first"], x["last"] + 100))
            want = brute_dedup(texts.items())
            assert {u: len(g) for u, g in gone.items()} == {u: w[1] for u, w in want.items()} and sum(map(len, gone.values())) > 3000
            assert late
    finally:
        suffix_dedup.PIECE, suffix_dedup.HELD = old


def test_suffix_dedup_awkward(spark, awkward):
    out = suffix_dedup.dedup(awkward, texts=True).collect()
    assert len(out) == len(AWKWARD)
    assert {x.n_removed for x in out if x.doc_id == 7} == {50_000 - 1}
    assert suffix_dedup.dedup(awkward.limit(0)).count() == 0


def test_merge_sorts_what_the_shards_hold():
    r = random.Random(4)
    parts = [["".join(r.choice("ab") for _ in range(r.randrange(1, 40))).encode() for _ in range(5)] for _ in range(3)]
    transforms = [suffix_dedup.Transform(p) for p in parts]
    number, prefix, step = suffix_dedup.merge(lambda n: np.concatenate([t.before(n) for t in transforms]), [len(t) for t in transforms], depth=20)
    turns = []
    for p, t in zip(parts, transforms, strict=True):
        whole = [(w + b"\xff")[k:] + (w + b"\xff")[:k] for w in p for k in range(len(w) + 1)]
        turns += [(whole[k] * 20)[:20] for k in t.order]
    merged = [turns[k] for k in number]
    assert merged == sorted(turns)
    for k in range(1, len(merged)):
        common = next((n for n in range(20) if merged[k][n] != merged[k - 1][n]), None)
        assert prefix[k] == (-1 if common is None else common - common % step)
    # What travels is the byte before each rotation; the rest is read off it.
    came = suffix_dedup.Received([t.before(1).astype(np.uint8) for t in transforms])
    assert all((came.before(n) == np.concatenate([t.before(n) for t in transforms])).all() for n in (1, 2, 5))
    order = [(i, int(t.word[k])) for i, t in enumerate(transforms) for k in t.order if t.offset[k] == 0]
    word, offset = came.words(np.array([len(parts[i][k]) + 1 for i, k in order]))
    assert [order[k] for k in word] == [(i, k) for i, t in enumerate(transforms) for k in t.word[t.order].tolist()]
    assert offset.tolist() == [k for t in transforms for k in t.offset[t.order].tolist()]


# 5


def brute_segments(scores):
    """All maximal scoring subsequences by their definition (Ruzzo and Tompa): the best one, then left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda x: (round(x[0], 9), x[1], x[2]))
    a = -best[2]
    b = a - best[1]
    return brute_segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments():
    r = random.Random(7)
    for _ in range(150):
        scores = [r.uniform(0.2, 2) if r.random() < 0.3 else -0.5 for _ in range(r.randrange(14))]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.5)
        # Merged from the definition too: a found segment must be one of the maximal ones.
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_segments_of_long_texts():
    import time

    for scores in ([(2 * i, 1.0 + (i % 7) / 100) for i in range(200_000)], [(i * i % 10**9 + 10**9 * (i // 31000), 1.0) for i in range(30_000)], [(100 * i, 200_000.0 - i) for i in range(200_000)], [(100 * i, 1.0) for i in range(200_000)]):
        began = time.process_time()
        toxicity.maximal_segments(sorted(set(scores)), 0.1)
        assert time.process_time() - began < 10


def test_toxicity_held_out(spark, awkward):
    sf = SF.replace("0.001", "0.1")
    out = queries.op5_toxicity(spark, sf).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    x = out[out.held_out]
    bad, good = x[x.toxic == 1].score.values, x[x.toxic == 0].score.values
    assert ((bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2) > 0.9
    assert (x.predicted == x.toxic).mean() > 0.95
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out, strict=True))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.score(awkward, toxicity.learn(awkward, none)).collect())


# 6


def test_line_dedup(spark, awkward):
    rows = [(k, "h", f"menu\nown {k}\n\n  menu  ") for k in range(10)] + [(k, "h", f"own {k}") for k in range(10, 40)] + [(100 + k, None, "menu\nx") for k in range(4)] + [(200, "small", "menu"), (201, "h", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, counts=("n", "gone")).collect()}
    assert got[3].text == "own 3\n" and (got[3].n, got[3].gone) == (4, 2)
    assert got[101].text == "" and got[200].text == "menu" and got[201].text is None and got[201].n == 0
    out = line_dedup.drop_boilerplate(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)
    assert line_dedup.drop_boilerplate(awkward.limit(0)).count() == 0


# 7


def test_mixing_reaches_its_margins(spark, docs, awkward):
    cells = {("a", "x"): 900.0, ("a", "y"): 100.0, ("b", "x"): 50.0, ("b", "y"): 50.0}
    keys = list(cells)
    n = np.array([cells[k] for k in keys])
    f = mixing.rake_arrays([[k[0] for k in keys], [k[1] for k in keys]], n, [0.5, 0.5], 60)
    share = f * n / n.sum()
    for at, powers in ((0, (1000**0.5, 100**0.5)), (1, (950**0.5, 150**0.5))):
        for name, p in zip(("a", "b") if at == 0 else ("x", "y"), powers, strict=True):
            assert sum(s for s, k in zip(share, keys, strict=True) if k[at] == name) == pytest.approx(p / sum(powers), abs=1e-6)
    frame = spark.createDataFrame([(*k, int(v)) for k, v in cells.items()], "s string, l string, tokens long")
    apart = {(r.s, r.l): r.factor for r in mixing.rake(frame, {"s": 0.5, "l": 0.5}, rounds=5, max_cells=0).collect()}
    on_driver = {(r.s, r.l): r.factor for r in mixing.rake(frame, {"s": 0.5, "l": 0.5}, rounds=5).collect()}
    assert apart == {k: pytest.approx(v) for k, v in on_driver.items()}
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}
    assert mixing.mix(awkward, margins).columns == awkward.columns
    assert mixing.mix(awkward.limit(0), margins).count() == 0


def test_mixing_meets_given_targets(spark, docs):
    targets = {"source": {"src0": 3.0, "src1": 1.0, "src2": 4.0}, "lang": {"en": 0.7, "fr": 0.3, "none": 5.0}}
    margins = {m: F.col(m) for m in targets}
    sf = SF.replace("0.001", "0.1")
    docs = table(spark, sf, "documents").where("source in ('src0', 'src1', 'src2', 'src3') and lang in ('en', 'fr', 'de')")
    for bounded in (False, True):
        kept = mixing.mix(docs, margins, targets, rounds=200, details=("n", "p"), bounded=bounded).toPandas()
        assert len(kept) and 0 < kept.p.min() and kept.p.max() <= 1 and set(kept.source) == {"src0", "src1", "src2"} and set(kept.lang) == {"en", "fr"}
        # Expected shares, from every document's probability; those of the sample itself are near.
        cells = docs.select("source", "lang", F.size(mixing.words(F.col("text"))).alias("tokens")).groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).toPandas().merge(kept.groupby(["source", "lang"]).p.first().reset_index())
        for m, want in (("source", {"src0": 0.375, "src1": 0.125, "src2": 0.5}), ("lang", {"en": 0.7, "fr": 0.3})):
            expected = cells.assign(x=cells.tokens * cells.p).groupby(m).x.sum()
            assert (expected / expected.sum()).to_dict() == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}
            got = kept.groupby(m).n.sum()
            assert (got / got.sum()).to_dict() == {k: pytest.approx(v, abs=0.12) for k, v in want.items()}
    with pytest.raises(ValueError):
        mixing.rake_arrays([["a"]], np.array([1.0]), [{"b": 1.0}], 5)


def test_bounded_mixing_meets_its_margins(spark, awkward):
    r = random.Random(7)
    cells = {(s, lang): float(r.randrange(1, 10) ** 4) for s in "abcd" for lang in "wxyz"}
    keys, n = list(cells), np.array(list(cells.values()))
    values = [[k[0] for k in keys], [k[1] for k in keys]]
    off = lambda got, powers: max(abs(sum(g for g, k in zip(got, keys, strict=True) if k[m] == v) / sum(got) - sum(n[[k[m] == v for k in keys]]) ** powers[m] / sum(sum(n[[k[m] == u for k in keys]]) ** powers[m] for u in set(values[m]))) for m in (0, 1) for v in set(values[m]))
    powers = [0.5, 0.4]
    p = mixing.bounded_arrays(values, n, powers, 0.6)
    factors = mixing.rake_arrays(values, n, powers, 100)
    assert (0.6 * factors).max() > 1 and off(n * np.minimum(1, 0.6 * factors), powers) > 0.02
    assert 0 < p.min() and p.max() <= 1 and off(n * p, powers) < 2e-6 and p @ n >= 0.999 * (factors @ n) / factors.max()
    # The documents that are kept, of some thousands of one token each; on the driver and as a DataFrame.
    n = np.array([k * 150 for k in range(1, 17)])
    rows = [(j * 100 + k, *keys[k], "token") for k in range(16) for j in range(n[k])]
    docs = spark.createDataFrame(rows, "doc_id long, s string, l string, text string")
    kept = mixing.mix(docs, {"s": F.col("s"), "l": F.col("l")}, {"s": 0.3, "l": 0.3}, bounded=True)
    count = collections.Counter((x.s, x.l) for x in kept.collect())
    assert off([count[k] for k in keys], [0.3, 0.3]) < 0.02
    frame = spark.createDataFrame([(*k, int(v)) for k, v in zip(keys, n, strict=True)], "s string, l string, tokens long")
    apart = {(x.s, x.l): 0.6 * x.factor for x in mixing.rake(frame, {"s": 0.3, "l": 0.3}, rounds=6, max_cells=0, bound=0.6).collect()}
    assert max(apart.values()) <= 1 + 1e-9 and off([v * apart[k] for k, v in zip(keys, n, strict=True)], [0.3, 0.3]) < 1e-3
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}
    assert mixing.mix(awkward, margins, bounded=True).columns == awkward.columns and mixing.mix(awkward.limit(0), margins, bounded=True).count() == 0


# 8


def test_extraction(spark):
    pages = table(spark, SF, "pages").toPandas()
    got = {r.page_id: r for r in queries.op8_html_extraction(spark, SF).collect()}
    for r in pages.itertuples():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_extraction_of_the_fixture_without_article_tags(spark):
    """What the markup then leaves open, repeats decide: articles stay but for sentences that other pages of the host carry as well (the fixture plants such copies; its menus and footers never repeat)."""
    pages = table(spark, SF.replace("0.001", "0.01"), "pages")
    want = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    got = {r.page_id: r for r in html_text.extract(pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))).collect()}
    assert sum(got[i].text == want[i] for i in want) >= 0.7 * len(want)
    assert all(got[i].n_repeated and not collections.Counter(got[i].text.split()) - collections.Counter(want[i].split()) for i in want if got[i].text != want[i])


def test_extraction_without_an_article(spark):
    menu = "<div>Home News Sport Weather Travel Culture Food Health Money</div>"
    rows = [(k, f"http://h.example/{k}", f"<html>{menu}<p>{k}th unique &lt;text&gt;, {' '.join(f'w{k}x{j}' for j in range(12))}</p></html>") for k in range(6)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://h.example/", "<div class='sidebar'>no</div><main><header><h1>No</h1></header><p>a<br>b<div class='reader-comments'>no</div><aside>no</aside></main><script>if (a < b) '</p>'</script>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{k}th unique <text>, {' '.join(f'w{k}x{j}' for j in range(12))}" for k in range(6))
    assert (got[90], got[91], got[92]) == ("", "", "a b")


def test_extraction_beside_a_small_main_block():
    unique = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    again = "Read more of this and other stories in our daily letter"
    pages = [f"<div class='entry-title'>Title {k}</div><div>{unique(k, 40)}</div><div>{again}</div>" for k in range(4)]
    pages += [f"<article><p>{unique(k, 40)}</p></article><div>beside {k}</div><div>{again}</div>" for k in range(4, 8)]
    got = html_text.main_texts([html_text.blocks(p) for p in pages])
    assert got == [f"Title {k}\n{unique(k, 40)}" for k in range(4)] + [unique(k, 40) for k in range(4, 8)]


def brute_repeated(streams, width=8):
    """Tokens in a run of `width` that at least three distinct streams hold, and a twentieth of them."""
    runs = collections.defaultdict(set)
    for s in streams:
        for k in range(len(s) - width + 1):
            runs[tuple(s[k : k + width])].add(tuple(s))
    often = {g for g, where in runs.items() if len(where) >= max(3, 0.05 * len({tuple(s) for s in streams}))}
    return [[any(0 <= j <= len(s) - width and tuple(s[j : j + width]) in often for j in range(k - width + 1, k + 1)) for k in range(len(s))] for s in streams]


def test_repeats_by_brute_force():
    r = random.Random(11)
    for n in (1, 5, 30, 90):
        base = [r.randrange(4) for _ in range(60)]
        streams = [base[(a := r.randrange(50)) : a + r.randrange(40)] + [r.randrange(4) for _ in range(r.randrange(25))] for _ in range(n)]
        streams += [list(s) for s in streams[: n // 3]]
        got = html_text.repeated([np.array(s, dtype=np.int64) for s in streams])
        assert [g.tolist() for g in got] == brute_repeated(streams)


def test_extraction_by_repeats_alone_however_dealt(spark):
    """Hosts of pages without an article element: menus, notices and footers that repeat go, whatever the shards; what is unique stays."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for h in range(3):
        menu, foot, notice = [some(2) for _ in range(6)], some(14), some(11)
        for k in range(40):
            body = [some(r.randrange(9, 40)) for _ in range(r.randrange(1, 5))]
            page = "".join(f"<div><a href='/{m}'>{m}</a></div>" for m in menu) + "".join(f"<p>{b}</p>" for b in body[:1]) + (f"<p>{notice}</p>" if k % 4 == 0 else "") + "".join(f"<p>{b}</p>" for b in body[1:]) + f"<div>{foot}</div>"
            rows.append((100 * h + k, f"https://h{h}.example/{k}", f"<html><body>{page}</body></html>"))
            want[100 * h + k] = "\n".join(body)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for chars in (1, 3_000, 10**9):
        got = {x.page_id: x for x in html_text.extract(pages, chars).collect()}
        assert {i: x.text for i, x in got.items()} == want and all(x.n_named == 0 and x.n_repeated >= 26 for x in got.values())


def test_scanning_is_linear():
    import time

    for piece in ("<a ", "<a '", '<a "', "<div>", "<!--", "<script>", "<p class=", "</div", "< ", "<a '>", "<div class='x'>y", "&amp", "<!x", "<script></scrip>"):
        for page in (piece * (1_000_000 // len(piece)), piece * (1_000_000 // len(piece)) + ">", ">" + piece * (1_000_000 // len(piece)) + "'"):
            began = time.process_time()
            html_text.blocks(page)
            assert time.process_time() - began < 6, piece


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav>menu<article><p>text</p></article><footer>no", "text"),
        ("<article class='long-form'><header><p>by line</p><h1>Title</h1></header><p>one</p><p class='notice'>no</p><p>two<div class='ad-slot'>no<p>no</p></div>three</article>", "Title\none\ntwo\nthree"),
        ("<article>a</article><section id='comments'><article>no</article></section>", "a"),
        ("<div id='content'>x &amp;amp; y&nbsp;\n z<ul><li>i</li><li>j</ul></div><div>other</div>", "x &amp; y z\ni\nj"),
        ("<article><p>a<form>no<input></form><aside>no</aside><script>x</script><!-- no --><b>b</b>c</p></article>", "a\nbc"),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<main hidden>no</main><main>yes</main>", "yes"),
    ],
)
def test_roles(page, want):
    assert html_text.main_texts([html_text.blocks(page)]) == [want]


# 9


def test_quality(spark, docs, texts, awkward):
    labels = table(spark, SF.replace("0.001", "0.1"), "labels")
    rules = quality_rules.learn(table(spark, SF.replace("0.001", "0.1"), "documents"), labels)
    assert rules.rules
    judged = quality_rules.judge(table(spark, SF.replace("0.001", "0.1"), "documents"), rules).toPandas().merge(labels.toPandas(), on="doc_id")
    good = judged[(judged.quality == 1) & ~judged.base_failed]
    assert good.kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.1
    rows = [(i, t) for i, t in texts.items()] + [(10_000 + k, t) for k, (_, t) in enumerate(AWKWARD)]
    for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), rules).collect():
        t = dict(rows)[r.doc_id] or ""
        w = words(t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = collections.Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(awkward, rules)
    assert kept.columns == awkward.columns
    assert not quality_rules.learn(awkward, labels.limit(0)).rules


def test_quality_held_out(spark):
    """Learned from the labels that are not held out, by the rule of the toxicity labels; judged on those that are."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = toxicity.held_out(F.col("doc_id"))
    judged = quality_rules.judge(docs, quality_rules.learn(docs, labels.where(~held))).join(labels.where(held), "doc_id").toPandas()
    good = judged[(judged.quality == 1) & ~judged.base_failed]
    assert len(good) > 500 and good.kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.1


# 10


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (2, "http://a/%20", "same"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "WARC/1.0\r\n\r\n\r\n\nline é\r\n\r\n"), (5, "http://a/5", "WARC/1.0\r\n\r\n\r\n\nline é\r\n\r\n"), (6, "http://a/6", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for version in (1, 2):
        arc, out = f"{tmp_path}/arc{version}", f"{tmp_path}/warc{version}"
        warc.write_arc(pages, arc, version)
        warc.convert(spark, arc, out)
        got = sorted(warc.records(spark, out).collect(), key=lambda r: r.page_id)
        digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
        assert [(r.page_id, r.payload_bytes, r.payload_digest) for r in got] == [(i, len((h or "").encode()), digest(h)) for i, _, h in rows]
        assert [(r.record_type, r.refers_to) for r in got] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None), ("response", None), ("response", None)]
        assert got[0].url == "http://a/%20b" and got[1].url == "http://a/%20" and got[2].url is None
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"http://a/ 0 0 t 99\nshort")))


def test_warc_by_sql(spark, tmp_path):
    pages = table(spark, SF, "pages").select("page_id", F.when(F.col("page_id") % 3 > 0, F.col("html")).alias("html"), "url")
    more = pages.where("page_id % 4 = 0").withColumn("page_id", F.col("page_id") + 100_000)
    pages.union(more).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.op10_warc(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.OP10_SQL).select(", ".join(got.columns)).fetchall()) and got.where("refers_to is not null").count() > 5


def test_warc_archives_are_bounded(spark, tmp_path):
    pages = table(spark, SF, "pages").coalesce(1)
    pages = pages.union(pages.where("page_id % 5 = 0").withColumn("page_id", F.col("page_id") + 100_000)).coalesce(1)
    warc.write_arc(pages, f"{tmp_path}/arc", archive_bytes=8_000)
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", archive_bytes=8_000)
    for kind, start in (("arc", b"filedesc://"), ("warc", b"WARC/1.1\r\nWARC-Type: warcinfo")):
        files = sorted(Path(f"{tmp_path}/{kind}").glob("part-*"))
        assert len(files) > 5
        for file in files:
            members, data = [], file.read_bytes().rstrip(b"\0")
            while data:
                one = zlib.decompressobj(31)
                members.append((len(data), one.decompress(data)))
                data = one.unused_data.lstrip(b"\0")
                members[-1] = (members[-1][0] - len(data), members[-1][1])
            assert members[0][1].startswith(start) and sum(n for n, _ in members[:-1]) < 8_000
            parse = warc.read_arc if kind == "arc" else warc.read_warc
            # One record a member; the version block is none.
            assert all(len(list(parse(io.BytesIO(m)))) == 1 for _, m in members[1:])
    got = warc.records(spark, f"{tmp_path}/warc").collect()
    by_id = {r.page_id: r for r in got}
    revisits = [r for r in got if r.record_type == "revisit"]
    assert len(got) == len(by_id) == pages.count() and len({r.record_id for r in got}) == len(got) and len(revisits) >= pages.where("page_id >= 100000").count() > 0
    assert all(r.refers_to_record == by_id[r.refers_to].record_id and by_id[r.refers_to].record_type == "response" for r in revisits)


def test_warc_of_other_writers(spark, tmp_path):
    """An archive of one gzip member, of version 2, with a record that holds no HTTP."""
    (tmp_path / "arc").mkdir()
    plain = warc.arc_record("dns:a", b"20240101 a", 2, date="20200102030405", mime="text/dns")
    body = warc.arc_version_block("x.arc", 2) + b"\n" + b"".join(r + b"\n" for r in (plain, warc.arc_record("http://b/", warc.http_block(7, 2) + b"hi", 2)))
    (tmp_path / "arc" / "part-0.arc.gz").write_bytes(gzip.compress(body))
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = {r.url: r for r in warc.records(spark, f"{tmp_path}/warc").collect()}
    assert got["dns:a"].payload_bytes == 10 and got["dns:a"].page_id is None and got["http://b/"].page_id == 7 and got["http://b/"].payload_bytes == 2


def test_warc_of_nothing(spark, tmp_path):
    warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/arc")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert warc.records(spark, f"{tmp_path}/warc").count() == 0


