"""SimHash near-dedup with BK-trees.

Fingerprint: the texts's word shingles (A-Z lower-cased, repeats included) are hashed by XXH64 (seed 42); a bit is set
if more than half of the hashes have it. Two fingerprints link if at most `radius` bits differ, and documents are put
together over links.

Search: the 64 bits are cut into radius + 2 blocks; fingerprints that link agree in at least two of them. Each pair
of blocks is a table, and the distinct fingerprints that agree there are a shard. Every shard gets a BK-tree, which
its fingerprints walk along the edges within the radius; what leaves the task is a spanning star per component of the
shard, never all pairs. Components over all shards are then joined as a DataFrame.

Near copies by similarity (drop_near_copies) go by the same search over fingerprints of the set of shingles, with a wider
radius in shards by band, and an exact count after it.

Defined results: a null text counts as empty; a text of fewer words than a shingle has one shingle, the whole; a text
without words has fingerprint zero; rows of equal doc_id are joined as one document; a
row without doc_id gets the component of its fingerprint (null if no row with an id has it); an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bktree import BKTree, forest
from tidemark.llm.common import fresh, materialize
from tidemark.llm.components import components

SEED = 42
WORDS, RADIUS = 3, 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of the n-word shingles, in order."""
    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return np.array([], dtype=np.uint64)
    joined, hash64 = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= n:
        return np.array([hash64(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-n]])
    return np.array([hash64(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[n - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes())


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), n)) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def shards(distinct: DataFrame, radius: int) -> DataFrame:
    """(shard, fp, rep): one row for each table of two blocks."""
    blocks = radius + 2
    at = [64 * k // blocks for k in range(blocks + 1)]
    cut = lambda k: F.shiftrightunsigned("fp", at[k]).bitwiseAND((1 << (at[k + 1] - at[k])) - 1)
    keys = [F.shiftleft(F.lit(n).cast("long"), 56) + F.shiftleft(cut(j), at[i + 1] - at[i]) + cut(i) for n, (i, j) in enumerate(combinations(range(blocks), 2))]
    return distinct.select(F.explode(F.array(*keys)).alias("shard"), "fp", "rep")


def links(sharded: DataFrame, radius: int) -> DataFrame:
    """Spanning stars (a, b) of the components of every shard (shard, fp, rep) under links within the radius."""

    def label(fp: np.ndarray) -> np.ndarray:
        values, first, of_value = np.unique(fp.view(np.uint64), return_index=True, return_inverse=True)
        return first[forest(values, radius)[of_value]]

    return _stars(sharded, label)


def _stars(sharded: DataFrame, label_of: Callable[..., np.ndarray]) -> DataFrame:
    """(a, b) for every row of a shard (shard, *values, rep) that label_of, given the shard's values, puts with another. Shards arrive sorted, one after the other."""
    width = len(sharded.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.array([], dtype=np.int64)] * width
        for batch in batches:
            new = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True)]
            last = np.searchsorted(new[0], new[0][-1]) if len(new[0]) else 0
            yield of([x[:last] for x in new])
            kept = [x[last:] for x in new]
        yield of(kept)

    def of(columns: list[np.ndarray]) -> pa.RecordBatch:
        shard, *values, rep = columns
        a, b = [], []
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else np.array([0])
        for k in np.flatnonzero(np.diff(edges) > 1):
            lo, hi = edges[k], edges[k + 1]
            label = label_of(*(v[lo:hi] for v in values))
            tied = np.flatnonzero(label != np.arange(hi - lo))
            a.append(rep[lo:hi][tied])
            b.append(rep[lo:hi][label[tied]])
        flat = [np.concatenate(x) if x else np.array([], dtype=np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], ["a", "b"])

    return sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id that links reach."""
    fps = materialize(fingerprints(docs, n), "fingerprints")
    distinct = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # A document may stand in several rows with different texts: its fingerprints belong together.
    same = fps.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    distinct = materialize(distinct, "distinct")
    again = fps.join(same.select("doc_id"), "doc_id", "left_semi").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    tied = components(links(shards(distinct, radius), radius).union(again))
    named = distinct.join(tied, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


#: For near copies by similarity. Fingerprints are of the set of shingles: those of two texts of similarity 0.8 differ at
#: each bit with a chance of 0.153 (0.1875 at most, for sets of 4 and 5), hence in more than COPY_RADIUS bits with one of
#: 2e-7 (1.3e-5 at most). Blocks of bits deal radius 3 exactly, but at such a radius would be of two bits each; there, shards
#: are bands of ROWS MinHash values, so many of them that the two texts share none with a chance of
#: (1 - 0.8 ** 4) ** 20 = 3e-5.
COPY_WORDS, SIMILARITY, COPY_RADIUS, BANDS, ROWS = 5, 0.8, 26, 20, 4
#: Documents, and shingles in all, that one task judges at once: first and at most (each round doubles the first).
BLOCK, MAX_BLOCK, MAX_SHINGLES = 128, 1 << 13, 1 << 22
#: Unrelated odd numbers: of multiples of one number, most would have their least value at the same hash.
_MIX = np.array([xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)


def _mixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(29))


def bands(h: np.ndarray) -> np.ndarray:
    """The bands of a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(h), 2048):
        low = np.minimum(low, _mixed(h[None, k : k + 2048], _MIX[:, None]).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out + low[k::ROWS], _MIX[k])
    return out


def profiles(docs: DataFrame, n: int = COPY_WORDS) -> DataFrame:
    """(doc_id, d1, d2, size, fp, bands): two digests of the text's set of shingles, its size, its fingerprint, and its bands."""

    def one(text: str | None) -> tuple[int, int, int, int, list[int]]:
        own = np.unique(shingle_hashes(text, n))
        if not len(own):
            return 0, 0, 0, 0, []
        digests = np.array([*(_mixed(own, m).sum() for m in _MIX[3:5]), fingerprint(own)], dtype=np.uint64)
        d1, d2, fp = digests.view(np.int64).tolist()
        return d1, d2, len(own), fp, bands(own).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column(1)]
            *numbers, found = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "d1", "d2", "size", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, d1 long, d2 long, size long, fp long, bands array<long>")


def copy_links(found: DataFrame, similarity: float, radius: int = COPY_RADIUS) -> DataFrame:
    """Spanning stars (a, b) of documents (doc_id, size, fp, bands): all whose fingerprints link, and those of a band whose fingerprints are within the wider radius, unless their sizes rule the similarity out."""
    near = links(shards(found.select("fp", F.col("doc_id").alias("rep")), RADIUS), RADIUS)
    banded = found.select(F.explode("bands").alias("shard"), "fp", "size", F.col("doc_id").alias("rep"))
    return near.union(_stars(banded, lambda fp, size: copy_label(fp.view(np.uint64), size, similarity, radius)))


def copy_label(fp: np.ndarray, size: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """For each set of a shard the first of its component, walking a BK-tree of the fingerprints."""
    may = lambda low, high: low >= similarity * high - 1e-9
    # Mostly all are within the root's radius.
    if (np.bitwise_count(fp ^ fp[0]) <= radius).all() and may(size.min(), size[0]) and may(size[0], size.max()):
        return np.zeros(len(fp), dtype=np.int64)
    values, first, of_value = np.unique(fp, return_index=True, return_inverse=True)
    low, high = np.full(len(values), size.max()), np.zeros(len(values), dtype=np.int64)
    np.minimum.at(low, of_value, size)
    np.maximum.at(high, of_value, size)
    return first[BKTree(values).spread(radius, lambda a, b: may(high[a], low[b]) & may(high[b], low[a]))[of_value]]


class Kept:
    """Sets of hashes, none of them similar to another: inverted indexes, each at least twice the next, and the latest few side by side."""

    def __init__(self, similarity: float):
        self.similarity = similarity
        #: Sizes of the sets; all their hashes, ascending; the number of the set of each.
        self.indexes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.latest: list[np.ndarray] = []

    def takes(self, own: np.ndarray) -> bool:
        """Takes the set in unless it is similar to one that is in."""
        if self.holds(own):
            return False
        self.latest.append(own)
        if len(self.latest) == 16:
            new = np.array([len(s) for s in self.latest]), np.concatenate(self.latest), np.repeat(np.arange(16, dtype=np.int32), [len(s) for s in self.latest])
            while self.indexes and len(self.indexes[-1][0]) < 2 * len(new[0]):
                old = self.indexes.pop()
                new = np.append(old[0], new[0]), np.append(old[1], new[1]), np.append(old[2], new[2] + np.int32(len(old[0])))
            order = np.argsort(new[1], kind="stable")
            self.indexes.append((new[0], new[1][order], new[2][order]))
            self.latest = []
        return True

    def holds(self, own: np.ndarray) -> bool:
        """Whether a set that is in is similar to this one."""
        return any(similar(s, own, self.similarity) for s in self.latest) or any(self._indexed(own, *x) for x in self.indexes)

    def _indexed(self, own: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, owners: np.ndarray) -> bool:
        """Shared hashes are counted for all sets of an index at once."""
        lo = np.searchsorted(hashes, own)
        n = np.searchsorted(hashes, own, "right") - lo
        total = int(n.sum())
        if not total:
            return False
        both = np.bincount(owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(total)], minlength=len(sizes))
        return bool((both >= self.similarity * (sizes + len(own) - both) - 1e-9).any())


def similar(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    a, b = len(one), len(other)
    if min(a, b) < similarity * max(a, b):
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both >= similarity * (a + b - both) - 1e-9


def _keep_first(docs: DataFrame, n: int, similarity: float) -> DataFrame:
    """Of (component, doc_id, text): the (component, doc_id) that stay when, per component, each goes that is similar to a smaller one that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, Kept(similarity)
        for batch in batches:
            stay = []
            for component, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != now:
                    now, kept = component, Kept(similarity)
                stay.append(kept.takes(np.unique(shingle_hashes(text, n))))
            yield batch.filter(pa.array(stay, pa.bool_())).select(["component", "doc_id"])

    dealt = docs.select("component", "doc_id", "text").repartition("component").sortWithinPartitions("component", "doc_id")
    return dealt.mapInArrow(run, "component long, doc_id long")


def _open(later: DataFrame, news: DataFrame, texts: DataFrame, n: int, similarity: float, chunk: int) -> DataFrame:
    """What of later (component, doc_id, size) is similar to none of news (component, doc_id), by component.

    A component's later documents are dealt to chunks, ahead of each of which go all of its news: no pair of documents is
    ever a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, Kept(similarity)
        for batch in batches:
            keep = []
            for component, chunk, _, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (component, chunk) != now:
                    now, kept = (component, chunk), Kept(similarity)
                own = np.unique(shingle_hashes(text, n))
                if size is None:
                    kept.takes(own)
                keep.append(size is not None and not kept.holds(own))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["component", "doc_id", "size"])

    chunks = later.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    rows = later.join(chunks, "component").join(texts, "doc_id").select("component", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int").alias("chunk"), "doc_id", "size", "text")
    ahead = news.join(chunks, "component").join(texts, "doc_id").select("component", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id", F.lit(None).cast("long").alias("size"), "text")
    dealt = rows.unionByName(ahead).repartition("component", "chunk").sortWithinPartitions("component", "chunk", F.col("size").asc_nulls_first(), "doc_id")
    return dealt.mapInArrow(run, "component long, doc_id long, size long")


def _blocks(open_: DataFrame, block: int, max_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(component, doc_id, size) in two: whole components up to `block` documents, and of the others about so many with the smallest ids; and what is left of those."""
    per = open_.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    # So many halvings of a component as make its first part small enough.
    halvings = F.ceil(F.log2(F.greatest(F.col("n") / float(block), F.col("w") / float(max_shingles)))).cast("int")
    large = materialize(per.where((F.col("n") > block) | (F.col("w") > max_shingles)).select("component", F.least(F.greatest(halvings, F.lit(1)), F.lit(30)).alias("halvings")), "large")
    ends = open_.join(large, "component").groupBy("component", "halvings").agg(F.percentile_approx("doc_id", [2.0**-k for k in range(1, 31)], 100_000).alias("ends"))
    cut = ends.select("component", F.element_at("ends", F.col("halvings")).alias("cut"))
    now = open_.join(cut, "component", "left")
    return now.where("cut is null or doc_id <= cut").drop("cut"), now.where("doc_id > cut").drop("cut")


def stays(open_: DataFrame, texts: DataFrame, n: int, similarity: float, block: int = BLOCK, max_block: int = MAX_BLOCK, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """The doc_id of (component, doc_id, size) that stay when, in order of doc_id, each goes that is similar to a smaller one of its component that stays. texts: (doc_id, text).

    A task judges whole components, or a bounded block of a larger one's smallest documents; the component's later
    documents are then compared with what stays of the block, and the next round goes on with what is left of them.
    """
    kept = []
    while True:
        now, later = (materialize(x, tag) for x, tag in zip(_blocks(open_, block, max_shingles), ("now", "later"), strict=True))
        stay = materialize(_keep_first(now.select("component", "doc_id").join(texts, "doc_id"), n, similarity), "stay")
        kept.append(stay.select("doc_id"))
        if later.isEmpty():
            break
        open_ = materialize(_open(later, stay, texts, n, similarity, block), "open")
        block = min(2 * block, max_block)
    return reduce(DataFrame.union, kept)


def drop_near_copies(docs: DataFrame, n: int = COPY_WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """docs without copies: in order of doc_id, a document goes if one that stays has a set of n-word shingles of a Jaccard similarity of `similarity` or more.

    Texts of one set go at once, by digest. The others go by SimHash: fingerprints that copy_links finds make candidate
    components; in each, a document goes only if one that stays is similar by exact count. Rows without a doc_id stay; of several rows of one
    doc_id the smallest text is judged for all; a text without words equals any other such text.
    """
    several = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    judged = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")) if several else docs.where("doc_id is not null")
    found = materialize(profiles(judged, n), "profiles")
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "size", "fp", "bands")).alias("one")).select("one.*")
    alone = materialize(first, "first")
    tied = components(copy_links(alone, similarity))
    tied = materialize(tied.union(tied.select(F.col("component"), "component").distinct()).toDF("doc_id", "component"), "tied")
    # The texts move once, to learn what became of them; from then on only the candidates do.
    id_, component = fresh(docs, "tm_id", "tm_component")
    status = alone.select("doc_id").join(tied, "doc_id", "left").toDF(id_, component)
    marked = materialize(docs.join(status, docs["doc_id"].cast("long") == F.col(id_)), "marked")
    candidates = marked.where(F.col(component).isNotNull())
    texts = candidates.select(F.col(id_).alias("doc_id"), "text")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")) if several else texts
    open_ = materialize(tied.join(alone.select("doc_id", "size"), "doc_id").select("component", "doc_id", "size"), "open")
    stay = materialize(stays(open_, texts, n, similarity, block).select(F.col("doc_id").alias(id_)), "stays")
    whole = marked.where(F.col(component).isNull()).unionByName(candidates.join(stay, id_, "left_semi"))
    return whole.select(*docs.columns).unionByName(docs.where("doc_id is null"))
