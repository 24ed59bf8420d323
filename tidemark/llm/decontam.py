"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed set of token offsets; the tokens at the other offsets are ignored, so that a substituted token
spoils only the seeds that look at it. Seeds of the benchmark items are hashed into a table; the seeds of every
document at every position are looked up there; a hit lays the document on the whole item, on the hit's diagonal. An
item is found in a document if at least `similarity` of its tokens are equal to the document's, on one diagonal or, where
tokens were put in or left out, on several: either each token of the item lies on one of them and each change costs GAP
tokens, or the tokens are those of the diagonals' best stretches (a match +1, a mismatch -2), whatever their order.

The benchmark side is taken in blocks of about MAX_BLOCK_CHARS characters, one after the other and one pass over the
documents each, so that what is held and broadcast is bounded whatever the benchmark's size (by one item's, if that is longer).

Tokens are runs of letters and digits, lower-cased. Defined results: null texts have no tokens; an item of fewer
tokens than the shortest mask spans matches only documents that hold it word by word; an item without tokens never
matches; equal items are found each by its own id; rows with equal doc_id are searched each by itself; empty tables
give an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8), (0, 1, 4, 5, 8, 10))
#: Also for items of fewer than SHORT tokens, whose seeds of six few substitutions spoil: where four of five tokens are
#: equal, some three in a row are. Their hits count on one diagonal only. Pairs of equal seeds that are held at once.
SHORT, SHORT_MASKS, PAIRS = 16, ((0, 1, 2),), 1 << 20
SIMILARITY = 0.8
#: Tokens that a change to another diagonal has to gain more than.
GAP = 2
MAX_BLOCK_CHARS = 4_000_000
SCHEMA = "doc_id long, item_id long, start_token long, n_matched long, n_item_tokens long, similarity double"
_TOKEN = re.compile(r"[^\W_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _seeds(ids: np.ndarray, mask: tuple[int, ...], at: np.ndarray) -> np.ndarray:
    """The seed hash at each of the given positions."""
    h = np.zeros(len(at), dtype=np.uint64)
    for k, off in enumerate(mask):
        h += (ids[at + off].astype(np.uint64) + np.uint64(1)) * _ODD[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class Index:
    """The seeds of a block of items. Token ids: 0 for words that no item has."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            if words := tokens(text):
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int64)))
        #: Items too short for a seed, by their first token.
        self.short: dict[int, list[int]] = defaultdict(list)
        longest_unseeded = min(m[-1] for m in MASKS)
        for n, (_, ids) in enumerate(self.items):
            if len(ids) <= longest_unseeded:
                self.short[int(ids[0])].append(n)
        self.tables = [self._table(mask, range(len(self.items))) for mask in MASKS]
        few = [n for n, (_, ids) in enumerate(self.items) if longest_unseeded < len(ids) < SHORT]
        self.short_tables = [self._table(mask, few) for mask in SHORT_MASKS]
        #: The tokens of those items, to SHORT of them; -1 equals nothing.
        self.rows, self.few = np.full(len(self.items), -1), np.full((len(few), SHORT), -1, dtype=np.int64)
        for k, n in enumerate(few):
            self.rows[n] = k
            self.few[k, : len(self.items[n][1])] = self.items[n][1]

    def _table(self, mask: tuple[int, ...], numbers: Iterable[int]) -> tuple:
        """The mask, its seeds of the given items in order, their items and positions, and a bit per hash of 20 bits: most seeds of documents end there."""
        parts = [(_seeds(ids, mask, at), np.full(len(at), n), at) for n in numbers if len(at := np.arange(max(0, len(ids := self.items[n][1]) - mask[-1])))]
        h, item, at = (np.concatenate(x) if parts else np.array([], dtype=t) for x, t in zip(zip(*parts, strict=True) if parts else ((), (), ()), (np.uint64, np.int64, np.int64), strict=True))
        order = np.argsort(h, kind="stable")
        bits = np.zeros(1 << 20, dtype=bool)
        bits[h >> np.uint64(44)] = True
        return mask, h[order], item[order], at[order], bits

    def hits(self, ids: np.ndarray, tables: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each table, some at a time: positions, items and positions in the item of equal seeds."""
        known = ids > 0
        for mask, h, item, at, bits in tables:
            n = len(ids) - mask[-1]
            if n <= 0 or not len(h):
                continue
            ok = known[:n].copy()
            for off in mask[1:]:
                ok &= known[off : off + n]
            where = np.flatnonzero(ok)
            seeds = _seeds(ids, mask, where)
            keep = bits[seeds >> np.uint64(44)]
            where, seeds = where[keep], seeds[keep]
            lo, hi = np.searchsorted(h, seeds), np.searchsorted(h, seeds, "right")
            cuts = np.flatnonzero(np.diff(np.cumsum(hi - lo) // PAIRS)) + 1
            for where_, lo_, count in zip(*(np.split(x, cuts) for x in (where, lo, hi - lo)), strict=True):
                if total := int(count.sum()):
                    rows = np.repeat(lo_ - np.cumsum(count) + count, count) + np.arange(total)
                    yield np.repeat(where_, count), item[rows], at[rows]

    def _short(self, ids: np.ndarray, bounds: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int]]:
        """(document, item, diagonal) of the short items that a diagonal holds."""
        for pos, item, at in self.hits(ids, self.short_tables):
            doc = np.searchsorted(bounds, pos, "right") - 1
            want = self.few[self.rows[item]]
            same, size = np.zeros(len(pos), dtype=np.int64), (want >= 0).sum(axis=1)
            for k in range(SHORT):
                place = pos - at + k
                inside = (place >= bounds[doc]) & (place < bounds[doc + 1])
                same += inside & (ids[np.where(inside, place, 0)] == want[:, k])
            for k in np.flatnonzero(same >= similarity * size - 1e-9).tolist():
                yield int(doc[k]), int(item[k]), int(pos[k] - at[k])

    def search(self, ids: np.ndarray, bounds: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item id, first token, tokens matched, tokens of the item) over documents laid end to end; bounds: their first tokens, and the end."""
        triples = []
        for pos, item, at in self.hits(ids, self.tables):
            doc = np.searchsorted(bounds, pos, "right") - 1
            triples.append(np.stack([doc, item, pos - at], axis=1))
        found: dict[tuple[int, int], dict] = defaultdict(dict)
        laid: dict[tuple[int, int], list[int]] = defaultdict(list)
        if triples:
            for doc, item, diagonal in np.unique(np.concatenate(triples), axis=0).tolist():
                laid[doc, item].append(diagonal)
        for (doc, item), diagonals in laid.items():
            found[doc, item] = self._matched(ids, bounds[doc], bounds[doc + 1], item, np.array(diagonals), similarity)
        for doc, item, diagonal in set(self._short(ids, bounds, similarity)):
            one = self._matched(ids, bounds[doc], bounds[doc + 1], item, np.array([diagonal]), similarity)
            found[doc, item] = max(found[doc, item], one, key=lambda x: (len(x), -min(x.values(), default=0)))
        for n, k in [(n, k) for k in np.flatnonzero(np.isin(ids, list(self.short))).tolist() for n in self.short[int(ids[k])]] if self.short else ():
            doc = int(np.searchsorted(bounds, k, "right")) - 1
            want = self.items[n][1]
            if k + len(want) <= bounds[doc + 1] and np.array_equal(ids[k : k + len(want)], want):
                found[doc, n].update({i: k + i for i in range(len(want))})
        for (doc, n), matched in sorted(found.items()):
            item_id, want = self.items[n]
            if len(matched) >= similarity * len(want) - 1e-9:
                yield doc, item_id, int(min(matched.values()) - bounds[doc]), len(matched), len(want)

    def _matched(self, ids: np.ndarray, start: int, end: int, item: int, diagonals: np.ndarray, similarity: float) -> dict[int, int]:
        """Item positions (and where they match) on the given diagonals; none if too few for `similarity`."""
        want = self.items[item][1]
        n = len(want)
        at = diagonals[:, None] + np.arange(n)
        same = (at >= start) & (at < end)
        same[same] = ids[at[same]] == np.broadcast_to(want, at.shape)[same]
        if same.any(axis=0).sum() < similarity * n - 1e-9:
            return {}
        best = int(same.sum(axis=1).argmax())
        ways = [{k: int(at[best, k]) for k in np.flatnonzero(same[best]).tolist()}]
        if len(diagonals) > 1:
            ways.append({k: int(at[d, k]) for k, d in enumerate(_path(same)) if same[d, k]})
            ways.append({k: int(at[d, k]) for d, row in enumerate(same) for k in _stretch(row)})
        return max(ways, key=len)


def _path(same: np.ndarray) -> list[int]:
    """The diagonal of each token that gives most equal tokens, less GAP for each change. same: (diagonal, token)."""
    score, back = np.zeros(len(same), dtype=np.int64), np.empty(same.shape[::-1], dtype=np.int64)
    for k in range(same.shape[1]):
        top = int(score.argmax())
        change = score[top] - GAP > score
        back[k] = np.where(change, top, np.arange(len(same)))
        score = np.where(change, score[top] - GAP, score) + same[:, k]
    out = [int(score.argmax())]
    for k in range(same.shape[1] - 1, 0, -1):
        out.append(int(back[k, out[-1]]))
    return out[::-1]


def _stretch(same: np.ndarray) -> list[int]:
    """The equal tokens of the best stretch on a diagonal."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(total)
    last = int(np.argmax(total - low))
    first = int(np.argmin(total[: last + 1]))
    return (np.flatnonzero(same[first:last]) + first).tolist()


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, max_block_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) found in it."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").where("text is not null")
    n_blocks = -(-int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // max_block_chars)
    if n_blocks <= 1:
        return _search(docs, _broadcast(items), similarity) if n_blocks else spark.createDataFrame([], SCHEMA)
    found = []
    for k in range(n_blocks):
        # One block's index at a time, on the driver and on the executors.
        held = _broadcast(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k))
        found.append(materialize(_search(docs, held, similarity), "contaminated"))
        held.destroy()
    return reduce(DataFrame.unionByName, found)


def _broadcast(items: DataFrame) -> Broadcast:
    return items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))


def _search(docs: DataFrame, held: Broadcast, similarity: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_token", pa.int64()), ("n_matched", pa.int64()), ("n_item_tokens", pa.int64()), ("similarity", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        get = index.vocabulary.get
        for batch in batches:
            doc_ids, rows = batch.column(0).to_pylist(), []
            # A gap between documents longer than any mask keeps seeds inside one.
            ids, sizes = [], []
            for text in batch.column(1).to_pylist():
                ids.append(np.array([get(w, 0) for w in tokens(text)] + [0] * 12, dtype=np.int32))
                sizes.append(len(ids[-1]))
            if ids:
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                rows = [(doc_ids[d], i, s, m, n, m / n) for d, i, s, m, n in index.search(np.concatenate(ids), bounds, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(search, SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that hold an item. Rows go by doc_id."""
    bad = find(docs, items, similarity).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
