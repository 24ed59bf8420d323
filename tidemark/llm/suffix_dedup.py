"""Exact substring dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller document, or earlier in the
same one). Texts are UTF-8 bytes, matches stay inside documents, and all strings are judged on the input.

1. Every window of LENGTH bytes has an anchor: the leftmost smallest hash of the GRAM-byte strings in it. Equal windows
   have equal anchors at equal offsets. Neighbouring windows share an anchor, so that a document is a sequence of runs
   of windows; the bytes that a run's windows cover are its context. One shuffle deals thin rows (the anchor's hash, the
   context's hash, where it stands) by anchor. Equal contexts (128 bits of hash) collapse before, in the sending task,
   and there, on the earliest. Anchors with one context are done; the contexts of the others are compared byte by byte.
2. Texts with a repeat or with bytes to compare move once, compressed, to a table bucketed by document; all later joins
   with it move thin rows only.
3. Anchors of many different contexts are split before bytes move: a context falls into parts by the distance of
   their windows from the anchor (first of SPLIT distances, then one), and a part's key hashes all bytes that its windows
   have in common. What shares no such key has no window in common. Anchors that hold a large share of all rows are
   found in a sample (which decides where rows go, never what they say) and dealt by context too, so that no task gets
   a hot anchor.
4. Each data shard (a task's buckets) sorts its words, a word being a context with a terminator, read in a circle, into
   one Burrows-Wheeler transform per unit of anchors. Only transforms travel; words are read off them by walking the
   preceding bytes. The task of a unit merges the transforms of all data shards: starting from the shards end to end,
   each pass stably deals the interleave out by the preceding bytes of its suffixes, after which it is in order of some
   bytes more (Holt, McMillan 2014). Where a pass first parts two neighbours their common prefix ends (Egidi, Manzini
   2017); where LENGTH bytes have parted no neighbours there is an interval of one repeated string. No suffix is
   sorted again after its shard.
5. In each interval the earliest window stays; the others' bytes go, document by document.

Defined results: a null text is empty; documents under LENGTH bytes keep everything; rows of one doc_id with equal texts
are one document and all get its result, other rows of one doc_id follow each other in order of their texts; a null
doc_id comes first; an empty table gives an empty table. Texts of any length are cut into overlapping pieces. Where some
doc_id has several rows, a doc_id beyond 2 ** 46 or with more than 65,536 texts raises ValueError.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shared_path

LENGTH, GRAM = 100, 24
#: Distances from the anchor that a part of a split context spans, and contexts of an anchor beyond which it is split.
SPLIT, CROWD = 20, 64
#: Bytes of text that are hashed at once, rows that collapse together in a task, and bytes of words that are sorted together in a shard.
PIECE, HELD, SHARD = 1 << 18, 1 << 19, 1 << 20
#: Rows that are Python's values at once.
ROWS = 128
#: Suffixes of a unit, about, and bytes of the sample that shows hot anchors.
UNIT, SAMPLE = 1 << 18, 1 << 24
#: Bytes that a pass of the merge may take, most first; two always can.
STEPS = (5, 4, 2)
#: Ends a word; no UTF-8 text holds it.
END = 0xFF
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_POSITION = np.uint64((1 << 26) - 1)
#: In the lower bits of a place: windows of a run, and whether its anchor is hot.
_N, _HOT, _AT = 127, 128, 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _ODD[0]
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of the strings of one, two, four ... bytes at each position of a piece, and of what they add up to."""

    def __init__(self, data: np.ndarray, longest: int = LENGTH):
        self.by_size, size = {1: _mix((data.astype(np.uint64) + np.uint64(1)) * _ODD[1])}, 1
        while 2 * size <= longest:
            h = self.by_size[size]
            self.by_size[2 * size] = _mix(h[: len(h) - size] * _ODD[2] + h[size:]) if len(h) > size else h[:0]
            size *= 2

    def of(self, n: int, at: np.ndarray | None = None, odd: int = 3) -> np.ndarray:
        """Of the n bytes at the given positions, or at each."""
        out, have = None, 0
        for size in sorted(self.by_size, reverse=True):
            if have + size <= n:
                h = self.by_size[size]
                h = h[at + have] if at is not None else h[have:]
                if out is None:
                    out = h
                else:
                    m = min(len(out), len(h))
                    out = _mix(out[:m] * _ODD[odd] + h[:m])
                have += size
        return out


def runs(hashes: Hashes, size: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window, anchor) of every run of documents laid end to end."""
    none = np.zeros(0, dtype=np.int64)
    if size < LENGTH:
        return none, none, none, none
    h = hashes.of(GRAM)
    # The position in the low bits makes the leftmost of equal hashes the smallest.
    low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    anchor = (low & _POSITION).astype(np.int64)
    n = len(anchor)
    # Windows that lie inside a document.
    valid = np.zeros(n + 1, dtype=np.int32)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, np.minimum(ends[long] - LENGTH + 1, n), -1)
    valid = np.cumsum(valid[:-1]) > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first[starts[long]] = True
    at = np.flatnonzero(first)
    last = np.append(at[1:], n) - 1
    doc = np.searchsorted(starts, at, "right") - 1
    last = np.minimum(last, ends[doc] - LENGTH)
    return doc, at, last, anchor[at]


def _pieces(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents laid end to end, some at a time, long ones in parts that overlap: (document, offset in it) of each part, bytes, starts, ends."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[a : a + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE:
                yield _laid(held)
                held, size = [], 0
            held.append((k, a, part))
            size += len(part)
    if held:
        yield _laid(held)


def _laid(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(x[2]) for x in held], dtype=np.int64)
    return np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.frombuffer(b"".join(x[2] for x in held), dtype=np.uint8), np.append(0, ends[:-1]), ends


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for a in range(0, len(column), ROWS):
        yield from column.slice(a, ROWS).cast(pa.binary()).to_pylist()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """As Python's values, few at a time: lists of structs take many times the room there."""
    for a in range(0, batch.num_rows, ROWS):
        yield from zip(*(c.to_pylist() for c in batch.slice(a, ROWS).columns), strict=True)


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64, copy=False)) for c in columns], names.split())


_ROW = "deal long, hash long, uid long, place long, last long"


class _Collapse:
    """Gathers (key, hash, uid, at, n) rows of a task. Of equal contexts the earliest goes on as a row; the others are repeats, whose neighbours make one span."""

    def __init__(self, hot: np.ndarray | None):
        #: Hot keys, ascending; None: all are.
        self.hot, self.held, self.size = hot, [], 0

    def add(self, key: np.ndarray, h: np.ndarray, uid: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((key, h, uid, at, n))
        self.size += len(key)
        if self.size >= HELD:
            yield self.rows()

    def rows(self) -> pa.RecordBatch:
        empty = [np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        key, h, uid, at, n = (np.concatenate(x) for x in zip(empty, *self.held, strict=True))
        self.held, self.size = [], 0
        order = np.lexsort((at, uid, h, key))
        key, h, uid, at, n = (x[order] for x in (key, h, uid, at, n))
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        u, a, b = _joined(uid[~first], at[~first], at[~first] + n[~first] - 1)
        key, h, uid, at, n = (x[first] for x in (key, h, uid, at, n))
        hot = np.ones(len(key), dtype=bool) if self.hot is None else np.isin(key, self.hot)
        deal = np.where(hot, key ^ (h * _ODD[4]), key)
        away = _mix(u.astype(np.uint64) * _ODD[1] + a.astype(np.uint64))
        return _batch("deal hash uid place last", np.append(deal, away).view(np.int64), np.append(h, np.zeros_like(away)).view(np.int64), np.append(uid, u), np.append(at << _AT | np.where(hot, _HOT, 0) | n, a << _AT), np.append(np.full(len(key), -1), b))


def _joined(uid: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order, those that follow on each other as one."""
    order = np.lexsort((first, uid))
    uid, first, last = uid[order], first[order], last[order]
    new = np.ones(len(uid), dtype=bool)
    new[1:] = (uid[1:] != uid[:-1]) | (first[1:] != last[:-1] + 1)
    at = np.flatnonzero(new)
    return uid[at], first[at], last[np.append(at[1:], len(uid)) - 1] if len(at) else last


def anchors(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """A row for every run of (uid, text): dealt by its anchor's hash, or by its context's too if the anchor is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Collapse(hot)
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for part, offset, data, starts, ends in _pieces(_bytes(batch.column(1))):
                hashes = Hashes(data)
                doc, at, last, anchor = runs(hashes, len(data), starts, ends)
                n = last - at + 1
                h = _mix(hashes.of(LENGTH, at) * _ODD[3] ^ _mix(hashes.of(LENGTH, last) * _ODD[4] + n.astype(np.uint64)))
                yield from found.add(hashes.of(GRAM, anchor), h, uids[part[doc]], at - starts[doc] + offset[doc], n)
        yield found.rows()

    return docs.select("uid", "text").mapInArrow(run, _ROW)


def hot_anchors(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of the anchors that hold more than a small share of a task's rows, as a sample of about SAMPLE bytes has them; a bounded number."""
    share, most = min(1.0, SAMPLE / max(size, 1)), 20 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, starts, ends in _pieces(_bytes(batch.column(0))):
                hashes = Hashes(data)
                yield _batch("key", hashes.of(GRAM, runs(hashes, len(data), starts, ends)[3]).view(np.int64) if len(data) >= LENGTH else np.zeros(0, dtype=np.int64))

    least = max(16, int(share * size / ((LENGTH - GRAM) / 2) / most))
    keys = docs.sample(share, seed=1).select("text").mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= least).orderBy(F.desc("count")).limit(most)
    return np.sort(np.array([r["key"] for r in keys.collect()], dtype=np.int64).view(np.uint64))


_FOUND = "uid long, first long, last long, key long, hot boolean"


def judged(rows: DataFrame) -> DataFrame:
    """(uid, first, last, key, hot): repeats, without a key; and, with it, the first of each context that others share its key.

    Rows arrive sorted by deal and context; nothing but the last one is held. The firsts of hot keys all go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last deal and hash, its first row if that may still turn out to be alone, and whether it is not.
        before, alone, several = None, None, False
        for batch in batches:
            deal, h, uid, place, last = (c.to_numpy() for c in batch.columns)
            if not len(deal):
                continue
            at, n, hot, apart = place >> _AT, place & _N, (place & _HOT) > 0, last >= 0
            same = np.append(before is not None and before[0] == deal[0], deal[1:] == deal[:-1])
            first = ~np.append(before is not None and before == (deal[0], h[0]), same[1:] & (h[1:] == h[:-1])) & ~apart
            group = np.cumsum(~same)
            count = np.bincount(group, first, minlength=group[-1] + 1)
            count[0] += bool(same[0]) * (several + 1)
            shared = first & ((count[group] > 1) | hot)
            repeat = ~first & ~apart
            key = np.where(hot, (deal.view(np.uint64) ^ (h.view(np.uint64) * _ODD[4])).view(np.int64), deal)
            if alone is not None and same[0] and count[0] > 1:
                yield _found(*([x] for x in alone), [True], [False])
                alone = None
            keep = shared | repeat | apart
            yield _found(uid[keep], at[keep], np.where(apart, last, at + n - 1)[keep], key[keep], shared[keep], hot[keep])
            whole = group == group[-1]
            several = bool(count[-1] > 1)
            if not same[0] or group[-1] > 0:
                k = np.flatnonzero(first & whole & ~hot)
                alone = (uid[k[0]], at[k[0]], at[k[0]] + n[k[0]] - 1, deal[k[0]]) if len(k) and not several else None
            before = (deal[-1], h[-1])

    return rows.repartition("deal").sortWithinPartitions("deal", "hash", "uid", "place").mapInArrow(run, _FOUND)


def _found(uid, first, last, key, shared, hot) -> pa.RecordBatch:
    shared = np.asarray(shared, dtype=bool)
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(c, dtype=np.int64)) for c in (uid, first, last)), pa.array(np.asarray(key, dtype=np.int64), mask=~shared), pa.array(np.asarray(hot, dtype=bool) & shared)], ["uid", "first", "last", "key", "hot"])


def packed(docs: DataFrame) -> DataFrame:
    """(uid, size, packed): texts compressed, for what they cost on their way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts = zip(*((len(t), pa.compress(t, "zstd", asbytes=True)) for t in _bytes(batch.column(1))), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], ["uid", "size", "packed"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, size long, packed binary")


def _unpacked(size: int, data: bytes) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def parts(texts: DataFrame, width: int) -> DataFrame:
    """Rows like those of anchors() for the contexts named in (uid, size, packed, needs), cut to parts of `width` distances; a part's key is of all that its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Collapse(None)
        for batch in batches:
            uids, held, size = [], [], 0
            for uid, n, data, needs in _rows(batch):
                text = _unpacked(n, data)
                for x in needs:
                    held.append((len(uids), x["first"], text[x["first"] : x["last"] + LENGTH]))
                    size += len(held[-1][2])
                uids.append(uid)
                if size >= PIECE:
                    yield from found.add(*cut(held, np.array(uids)))
                    uids, held, size = [], [], 0
            if held:
                yield from found.add(*cut(held, np.array(uids)))
        yield found.rows()

    def cut(held: list[tuple[int, int, bytes]], uids: np.ndarray) -> tuple[np.ndarray, ...]:
        doc, offset, data, starts, ends = _laid(held)
        hashes = Hashes(data)
        part, at, last, anchor = runs(hashes, len(data), starts, ends)
        # From the nearest class of distances to the farthest.
        low, high = (anchor - last) // width, (anchor - at) // width
        many = high - low + 1
        kind = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        part, at, last, anchor = (np.repeat(x, many) for x in (part, at, last, anchor))
        at, last = np.maximum(at, anchor - kind * width - width + 1), np.minimum(last, anchor - kind * width)
        n = last - at + 1
        core = hashes.of(LENGTH - width + 1, anchor - kind * width)
        key = _mix(core * _ODD[5] + kind.astype(np.uint64))
        h = _mix(hashes.of(LENGTH, at, odd=5) * _ODD[3] ^ _mix(hashes.of(LENGTH, last, odd=5) * _ODD[4] + n.astype(np.uint64)))
        return key, h, uids[doc[part]], at - starts[part] + offset[part], n

    return texts.select("uid", "size", "packed", "needs").mapInArrow(run, _ROW)


class Transform:
    """The sorted rotations of a shard's words, group by group, and what stands before each."""

    def __init__(self, words: list[bytes], group: np.ndarray | None = None):
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        self.data = np.frombuffer(b"".join(w + bytes([END]) for w in words), dtype=np.uint8)
        # A shard is far below 2 ** 31 bytes.
        self.base = np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        self.offset, self.size = np.arange(len(self.data), dtype=np.int32) - self.base, np.repeat(sizes.astype(np.int32), sizes)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        rank = np.unique(self._blocks(0, 8), return_inverse=True)[1].astype(np.int64)
        if group is not None:
            rank += group[self.word] * (int(rank.max()) + 1)
        depth = 8
        # Doubled until all are told apart, or are rotations of equal words.
        while True:
            values, rank = np.unique(rank, return_inverse=True)
            if len(values) == len(rank) or depth > 2 * int(sizes.max()):
                break
            rank = rank * len(values) + rank[self._ahead(depth)]
            depth *= 2
        self.order = np.argsort(rank, kind="stable")

    def __len__(self) -> int:
        return len(self.order)

    def _ahead(self, d: int) -> np.ndarray:
        """Where each rotation's byte d stands."""
        return self.base + (self.offset + np.int32(d)) % self.size

    def _blocks(self, start: int, n: int) -> np.ndarray:
        """The n bytes from `start` on of each rotation, as a number."""
        out = np.zeros(len(self.data), dtype=np.uint64)
        for d in range(start, start + n):
            out = (out << np.uint64(8)) | self.data[self._ahead(d)].astype(np.uint64)
        return out

    def before(self, n: int) -> np.ndarray:
        """The n bytes before each rotation, in sorted order: the transform over blocks of n bytes."""
        return self._blocks(-n, n)[self.order]


class Received:
    """Transforms that came from elsewhere, end to end: nothing but the byte before each rotation, in sorted order."""

    def __init__(self, shards: list[np.ndarray]):
        self.sizes = [len(x) for x in shards]
        self.symbols = np.concatenate(shards)
        self.back = np.empty(len(self.symbols), dtype=np.int64)
        self.back[np.argsort(np.repeat(np.arange(len(shards)) << 8, self.sizes) | self.symbols, kind="stable")] = np.arange(len(self.symbols))

    def before(self, n: int) -> np.ndarray:
        out, at = np.zeros(len(self.symbols), dtype=np.uint64), np.arange(len(self.symbols))
        for k in range(n):
            out |= self.symbols[at].astype(np.uint64) << np.uint64(8 * k)
            at = self.back[at]
        return out

    def words(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each rotation its word, numbered shard by shard as the whole words are sorted, and its offset. sizes: of the words with their ends."""
        word, offset = np.empty(len(self.symbols), dtype=np.int64), np.zeros(len(self.symbols), dtype=np.int64)
        at = np.flatnonzero(self.symbols == END)
        number = np.arange(len(at))
        word[at] = number
        for k in range(1, int(sizes.max(initial=1))):
            at = self.back[at]
            more = sizes[number] > k
            at, number = at[more], number[more]
            word[at], offset[at] = number, sizes[number] - k
        return word, offset


def _symbols(before: Callable[[int], np.ndarray], depth: int) -> tuple[np.ndarray, int]:
    """The transforms end to end, over the longest blocks that are few enough to number in two bytes, and that length."""
    for step in STEPS:
        if depth % step == 0:
            blocks = before(step)
            if step == STEPS[-1]:
                return blocks.astype(np.uint16), step
            values, number = np.unique(blocks, return_inverse=True)
            if len(values) <= 1 << 16:
                return number.astype(np.uint16), step
    raise ValueError("an odd depth")


def merge(before: Callable[[int], np.ndarray], sizes: list[int], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """The interleave of the shards' rotations by their first `depth` bytes (an even number). before(n): the n bytes before each, shards end to end; sizes: of the shards.

    Returns, in merged order, each rotation's number in the shards laid end to end, and the common prefix with its
    predecessor as far as it was found to end (-1: not within depth), rounded down to a multiple of the last value
    returned.
    """
    symbols, step = _symbols(before, depth)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.int64), sizes)
    block, prefix = np.zeros(len(symbols), dtype=np.int32), np.full(len(symbols), -1, dtype=np.int16)
    own, new = np.empty_like(symbols), np.ones(len(symbols), dtype=bool)
    for known in range(0, depth, step):
        # The k-th rotation of a shard in the interleave is the shard's k-th.
        own[np.argsort(shard, kind="stable")] = symbols
        deal = np.argsort(own, kind="stable")
        shard, block, first = shard[deal], block[deal], own[deal]
        new[1:] = (block[1:] != block[:-1]) | (first[1:] != first[:-1])
        parted = int(block.max(initial=-1)) if known else -1
        block = np.cumsum(new, dtype=np.int32)
        if known == 0 or int(block[-1]) != parted:
            prefix[new & (prefix < 0)] = known
    return np.argsort(np.argsort(shard, kind="stable"), kind="stable"), prefix, step


def transforms(texts: DataFrame, units: int) -> DataFrame:
    """(unit, symbols, uid, first, last): of the contexts named in (uid, size, packed, needs), a transform per data shard and unit, and whose words they are, in order of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for uid, n, data, needs in _rows(batch):
                text = _unpacked(n, data)
                for x in needs:
                    held.append((x["key"] % units, uid, x["first"], x["last"], text[x["first"] : x["last"] + LENGTH]))
                    size += len(held[-1][4])
                if size >= SHARD:
                    yield shard(held)
                    held, size = [], 0
        if held:
            yield shard(held)

    def shard(held: list[tuple]) -> pa.RecordBatch:
        units_, group = np.unique(np.array([x[0] for x in held], dtype=np.int64), return_inverse=True)
        t = Transform([x[4] for x in held], group)
        symbols, word = t.before(1).astype(np.uint8), t.word[t.order]
        # Groups are sorted one after the other.
        ends = np.cumsum(np.bincount(group[t.word]))
        rows = []
        for unit, a, b in zip(units_.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own = [held[k] for k in word[a:b][symbols[a:b] == END].tolist()]
            rows.append((unit, symbols[a:b].tobytes(), *([x[k] for x in own] for k in (1, 2, 3))))
        kinds = (pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["unit", "symbols", "uid", "first", "last"])

    return texts.select("uid", "size", "packed", "needs").mapInArrow(run, "unit long, symbols binary, uid array<long>, first array<long>, last array<long>")


def repeats(unit: list[tuple[bytes, list[int], list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, first, last) of the windows that are not the earliest of their string; unit: the transforms of one unit, with their words' places."""
    came = Received([np.frombuffer(x[0], dtype=np.uint8) for x in unit])
    number, prefix, _ = merge(came.before, came.sizes)
    uid, first, last = (np.array([v for x in unit for v in x[k]], dtype=np.int64) for k in (1, 2, 3))
    n = last - first + 1
    word, offset = (x[number] for x in came.words(n + LENGTH))
    # An interval goes on as long as no pass has parted it.
    interval, window = np.cumsum(prefix >= 0), offset < n[word]
    word, offset, interval = word[window], offset[window], interval[window]
    uid, at = uid[word], first[word] + offset
    order = np.lexsort((at, uid, interval))
    late = order[1:][interval[order][1:] == interval[order][:-1]]
    return _joined(uid[late], at[late], at[late])


def merged(shards: DataFrame) -> DataFrame:
    """(uid, first, last): runs of windows that repeat earlier ones, from the units' transforms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for unit, *row in _rows(batch):
                if unit != now and held:
                    yield _batch("uid first last", *repeats(held))
                    held = []
                now = unit
                held.append(tuple(row))
        if held:
            yield _batch("uid first last", *repeats(held))

    return shards.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "uid long, first long, last long")


def removed(texts: DataFrame) -> DataFrame:
    """(uid, n_removed, n_spans, kept_sha256, kept) of each document of (uid, size, packed, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, size, data, found in _rows(batch):
                edge = np.zeros(size + 1, dtype=np.int32)
                at = np.array([(s["first"], s["last"] + LENGTH) for s in found], dtype=np.int64)
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(_unpacked(size, data), dtype=np.uint8)[~gone].tobytes()
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((uid, int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["uid", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("uid", "size", "packed", "spans").mapInArrow(run, "uid long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _with_uid(docs: DataFrame) -> tuple[DataFrame, bool, int]:
    """doc_id, uid and text; whether a uid has several rows; bytes of all texts. uid orders the documents; it is doc_id unless some doc_id has several rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    by_id = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    most, size, far = by_id.agg(F.max("n"), F.sum("size"), F.max(F.abs("doc_id"))).first()
    lowest = F.lit(-(1 << 63) if (most or 0) <= 1 else -(1 << 46))
    ids = F.coalesce(F.col("doc_id"), lowest)
    if (most or 0) <= 1:
        return rows.select("doc_id", ids.alias("uid"), "text"), False, size or 0
    ranked = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    rows = rows.select("doc_id", ranked.alias("rank"), "text")
    if (far or 0) >= 1 << 46 or rows.agg(F.max("rank")).first()[0] >= 1 << 16:
        raise ValueError("a doc_id beyond 2 ** 46, or of more than 65536 texts, beside repeated ones")
    return rows.select("doc_id", (ids * (1 << 16) + F.col("rank")).alias("uid"), "text"), True, size or 0


def _listed(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    return rows.groupBy("uid").agg(F.collect_list(F.struct(*fields)).alias(name))


def _crowded(shared: DataFrame, crowd: int) -> DataFrame:
    """Rows with a key that several have; `crowd` says whether more than that many do."""
    counts = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.join(counts.select("key", (F.col("n") > crowd).alias("crowd")), "key")


def _bucketed(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder in buckets of uid, which later joins keep."""
    spark, name = df.sparkSession, f"tidemark_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, "uid").sortBy("uid").option("path", shared_path(spark, tag)).saveAsTable(name)
    return spark.table(name), name


def dedup(docs: DataFrame, texts: bool = False, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with `texts` the bytes that stay."""
    rows, several, size = _with_uid(docs)
    work = rows.select("uid", "text")
    work = work.dropDuplicates(["uid"]) if several else work
    spans = ["uid", "first", "last"]
    found = materialize(judged(anchors(work, hot_anchors(work, size))), "found")
    shared = found.where("key is not null")
    # A hot key is split whatever its rows, so they stay where they are: no task gets them all.
    cold = shared.where("not hot")
    crowds = cold.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key", F.lit(True).alias("crowd"))
    shared = materialize(cold.join(crowds, "key", "left").drop("hot").unionByName(shared.where("hot").select(*spans, "key", F.lit(True).alias("crowd"))), "shared")
    listed = _listed(found.where("key is null"), "spans", "first", "last").join(_listed(shared, "needs", "first", "last", "key", F.coalesce("crowd", F.lit(False)).alias("crowd")), "uid", "full")
    held, name = _bucketed(packed(work).join(listed, "uid"), "held")
    try:
        few = F.filter(F.coalesce("needs", F.array()), lambda x: ~x["crowd"])
        crowded, more = held.withColumn("needs", F.filter("needs", lambda x: x["crowd"])).where("size(needs) > 0"), []
        if not crowded.isEmpty():
            # Parts, then single windows, of contexts whose anchors have too many; equal ones meet as before.
            first = materialize(judged(parts(crowded, SPLIT)), "parts")
            split = materialize(_crowded(first.where("key is not null"), crowd), "split")
            single = held.drop("needs").join(_listed(split.where("crowd"), "needs", "first", "last"), "uid")
            more = [first.where("key is null").select(spans), materialize(judged(parts(single, 1)).where("key is null").select(spans), "single")]
            held_parts = _listed(split.where("not crowd"), "more", "first", "last", "key")
            words = held.join(held_parts, "uid", "left").withColumn("needs", F.concat(F.transform(few, lambda x: F.struct(x["first"], x["last"], x["key"])), F.coalesce("more", F.array())))
        else:
            words = held.withColumn("needs", few)
        words = words.where("size(needs) > 0")
        length = F.aggregate("needs", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + LENGTH + 1)
        units = max(1, -(-int(words.agg(F.sum(length)).first()[0] or 0) // UNIT))
        more.append(materialize(merged(transforms(words, units)), "merged"))
        late = more[0]
        for x in more[1:]:
            late = late.union(x)
        spread = held.join(_listed(late, "late", "first", "last"), "uid", "left").withColumn("spans", F.concat(F.coalesce("spans", F.array()), F.coalesce("late", F.array()))).where("size(spans) > 0")
        changed = removed(spread)
        changed = materialize(changed if texts else changed.drop("kept"), "changed")
    finally:
        held.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    own = rows.select("doc_id", "uid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *([F.col("text").cast("binary").alias("whole")] if texts else []))
    out = own.join(changed, "uid", "left")
    kept = [F.coalesce("kept", "whole").alias("kept")] if texts else []
    return out.select("doc_id", "n_bytes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")], F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *kept)
