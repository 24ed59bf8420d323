"""HTML extraction with a suffix array per host.

A page becomes a stream of text blocks, each with a role by markup: named boilerplate (inside a menu, header, footer, sidebar,
notice, advert, form or reader comments), article (inside an article or main element or a container named as one) or
neutral. The token streams of a host's pages, without their article blocks, are concatenated and their suffixes ranked;
substrings of at least MIN_TOKENS tokens that stand on enough distinct pages of the host are boilerplate. Of all blocks but
the article's the covered tokens go and the unique runs stay; markup decides what repeats cannot: unique runs in named
boilerplate go, article blocks stay as they are (an article that several pages carry repeats as well, and is no boilerplate),
and neutral blocks go altogether if the page has as much article text as unique neutral text at least; a smaller
article (a marked title beside an unnamed body) leaves the neutral runs where they are.

Each batch of pages ranks the suffixes of its hosts, and what it found is added up over the host as a DataFrame of
(host, substring, page): a result depends on nothing but the host's pages, however they are dealt, and no task holds a
host. Pages with equal streams count as one page. Then a host's boilerplate goes ahead of its pages to each of its shards.

Defined results: null html and pages without text give an empty text; a page whose URL names no host is on the host
''; repeated rows are extracted each by itself; an empty table gives an empty table. Scanning takes time in proportion to
the page, whatever its markup: a "<" that nothing closes is text, a quote that nothing closes ends with its tag.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

MIN_TOKENS = 8
#: Distinct pages of a host that boilerplate stands on, at least: so many, and this share.
MIN_PAGES, MIN_SHARE = 3, 0.05
#: Characters of html of a host that are dealt together; the result is the same for any number.
SHARD_CHARS = 200_000
NEUTRAL, MAIN, DROPPED = 0, 1, 2

#: Elements without text of the page.
_RAW = frozenset("script style title textarea noscript template iframe svg select button canvas".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
#: Elements that end a block before and after.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Of those, the ones whose nesting matters.
_CONTAINERS = frozenset("address article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul head".split())
_DROPPED_TAGS = frozenset("nav footer aside form menu header dialog head".split())
_MAIN_TAGS = frozenset(("article", "main"))
#: Words of class, id or role.
_DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead topbar footer sidebar aside complementary contentinfo cookie cookies consent gdpr notice notices alert newsletter subscribe signup login comment comments discussion disqus replies respond related recommended share sharing social toolbar widget popup modal search skip".split()
)
#: Of those, the ones that tell an article element apart from the page's article.
_NO_ARTICLE = _DROPPED_WORDS & frozenset("ad ads advert advertisement sponsored promo sidebar comment comments replies related recommended widget".split())
#: Elements that pages forget to close: an article inside is the page's article all the same.
_LEFT_OPEN = frozenset("nav header head menu".split())
_MAIN_WORDS = frozenset("article content main post entry story".split())


def _role(tag: str, attributes: str, above: int) -> int:
    if tag in _MAIN_TAGS:
        return DROPPED if _words(attributes) & _NO_ARTICLE or _HIDDEN.search(attributes) else MAIN
    if tag in _DROPPED_TAGS:
        return DROPPED
    if attributes:
        names = _words(attributes)
        if names & _DROPPED_WORDS or _HIDDEN.search(attributes):
            return DROPPED
        if above == NEUTRAL and names & _MAIN_WORDS:
            return MAIN
    return above


def _words(attributes: str) -> set[str]:
    return {w for m in _NAMES.finditer(attributes) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())} if attributes.strip() else set()


def tags(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text before, name, attributes, closing) of each tag in order, and last the text after all, with an empty name. Comments and raw elements are passed over, as tags named "!"."""
    at, start, last = 0, 0, page.rfind(">")
    missing: set[str] = set()

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, at)
        if found < 0:
            missing.add(what)
        return found

    while 0 <= (at := page.find("<", at)) < last:
        first = page[at + 1]
        closing = first == "/"
        if first in "!?":
            comment = page.startswith("<!--", at)
            end = find("-->", at + 4) if comment else page.find(">", at)
            yield page[start:at], "!", "", False
            at = start = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            at += 1
            continue
        end = name.end()
        while (stop := _STOP.search(page, end)) and stop[0] != ">":
            close = find(stop[0], stop.end())
            if close < 0:
                stop = re.compile(">").search(page, stop.end())
                break
            end = close + 1
        if not stop:
            # A quote went past the last ">".
            stop = re.compile(">").search(page, name.end())
        end, tag = stop.start(), name[0].lower()
        attributes, text = page[name.end() : end], page[start:at]
        at = start = end + 1
        if tag in _RAW and not closing:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = start = over.end() if over else len(page)
            yield text, "!", "", False
        else:
            yield text, tag, attributes, closing
    yield page[start:], "", "", False


def blocks(page: str | None) -> tuple[list[str], list[int]]:
    """The text blocks of a page and their roles, in page order."""
    texts, roles, held = [], [], []
    # Name, role, and the outermost element around (or the element itself) that is dropped.
    stack: list[tuple[str, int, str | None]] = []
    inside: Counter[str] = Counter()
    role, heading, marked = NEUTRAL, False, False

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                texts.append(text)
                # An article's own header holds its headline.
                own = role == DROPPED and heading and [t for t, _, _ in stack[-2:]] == ["article", "header"]
                roles.append(DROPPED if marked else MAIN if own else role)

    for text, tag, attributes, closing in tags(page or ""):
        if text:
            held.append(text)
        if tag == "br":
            held.append(" ")
        if tag not in _BLOCKS:
            continue
        flush()
        marked = False
        if closing:
            heading = False
            if tag in _CONTAINERS and inside[tag]:
                while True:
                    gone = stack.pop()[0]
                    inside[gone] -= 1
                    if gone == tag:
                        break
                role = stack[-1][1] if stack else NEUTRAL
        else:
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            if tag not in _CONTAINERS:
                # A paragraph, item or cell of its own name: only its own text goes.
                marked = bool(attributes) and _role(tag, attributes, role) == DROPPED
            elif not attributes.endswith("/"):
                outer = stack[-1][2] if stack else None
                role = _role(tag, attributes, role) if outer is None or tag in _MAIN_TAGS and outer in _LEFT_OPEN else DROPPED
                stack.append((tag, role, outer or (tag if role == DROPPED else None)))
                inside[tag] += 1
    flush()
    return texts, roles


def suffix_ranks(streams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the streams laid end to end: each position's stream, the tokens from it to the stream's end, and its rank among the suffixes by their first `depth` tokens.

    Ranks double; suffixes of one rank share that many tokens. Rank 0 would stand beyond a stream's end.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    total = int(sizes.sum())
    page = np.repeat(np.arange(len(streams)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)
    rank = np.unique(np.concatenate([*streams, np.zeros(0, dtype=np.int64)]), return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while have < depth and total:
        step = min(have, depth - have)
        after = np.zeros(total, dtype=np.int64)
        after[: max(total - step, 0)] = rank[step:]
        after[left <= step] = 0
        rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1] + 1
        have += step
    return page, left, rank


def repeated(streams: list[np.ndarray], min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> list[np.ndarray]:
    """For each token stream of a host, which tokens lie in a substring of min_tokens tokens that enough distinct streams hold."""
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return [np.zeros(0, dtype=bool) for _ in streams]
    page, left, rank = suffix_ranks(streams, min_tokens)
    whole = np.flatnonzero(left >= min_tokens)
    distinct = len({s.tobytes() for s in streams})
    first: dict[bytes, int] = {}
    alike = np.array([first.setdefault(s.tobytes(), k) for k, s in enumerate(streams)])
    order = np.lexsort((alike[page[whole]], rank[whole]))
    r, p = rank[whole][order], alike[page[whole]][order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])]) if len(r) else np.array([], dtype=bool)
    pages = np.bincount(r[new], minlength=int(rank.max()) + 1)
    often = whole[pages[rank[whole]] >= max(min_pages, min_share * distinct)]
    return np.split(_covered(often, total, min_tokens), np.cumsum(sizes)[:-1])


def _covered(starts: np.ndarray, total: int, width: int) -> np.ndarray:
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]


class Words:
    """Hashes of words, remembered up to a number."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def stream(self, texts: list[str], roles: list[int]) -> np.ndarray:
        """Of the tokens of all blocks but the article's, as signed numbers."""
        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        for text, role in zip(texts, roles, strict=True):
            if role != MAIN:
                for w in text.split(" "):
                    if (h := known.get(w)) is None:
                        h = known[w] = xxhash.xxh64_intdigest(w)
                    out.append(h)
        return np.array(out, dtype=np.uint64).view(np.int64)


def substrings(stream: np.ndarray, host: int) -> np.ndarray:
    """A hash of the host and the MIN_TOKENS tokens at each position."""
    n = len(stream) - MIN_TOKENS + 1
    out = np.full(max(n, 0), np.int64(host).view(np.uint64))
    for k in range(MIN_TOKENS if n > 0 else 0):
        out = (out ^ (out >> np.uint64(29))) * _ODD[0] + stream[k : k + n].view(np.uint64) * _ODD[1]
    out = (out ^ (out >> np.uint64(32))) * _ODD[2]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def main_text(texts: list[str], roles: list[int], covered: np.ndarray) -> tuple[str, int, int]:
    """The main text of a page, the tokens that went as repeats of its host, and those that went by their names only. covered: of the tokens of all blocks but the article's."""
    parts, at, repeats, named = [], 0, 0, 0
    for text, role in zip(texts, roles, strict=True):
        words = text.split(" ")
        if role == MAIN:
            parts.append((role, words))
            continue
        bad = covered[at : at + len(words)]
        at += len(words)
        n = int(bad.sum())
        repeats += n
        if role == DROPPED:
            named += len(words) - n
        else:
            parts.append((role, [w for w, b in zip(words, bad.tolist(), strict=True) if not b] if n else words))
    size = {role: sum(len(words) for r, words in parts if r == role) for role in (NEUTRAL, MAIN)}
    return "\n".join(" ".join(words) for role, words in parts if words and (role == MAIN or size[NEUTRAL] > size[MAIN])), repeats, named


def main_texts(pages: list[tuple[list[str], list[int]]]) -> list[str]:
    """The main text of each page of a host, given its blocks and roles."""
    words = Words()
    covered = repeated([words.stream(*p) for p in pages])
    return [main_text(texts, roles, c)[0] for (texts, roles), c in zip(pages, covered, strict=True)]


def boilerplate(rows: DataFrame) -> DataFrame:
    """(host, substring): hashes of what enough distinct pages of a host hold. rows: host (a long), html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            by_host: dict[int, list[np.ndarray]] = {}
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_host.setdefault(host, []).append(words.stream(*blocks(page)))
            for host, streams in by_host.items():
                digests = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in streams], dtype=np.uint64).view(np.int64)
                page, left, rank = suffix_ranks(streams, MIN_TOKENS)
                whole = np.flatnonzero(left >= MIN_TOKENS)
                # One of each rank and page; the hash is of the rank's tokens.
                _, first = np.unique(np.stack([rank[whole], page[whole]]), axis=1, return_index=True)
                h = substrings(np.concatenate(streams), host)[whole[first]] if len(whole) else np.zeros(0, dtype=np.int64)
                # Zero stands for the page itself.
                own = np.append(h, np.zeros(len(streams), dtype=np.int64)), np.append(digests[page[whole[first]]], digests)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), host)), pa.array(own[0]), pa.array(own[1])], ["host", "substring", "page"])

    found = rows.select("host", "html").mapInArrow(run, "host long, substring long, page long")
    per = materialize(found.distinct().groupBy("host", "substring").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {MIN_PAGES} or substring = 0"), "substrings")
    total = per.where("substring = 0").select("host", F.col("n").alias("pages"))
    return per.where("substring <> 0").join(total, "host").where(f"n >= {MIN_SHARE} * pages").select("host", "substring")


def extract(pages: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated, n_named) of every row of pages (page_id, url, html)."""
    name = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64(name).alias("host"))
    shards = materialize(rows.groupBy("host").agg(F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.length("html")), F.lit(0)) / shard_chars)).cast("int").alias("shards")), "hosts")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(blocks(h.as_py()), ensure_ascii=False).encode() for h in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(f) for f in found], pa.int64()), pa.array([pa.compress(f, "zstd", asbytes=True) for f in found], pa.binary())], ["host", "page_id", "url", "size", "packed"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, often, known = Words(), None, np.zeros(0, dtype=np.int64), []
        for batch in batches:
            out = []
            for host, shard, substring, page_id, url, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (host, shard) != now:
                    now, often, known = (host, shard), np.zeros(0, dtype=np.int64), []
                if substring is not None:
                    known.append(substring)
                    continue
                if known:
                    often, known = np.array(known, dtype=np.int64), []
                texts, roles = json.loads(pa.decompress(packed, size, "zstd", asbytes=True))
                stream = words.stream(texts, roles)
                bad = np.flatnonzero(np.isin(substrings(stream, host), often)) if len(often) else np.zeros(0, dtype=np.int64)
                text, n_repeated, n_named = main_text(texts, roles, _covered(bad, len(stream), MIN_TOKENS))
                out.append((page_id, url, text, len(text), n_repeated, n_named))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3), strict=True)], ["page_id", "url", "text", "n_chars", "n_repeated", "n_named"])

    parsed = rows.select("host", "page_id", "url", "html").mapInArrow(parse, "host long, page_id long, url string, size long, packed binary")
    dealt = parsed.join(shards, "host").select("host", F.pmod(F.xxhash64("page_id", "url"), "shards").cast("int").alias("shard"), F.lit(None).cast("long").alias("substring"), "page_id", "url", "size", "packed")
    ahead = boilerplate(rows).join(shards, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "substring", *(F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("size", "long"), ("packed", "binary"))))
    both = dealt.unionByName(ahead).repartition("host", "shard").sortWithinPartitions("host", "shard", F.col("substring").asc_nulls_last())
    return both.mapInArrow(judge, "page_id long, url string, text string, n_chars long, n_repeated long, n_named long")
