"""Toxicity by maximum-scoring segments.

Token scores are log-odds of toxic against other training texts under a Dirichlet prior in proportion to the overall
counts (Monroe, Colaresi, Quinn 2008). Counted are the texts that hold a token, and those that hold a token of a given
beginning, so that inflected and compound forms count; a token scores as the best of itself and its beginnings. Those
whose log-odds are not well above their standard error count as background, a small loss. All maximal-scoring segments of a text come from one linear scan (Ruzzo, Tompa 1999). A
segment's chance among that many background tokens is that of an extreme value, 1 - exp(-K n exp(-lambda s)) (Karlin,
Altschul 1990); the surprises of a text's segments add up, and a logistic curve turns the sum into a probability.

The fit sees at most about MAX_LABELLED labelled rows. Tokens are runs of letters and digits, lower-cased. Defined
results: a null text counts as empty; an empty text has no segment and the probability of such texts; without labels
of both kinds every score is the share of toxic labels (0 without any); an id with several labels counts as toxic if
one says so; a null doc_id is not held out; repeated rows are scored each by itself; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit looks at, about (a hash of doc_id picks them where there are more).
MAX_LABELLED = 20_000
#: The prior: so many counts for each token, and so many more in proportion to the overall counts. Then the standard
#: errors that a token's log-odds must be above zero, and what a background token costs.
EACH, PRIOR, MIN_Z, COST = 0.5, 1000.0, 3.5, 0.1
#: Lengths of the beginnings.
PREFIXES = (3, 4, 5, 6, 7, 8)
_TOKEN = re.compile(r"[^\W_]+")
#: Tokens whose scores are remembered, per Python worker; the memory starts anew beyond that.
_MEMORY = 300_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def features(token: str) -> list[str]:
    """The token, and its beginnings with a star."""
    return [token, *(token[:k] + "*" for k in PREFIXES if k < len(token))]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -30.0
    slope: float = 0.0
    memory: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def token_score(self, token: str) -> float:
        """Zero: background."""
        get = self.scores.get
        return max([get(f, 0.0) for f in features(token)])

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """Maximal segments (first character, end, score, surprise) of a text, and its number of tokens."""
        tokens = _TOKEN.findall(text.lower()) if text else []
        get, memory = self.memory.get, self.memory
        if len(memory) > _MEMORY:
            memory.clear()
        scores = [get(w, -1.0) for w in tokens]
        for i, w in enumerate(tokens):
            if scores[i] < 0:
                scores[i] = memory[w] = self.token_score(w)
        hits = [(i, s) for i, s in enumerate(scores) if s]
        if not hits:
            return [], len(tokens)
        found = maximal_segments(hits, COST)
        at = [m.span() for m in _TOKEN.finditer(text.lower())]
        return [(at[a][0], at[b - 1][1], s, self.surprise(s, len(tokens))) for a, b, s in found], len(tokens)

    def surprise(self, score: float, n: int) -> float:
        """Minus the logarithm of the chance that n background tokens hold a segment of such a score."""
        e = self.k * n * math.exp(-self.lam * score)
        return -math.log(-math.expm1(-e)) if e > 1e-12 else -math.log(max(e, 1e-300))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def maximal_segments(hits: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score); hits: the tokens that gain, in order; each other costs."""
    # First token, end, sums left of and through it, and the nearest entry before whose left sum is smaller.
    stack: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for i, s in hits:
        total -= cost * (i - last - 1)
        start, left, last = i, total, i
        total += s
        right = total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, i + 1, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _labelled(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    total = y.count()
    if total > max_labelled:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_labelled / total * (1 << 20)))
    # At most about max_labelled ids and labels are broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from the labelled rows that are not held out."""
    train = _labelled(docs, labels, label, max_labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y > 0].update({f for w in set(_TOKEN.findall(text.lower())) for f in features(w)} if text else ())
        words = sorted(counts[0].keys() | counts[1].keys())
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[c][w] for w in part], pa.int64()) for c in (1, 0))], ["token", "bad", "good"])

    counted = train.mapInArrow(count, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).persist()
    try:
        n = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).first()
        rate = train.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
        if rate is None or not n["bad"] or not n["good"]:
            return Model(intercept=-30.0 if not rate else 30.0 if rate == 1 else math.log(rate / (1 - rate)))
        share = (F.col("bad") + F.col("good")) / float(n["bad"] + n["good"])
        a = EACH + PRIOR * share
        bad, good = F.col("bad") + a, F.col("good") + a
        whole = PRIOR + EACH * n["n"]
        odds = F.log(bad / (n["bad"] + whole - bad)) - F.log(good / (n["good"] + whole - good))
        z = odds / F.sqrt(1 / bad + 1 / good)
        # The tokens of a bounded sample, and of those the few that stand out.
        rows = counted.select("token", odds.alias("s"), z.alias("z"), (F.col("good") / float(n["good"])).alias("p")).where(F.col("z") >= MIN_Z).collect()
    finally:
        counted.unpersist()
    model = Model({r["token"]: r["s"] for r in rows})
    model.lam = _lambda([(r["p"], r["s"]) for r in rows])
    return _calibrate(model, train, n["good"])


def _lambda(positive: list[tuple[float, float]]) -> float:
    """The root above zero of the sum of p * exp(lambda * score) = 1 over background tokens."""
    rest = 1 - sum(p for p, _ in positive)
    f = lambda x: rest * math.exp(-COST * x) + sum(p * math.exp(min(700.0, x * s)) for p, s in positive) - 1
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _calibrate(model: Model, train: DataFrame, background: int) -> Model:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, ns, scores = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, n = model.segments(text)
                ys.append(int(y > 0))
                ns.append(n)
                scores.append([s for _, _, s, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ns, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["y", "n", "scores"])

    rows = train.mapInArrow(measure, "y int, n long, scores array<double>").collect()
    # K: that background texts have as many segments as they are expected to, each at least as good as it is.
    null = [s for r in rows if not r["y"] for s in r["scores"]]
    model.k = (len(null) + 0.5) / max(1, background) * math.exp(model.lam * (min(null) if null else 1.0))
    x = np.array([sum(model.surprise(s, r["n"]) for s in r["scores"]) for r in rows])
    y = np.array([r["y"] for r in rows], dtype=float)
    model.intercept, model.slope = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method with a little ridge on the slope."""
    design, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - np.array([1e-6, ridge]) * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, ridge])
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages) of every row; passages: first character, end, score and surprise of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("surprise", pa.float64())]))
        for batch in batches:
            found = [model.segments(t.as_py())[0] for t in batch.column(1)]
            scores = [model.probability(sum(x[3] for x in f)) for f in found]
            passages = [[dict(zip(("start", "end", "score", "surprise"), x, strict=True)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, passages array<struct<start:int,end:int,score:double,surprise:double>>")
