"""Quality rules: text statistics, two base rules, and a decision list learned by sequential covering.

Everything on the data runs as DataFrame expressions. The learner sees one aggregated table of bin counts of at
most MAX_LABELLED labelled rows and works on the driver; its result is one ordered CASE expression.

Defined results: a null text counts as empty; an empty text has zero words and so fails the base rule; repeated rows
and repeated doc_ids are each judged by themselves; an empty table gives an empty table; without labels (or with
labels of one kind) the list is empty and keeps what the base rules keep; columns of other names pass through
untouched, whatever they are called. Two different eight-word windows of one text count as equal only if their 64-bit
hashes collide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, fresh, words

#: Labelled rows that the learner looks at, about (a hash of doc_id picks them where there are more).
MAX_LABELLED = 20_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Cut points per feature.
BINS = 32
MAX_RULES, MAX_CONDITIONS = 8, 3
#: A rule stays if it is at least this often right on the rows held back for pruning, and covers so many rows there.
MIN_PRECISION, MIN_COVER = 0.8, 3

#: Features by name, as a function of the statistics struct.
FEATURES = {
    "n_words": lambda s: s["n_words"].cast("double"),
    "mean_word_chars": lambda s: s["word_chars"] / F.greatest(s["n_words"], F.lit(1)),
    "symbols_per_word": lambda s: s["n_symbols"] / F.greatest(s["n_words"], F.lit(1)),
    "dup_lines_per_line": lambda s: s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
    "repeat_share": lambda s: s["n_repeat_words"] / F.greatest(s["n_words"], F.lit(1)),
    "distinct_share": lambda s: s["n_distinct_words"] / F.greatest(s["n_words"], F.lit(1)),
}


def with_statistics(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """docs with a struct column `into` of n_words, n_distinct_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Steps are kept in helper columns of their own, so that none is computed twice in a row.
    """
    t, h, g, s, d = fresh(docs, "tm_text", "tm_hashes", "tm_windows", "tm_sorted", "tm_starts")
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    ln = fresh(docs, "tm_lines")[0]
    out = (
        docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
        .withColumn(h, F.transform(words(F.col(t)), lambda w: F.xxhash64(w)))
        .withColumn(ln, lines)
    )
    at = lambda i, k: F.get(F.col(h), i + k)
    out = out.withColumn(
        g,
        F.when(
            F.size(h) >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only texts that repeat a window are sorted: equal windows then stand side by side.
    out = out.withColumn(
        s,
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.transform(F.col(g), lambda x, i: F.struct(x.alias("g"), i.alias("i")))),
        ),
    )
    near = lambda k: F.get(F.col(s), k)["g"]
    starts = F.transform(
        F.filter(
            F.transform(F.col(s), lambda x, k: F.when((near(k - 1) == x["g"]) | (near(k + 1) == x["g"]), x["i"])),
            lambda i: i.isNotNull(),
        ),
        lambda i: i,
    )
    out = out.withColumn(d, F.when(F.col(s).isNotNull(), F.sort_array(starts)))
    covered = F.aggregate(
        F.transform(F.col(d), lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(d), k + 1) - i, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    n_symbols = F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, ""))
    struct = F.struct(
        F.size(h).cast("long").alias("n_words"),
        F.size(F.array_distinct(h)).cast("long").alias("n_distinct_words"),
        F.length(F.translate(F.col(t), BLANKS, "")).cast("long").alias("word_chars"),
        n_symbols.cast("long").alias("n_symbols"),
        F.size(ln).cast("long").alias("n_lines"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        # Not deterministic, so that no filter above is pushed below and the whole chain written out again for each use.
        F.spark_partition_id().alias("at"),
    )
    return out.withColumn(into, struct).drop(t, h, g, s, d, ln)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    """True: the feature is at least the threshold; False: it is below."""
    threshold: float

    def column(self, s: Column) -> Column:
        value = FEATURES[self.feature](s)
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction of conditions that rejects; what no rule rejects is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def keeps(self, s: Column) -> Column:
        out = None
        for rule in self.rules:
            test = rule[0].column(s)
            for c in rule[1:]:
                test = test & c.column(s)
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "else keep"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learns which texts to reject (label 0) from labelled statistics.

    Rows that fail a base rule are none of the list's business and left out. labels may hold nulls and repeated doc_ids: rows without an id or label are left out, and of an id with several
    labels the smallest counts.
    """
    y = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    total = y.count()
    if not total:
        return DecisionList()
    if total > max_labelled:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_labelled / total * (1 << 20)))
    # At most about max_labelled ids and labels are broadcast.
    seen = with_statistics(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id"), "s")
    values = seen.where(~base_failed(F.col("s"))).select("doc_id", "y", F.array(*[f(F.col("s")) for f in FEATURES.values()]).alias("x")).persist()
    try:
        shares = [k / BINS for k in range(1, BINS)]
        cuts = values.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 100_000).alias(name) for i, name in enumerate(FEATURES)]).first()
        if cuts is None or cuts[0] is None:
            return DecisionList()
        cuts = [sorted(set(c)) for c in cuts]
        binned = [_bin(F.get("x", F.lit(i)), c).alias(f"b{i}") for i, c in enumerate(cuts)]
        hold = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("hold")
        cells = values.select("y", hold, *binned).groupBy("y", "hold", *[f"b{i}" for i in range(len(cuts))]).count().collect()
    finally:
        values.unpersist()
    return cover([(r[0] == 0, r[1], tuple(r[2:-1]), r[-1]) for r in cells], cuts)


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cut points the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: value >= t))


def cover(cells: list[tuple[bool, bool, tuple[int, ...], int]], cuts: list[list[float]]) -> DecisionList:
    """Sequential covering over counted cells (bad, held back, bins, rows): grow by information gain, prune on what is held back."""
    names, rules = list(FEATURES), []
    left = sorted(cells)
    while len(rules) < MAX_RULES:
        grow, prune = [c for c in left if not c[1]], [c for c in left if c[1]]
        rule: list[tuple[int, bool, int]] = []
        inside = grow
        while len(rule) < MAX_CONDITIONS and (best := _best_condition(inside, cuts)):
            rule.append(best)
            inside = [c for c in inside if _holds(best, c[2])]
            if not any(not c[0] for c in inside):
                break
        # Prune: the prefix that is best on the rows held back.
        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (_worth(r, prune), -len(r)), default=[])
        bad, good = _counts(rule, prune)
        if not rule or bad < MIN_COVER or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(tuple(Condition(names[f], up, float(cuts[f][b - 1])) for f, up, b in rule))
        left = [c for c in left if not all(_holds(x, c[2]) for x in rule)]
    return DecisionList(tuple(rules))


def _holds(condition: tuple[int, bool, int], bins: tuple[int, ...]) -> bool:
    f, up, b = condition
    return bins[f] >= b if up else bins[f] < b


def _counts(rule: list[tuple[int, bool, int]], cells: list) -> tuple[int, int]:
    bad = good = 0
    for is_bad, _, bins, n in cells:
        if all(_holds(c, bins) for c in rule):
            bad, good = bad + n * is_bad, good + n * (not is_bad)
    return bad, good


def _worth(rule: list, cells: list) -> float:
    bad, good = _counts(rule, cells)
    return (bad - good) / (bad + good + 1)


def _best_condition(cells: list, cuts: list[list[float]]) -> tuple[int, bool, int] | None:
    """The condition of the largest FOIL gain over the cells."""
    bad, good = (sum(n for b, _, _, n in cells if b == kind) for kind in (True, False))
    if not bad or not good:
        return None
    before, best, gain = math.log2(bad / (bad + good)), None, 1e-9
    for f, c in enumerate(cuts):
        by_bin = [[0, 0] for _ in range(len(c) + 1)]
        for is_bad, _, bins, n in cells:
            by_bin[bins[f]][not is_bad] += n
        below = [0, 0]
        for b in range(1, len(c) + 1):
            below = [below[0] + by_bin[b - 1][0], below[1] + by_bin[b - 1][1]]
            for up, (p, q) in ((False, below), (True, (bad - below[0], good - below[1]))):
                if p and (now := p * (math.log2(p / (p + q)) - before)) > gain:
                    best, gain = (f, up, b), now
    return best


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed and kept."""
    s = F.col("s")
    out = with_statistics(docs.select("doc_id", "text"), "s")
    return out.select("doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines")], base_failed(s).alias("base_failed"), (~base_failed(s) & rules.keeps(s)).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that pass, columns as they were."""
    stats = fresh(docs, "tm_stats")[0]
    s = F.col(stats)
    return with_statistics(docs, stats).where(~base_failed(s) & rules.keeps(s)).drop(stats)
