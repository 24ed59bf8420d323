"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, lang, topic). Token counts of the cells are raked, margin by margin, until each
margin has its target share of tokens; a cell's factor is its raked share over its actual share, and a document of
the cell is kept with probability rate * factor, at the largest rate, `rate` at most, that leaves no probability over 1: the
expected shares of the sample are the targets. Target weights are given per margin, by value (values without one have
weight 0 and go), or else are tokens ** power, so that large sources, languages and topics give way to small ones. With
`bounded` the cells are raked under the bound of 1 instead, at the largest rate at which that meets the margins: a larger
sample of the same expected shares. The draw is a hash of doc_id: the same document always draws the same number, and
repeated rows are kept or dropped together, as are all rows without a doc_id.

Defined results: nulls in a margin are a value of their own; a null text has no tokens; a cell without tokens has
factor 1; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, materialize, words

#: Of each margin, the power of its token count that its target share is in proportion to.
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.7}
ROUNDS = 20
RATE = 0.6
#: For bounded raking: rounds at most, error of a margin's share that counts as met, and rates tried below the largest.
BOUNDED_ROUNDS, MET, TRIES = 400, 1e-6, 8
#: Cells that are raked on the driver; more are raked as a DataFrame.
MAX_CELLS = 100_000
#: Stands for null in a margin.
NONE = "\x00"


def topic(text: Column) -> Column:
    """A coarse topic by form: legal, tabular, contact, markup or prose (the first that fits)."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains("icensed under") | t.contains("LICENSED UNDER"), "legal")
        .when(t.contains(" | "), "tabular")
        .when(t.contains("@"), "contact")
        .when(t.contains("***") | t.contains("!!"), "markup")
        .otherwise("prose")
    )


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the MD5 of doc_id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(16**13)


#: Target weights of a margin: of its values, or the power of their tokens.
Target = float | dict[str, float]


def rake(cells: DataFrame, powers: dict[str, Target], rounds: int = ROUNDS, max_cells: int = MAX_CELLS, bound: float | None = None) -> DataFrame:
    """cells (the margins and `tokens`) with `factor`; margins must not be null. With `bound`, a rate, no bound * factor is over 1."""
    spark, margins = cells.sparkSession, list(powers)
    cells = materialize(cells, "cells")
    if cells.count() <= max_cells:
        rows = cells.collect()
        given = [[r[m] for r in rows] for m in margins], np.array([float(r["tokens"] or 0) for r in rows]), list(powers.values())
        factors = rake_arrays(*given, rounds) if bound is None else bounded_arrays(*given, bound) / bound
        return spark.createDataFrame([(*[r[m] for m in margins], float(f)) for r, f in zip(rows, factors, strict=True)], ", ".join([*(f"`{m}` string" for m in margins), "factor double"]))
    raked = _rake_frame(cells, powers, rounds)
    if bound is None:
        return raked
    # Too many cells to look for the largest rate: the one at which the largest factor gives 1.
    raked = materialize(raked, "factors")
    return raked.withColumn("factor", F.col("factor") * F.lit(min(1.0, 1 / (bound * (raked.agg(F.max("factor")).first()[0] or 1.0)))))


def _targets(values: list[list], tokens: np.ndarray, powers: list[Target]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each margin the number of each cell's value, and the target share of each value."""
    codes, targets = [], []
    for v, power in zip(values, powers, strict=True):
        names, code = np.unique(np.array(v, dtype=object).astype(str), return_inverse=True)
        sums = np.bincount(code, tokens)
        given = np.array([float(power.get(x, 0.0)) for x in names.tolist()]) if isinstance(power, dict) else sums**power
        wanted = np.where(sums > 0, given, 0.0)
        if not wanted.sum() > 0:
            raise ValueError("no value of a margin has both tokens and a target weight")
        codes.append(code)
        targets.append(wanted / wanted.sum())
    return codes, targets


def rake_arrays(values: list[list], tokens: np.ndarray, powers: list[Target], rounds: int) -> np.ndarray:
    """The factor of each cell."""
    total = tokens.sum()
    if not total:
        return np.ones(len(tokens))
    codes, targets = _targets(values, tokens, powers)
    share = weight = tokens / total
    for _ in range(rounds):
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, weight)
            weight = weight * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
    return np.divide(weight, share, out=np.ones(len(tokens)), where=share > 0)


def bounded_arrays(values: list[list], tokens: np.ndarray, powers: list[Target], rate: float) -> np.ndarray:
    """The probability of each cell, at most 1: the margins of tokens * probability have their target shares."""
    total = tokens.sum()
    if not total:
        return np.full(len(tokens), rate)
    codes, targets = _targets(values, tokens, powers)
    factor = rake_arrays(values, tokens, powers, BOUNDED_ROUNDS)
    # A rate that does without the bound, and one over which some value has not tokens enough.
    low = min(rate, 1 / factor.max())
    high = min([rate, *(float((np.bincount(c, tokens)[t > 0] / (t[t > 0] * total)).min()) for c, t in zip(codes, targets, strict=True))])
    best = np.minimum(low * factor, 1.0)
    for k in range(TRIES + 1):
        if high <= low:
            break
        at = high if not k else (low + high) / 2
        p = _bounded(codes, targets, tokens, at)
        if p is None:
            high = at
        else:
            best, low = p, at
    return np.where(tokens > 0, best, low)


def _bounded(codes: list[np.ndarray], targets: list[np.ndarray], tokens: np.ndarray, rate: float) -> np.ndarray | None:
    """Probabilities at this rate, or None if the margins are not met."""
    total = tokens.sum()
    weight = np.full(len(tokens), rate)
    for _ in range(BOUNDED_ROUNDS):
        for code, target in zip(codes, targets, strict=True):
            by, capped = np.ones(len(target)), np.zeros(len(tokens), dtype=bool)
            while True:
                rest, free = target * rate * total - np.bincount(code, tokens * capped, len(target)), np.bincount(code, tokens * weight * ~capped, len(target))
                by = np.divide(np.maximum(rest, 0), free, out=by, where=free > 0)
                over = ~capped & (weight * by[code] > 1)
                if not over.any():
                    break
                capped |= over
            weight = np.minimum(weight * by[code], 1e12)
        p = np.minimum(weight, 1.0)
        if max(np.abs(np.bincount(c, tokens * p, len(t)) / (tokens @ p) - t).max() for c, t in zip(codes, targets, strict=True)) <= MET:
            return p
    return None


def _rake_frame(cells: DataFrame, powers: dict[str, Target], rounds: int) -> DataFrame:
    """The same as rake_arrays, for more cells than the driver should hold."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.select(*powers, F.lit(1.0).alias("factor"))
    now, targets = cells.withColumn("weight", F.col("tokens") / float(total)), {}
    for m, power in powers.items():
        # Weights that are given for more values than a plan can hold belong in a table of their own.
        given = F.coalesce(F.create_map(*(F.lit(x) for kv in power.items() for x in kv))[F.col(m)].cast("double"), F.lit(0.0)) if isinstance(power, dict) else F.pow("n", F.lit(power))
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("n")).select(m, F.when(F.col("n") > 0, given).otherwise(0.0).alias("wanted"))
        whole = sums.agg(F.sum("wanted")).first()[0]
        targets[m] = materialize(sums.select(m, (F.col("wanted") / whole).alias("wanted")), "targets")
    for _ in range(rounds):
        for m in powers:
            have = now.groupBy(m).agg(F.sum("weight").alias("have")).join(targets[m], m).select(m, F.when(F.col("have") > 0, F.col("wanted") / F.col("have")).otherwise(0.0).alias("by"))
            now = now.join(have, m).withColumn("weight", F.col("weight") * F.col("by")).drop("by")
        now = now.checkpoint()
    return now.select(*powers, F.when(F.col("tokens") > 0, F.col("weight") / (F.col("tokens") / float(total))).otherwise(1.0).alias("factor"))


def mix(docs: DataFrame, margins: dict[str, Column], targets: dict[str, Target] = POWERS, rate: float = RATE, rounds: int = ROUNDS, details: tuple[str, str] | None = None, bounded: bool = False) -> DataFrame:
    """The documents that the calibrated probabilities keep. `details` names columns for tokens and probability."""
    n, *own = fresh(docs, "tm_tokens", *[f"tm_{m}" for m in margins])
    factor, p = fresh(docs, "tm_factor", "tm_p")
    out = docs.withColumns({n: F.size(words(F.col("text"))).cast("long")} | {c: F.coalesce(v.cast("string"), F.lit(NONE)) for c, v in zip(own, margins.values(), strict=True)})
    cells = out.groupBy(*own).agg(F.sum(n).alias("tokens"))
    raked = materialize(rake(cells, dict(zip(own, (targets[m] for m in margins), strict=True)), rounds, bound=rate if bounded else None), "raked").withColumnRenamed("factor", factor)
    most = raked.agg(F.max(factor)).first()[0] or 1.0
    out = out.join(raked, own, "left").withColumn(p, F.least(F.lit(1.0), min(rate, 1.0 / most) * F.coalesce(F.col(factor), F.lit(1.0))))
    out = out.where(draw(F.col("doc_id")) < F.col(p))
    more = [F.col(n).alias(details[0]), F.round(p, 9).alias(details[1])] if details else []
    return out.select(*docs.columns, *more)
