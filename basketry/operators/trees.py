"""Boosted trees that take nulls as they are: every split learns on which side they go.

Fitting: features are cut into bins at their quantiles, nulls being a bin of their own. For each level of a tree one
aggregate over the rows sums first and second derivatives of the logistic loss by node, feature and bin; from these few
sums (nodes x features x bins) the driver takes the split with the largest gain, nulls tried on both sides. So
a level is one pass with a small shuffle, and nothing else of the data leaves the executors.

A tree is nested ``Split``s with leaf values; scoring is one CASE expression per tree and reads one row at a time.
Equal gains go to the first feature, the lowest bin, nulls low. A node that no split improves stays a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import durable

#: Trees between two writes of the rows' margins; expressions grow until then.
_TREES_PER_WRITE = 5


@dataclass(frozen=True)
class Split:
    """Values up to ``threshold`` go low, larger ones high, nulls low if ``nulls_low``."""

    feature: str
    threshold: float
    nulls_low: bool
    low: Split | float
    high: Split | float
    gain: float = 0.0


def goes_low(split: Split) -> Column:
    return F.coalesce(F.col(split.feature) <= split.threshold, F.lit(split.nulls_low))


def leaf_value(tree: Split | float) -> Column:
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    return F.when(goes_low(tree), leaf_value(tree.low)).otherwise(leaf_value(tree.high))


def margin(trees: Sequence[Split | float]) -> Column:
    total = F.lit(0.0)
    for tree in trees:
        total = total + leaf_value(tree)
    return total


def probability(trees: Sequence[Split | float]) -> Column:
    return 1.0 / (1.0 + F.exp(-margin(trees)))


def splits_of(trees: Sequence[Split | float]) -> list[Split]:
    found, waiting = [], list(trees)
    while waiting:
        tree = waiting.pop()
        if isinstance(tree, Split):
            found.append(tree)
            waiting += [tree.low, tree.high]
    return found


def gain_shares(trees: Sequence[Split | float]) -> dict[str, float]:
    """Each feature's share of the gains of all splits."""
    total: dict[str, float] = {}
    for s in splits_of(trees):
        total[s.feature] = total.get(s.feature, 0.0) + s.gain
    whole = sum(total.values())
    return {f: g / whole for f, g in total.items()} if whole else {}


def gain_of(low: tuple[float, float], high: tuple[float, float], penalty: float) -> float:
    """Gain of a split from the sums of first and second derivatives on both sides."""
    part = lambda g, h: g * g / (h + penalty)
    return part(*low) + part(*high) - part(low[0] + high[0], low[1] + high[1])


def split_gains(labelled: DataFrame, splits: Sequence[Split], penalty: float = 1.0) -> DataFrame:
    """(feature, threshold, gain) of given splits of all rows (label 0 or 1) at margin 0: true gains of stumps."""
    g, h = 0.5 - F.col("label"), F.lit(0.25)
    def part(a: Column, b: Column) -> Column:
        return a * a / (b + penalty)

    def one(s: Split) -> Column:
        inside = goes_low(s)
        low = [F.coalesce(F.sum(F.when(inside, x)), F.lit(0.0)) for x in (g, h)]
        high = [F.coalesce(F.sum(F.when(~inside, x)), F.lit(0.0)) for x in (g, h)]
        gain = part(*low) + part(*high) - part(low[0] + high[0], low[1] + high[1])
        return F.struct(F.lit(s.feature).alias("feature"), F.lit(s.threshold).alias("threshold"), gain.alias("gain"))

    return labelled.agg(F.array(*[one(s) for s in splits]).alias("s")).select(F.inline("s"))


def _edges(rows: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]).head()  # features x bins numbers
    return {f: sorted(set(map(float, found[f] or []))) for f in features}


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value; -1 for nulls."""
    below = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < value))
    return F.when(value.isNull(), F.lit(-1)).otherwise(below)


def _best(sums: dict[int, np.ndarray], features: Sequence[str], edges: dict[str, list[float]], penalty: float, least: float) -> dict[int, tuple]:
    """Of each node (gain, feature, bin, nulls low, sums low, sums high); ``sums`` per node: feature x bin x (g, h), nulls in the last bin."""
    out = {}
    for node, table in sums.items():
        best = (0.0,)
        for i, f in enumerate(features):
            nulls, known = table[i, -1], np.cumsum(table[i, :-1], axis=0)
            whole = known[-1] + nulls
            for b in range(len(edges[f])):
                for nulls_low in (True, False):
                    low = known[b] + nulls * nulls_low
                    high = whole - low
                    if low[1] < least or high[1] < least:
                        continue
                    gain = gain_of(tuple(low), tuple(high), penalty)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, b, nulls_low, low, high)
        out[node] = best
    return out


def fit(
    labelled: DataFrame, features: Sequence[str], trees: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32,
    penalty: float = 1.0, least: float = 1.0,
) -> list[Split | float]:
    """Trees for ``label`` (0 or 1); ``least`` is the smallest sum of second derivatives of a side."""
    edges = _edges(labelled, features, bins)
    binned = F.array(*[_bin(F.col(f), edges[f]) for f in features])
    rows = durable(labelled.select(*[F.col(f).cast("double").alias(f) for f in features], F.col("label").cast("double").alias("label"), binned.alias("bins"), F.lit(0.0).alias("margin")))
    width = max(len(e) for e in edges.values()) + 2
    model: list[Split | float] = []
    for number in range(trees):
        p = 1.0 / (1.0 + F.exp(-F.col("margin")))
        current = rows.select("*", (p - F.col("label")).alias("g"), (p * (1 - p)).alias("h"))
        splits: dict[int, tuple] = {}
        leaves: dict[int, np.ndarray] = {}
        node, level = F.lit(1), [1]
        for _ in range(depth):
            at = current.withColumn("node", node).filter(F.col("node").isin(level))
            cells = at.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
            sums = {n: np.zeros((len(features), width, 2)) for n in level}
            for r in cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums[r["node"]][r["feature"], r["bin"]] = r["g"], r["h"]  # bin -1, the last one, holds the nulls
            if 1 in level:
                leaves[1] = sums[1][0].sum(axis=0)
            found = {n: b for n, b in _best(sums, features, edges, penalty, least).items() if len(b) > 1}
            level = []
            for n, (gain, f, b, nulls_low, low, high) in found.items():
                splits[n] = (f, edges[f][b], nulls_low, gain)
                leaves[2 * n], leaves[2 * n + 1] = low, high
                level += [2 * n, 2 * n + 1]
                inside = F.coalesce(F.col(f) <= edges[f][b], F.lit(nulls_low))
                node = F.when(node == n, F.when(inside, 2 * n).otherwise(2 * n + 1)).otherwise(node)
            if not level:
                break

        def grown(n: int, splits=splits, leaves=leaves) -> Split | float:
            if n not in splits:
                g, h = leaves[n]
                return float(-rate * g / (h + penalty))
            f, threshold, nulls_low, gain = splits[n]
            return Split(f, threshold, nulls_low, grown(2 * n), grown(2 * n + 1), float(gain))

        model.append(grown(1))
        rows = rows.withColumn("margin", F.col("margin") + leaf_value(model[-1]))
        if (number + 1) % _TREES_PER_WRITE == 0:
            rows = durable(rows)
    return model
