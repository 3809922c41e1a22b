import math
import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import trees
from basketry.operators.trees import Split


def small(spark, n=80):
    rng = random.Random(6)
    rows = []
    for _ in range(n):
        a, b = rng.randrange(12), None if rng.random() < 0.3 else rng.randrange(9)
        rows.append((float(a), None if b is None else float(b), int(rng.random() < (0.9 if b is None else 0.2 if a < 5 else 0.5))))
    return rows, spark.createDataFrame(rows, "a double, b double, label int")


def brute(rows, depth, penalty, least, p=0.5):
    """The best split by trying every value and both sides for nulls, then the same on both sides."""
    g, h = sum(p - r[2] for r in rows), len(rows) * p * (1 - p)
    best = None
    if depth:
        for i, f in enumerate("ab"):
            for t in sorted({r[i] for r in rows if r[i] is not None}):
                for nulls_low in (True, False):
                    low = [r for r in rows if (nulls_low if r[i] is None else r[i] <= t)]
                    gl, hl = sum(p - r[2] for r in low), len(low) * p * (1 - p)
                    if hl < least or h - hl < least:
                        continue
                    gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
                    if gain > (best[0] if best else 0) + 1e-12:
                        best = (gain, f, t, nulls_low, low, [r for r in rows if r not in low])
    if best is None:
        return -0.1 * g / (h + penalty)
    gain, f, t, nulls_low, low, high = best
    high = [r for r in rows if not (nulls_low if r["ab".index(f)] is None else r["ab".index(f)] <= t)]
    return Split(f, t, nulls_low, brute(low, depth - 1, penalty, least), brute(high, depth - 1, penalty, least), gain)


def value(tree, row):
    while isinstance(tree, Split):
        x = row["ab".index(tree.feature)]
        tree = tree.low if (tree.nulls_low if x is None else x <= tree.threshold) else tree.high
    return tree


def gains(tree):
    return [tree.gain, *gains(tree.low), *gains(tree.high)] if isinstance(tree, Split) else []


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_first_tree_is_that_of_trying_every_split(spark, depth):
    rows, df = small(spark)
    got = trees.fit(df, ["a", "b"], trees=1, depth=depth, bins=200, least=1.0)[0]
    want = brute(rows, depth, 1.0, 1.0)
    assert gains(got) == pytest.approx(gains(want))
    assert [value(got, r) for r in rows] == pytest.approx([value(want, r) for r in rows])
    scored = df.select(trees.leaf_value(got).alias("v"), "a", "b").collect()
    assert [r.v for r in scored] == pytest.approx([value(got, (r.a, r.b)) for r in scored])


def test_more_trees_lower_the_loss_and_nulls_get_a_side(spark):
    rows, df = small(spark, 300)
    model = trees.fit(df, ["a", "b"], trees=7, depth=2, rate=0.3)
    losses = []
    for k in range(len(model) + 1):
        p = [1 / (1 + math.exp(-sum(value(t, r) for t in model[:k]))) for r in rows]
        losses.append(-sum(math.log(q if r[2] else 1 - q) for q, r in zip(p, rows)))
    assert all(b < a for a, b in zip(losses, losses[1:])) and len(model) == 7
    assert any(s.feature == "b" for s in trees.splits_of(model))
    assert sum(trees.gain_shares(model).values()) == pytest.approx(1.0)
    first = next(s for s in trees.splits_of(model[:1]))
    stated = trees.split_gains(df, [first]).first().gain
    whole = [t for t in model[:1]][0]
    assert trees.split_gains(df, [whole]).first().gain == pytest.approx(whole.gain) and stated > 0


def test_one_label_or_no_rows_give_leaves(spark):
    _, df = small(spark)
    same = trees.fit(df.withColumn("label", F.lit(1)), ["a", "b"], trees=1, depth=2)
    assert len(same) == 1 and (not isinstance(same[0], Split) or same[0].gain < 1e-6)
    assert not isinstance(trees.fit(df.limit(0), ["a", "b"], trees=1, depth=2)[0], Split)
