"""Boosted trees as tables of nodes: what each round adds, and what each feature adds to a row's margin.

A fitted ensemble is small: its trees go to the rows. Margins are nested conditions inside Catalyst;
attributions are array arithmetic over batches of rows.
"""

from __future__ import annotations

import re
from functools import reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.operators import evaluate

#: A leaf is its value, an inner node (feature, threshold, left, right): left is at most the threshold.
Tree = float | tuple[int, float, "Tree", "Tree"]


def parsed(description: str) -> Tree:
    """A tree from its printed form, whose thresholds and predictions are printed in full."""
    lines = [x.strip() for x in description.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]

    def node() -> Tree:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        found = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
        if not found:
            raise ValueError(f"not a split at a threshold: {line}")
        left = node()
        lines.pop(0)  # its Else
        return int(found[1]), float(found[2]), left, node()

    return node()


def boosted_trees(model) -> list[Tree]:
    """The trees of a boosted model, leaves times the tree's weight."""
    def weighted(tree: Tree, w: float) -> Tree:
        return tree * w if isinstance(tree, float) else (*tree[:2], weighted(tree[2], w), weighted(tree[3], w))

    return [weighted(parsed(t.toDebugString), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]


def _chosen(tree: Tree, x: list[Column], leaf) -> Column:
    """What ``leaf`` gives for the leaf that a row falls into; leaves are numbered from the left."""
    at = iter(range(1 << 30))

    def step(t: Tree) -> Column:
        return F.lit(leaf(next(at), t)) if isinstance(t, float) else F.when(x[t[0]] <= t[1], step(t[2])).otherwise(step(t[3]))

    return step(tree)


def staged(features: list[str], trees: list[Tree]) -> Column:
    """The margins after each round: running sums of what the trees add."""
    added = F.array(*(_chosen(t, [F.col(c) for c in features], lambda _, v: v) for t in trees))
    return F.transform(F.sequence(F.lit(1), F.lit(len(trees))), lambda i: F.aggregate(F.slice(added, F.lit(1), i), F.lit(0.0), lambda a, b: a + b))


def boosting_curves(rows: DataFrame, features: list[str], label: str, models: dict, fold: str = "fold") -> DataFrame:
    """fold, part, round, n, log_loss, auc: of each fold's model on its training and on its held rows, round by round.

    ``models`` has the trees of each fold, or the constant of one that could not be fitted. A row counts once per fold
    and round, but rows of equal margin are summed before anything is shuffled, and an ensemble has few margins.
    The chance of a margin m is 1 / (1 + exp(-2 m)).
    """
    known = rows.where(F.col(label).isNotNull())
    parts = []
    for f, trees in models.items():
        margins = staged(features, trees) if isinstance(trees, list) else F.array(F.lit(float(np.log(max(trees, 1e-9) / max(1 - trees, 1e-9)) / 2)))
        part = F.when(F.col(fold) == f, "held").otherwise("train")
        parts.append(known.select(F.lit(f).alias("fold"), part.alias("part"), F.col(label).alias("y"), F.posexplode(margins).alias("at", "p")))
    each = reduce(DataFrame.unionByName, parts).withColumn("round", F.col("at") + 1)
    scores = evaluate.by_score(each, "fold", "part", "round")
    m = F.col("p")
    loss = F.sum(F.col("n1") * F.log1p(F.exp(-2 * m)) + F.col("n0") * F.log1p(F.exp(2 * m)))
    sums = scores.groupBy("fold", "part", "round").agg((loss / F.sum(F.col("n1") + F.col("n0"))).alias("log_loss"))
    return sums.join(evaluate._auc(scores, "fold", "part", "round"), ["fold", "part", "round"]).select("fold", "part", "round", "n", "log_loss", "auc")


def covers(rows: DataFrame, features: list[str], trees: list[Tree]) -> list[dict[int, int]]:
    """Per tree, how many of ``rows`` fall into each leaf."""
    x = [F.col(c) for c in features]
    fallen = F.posexplode(F.array(*(_chosen(t, x, lambda i, _: i) for t in trees))).alias("tree", "leaf")
    out: list[dict[int, int]] = [{} for _ in trees]
    for r in rows.select(fallen).groupBy("tree", "leaf").count().collect():  # one row per leaf
        out[r.tree][r.leaf] = r["count"]
    return out


def leaves(tree: Tree, cover: dict[int, int]) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, [(feature, low, high, share)]) of each leaf that rows fall into: the features of its path with their
    bounds (low < x <= high), and the share of rows that go on along the path at that feature's splits."""
    at = iter(range(1 << 30))

    def counted(t: Tree):
        return (t, cover.get(next(at), 0)) if isinstance(t, float) else (*t[:2], *(pair := (counted(t[2]), counted(t[3]))), pair[0][-1] + pair[1][-1])

    out = []

    def walk(t, path: dict[int, tuple[float, float, float]]) -> None:
        if not t[-1]:
            return
        if len(t) == 2:
            out.append((t[0], [(j, *v) for j, v in path.items()]))
            return
        j, cut, left, right, n = t
        low, high, share = path.get(j, (-np.inf, np.inf, 1.0))
        walk(left, path | {j: (low, min(high, cut), share * left[-1] / n)})
        walk(right, path | {j: (max(low, cut), high, share * right[-1] / n)})

    walk(counted(tree), {})
    return out


def shapley(x: np.ndarray, listed: list) -> tuple[np.ndarray, float]:
    """(contributions of each row and feature, base): exact Shapley values of a sum of leaves.

    A leaf is a product over its path's features: 1 or 0 for a feature that is known, its share for one that is
    not. So the values follow from the sums over subsets by size, a product of (share + known t) over the others.
    """
    out, base = np.zeros(x.shape), 0.0
    for value, path in listed:
        m = len(path)
        base += value * float(np.prod([share for *_, share in path]))
        known = [((x[:, j] > low) & (x[:, j] <= high)).astype(float) for j, low, high, _ in path]
        for a, (j, _, _, share) in enumerate(path):
            sums = np.zeros((len(x), m))
            sums[:, 0] = 1
            for b, (*_, other) in enumerate(path):
                if b != a:
                    moved = sums * other
                    moved[:, 1:] += sums[:, :-1] * known[b][:, None]
                    sums = moved
            weights = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
            out[:, j] += value * (known[a] - share) * (sums @ weights)
    return out, base


def attributions(rows: DataFrame, key: str, features: list[str], trees: list[Tree], background: DataFrame) -> DataFrame:
    """key, base, contributions (one per feature): they add up to the row's margin.

    What a path is worth without a feature is weighed by how the rows of ``background`` go along it.
    """
    listed = [leaf for t, cover in zip(trees, covers(background, features, trees), strict=True) for leaf in leaves(t, cover)]

    def explain(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            found, base = shapley(x, listed)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(len(x), base)), pa.array(list(found), pa.list_(pa.float64()))], names=[key, "base", "contributions"])

    own = rows.select(key, *(F.col(c).cast("double").alias(c) for c in features))
    return own.mapInArrow(explain, f"{key} {dict(own.dtypes)[key]}, base double, contributions array<double>")
