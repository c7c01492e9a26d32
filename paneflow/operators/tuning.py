"""Adaptive search of parameters: a tree of Parzen estimators over the trials made so far.

Trials are evaluated together where they do not depend on each other; their scores are one
table, keyed by trial and fold, that is ranked in one pass.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.operators import evaluate, models

#: A parameter is a list of choices or a range (low, high) of numbers.
Space = dict[str, list | tuple[float, float]]


def _drawn(rng: random.Random, space: Space) -> dict:
    return {name: rng.uniform(*kind) if isinstance(kind, tuple) else rng.choice(kind) for name, kind in space.items()}


def _density(x, seen: list, kind) -> float:
    """Parzen density of a value among the values seen: kernels beside an even one over the whole range."""
    if not isinstance(kind, tuple):
        return (seen.count(x) + 1) / (len(seen) + len(kind))
    low, high = kind
    width = max((high - low) / max(1, len(seen)), 1e-12 + (high - low) / 25)
    kernels = sum(math.exp(-(((x - v) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi)) for v in seen)
    return (kernels + 1 / max(high - low, 1e-12)) / (len(seen) + 1)


def proposed(rng: random.Random, space: Space, done: list[tuple[dict, float]], share: float = 0.25, candidates: int = 24) -> dict:
    """The candidate most likely among the best ``share`` of the trials and least among the rest, near the best by turns."""
    ranked = sorted(done, key=lambda t: -t[1])
    n = max(1, math.ceil(share * len(ranked)))
    best, rest = [t for t, _ in ranked[:n]], [t for t, _ in ranked[n:]]

    def near() -> dict:
        out = {}
        for name, kind in space.items():
            if isinstance(kind, tuple):
                v = rng.choice(best)[name] if rng.random() < n / (n + 1) else rng.uniform(*kind)
                width = max((kind[1] - kind[0]) / max(1, n), (kind[1] - kind[0]) / 25)
                out[name] = min(kind[1], max(kind[0], rng.gauss(v, width)))
            else:
                out[name] = rng.choices(kind, [_density(c, [t[name] for t in best], kind) for c in kind])[0]
        return out

    def gain(c: dict) -> float:
        return sum(math.log(_density(c[p], [t[p] for t in best], kind)) - math.log(_density(c[p], [t[p] for t in rest], kind)) for p, kind in space.items())

    return max((near() for _ in range(candidates)), key=gain)


def parzen_search(objective: Callable[[list[dict]], list[float]], space: Space, trials: int, startup: int = 5, batch: int = 1, seed: int = 42) -> list[tuple[dict, float]]:
    """All trials with their values, highest wanted: ``startup`` drawn at random, the others proposed from those before.

    ``objective`` values several trials at once. A trial without a value (NaN) counts as the worst.
    """
    rng = random.Random(seed)
    done: list[tuple[dict, float]] = []
    while len(done) < trials:
        n = min(trials - len(done), startup if not done else batch)
        given = [_drawn(rng, space) if not done else proposed(rng, space, done) for _ in range(n)]
        done += [(g, -math.inf if v != v else v) for g, v in zip(given, objective(given), strict=True)]
    return done


def fold_auc(rows: DataFrame, features: list[str], label: str, folds: list[int], kind: str) -> Callable[[list[dict]], list[float]]:
    """The objective of models by their mean AUC over folds: the scores of all trials are ranked in one pass."""

    def values(given: list[dict]) -> list[float]:
        own = rows.where(F.col("fold").isin(folds))
        parts = [models.out_of_fold(own, features, label, folds, kind=kind, **g).select(F.lit(i).alias("trial"), "fold", F.col(label).alias("y"), "p") for i, g in enumerate(given)]
        found = evaluate.roc_auc(reduce(DataFrame.unionByName, parts), "trial", "fold").groupBy("trial").agg(F.avg("auc").alias("auc"))
        by_trial = {r.trial: r.auc for r in found.collect()}
        return [by_trial.get(i) if by_trial.get(i) is not None else math.nan for i in range(len(given))]

    return values
