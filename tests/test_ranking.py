"""Rankings of scores finer than any rounding, order statistics by fold, exact signed ranks."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneflow.operators import diagnostics, evaluate, features, quantiles


def plain_auc(rows):
    wins = pairs = 0
    for (p, y), (q, z) in itertools.product(rows, rows):
        if y == 1 and z == 0:
            pairs += 1
            wins += 1 if p > q else 0.5 if p == q else 0
    return wins / pairs if pairs else None


def plain_ap(rows):
    positives = sum(y for _, y in rows)
    return sum(sum(y for q, y in rows if q == p) * sum(y for q, y in rows if q >= p) / sum(q >= p for q, _ in rows) for p in {p for p, _ in rows}) / positives if positives else None


def test_fine_scores_do_not_tie(spark):
    rows = spark.createDataFrame([(1e-7, 0), (2e-7, 0), (3e-7, 1), (4e-7, 1)], "p double, y int")
    assert evaluate.roc_auc(rows).first().auc == 1.0
    assert evaluate.average_precision(rows).first().ap == 1.0


@pytest.fixture(params=[4, 1024])
def ranges(request, monkeypatch):
    """With few ranges and with many."""
    monkeypatch.setattr(quantiles, "BINS", request.param)
    monkeypatch.setattr(quantiles, "_STEP", 2 if request.param == 4 else 32)


def test_ranking_equals_plain(spark, ranges):
    rng = random.Random(3)
    rows = {g: [(rng.choice([rng.random() ** 9, rng.randrange(5) / 4, -rng.random() * 1e-9]), int(rng.random() < 0.3)) for _ in range(120)] for g in "ab"} | {"c": [(0.5, 1), (0.5, 0)], "d": [(0.1, 1)]}
    df = spark.createDataFrame([(g, p, y) for g, own in rows.items() for p, y in own] + [("a", float("nan"), 1), ("a", None, 0)], "g string, p double, y int")
    auc = {r.g: (r.n, r.auc) for r in evaluate.roc_auc(df, "g").collect()}
    ap = {r.g: r.ap for r in evaluate.average_precision(df, "g").collect()}
    for g, own in rows.items():
        assert auc[g][0] == len(own) and auc[g][1] == pytest.approx(plain_auc(own)) and ap[g] == pytest.approx(plain_ap(own))


def test_topk_equals_plain(spark, ranges):
    rng = random.Random(4)
    rows = [(i, rng.choice([1e-9 * rng.randrange(9), rng.random()]), int(rng.random() < 0.4)) for i in range(230)]
    df = spark.createDataFrame(rows, "event long, p double, y int")
    best = [y for *_, y in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for r in evaluate.topk_gain(df, (1, 3, 10, 55, 100), "event").collect():
        k = max(1, 230 * r.percent // 100)
        assert (r.k, r.gain) == (k, pytest.approx(sum(best[:k]) / sum(best)))


def test_threshold_search_on_the_grid(spark):
    rng = random.Random(5)
    rows = [(rng.choice([rng.random(), round(rng.random(), 2)]), int(rng.random() < 0.5)) for _ in range(400)]
    df = spark.createDataFrame(rows, "p double, y int")
    for metric in ("f1", "balanced_accuracy"):
        got = evaluate.threshold_search(df, 81, 0.1, 0.9, metric=metric).first()

        def rate(t, metric=metric):
            tp, fp, fn, tn = (sum((p >= t) == h and y == c for p, y in rows) for h, c in ((True, 1), (True, 0), (False, 1), (False, 0)))
            return 2 * tp / (2 * tp + fp + fn) if metric == "f1" else (tp / (tp + fn) + tn / (tn + fp)) / 2

        grid = [round(0.1 + 0.01 * i, 6) for i in range(81)]
        want = max(grid, key=lambda t: (round(rate(t), 9), -t))
        assert (got.t, got[metric]) == (want, pytest.approx(rate(want)))


def test_no_window_spans_all_scores(spark):
    df = spark.range(2000).select(F.rand(1).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    plan = evaluate.roc_auc(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "n0" in line]
    assert all("_bin" in line for line in windows) and windows


def test_training_quantiles_equal_numpy(spark, ranges):
    rng = random.Random(6)
    rows = [(rng.randrange(5), rng.choice([rng.random(), 1.5, rng.randrange(4) * 1e6])) for _ in range(500)] + [(5, 9.0)]
    counts = spark.createDataFrame(rows, "own int, x double").groupBy("own", "x").agg(F.count("*").alias("n"))
    got = {r.fold: (r.q1, r.median, r.q9) for r in quantiles.training_quantiles(counts, 7, {"q1": 0.1, "median": 0.5, "q9": 0.93}).collect()}
    assert set(got) == set(range(7))
    for f, found in got.items():
        assert found == pytest.approx(tuple(np.quantile([x for o, x in rows if o != f], (0.1, 0.5, 0.93))))


def test_fit_medians_and_indicators(spark):
    rows = spark.createDataFrame([(i, float(i * i % 37), None if i % 10 else 1.0) for i in range(90)], "event long, a double, b double")
    fitted = features.fit(rows, "event", ["a", "b"])
    assert fitted.columns == ["a_scaled", "b_scaled", "b_missing"]
    assert fitted.numbers["a"][0] == pytest.approx(np.median(np.log1p([i * i % 37 for i in range(90)])))
    assert features.fit(rows, "event", ["a", "b"], indicators=["a"]).columns == ["a_scaled", "a_missing", "b_scaled"]


@pytest.mark.parametrize("n", [5, 20, 24, 60])
def test_signed_rank_p_of_many_pairs(spark, n):
    rng = random.Random(n)
    d = [round(rng.uniform(-1, 1.4), 1 if n == 20 else 6) or 0.5 for _ in range(n)]
    sizes = sorted(abs(x) for x in d)
    rank = {x: np.mean([i + 1 for i, y in enumerate(sizes) if y == x]) for x in sizes}
    ranks = [round(2 * rank[abs(x)]) for x in d]
    ways = {0: 1}
    for r in ranks:
        new = dict(ways)
        for s, c in ways.items():
            new[s + r] = new.get(s + r, 0) + c
        ways = new
    plus = sum(round(2 * rank[abs(x)]) for x in d if x > 0)
    w = min(plus, sum(ranks) - plus)
    want = sum(c for s, c in ways.items() if min(s, sum(ranks) - s) <= w) / 2**n
    got = diagnostics.signed_rank_p(spark.createDataFrame([(x, 0.0) for x in d], "a double, b double"), "a", "b").first()
    assert (got.n_pairs, got.w) == (n, w / 2) and got.p == pytest.approx(want)


def test_signed_rank_p_beyond_the_bound(spark):
    from statistics import NormalDist

    d = [(-1) ** (i % 3 == 0) * (i + 1.0) for i in range(150)]
    ranks = range(1, 151)
    w = min(sum(r for r, x in zip(ranks, d, strict=True) if x > 0), sum(r for r, x in zip(ranks, d, strict=True) if x < 0))
    want = 2 * NormalDist().cdf((w - sum(ranks) / 2) / (sum(r * r for r in ranks) / 4) ** 0.5)
    got = diagnostics.signed_rank_p(spark.createDataFrame([(x, 0.0) for x in d], "a double, b double"), "a", "b").first()
    assert got.w == w and got.p == pytest.approx(want, rel=1e-9)
    row = spark.range(1).select(*(diagnostics.normal_cdf(F.lit(float(z))).alias(str(i)) for i, z in enumerate((0, -1, -3.5, -6)))).first()
    assert list(row) == pytest.approx([NormalDist().cdf(z) for z in (0, -1, -3.5, -6)], rel=1e-7)
