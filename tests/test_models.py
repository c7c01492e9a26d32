"""Fitted operators against small independent computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneflow.operators import evaluate, models, trees, tuning

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for i in range(360):
        a, b, c = rng.random(), rng.random(), rng.random()
        y = int(rng.random() < 1 / (1 + math.exp(-6 * (a - b) + 2 * (c > 0.7) - 0.5)))
        z = int(rng.random() < 0.15 + 0.5 * y) if i % 3 else None
        out.append((i, i % 3, a, b, c, y, z))
    return spark.createDataFrame(out, "event long, fold int, a double, b double, c double, y int, z int").repartition(4).cache()


@pytest.fixture(scope="module")
def model(rows):
    return models._fitted(models._assembled(rows.where("fold <> 0"), COLUMNS), "y", "boosted", None, {"maxIter": 5, "maxDepth": 3})


def walked(tree, x):
    while not isinstance(tree, float):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def flipped(rows, fold, column="y"):
    return rows.withColumn(column, F.when(F.col("fold") == fold, 1 - F.col(column)).otherwise(F.col(column)))


def of_fold(df, fold, key="event"):
    return {r[key]: r.p for r in df.where(F.col("fold") == fold).collect()}


def test_parsed_trees_are_the_model(rows, model):
    grown = trees.boosted_trees(model)
    scored = models._with_scores(model, models._assembled(rows, COLUMNS), "p").select(*COLUMNS, "p", trees.staged(COLUMNS, grown).alias("m")).collect()
    for r in scored:
        margin = sum(walked(t, r[:3]) for t in grown)
        assert r.m[-1] == pytest.approx(margin) and r.p == pytest.approx(1 / (1 + math.exp(-2 * margin)))
        assert len(r.m) == 5 and r.m[0] == pytest.approx(walked(grown[0], r[:3]))


def test_boosting_curves(rows, model):
    grown = trees.boosted_trees(model)
    got = {(r.fold, r.part, r.round): r for r in trees.boosting_curves(rows, COLUMNS, "y", {0: grown, 1: 0.25}).collect()}
    assert set(got) == {(0, p, i) for p in ("train", "held") for i in range(1, 6)} | {(1, p, 1) for p in ("train", "held")}
    own = rows.collect()
    for part, keep in (("held", lambda r: r.fold == 0), ("train", lambda r: r.fold != 0)):
        last = [(1 / (1 + math.exp(-2 * sum(walked(t, (r.a, r.b, r.c)) for t in grown))), r.y) for r in own if keep(r)]
        assert got[0, part, 5].log_loss == pytest.approx(-np.mean([math.log(p if y else 1 - p) for p, y in last]))
        wins = [1 if p > q else 0.5 if p == q else 0 for (p, y), (q, z) in itertools.product(last, last) if y and not z]
        assert got[0, part, 5].auc == pytest.approx(np.mean(wins))
    losses = [got[0, "train", i].log_loss for i in range(1, 6)]
    assert losses == sorted(losses, reverse=True)
    assert got[1, "held", 1].auc == 0.5


def brute_shapley(x, tree_list, counts):
    """From the definition, over all subsets, with path-dependent expectations."""
    def worth(t, known, cover, at):
        if isinstance(t, float):
            return t, cover.get(next(at), 0)
        left, n = worth(t[2], known, cover, at)
        right, m = worth(t[3], known, cover, at)
        if t[0] in known:
            return (left if x[t[0]] <= t[1] else right), n + m
        return ((left * n + right * m) / (n + m) if n + m else 0.0), n + m

    value = lambda known: sum(worth(t, known, c, iter(range(99)))[0] for t, c in zip(tree_list, counts, strict=True))
    out = []
    for j in range(3):
        rest = [i for i in range(3) if i != j]
        out.append(sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, j}) - value(set(s))) for k in range(3) for s in itertools.combinations(rest, k)))
    return value(set()), out


def test_attributions_are_shapley_values(rows, model):
    grown = trees.boosted_trees(model)
    background = rows.where("fold <> 0")
    counts = trees.covers(background, COLUMNS, grown)
    assert all(sum(c.values()) == background.count() for c in counts)
    got = {r.event: r for r in trees.attributions(rows, "event", COLUMNS, grown, background).collect()}
    for r in rows.collect():
        x = (r.a, r.b, r.c)
        found = got[r.event]
        assert found.base + sum(found.contributions) == pytest.approx(sum(walked(t, x) for t in grown))
        if r.event % 9 == 0:
            base, want = brute_shapley(x, grown, counts)
            assert found.base == pytest.approx(base) and found.contributions == pytest.approx(want)


def test_parzen_beats_random_draws():
    space = {"x": (-5.0, 5.0), "y": (0.0, 10.0), "kind": ["a", "b", "c", "d"]}
    surface = lambda t: -((t["x"] - 1.3) ** 2) - 0.5 * (t["y"] - 7) ** 2 - (0 if t["kind"] == "c" else 3)
    best = lambda trials: max(v for _, v in trials)
    adaptive = [best(tuning.parzen_search(lambda ts: [surface(t) for t in ts], space, 40, seed=s)) for s in range(15)]
    drawn = []
    for s in range(15):
        rng = random.Random(s)
        drawn.append(max(surface(tuning._drawn(rng, space)) for _ in range(40)))
    assert np.mean(adaptive) > np.mean(drawn) and np.median(adaptive) > np.median(drawn)
    again = tuning.parzen_search(lambda ts: [surface(t) for t in ts], space, 12, seed=3)
    assert again == tuning.parzen_search(lambda ts: [surface(t) for t in ts], space, 12, seed=3) and len(again) == 12
    assert tuning.parzen_search(lambda ts: [math.nan] * len(ts), space, 7)[-1][1] == -math.inf


def test_trials_are_ranked_together(rows):
    given = [{"regParam": 0.0}, {"regParam": 5.0}]
    got = tuning.fold_auc(rows, COLUMNS, "y", [0, 1, 2], "lr")(given)
    for g, v in zip(given, got, strict=True):
        scored = models.out_of_fold(rows, COLUMNS, "y", [0, 1, 2], kind="lr", **g).select("fold", "y", "p")
        assert v == pytest.approx(evaluate.roc_auc(scored, "fold").agg(F.avg("auc")).first()[0])


def test_random_search_takes_the_best_draw(rows):
    space = {"regParam": [0.0, 0.1, 3.0]}
    given, mean = models.random_search(rows, COLUMNS, "y", [0, 1, 2], "lr", space, 3, seed=1)
    rng = random.Random(1)
    drawn = [rng.choice(space["regParam"]) for _ in range(3)]
    values = tuning.fold_auc(rows, COLUMNS, "y", [0, 1, 2], "lr")([{"regParam": v} for v in drawn])
    assert given["regParam"] == drawn[int(np.argmax(values))] and mean == pytest.approx(max(values))


def test_own_fold_is_never_used(rows):
    for make in (
        lambda df: models.binary_relevance(df, COLUMNS, ["y"], 3),
        lambda df: models.backbone(df, COLUMNS, "y", 3, ("lr", "forest")).withColumn("p", F.col("p_lr") + F.col("p_forest")),
        lambda df: models.nested(df, COLUMNS, "y", 3, "lr", {"regParam": [0.0, 0.1]}, 2),
    ):
        a, b = of_fold(make(rows), 1), of_fold(make(flipped(rows, 1)), 1)
        assert a == pytest.approx(b) and len(a) == 120


def test_binary_relevance_scores_measured_rows(rows):
    got = models.binary_relevance(rows, COLUMNS, ["y", "z"], 3)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"y": 360, "z": 240}


def test_nested_threshold_is_of_the_inner_folds(rows):
    got = models.nested(rows, COLUMNS, "y", 3, "lr", {"regParam": [0.0]}, 1).where("fold = 2").select("threshold").distinct().collect()
    train = rows.where("fold <> 2")
    fitted = models.out_of_fold(train, COLUMNS, "y", [0, 1], kind="lr", regParam=0.0).select("y", "p")
    assert [r.threshold for r in got] == [evaluate.threshold_search(fitted).first().t]


def test_ensemble_is_the_mean(spark):
    a, b = (spark.createDataFrame([(1, "y", 0, 1, p), (2, "y", 0, 0, q)], "event long, label string, fold int, y int, p double") for p, q in ((0.2, 0.5), (0.6, 0.1)))
    assert {r.event: r.p for r in models.ensemble([a, b]).collect()} == pytest.approx({1: 0.4, 2: 0.3})


def test_label_classes_and_order(spark):
    labels = [f"l{i}" for i in range(6)]
    rows = spark.createDataFrame([tuple(int(j % (i + 1) == 0) for i in range(6)) for j in range(60)], ", ".join(f"{c} int" for c in labels))
    assert models.chain_order(rows, labels[::-1]) == labels
    assert models.label_classes(rows, labels, 4) == [["l0", "l1"], ["l2", "l3"], ["l4", "l5"]]


def test_pseudo_labels_are_monotone_and_sure(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 4 == 0 else int(rng.random() < i / 300), i / 300) for i in range(300)]
    got = models.pseudo_labels(spark.createDataFrame(rows, "event long, y int, p double"), "y").orderBy("p").collect()
    calibrated = [r.calibrated for r in got]
    assert all(b >= a - 1e-12 for a, b in zip(calibrated, calibrated[1:]))
    for r in got:
        want = None if r.y is not None else 1 if r.calibrated >= 0.85 else 0 if r.calibrated <= 0.15 else None
        assert r.pseudo == want
    assert {r.pseudo for r in got} == {None, 0, 1}


def test_refit_learns_from_sure_rows(rows):
    got = models.refitted(rows, COLUMNS, "z", 0.4, 0.6).collect()
    assert len(got) == 360 and all(0 <= r.p <= 1 for r in got)
    alone = {r.event: r.p for r in models.fit_predict(rows.where("z is not null"), rows, COLUMNS, "z").collect()}
    assert any(abs(alone[r.event] - r.p) > 1e-6 for r in got)


def test_platt_keeps_ranks_and_crosses_folds(rows):
    scored = models.out_of_fold(rows, COLUMNS, "y", 3).select("event", "fold", "y", "p")
    got = models.platt(scored, 3).collect()
    for f in range(3):
        own = sorted((r.p, r.p_cal) for r in got if r.fold == f)
        assert all(b[1] >= a[1] - 1e-12 for a, b in zip(own, own[1:]))
    again = {r.event: r.p_cal for r in models.platt(flipped(scored, 0), 3).collect() if r.fold == 0}
    assert again == pytest.approx({r.event: r.p_cal for r in got if r.fold == 0})


def test_stacking_uses_scores_and_meta_features(rows):
    base = models.backbone(rows, COLUMNS, "y", 3, ("lr", "forest"))
    got = models.stacked(base, 3, ("lr", "forest"))
    r = got.first()
    mean = (r.p_lr + r.p_forest) / 2
    assert (r["mean"], r.spread, r.gap_lr_forest) == pytest.approx((mean, abs(r.p_lr - mean), abs(r.p_lr - r.p_forest)))
    assert got.count() == 360 and evaluate.roc_auc(got.select("y", "p")).first().auc > 0.75


def test_stacking_computes_the_scores_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda p: seen.add(1) or p, "double")
    base = models.backbone(rows, COLUMNS, "y", 3, ("lr", "forest")).withColumn("p_lr", counted("p_lr"))
    assert models.stacked(base, 3, ("lr", "forest")).count() == 360
    assert seen.value <= 2 * 360


def test_logistic_scores_are_the_models(rows):
    fitted = models._model(models._assembled(rows, COLUMNS), "y", "lr", {})
    both = models._with_scores(fitted, models._assembled(rows, COLUMNS), "want").withColumn("got", models._logistic(fitted, COLUMNS))
    assert all(r.got == pytest.approx(r.want, abs=1e-12) for r in both.collect())
    plan = models.out_of_fold(rows, COLUMNS, "y", 3).select("event", "p")._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan  # a row computes its own fold's expression
    with pytest.raises(Exception, match="a feature is missing"):
        rows.withColumn("a", F.lit(None).cast("double")).select(models._logistic(fitted, COLUMNS)).collect()


def test_components_of_training_rows_alone(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5)) * [5, 2, 1, 0.1, 0.05]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.pc for r in models.train_components(rows.where("vec_id < 60"), rows, "embedding", 0.9).collect()}
    values, vectors = np.linalg.eigh(np.cov(x[:60].T))
    share = np.cumsum(values[::-1]) / values.sum()
    k = int(np.argmax(share >= 0.9)) + 1
    assert {len(p) for p in got.values()} == {k}
    want = np.abs(x @ vectors[:, ::-1][:, :k])
    assert np.allclose(np.abs([got[i] for i in range(80)]), want)
    other = rows.withColumn("embedding", F.when(F.col("vec_id") >= 60, F.transform("embedding", lambda v: v * 9)).otherwise(F.col("embedding")))
    again = {r.vec_id: r.pc for r in models.train_components(other.where("vec_id < 60"), other, "embedding", 0.9).collect()}
    assert all(np.allclose(again[i], got[i]) for i in range(60))


def test_components_keep_the_share(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i % 7), 0.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert {len(r.pc) for r in models.components(rows, "embedding", 2).collect()} == {2}


def test_thresholds_of_other_folds(spark):
    rng = random.Random(6)
    rows = [(i % 4, "ab"[i % 2], rng.random(), int(rng.random() < 0.4)) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, label string, p double, y int")
    got = {(r.label, r.fold): r.t for r in evaluate.crossed_thresholds(df, "fold", "label").collect()}
    for label, fold in itertools.product("ab", range(4)):
        other = df.where((F.col("label") == label) & (F.col("fold") != fold))
        want = evaluate.threshold_search(other).first()
        assert got.get((label, fold)) == (want.t if df.where((F.col("label") == label) & (F.col("fold") == fold)).count() else None)
