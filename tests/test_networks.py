"""Neighbours by widening searches, converged blocks, the encoder and the completion."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneflow.functions.expressions import bucket_hash
from paneflow.operators import blocks, encoder, evaluate, graph


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def plain_knn(points, k, cap=None):
    out = set()
    for a in points:
        near = sorted((round(km(a, b), 6), b[0]) for b in points if b[0] != a[0] and (cap is None or km(a, b) <= cap) and (len(a) == 3 or a[3] == b[3]))
        out |= {(a[0], dst, i + 1) for i, (_, dst) in enumerate(near[:k])}
    return out


def triples(df):
    return {(r.src, r.dst, r.place) for r in df.collect()}


def scattered(rng, n):
    """A dense town, sparse land, a few at one place, some at the poles and the meridian."""
    town = [(i, 38 + rng.gauss(0, 0.002), -120 + rng.gauss(0, 0.002)) for i in range(n)]
    land = [(n + i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(n // 3)]
    same = [(2 * n + i, 10.0, 20.0) for i in range(12)]
    odd = [(3 * n + i, lat, lon) for i, (lat, lon) in enumerate([(89.9, 0), (89.9, 180), (-89.5, 10), (0, 179.999), (0, -179.999)])]
    return town + land + same + [(i, float(a), float(b)) for i, a, b in odd]


@pytest.mark.parametrize("cap", [None, 300.0])
def test_nearest_equals_all_pairs(spark, cap):
    points = scattered(random.Random(2), 90)
    df = spark.createDataFrame(points, "entity long, lat double, lon double")
    assert triples(graph.nearest(df, 4, cap, per_cell=4)) == plain_knn(points, 4, cap)


def test_nearest_of_groups_few_points_and_none(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(30, 31), rng.uniform(-10, -9), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame([*points, (99, 30.0, -10.0, None), (98, None, 1.0, "a")], "entity long, lat double, lon double, g string")
    assert triples(graph.nearest(df, 3, same="g", per_cell=2)) == plain_knn(points, 3)
    assert triples(graph.nearest(df.where("entity < 2"), 3)) == plain_knn([p[:3] for p in points[:2]], 3)
    assert graph.nearest(df.limit(0), 3).count() == 0


def test_a_dense_cell_takes_the_widening_search(spark, monkeypatch):
    rng = random.Random(4)
    points = [(i, 40 + rng.uniform(0, 0.01), 5 + rng.uniform(0, 0.01)) for i in range(500)]
    df = spark.createDataFrame(points, "entity long, lat double, lon double")
    monkeypatch.setattr(graph, "near_pairs", None)
    assert triples(graph.knn(df, 5, 40.0)) == plain_knn(points, 5, 40.0)


def test_nearest_forms_few_pairs(spark):
    """Pairs met over 20,000 points in one cell stay near k times n."""
    df = spark.range(20_000).select(F.col("id").alias("entity"), (40 + F.rand(1) / 10).alias("lat"), (5 + F.rand(2) / 10).alias("lon"))
    seen = []
    within = graph._within
    try:
        graph._within = lambda *args: seen.append(within(*args)) or seen[-1]
        assert graph.nearest(df, 8).count() == 8 * 20_000
    finally:
        graph._within = within
    assert sum(pairs.count() for pairs in seen) < 25 * 8 * 20_000


def towns_with_copies(rng):
    """Points of 40 places, many at one place, over the meridian too; some without a value, an id or a position."""
    places = [(rng.uniform(10, 10.8), rng.uniform(179.6, 180.4)) for _ in range(40)]
    out = [(i, a, b if b < 180 else b - 360, rng.choice(["x", "y", None])) for i, (a, b) in enumerate(rng.choice(places) for _ in range(260))]
    return [*out, (900, None, 1.0, "x"), (None, 10.2, 179.9, "y"), (901, -40.0, 3.0, "x")]


def plain_sums(points, cap, bands):
    pairs = [(a, b, round(km(a, b), 6)) for a in points for b in points if None not in (a[0], a[1], b[0], b[1]) and a[0] != b[0] and km(a, b) <= cap]
    totals, found = {}, {}
    for a, _, d in pairs:
        n, total = totals.get(a[0], (0, 0))
        totals[a[0]] = n + 1, total + d
    for a, b, d in pairs:
        if a[0] < b[0]:
            n, known, same = found.get(band := min(t for t in bands if d <= t), (0, 0, 0))
            found[band] = n + 1, known + (None not in (a[3], b[3])), same + (a[3] is not None and a[3] == b[3])
    return {k: (n, round(t, 6)) for k, (n, t) in totals.items()}, {k: (n, same / known) for k, (n, known, same) in found.items() if n > 50}


def alike(df, want):
    got = {k: rest for k, *rest in df.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("share", [2_000, 3])
def test_sums_over_near_places_equal_all_pairs(spark, monkeypatch, share):
    points = towns_with_copies(random.Random(5))
    df = spark.createDataFrame(points, "entity long, lat double, lon double, g string")
    totals, bands = plain_sums(points, 40.0, (5.0, 20.0, 40.0))
    monkeypatch.setattr(graph, "SHARE", share)
    seen, pairs = [], graph._place_pairs
    monkeypatch.setattr(graph, "_place_pairs", lambda *a, **b: seen.append(pairs(*a, **b)) or seen[-1])
    monkeypatch.setattr(graph, "near_pairs", None)
    alike(graph.near_totals(df, 40.0), totals)
    alike(graph.near_concordance(df, "g", (5.0, 20.0, 40.0)), bands)
    assert len(bands) == 3
    assert seen[0].count() <= 41 * 41  # places meet, not points


def test_sums_of_ids_that_repeat_go_by_rows(spark):
    points = [(1, 10.0, 20.0, "x"), (1, 10.1, 20.0, "y"), (2, 10.0, 20.0, "x"), (3, 10.05, 20.0, "y")]
    df = spark.createDataFrame(points, "entity long, lat double, lon double, g string")
    totals, _ = plain_sums(points, 40.0, (40.0,))
    alike(graph.near_totals(df, 40.0), totals)
    assert graph.near_concordance(df, "g", (40.0,), 0).first().n == 9  # as the join of pairs with both ends: ends of id 1 stand twice
    assert graph.near_totals(df.limit(0), 40.0).count() == graph.near_concordance(df.limit(0), "g", (40.0,)).count() == 0


def four_towns(spark, n=400, extra=""):
    rng = random.Random(7)
    rows = [(i, 10.0 * (i % 2) + rng.gauss(0, 0.3), 20.0 * (i // 2 % 2) + rng.gauss(0, 0.3), i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "entity long, lat double, lon double, town int")


def test_clusters_converge_and_the_best_restart_wins(spark):
    found, log = blocks.clusters(four_towns(spark).select("entity", "lat", "lon"), 4, restarts=5)
    towns = {r.entity: r.block for r in found.collect()}
    assert len({(e % 4, b) for e, b in towns.items()}) == 4  # a block is a town
    for s in range(5):
        falls = [r["inertia"] for r in log if r["start"] == s]
        assert all(b <= a + 1e-9 for a, b in zip(falls, falls[1:]))
    last = {s: [r["inertia"] for r in log if r["start"] == s][-1] for s in range(5)}
    rows = {r.entity: r for r in found.collect()}
    centre = {b: np.mean([(r.lat, r.lon) for r in rows.values() if r.block == b], axis=0) for b in range(4)}
    inertia = sum(((r.lat, r.lon) - centre[r.block]) @ ((r.lat, r.lon) - centre[r.block]) for r in rows.values())
    assert inertia == pytest.approx(min(last.values()), rel=1e-3)


def test_clusters_of_groups_few_places_and_none(spark):
    rows = [(1, 0.0, 0.0, "x"), (2, 0.0, 0.0, "x"), (3, 5.0, 5.0, "x"), (4, 1.0, 1.0, "y"), (5, None, 1.0, "y"), (6, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "entity long, lat double, lon double, g string")
    found, _ = blocks.clusters(df, 3, "g", restarts=2)
    got = {r.entity: (r.g, r.block) for r in found.collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[2] != got[3]
    empty, log = blocks.clusters(df.limit(0).select("entity", "lat", "lon"), 3)
    assert empty.count() == 0 and log == []


def test_points_of_one_split_are_dealt_to_all_cores(spark, monkeypatch):
    seen, settled = [], blocks.settled
    monkeypatch.setattr(blocks, "settled", lambda df: seen.append(df.rdd.getNumPartitions()) or settled(df))
    found, _ = blocks.clusters(four_towns(spark).drop("town").coalesce(1), 4, restarts=2)
    assert found.count() == 400 and seen == [spark.sparkContext.defaultParallelism]


def test_sums_and_draws_equal_one_by_one(spark):
    df = four_towns(spark, 90).select("entity", "lat", "lon", F.col("town").cast("string").alias("grp"))
    held = {"0": [[(0.0, 0.0), (0.1, 0.1)], [(3.0, 3.0)]], "3": [[(10.0, 20.0), (10.0, 20.0)], [(9.0, 21.0), (11.0, 19.0)]]}
    want, costs, drawn = {}, {}, set()
    rows = df.withColumns({f"u{s}": bucket_hash(F.col("entity") * 131 + s, 9) / F.lit(float(blocks.SIZE)) for s in (0, 1)}).collect()
    near = {(r.entity, s): min(((r.lat - a) ** 2 + (r.lon - b) ** 2, i) for i, (a, b) in enumerate(c)) for r in rows for s, c in enumerate(held.get(r.grp, []))}
    for r in rows:
        for s in range(len(held.get(r.grp, []))):
            d, i = near[r.entity, s]
            old = want.get((r.grp, s, i), (0, 0, 0, 0))
            want[r.grp, s, i] = tuple(x + y for x, y in zip(old, (1, r.lat, r.lon, d), strict=True))
            costs[r.grp, s] = costs.get((r.grp, s), 0) + d
    drawn = {(r.grp, s, r.entity) for r in rows for s in range(len(held.get(r.grp, []))) if r[f"u{s}"] * costs[r.grp, s] < 16 * near[r.entity, s][0]}
    got = {(r.grp, r.start, r.i): (r.n, r.lat, r.lon, r.d) for r in blocks._sums(df, held).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {(r.grp, r.start, r.entity) for r in blocks._drawn(df, held, costs, 16, 9).collect()} == drawn and 0 < len(drawn) < 90
    assert {(r.entity, r.start): r.i for r in blocks._met(df, held).collect()} == {k: i for k, (_, i) in near.items()}


def test_micro_blocks_hold_out_a_share_of_each(spark):
    found = blocks.micro_holdout(four_towns(spark, 800), "town", 6, 0.18, restarts=2)
    sizes = found.groupBy("town", "micro").agg(F.count("*").alias("n"), F.sum(F.col("held").cast("int")).alias("held")).collect()
    assert len(sizes) == 24 and sum(r.n for r in sizes) == 800
    assert all(r.held == min(r.n - 1, max(1, int(0.18 * r.n + 0.5))) for r in sizes if r.n > 1)


def ring(spark, n=240):
    """Nodes in two blocks whose label is what their neighbours' feature says; two edges cross."""
    rng = random.Random(1)
    x = [rng.gauss(0, 1) for _ in range(n)]
    edges = [(i, (i + d) % n) for i in range(n) for d in (1, 2)]
    nodes = [(i, i * 4 // n, x[i], int(sum(x[(i + d) % n] for d in (-2, -1, 1, 2)) > 0), i % 5 == 0) for i in range(n)]
    nodes = spark.createDataFrame(nodes, "entity long, block int, x double, y int, held boolean")
    both = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, dist_km double")
    kept = graph.symmetrised(graph.cut(both, nodes)).select(F.lit("ring").alias("relation"), "src", "dst", F.lit(1.0).alias("weight"))
    return nodes, kept


def test_encoder_learns_from_neighbours(spark):
    nodes, edges = ring(spark)
    found, names = encoder.propagated(edges, nodes, ["x"])
    assert names == ["x", "ring_1_x", "ring_degree", "ring_2_x"]
    scores, log = encoder.train(found, names, rounds=40)
    losses = [r["loss"] for r in log if r["model"] == 0]
    assert losses[-1] < 0.5 * losses[0]
    assert evaluate.roc_auc(scores).first().auc > 0.9
    assert scores.count() == 240


def test_cut_edges_carry_no_message(spark):
    nodes, edges = ring(spark)
    names = ["ring_1_x", "ring_2_x"]
    changed = nodes.withColumn("x", F.when(F.col("block") == 0, F.col("x") + 100).otherwise(F.col("x")))
    a, b = ({r.entity: r for r in encoder.propagated(edges, df, ["x"])[0].where("block <> 0").collect()} for df in (nodes, changed))
    assert all(a[e][c] == pytest.approx(b[e][c]) for e in a for c in names)


def test_a_block_does_not_teach_its_own_model(spark):
    nodes, edges = ring(spark)
    found, names = encoder.propagated(edges, nodes, ["x"])
    turned = found.withColumn("y", F.when(F.col("block") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = ({r.entity: r.p for r in encoder.train(df, names, rounds=8)[0].where("block = 1").collect()} for df in (found, turned))
    assert a == pytest.approx(b)


def test_hybrid_features_know_nothing_of_the_outer_block(spark):
    nodes, edges = ring(spark, 120)
    found, names = encoder.propagated(edges, nodes, ["x"])
    changed = nodes.withColumn("y", F.when(F.col("block") == 2, 1 - F.col("y")).otherwise(F.col("y"))).withColumn("x", F.when(F.col("block") == 2, F.col("x") * 9 - 5).otherwise(F.col("x")))
    again, _ = encoder.propagated(edges, changed, ["x"])

    def made(df):
        return {(r.entity, r.outer): (r.p, *r.embedding) for r in encoder.hybrid_features(df, names, rounds=4, hidden=3)[0].collect()}

    a, b = made(found), made(again)
    block = {r.entity: r.block for r in nodes.collect()}
    assert set(a) == {(e, t) for e in block for t in range(4)}
    assert all(a[e, t] == pytest.approx(b[e, t]) for e, t in a if t == 2 and block[e] != 2)
    # and a block's own labels are not in its features for any outer block
    own = made(found.withColumn("y", F.when(F.col("block") == 1, 1 - F.col("y")).otherwise(F.col("y"))))
    assert all(a[e, t] == pytest.approx(own[e, t]) for e, t in a if block[e] == 1)
    assert any(a[e, t] != pytest.approx(own[e, t]) for e, t in a if block[e] != 1 and t != 1)


def test_gate_between_two_groups(spark):
    nodes, edges = ring(spark)
    found, names = encoder.propagated(edges, nodes, ["x"])
    scores, log = encoder.gated(found, ["x"], names[1:], rounds=40)
    rows = scores.collect()
    assert len(rows) == 240 and all(0 < r.gate < 1 for r in rows)
    assert evaluate.roc_auc(scores).first().auc > 0.85
    assert len({round(r.gate, 3) for r in rows}) > 10


@pytest.mark.parametrize("net", [encoder.Network(3, 4), encoder.Gated(3, 1, 4)])
def test_gradient_equals_finite_differences(net):
    rng = np.random.default_rng(2)
    theta, x, y, weight = rng.normal(size=net.size), rng.normal(size=(9, 3)), rng.integers(0, 2, 9).astype(float), rng.uniform(0.5, 2, 9)
    grad, _ = net.gradient(theta, x, y, weight, 2.0)
    for i in range(net.size):
        step = np.zeros(net.size)
        step[i] = 1e-6
        want = (net.gradient(theta + step, x, y, weight, 2.0)[1] - net.gradient(theta - step, x, y, weight, 2.0)[1]) / 2e-6
        assert grad[i] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_encoder_without_labels_or_features(spark):
    nodes, edges = ring(spark, 40)
    none = nodes.withColumn("y", F.lit(None).cast("int")).withColumn("x", F.lit(None).cast("double"))
    found, names = encoder.propagated(edges, none, ["x"])
    scores, log = encoder.train(found, names, rounds=3)
    assert scores.count() == 40 and log == []
    empty, _ = encoder.train(found.limit(0), names, rounds=3)
    assert empty.count() == 0


def cells_of(spark, flip=False):
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(150, 2)), rng.normal(size=(8, 2))
    rows = []
    for e in range(150):
        for a in range(8):
            y = int(u[e] @ v[a] > 0)
            part = ["train", "train", "train", "train", "val", "test"][(e * 7 + a * 5 + e // 6) % 6]
            rows.append((e, f"a{a}", 1 - y if flip and part == "test" else y, part))
    return spark.createDataFrame([*rows, (999, "a0", 1, "test")], "entity long, analyte string, y int, part string")


def test_completion_finds_held_out_cells(spark):
    found, log = encoder.completed(cells_of(spark), rank=2, rounds=15)
    test = found.where("part = 'test'").withColumn("y", F.col("y").cast("int"))
    assert evaluate.roc_auc(test).first().auc > 0.85
    assert log[0]["val_loss"] > min(r["val_loss"] for r in log)
    rows = found.collect()
    assert {r.part for r in rows} == {"val", "test"} and all(0 <= r.p <= 1 for r in rows)
    assert any(r.entity == 999 for r in rows)


def test_masked_cells_change_nothing(spark):
    a, b = ({(r.entity, r.analyte): r.p for r in encoder.completed(cells_of(spark, flip))[0].collect()} for flip in (False, True))
    assert a == pytest.approx(b)


def test_completion_of_nothing(spark):
    cells = cells_of(spark)
    assert encoder.completed(cells.limit(0))[0].count() == 0
    found, _ = encoder.completed(cells.withColumn("part", F.lit("test")))
    assert {r.p for r in found.collect()} == {0.5}
