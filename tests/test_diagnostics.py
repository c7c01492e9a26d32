import itertools
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paneflow.operators import diagnostics, features, folds, graph, models, quantiles
from paneflow.sources import sinks


def test_student_p_by_table(spark):
    # fixed values: two-sided 5 % points of Student's t
    points = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 7: 2.365, 10: 2.228}
    row = spark.range(1).select(*(diagnostics.student_p(F.lit(t), df).alias(str(df)) for df, t in points.items())).first()
    assert all(abs(row[str(df)] - 0.05) < 2e-4 for df in points)


def test_signed_rank_p_by_enumeration(spark):
    d = [0.3, -0.1, 0.25, 0.4, 0.1, -0.05, 0.0]
    some = sorted(abs(x) for x in d if x)
    rank = {x: statistics.mean(i + 1 for i, y in enumerate(some) if y == x) for x in some}
    ranks = [rank[abs(x)] for x in d if x]
    plus = sum(rank[abs(x)] for x in d if x > 0)
    w = min(plus, sum(ranks) - plus)
    drawn = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
    want = statistics.mean(min(x, sum(ranks) - x) <= w for x in drawn)
    row = diagnostics.signed_rank_p(spark.createDataFrame([(x, 0.0) for x in d], "a double, b double"), "a", "b").first()
    assert (row.n_pairs, row.w) == (6, w) and abs(row.p - want) < 1e-12
    assert diagnostics.signed_rank_p(spark.createDataFrame([(1.0, 0.0)] * 3, "a double, b double"), "a", "b").first().p is None


def test_group_codes_tie_at_six_digits(spark):
    # per group and fold (rows, positives): unrounded, the codes of a and b in fold 0 differ by some 1e-9
    counts = {"a": ((3, 1), (1000, 333)), "b": ((2, 0), (2000, 666)), "c": ((4, 2), (3, 1))}
    rows = [(g, f, int(i < s)) for g, x in counts.items() for f, (n, s) in enumerate(x) for i in range(n)]
    got = {(r.g, r.f): r.p for r in diagnostics.group_codes(spark.createDataFrame(rows, "g string, f int, y int"), "g", "y", "f").distinct().collect()}
    for g, x in counts.items():
        for f in (0, 1):
            n, s = x[1 - f]
            mean = sum(c[1 - f][1] for c in counts.values()) / sum(c[1 - f][0] for c in counts.values())
            assert got[g, f] == round((s + 20 * mean) / (n + 20), 6)
    assert got["a", 0] == got["b", 0]


def test_pseudo_replicates_equal_sql_on_more_rows(spark):
    """On this table ties of rounded codes move the AUC."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("customer", "orders", "lineitem", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["pseudo_replicate_leak"]).fetchall()
    assert [tuple(r) for r in entry.queries()["pseudo_replicate_leak"](spark, folder).collect()] == want


def test_quantiles_of_skewed_groups(spark):
    rng = random.Random(1)
    rows = [("a", float(rng.randrange(2000)) ** 2 / 7) for _ in range(3000)] + [("b", 1.0)] * 500 + [("b", 2.0)] * 501 + [("c", 5.0)] + [("d", float(x)) for x in (1, 2, 3, 10)]
    counts = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    got = {r.g: (r.low, r.mid) for r in quantiles.quantiles(counts, ["g"], {"low": 0.1, "mid": 0.5}).collect()}
    for g in "abcd":
        x = sorted(v for k, v in rows if k == g)
        for q, value in zip((0.1, 0.5), got[g], strict=True):
            at = (len(x) - 1) * q
            i = int(at)
            want = x[i] + (x[min(i + 1, len(x) - 1)] - x[i]) * (at - i)
            assert abs(value - want) < 1e-6 * max(1, abs(want))


def test_neighbours_meet_across_the_meridian_and_near_the_poles(spark):
    points = spark.createDataFrame([(1, 10.0, 179.9), (2, 10.0, -179.9), (3, 80.0, 0.0), (4, 80.0, 1.5), (5, -80.0, 1.5)], "entity long, lat double, lon double")
    assert sorted((r.src, r.dst) for r in graph.near_pairs(points, 40.0).collect()) == [(1, 2), (2, 1), (3, 4), (4, 3)]
    with pytest.raises(ValueError):
        graph.near_pairs(points.selectExpr("entity", "lat + 9 as lat", "lon"), 40.0)
    with pytest.raises(ValueError):
        graph.build(points, points.selectExpr("entity", "0 as block"), "far", 8, 40.0)


def test_holdout_takes_a_share_of_each_block(spark):
    rows = spark.range(1000).select(F.col("id").alias("entity"), F.when(F.col("id") < 50, 0).otherwise(1).alias("block"))
    held = {r.block: r.n for r in folds.holdout(rows, "block", "entity").groupBy("block").agg(F.sum(F.col("held").cast("int")).alias("n")).collect()}
    assert held == {0: 9, 1: 171}


def test_fit_uses_training_rows_alone_and_freezes_columns(spark):
    train = spark.createDataFrame([(1, 3.0, "a", 1), (2, None, "b", 0), (3, 7.0, "a", 0)], "k int, x double, c string, y int")
    other = spark.createDataFrame([(9, None, "zzz", 1), (8, 1000.0, None, 1)], "k int, x double, c string, y int")
    fitted = features.fit(train, "k", ["x"], ["c"], ["c"], "y")
    got = {r.k: r for r in fitted.transform(other).collect()}
    assert fitted.columns == ["x_scaled", "x_missing", "c=a", "c=b", "c_code"]
    assert got[9]["c=a"] == got[9]["c=b"] == 0 and got[9]["x_missing"] == 1 and abs(got[9]["c_code"] - 1 / 3) < 1e-9 and got[8]["x_scaled"] > 3
    assert fitted.transform(train).columns == fitted.transform(other).columns == ["k", *fitted.columns]
    with pytest.raises(ValueError):
        features.fit(train, "k", ["x"], blocked={"x"})


def test_permuted_keeps_the_values(spark):
    rows = spark.range(500).select(F.col("id").alias("event"), (F.col("id") * 2).alias("x"), F.lit(1).alias("y"))
    got = features.permuted(rows, "x", "event").collect()
    assert sorted(r.x for r in got) == [2 * i for i in range(500)] and sum(r.x == 2 * r.event for r in got) < 30


def test_models_of_other_folds_alone(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        x, noise = rng.gauss(0, 1), rng.gauss(0, 1)
        a = int(x > 0)
        rows.append((i, i % 4, x, noise, a if i % 10 else None, int(a == 1 and noise > 0)))
    df = spark.createDataFrame(rows, "event long, fold int, x double, z double, a int, b int").cache()
    chained = models.chain(df, ["x", "z"], ["a", "b"], 4)
    by_label = {r.label: r.n for r in chained.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert by_label == {"a": 360, "b": 400}
    hits = chained.select(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int").alias("h"), "label").groupBy("label").agg(F.avg("h").alias("h")).collect()
    assert all(r.h > 0.85 for r in hits)
    # a label that only its own fold could tell is not learned
    own = df.withColumn("y", F.when(F.col("fold") == 0, 1).otherwise(0)).where("fold = 0 or fold = 1")
    assert {r.p for r in models.out_of_fold(own, ["x"], "y", [0, 1]).where("fold = 0").collect()} == {0.0}
    forest = models.out_of_fold(df, ["x", "z"], "b", 4, kind="forest")
    assert forest.where((F.col("p") >= 0.5).cast("int") == F.col("b")).count() > 360
    assert forest.columns == [*df.columns, "p"]


def test_yaml_and_long_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a: \"b\"\n", 1.5), (None, None)], "name string, value double")
    sinks.write_yaml(rows.coalesce(1), f"file://{tmp_path}/y")
    text = "".join(p.read_text() for p in sorted(tmp_path.glob("y/part-*")))
    assert text == '- name: "a: \\"b\\"\\n"\n  value: 1.5\n- name: null\n  value: null\n'
    assert "there are more" in sinks.markdown(spark.range(300)) and "there are more" not in sinks.markdown(rows)
