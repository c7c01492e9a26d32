import math

import pytest
from pyspark.sql import functions as F

from paneflow.functions.expressions import null_if_nan
from paneflow.operators import evaluate, features, folds, graph, targets
from paneflow.sources import panel, sinks
from paneflow.streaming import events

CELLS = "entity long, event long, ts timestamp, analyte string, value double, detected boolean"


def test_censored_cells(spark):
    rows = spark.createDataFrame([(1, 1, None, "AF", 90.0, False), (1, 2, None, "AF", 90.0, True), (1, 3, None, "AF", None, True), (1, 3, None, "RO", 20.0, True)], CELLS)
    got = {(r.event, r.analyte): (r.guarded, r.y) for r in targets.flagged_cells(rows).collect()}
    assert got == {(1, "AF"): (0.0, 0), (2, "AF"): (90.0, 1), (3, "AF"): (0.0, 0), (3, "RO"): (20.0, 0)}


def test_hazard_index_of_one_is_positive(spark):
    rows = spark.createDataFrame([(1, 1, None, "AO", 60.0, True), (1, 1, None, "NF", 60.0, True)], CELLS)
    r = targets.event_targets(rows).first()
    assert (r.hazard_index, r.t1a, r.t1b, r.t1c) == (1.0, 1, 1, 1)


def test_majority_tie_and_nan(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "entity int, y int")
    assert {r.entity: r.y for r in targets.majority(rows, "entity", "y").collect()} == {1: 1, 2: 0}
    values = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double").select(null_if_nan(F.col("x")).alias("x"))
    assert sorted(values.collect(), key=str) == [(1.0,), (None,), (None,)]


def test_auc_ties_one_class_and_closed_bin(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("b", 1, 0.9), ("b", 1, 1.0), ("c", 1, 0.9), ("c", 0, 0.1), ("c", 0, None)], "g string, y int, p double")
    assert {r.g: r.auc for r in evaluate.roc_auc(rows, "g").collect()} == {"a": 0.5, "b": None, "c": 1.0}
    assert {r.bin: r.n for r in evaluate.reliability(rows.where("g = 'b'")).collect()} == {9: 2}
    assert {r.g: r.ap for r in evaluate.average_precision(rows, "g").collect()} == {"a": 0.5, "b": 1.0, "c": 1.0}


def test_signed_rank(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (3.0, 0.0), (5.0, 5.0)], "a double, b double")
    assert tuple(evaluate.signed_rank(rows, "a", "b").first()) == (3, 1.5)


def test_folds_keep_entities_whole_and_even(spark):
    rows = spark.range(4000).select((F.col("id") % 900).alias("entity"), F.col("id").alias("event"))
    held = folds.group_folds(rows)
    every = rows.join(held.select("entity", "fold"), "entity")
    assert folds.straddlers(every, "entity").count() == 0
    n = [r["count"] for r in every.groupBy("fold").count().collect()]
    assert len(n) == 8 and max(n) < 1.3 * min(n)


def test_training_statistics_ignore_test_rows(spark):
    rows = spark.createDataFrame([(i, i % 4, "ab"[i % 2], i % 3 == 0, float(i)) for i in range(80)], "event long, fold int, c string, b boolean, x double").withColumn("y", F.col("b").cast("int"))
    changed = rows.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y"))).withColumn("x", F.when(F.col("fold") == 1, 1e6).otherwise(F.col("x")))

    def stats(df):
        codes = features.target_codes(df, "c", "y", 4).where("fold = 1").orderBy("category").collect()
        return codes, features.scale_stats(df, "x", 4).where("fold = 1").collect(), features.frequency_codes(df, "c", 4).where("fold = 1").orderBy("category").collect()

    assert stats(rows) == stats(changed)


def test_leak_guard():
    features.leak_guard(["a", "b"], {"c"})
    with pytest.raises(ValueError, match="b"):
        features.leak_guard(["a", "b"], {"b"})


def test_neighbours_equal_all_pairs(spark, sf_dir):
    points = panel.entities(spark, sf_dir).select("entity", "lat", "lon")
    rows = points.collect()

    def km(a, b):
        h = math.sin(math.radians(b.lat - a.lat) / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))

    want = {(a.entity, b.entity) for a in rows for b in rows if a.entity != b.entity and km(a, b) <= 60}
    assert {(r.src, r.dst) for r in graph.near_pairs(points, 60.0).collect()} == want


def test_points_at_one_place_are_neighbours(spark):
    points = spark.createDataFrame([(1, 35.0, -120.0), (2, 35.0, -120.0), (3, 39.0, -120.0)], "entity long, lat double, lon double")
    assert sorted((r.src, r.dst, r.dist_km) for r in graph.knn(points, 2, 1.5).collect()) == [(1, 2, 0.0), (2, 1, 0.0)]


def test_crossing_edges_are_twice_the_removed(spark, sf_dir):
    points = panel.entities(spark, sf_dir)
    blocks = points.select("entity", F.col("region").alias("block"))
    edges = graph.undirected(graph.knn(points, 8, 120.0))
    ends = graph.with_ends(graph.symmetrised(edges), blocks, "block")
    assert ends.where("block_src <> block_dst").count() == 2 * (edges.count() - graph.cut(edges, blocks).count())


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("auc", 0.51234567)], "metric string, value double")
    for kind in ("json", "csv", "parquet"):
        sinks.write_metrics(rows, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.json(f"file://{tmp_path}/json").count() == 1
    assert sinks.markdown(rows).splitlines()[-1] == "| auc | 0.5123 |"
    for f in (0, 1, 1):
        sinks.checkpoint_fold(rows, f"file://{tmp_path}/folds", f)
    assert spark.read.parquet(f"file://{tmp_path}/folds").groupBy("fold").count().count() == 2


def test_stream_counts_equal_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    batch.orderBy("ts").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = events.windowed_counts(events.read_events(spark, f"file://{tmp_path}/in", "ts timestamp, event_type string, value double"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {(r.start, r.event_type): r.n for r in batch.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_bootstrap_interval(spark):
    import numpy as np
    from paneflow.operators import evaluate

    docs = spark.createDataFrame([(i // 2, (i * 7919 % 101) / 101, int(i * 7919 % 101 + i % 60 > 80)) for i in range(200)], "entity long, p double, y int")
    auc = [r.auc for r in evaluate.bootstrap_auc(docs, "entity", 300).collect()]
    got = evaluate.bootstrap_interval(docs, "entity").first()
    assert got.replicates == 300 and got.low < got.high
    assert np.allclose([got.low, got.high], np.percentile(auc, [2.5, 97.5]))
