"""Queries over converged blocks, neighbours without a cap, message passing and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.functions.expressions import bucket_hash, rounded
from paneflow.operators import blocks, encoder, evaluate, graph, models, targets
from paneflow.operators.tables import settled
from paneflow.plans.base import query
from paneflow.plans.graphs import CAP, K
from paneflow.sources import panel

_KM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
OWN = ["score", "price", "events"]
SEEDS = [(33.0 + 2.5 * (i // 2), -122.0 + 5.0 * (i % 2)) for i in range(6)]


def _points(spark, sf_dir):
    return panel.entities(spark, sf_dir).select("entity", "lat", "lon")


@query(f"SELECT src, dst, round(dist_km, 6) AS dist_km, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist_km, 6), dst) AS place FROM (SELECT a.entity AS src, b.entity AS dst, {_KM} AS dist_km FROM ents a JOIN ents b ON a.entity <> b.entity)) WHERE place <= 5", "ents")
def knn_uncapped(spark, sf_dir):
    return graph.knn(_points(spark, sf_dir), 5).withColumn("dist_km", rounded(F.col("dist_km")))


@query("SELECT block, count(*) AS n, round(avg(lat), 6) AS a, round(avg(lon), 6) AS b, round(sum(d), 4) AS inertia FROM (SELECT e.entity, e.lat, e.lon, c.i AS block, pow(e.lat - c.a, 2) + pow(e.lon - c.b, 2) AS d, row_number() OVER (PARTITION BY e.entity ORDER BY pow(e.lat - c.a, 2) + pow(e.lon - c.b, 2), c.i) AS place FROM ents e CROSS JOIN (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(SEEDS)) + ") c(i, a, b)) WHERE place = 1 GROUP BY block", "ents")
def lloyd_step(spark, sf_dir):
    """One refinement step from given centres: what each holds, its mean, and its inertia."""
    met = blocks._met(_points(spark, sf_dir).withColumn("grp", F.lit("")), {"": [SEEDS]})
    return met.groupBy(F.col("i").alias("block")).agg(F.count("*").alias("n"), rounded(F.avg("lat")).alias("a"), rounded(F.avg("lon")).alias("b"), rounded(F.sum("d"), 4).alias("inertia"))


@query()
def spatial_blocks_kmeans(spark, sf_dir):
    """Eight converged blocks, the best of ten restarts."""
    found, _ = blocks.clusters(_points(spark, sf_dir), 8)
    return found


@query()
def micro_blocks(spark, sf_dir):
    """Six micro-blocks inside each region, with a share of each held out."""
    return blocks.micro_holdout(panel.entities(spark, sf_dir).select("entity", "lat", "lon", "region"), "region")


def _nodes(spark, sf_dir):
    """entity, block, score, price, events, y: the entities, the majority of their events as label; null without events."""
    prices = panel.events(spark, sf_dir).groupBy("entity").agg(F.log1p(F.avg("price")).alias("price"), F.count("*").cast("double").alias("events"))
    labels = targets.majority(targets.event_targets(panel.cells(spark, sf_dir)).select("entity", F.col("t1a").alias("y")), "entity", "y").select("entity", "y")
    rows = panel.entities(spark, sf_dir).select("entity", F.col("region").alias("block"), "score")
    return rows.join(prices, "entity", "left").join(labels, "entity", "left")


def _relations(spark, sf_dir):
    points, own = panel.entities(spark, sf_dir), panel.entities(spark, sf_dir).select("entity", F.col("region").alias("block"))
    near, _ = graph.build(points, own, "near", K, CAP)
    same, _ = graph.build(points, own, "same_group", K, 200.0, "nation")
    return near.select(F.lit("near").alias("relation"), "src", "dst", F.exp(-F.pow(F.col("dist_km") / CAP, 2)).alias("weight")).unionByName(same.select(F.lit("same").alias("relation"), "src", "dst", F.lit(1.0).alias("weight")))


@query(", w AS (SELECT src, dst, exp(-pow(dist_km / 40, 2)) AS weight FROM twoway JOIN blocks a ON a.entity = src JOIN blocks b ON b.entity = dst AND a.block = b.block), h1 AS (SELECT dst AS entity, sum(weight * score) / sum(weight) AS h1, ln(1 + count(*)) AS degree FROM w JOIN ents e ON e.entity = src GROUP BY 1), h2 AS (SELECT dst AS entity, sum(weight * h1) / sum(weight) AS h2 FROM w JOIN h1 ON h1.entity = src GROUP BY 1) SELECT entity, round(h1, 6) AS near_1_score, round(coalesce(degree, 0), 6) AS near_degree, round(h2, 6) AS near_2_score FROM ents LEFT JOIN h1 USING (entity) LEFT JOIN h2 USING (entity)", "twoway", "blocks", "ents")
def propagated_features(spark, sf_dir):
    """Two hops of a feature over the near relation, with the edges between blocks cut."""
    edges = _relations(spark, sf_dir).where("relation = 'near'")
    found, _ = encoder.propagated(edges, panel.entities(spark, sf_dir).select("entity", "score"), ["score"])
    return found.select("entity", *(rounded(F.col(c)).alias(c) for c in ("near_1_score", "near_degree", "near_2_score")))


def _trainable(spark, sf_dir):
    """(nodes with their propagated features and held ones, the features' names)."""
    found, names = encoder.propagated(_relations(spark, sf_dir), _nodes(spark, sf_dir), OWN)
    held = blocks.micro_holdout(panel.entities(spark, sf_dir).select("entity", "lat", "lon", "region"), "region").select("entity", "held")
    return found.join(held, "entity"), names


@query()
def message_passing(spark, sf_dir):
    """Every entity scored by the encoder of the other regions, stopped early by their micro-blocks."""
    scores, _ = encoder.train(*_trainable(spark, sf_dir))
    return scores


@query()
def gating(spark, sf_dir):
    """Own features and those of neighbours, mixed by a gate per entity."""
    nodes, names = _trainable(spark, sf_dir)
    scores, _ = encoder.gated(nodes, OWN, [n for n in names if n not in OWN])
    return scores


@query()
def nested_hybrid(spark, sf_dir):
    """Entities of each outer region scored by a logistic regression on features and on embeddings that saw neither region."""
    nodes, names = _trainable(spark, sf_dir)
    made, _ = encoder.hybrid_features(nodes, names, hidden=4, rounds=30)
    rows = made.join(nodes.select("entity", *OWN).fillna(0.0), "entity").select("outer", "entity", "block", "y", *OWN, F.col("p").alias("encoded"), *(F.col("embedding")[i].alias(f"e{i}") for i in range(4)))
    return models.by_outer(settled(rows), [*OWN, "encoded", *(f"e{i}" for i in range(4))])


def _cells(spark, sf_dir):
    """entity, analyte, y, part: the measured cells of entities, some held out by hash."""
    cells = graph.bipartite(targets.flagged_cells(panel.cells(spark, sf_dir))).select("entity", "analyte", "y")
    turn = bucket_hash(F.col("entity") * 7 + F.ascii("analyte") * 31 + F.ascii(F.substring("analyte", 2, 1)), 29)
    return cells.withColumn("part", F.when(turn < 150_000, "test").when(turn < 300_000, "val").otherwise("train"))


@query()
def bipartite_completion(spark, sf_dir):
    """The held-out cells of entities and analytes with their completed scores."""
    found, _ = encoder.completed(_cells(spark, sf_dir))
    return found.where("part = 'test'").select("entity", "analyte", "y", "p")


@query()
def completion_auc(spark, sf_dir):
    """Cells held out, positives and AUC of the completion, per analyte and over all."""
    found, _ = encoder.completed(_cells(spark, sf_dir))
    rows = found.where("part = 'test'").select(F.explode(F.array(F.col("analyte"), F.lit("all"))).alias("analyte"), F.col("y").cast("int").alias("y"), "p")
    return evaluate.roc_auc(rows, "analyte")
