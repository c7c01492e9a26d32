"""Queries over neighbour graphs and spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.functions.expressions import rounded
from paneflow.operators import graph, targets
from paneflow.plans.base import query
from paneflow.sources import panel

K, CAP = 8, 40.0


def _points(spark, sf_dir):
    return panel.entities(spark, sf_dir)


def _edges(spark, sf_dir):
    return graph.undirected(graph.knn(_points(spark, sf_dir), K, CAP))


def _blocks(spark, sf_dir):
    return _points(spark, sf_dir).select("entity", F.col("region").alias("block"))


def _km(rows):
    return rows.withColumn("dist_km", rounded(F.col("dist_km")))


@query("SELECT src, count(*) AS n, round(sum(round(dist_km, 6)), 6) AS total_km FROM pairs WHERE dist_km <= 40 GROUP BY src", "pairs")
def range_join(spark, sf_dir):
    return graph.near_totals(_points(spark, sf_dir), CAP)


@query("SELECT src, dst, round(dist_km, 6) AS dist_km, place::INT AS place FROM near", "near")
def knn_topk(spark, sf_dir):
    return _km(graph.knn(_points(spark, sf_dir), K, CAP))


@query("SELECT src, dst, round(dist_km, 6) AS dist_km FROM edges", "edges")
def knn_edges(spark, sf_dir):
    return _km(_edges(spark, sf_dir))


@query("SELECT src, dst, round(dist_km, 6) AS dist_km FROM (SELECT p.*, row_number() OVER (PARTITION BY src ORDER BY round(dist_km, 6), dst) AS place FROM pairs_far p JOIN ents a ON a.entity = src JOIN ents b ON b.entity = dst AND a.nation = b.nation WHERE dist_km <= 200) WHERE place <= 8", "pairs_far", "ents")
def knn_intra_group(spark, sf_dir):
    return _km(graph.knn(_points(spark, sf_dir), K, 200.0, same="nation").drop("place"))


@query("SELECT src, dst, round(dist_km, 6) AS dist_km FROM edges JOIN blocks a ON a.entity = src JOIN blocks b ON b.entity = dst AND a.block = b.block", "edges", "blocks")
def cut_cross_block(spark, sf_dir):
    return _km(graph.cut(_edges(spark, sf_dir), _blocks(spark, sf_dir)))


@query("SELECT count(*) AS undirected, sum((a.block <> b.block)::INT)::BIGINT AS removed, 2 * sum((a.block <> b.block)::INT)::BIGINT AS crossing FROM edges JOIN blocks a ON a.entity = src JOIN blocks b ON b.entity = dst", "edges", "blocks")
def cut_audit(spark, sf_dir):
    rows = graph.with_ends(_edges(spark, sf_dir), _blocks(spark, sf_dir), "block")
    crosses = (F.col("block_src") != F.col("block_dst")).cast("int")
    return rows.agg(F.count("*").alias("undirected"), F.sum(crosses).alias("removed"), (2 * F.sum(crosses)).alias("crossing"))


@query("SELECT src, dst, round(dist_km, 6) AS dist_km FROM twoway", "twoway")
def symmetrise(spark, sf_dir):
    return _km(graph.symmetrised(_edges(spark, sf_dir)))


@query("SELECT src, dst, round(exp(-pow(dist_km / 40, 2)), 6) AS weight FROM edges", "edges")
def edge_weight(spark, sf_dir):
    return graph.weighted(_edges(spark, sf_dir), CAP).select("src", "dst", rounded(F.col("weight")).alias("weight"))


@query("SELECT src, dst, a.block AS block_src, b.block AS block_dst FROM edges JOIN blocks a ON a.entity = src JOIN blocks b ON b.entity = dst", "edges", "blocks")
def edge_endpoint_join(spark, sf_dir):
    return graph.with_ends(_edges(spark, sf_dir), _blocks(spark, sf_dir), "block").drop("dist_km")


@query("SELECT src, dst FROM edges WHERE src IN (SELECT entity FROM blocks WHERE block <> 0) AND dst IN (SELECT entity FROM blocks WHERE block <> 0)", "edges", "blocks")
def train_edge_filter(spark, sf_dir):
    rows = graph.with_ends(_edges(spark, sf_dir), _blocks(spark, sf_dir), "block")
    return rows.where("block_src <> 0 and block_dst <> 0").select("src", "dst")


@query("SELECT 'near' AS relation, src, dst FROM edges JOIN blocks a ON a.entity = src JOIN blocks b ON b.entity = dst AND a.block = b.block UNION ALL SELECT 'same_nation', src, dst FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY src ORDER BY round(dist_km, 6), dst) AS place FROM pairs_far p JOIN ents a ON a.entity = src JOIN ents b ON b.entity = dst AND a.nation = b.nation WHERE dist_km <= 200) WHERE place <= 8 GROUP BY ALL)", "edges", "blocks", "pairs_far", "ents")
def build_multirel_graph(spark, sf_dir):
    near = graph.cut(_edges(spark, sf_dir), _blocks(spark, sf_dir))
    same = graph.cut(graph.undirected(graph.knn(_points(spark, sf_dir), K, 200.0, same="nation")), _blocks(spark, sf_dir))
    return near.withColumn("relation", F.lit("near")).unionByName(same.withColumn("relation", F.lit("same_nation"))).select("relation", "src", "dst")


_AUDIT = "SELECT '{r}' AS relation, (SELECT count(*) FROM ents) AS nodes, count(*) AS undirected, coalesce(sum((a.block <> b.block)::INT), 0)::BIGINT AS removed, coalesce(sum((a.block = b.block)::INT), 0)::BIGINT AS kept, 0::BIGINT AS crossing FROM ({e}) JOIN blocks a ON a.entity = src JOIN blocks b ON b.entity = dst"
_SAME = "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM (SELECT p.src, p.dst, row_number() OVER (PARTITION BY src ORDER BY round(dist_km, 6), dst) AS place FROM pairs_far p JOIN ents a ON a.entity = src JOIN ents b ON b.entity = dst AND a.nation = b.nation WHERE dist_km <= 200) WHERE place <= 8"


@query(_AUDIT.format(r="near", e="SELECT src, dst FROM edges") + " UNION ALL " + _AUDIT.format(r="same_group", e=_SAME), "edges", "pairs_far", "blocks")
def build_well_graph(spark, sf_dir):
    points, blocks = _points(spark, sf_dir), _blocks(spark, sf_dir)
    _, near = graph.build(points, blocks, "near", K, CAP)
    _, same = graph.build(points, blocks, "same_group", K, 200.0, "nation")
    return near.unionByName(same)


@query("SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY ((((src * 31 + dst) % 1000003) * 48305 + 134623) % 1000003), src) AS r FROM twoway) WHERE r <= 3", "twoway")
def fanout_cap(spark, sf_dir):
    return graph.fanout(graph.symmetrised(_edges(spark, sf_dir)), 3).select("src", "dst")


@query("SELECT src, dst FROM edges WHERE ((((src * 31 + dst) % 1000003) * 48309 + 150461) % 1000003) >= 200000", "edges")
def drop_edge(spark, sf_dir):
    return graph.drop_edges(_edges(spark, sf_dir)).select("src", "dst")


@query("SELECT entity, coalesce(n, 0) AS n, round(m, 12) AS mean FROM ents LEFT JOIN (SELECT dst AS entity, count(*) AS n, avg(score) AS m FROM twoway JOIN ents e ON e.entity = src GROUP BY 1) USING (entity)", "twoway", "ents")
def mean_aggregate(spark, sf_dir):
    rows = graph.neighbour_mean(graph.symmetrised(_edges(spark, sf_dir)), _points(spark, sf_dir), "score")
    return rows.withColumn("mean", rounded(F.col("mean"), 12))


@query(", w AS (SELECT src, dst, exp(-pow(dist_km / 40, 2)) AS weight FROM twoway UNION ALL SELECT entity, entity, 1.0::DOUBLE FROM ents), d AS (SELECT dst AS entity, sum(weight) AS d FROM w GROUP BY 1) SELECT w.dst AS entity, round(sum(weight * score / sqrt(a.d * b.d)), 6) AS out FROM w JOIN d a ON a.entity = w.dst JOIN d b ON b.entity = w.src JOIN ents e ON e.entity = w.src GROUP BY 1", "twoway", "ents")
def gcn_norm_aggregate(spark, sf_dir):
    edges = graph.weighted(graph.symmetrised(_edges(spark, sf_dir)), CAP)
    return graph.normalised_sum(edges, _points(spark, sf_dir), "score").withColumn("out", rounded(F.col("out")))


@query(", z AS (SELECT entity, score - (SELECT avg(score) FROM ents) AS z FROM ents) SELECT (SELECT count(*) FROM z) AS n, count(*) AS w, round((SELECT count(*) FROM z) * sum(a.z * b.z) / (count(*) * (SELECT sum(z * z) FROM z)), 6) AS morans_i FROM twoway JOIN z a ON a.entity = src JOIN z b ON b.entity = dst", "twoway", "ents")
def morans_i(spark, sf_dir):
    rows = graph.morans_i(graph.symmetrised(_edges(spark, sf_dir)), _points(spark, sf_dir), "score")
    return rows.withColumn("morans_i", rounded(F.col("morans_i")))


@query("SELECT band, count(*) AS n, round(avg((a.region = b.region)::INT), 6) AS same FROM (SELECT *, CASE WHEN dist_km <= 5 THEN 5::DOUBLE WHEN dist_km <= 20 THEN 20 WHEN dist_km <= 40 THEN 40 END AS band FROM pairs WHERE dist_km <= 40 AND src < dst) JOIN ents a ON a.entity = src JOIN ents b ON b.entity = dst GROUP BY band HAVING count(*) > 50", "pairs", "ents")
def concordance_by_distance(spark, sf_dir):
    found = graph.near_concordance(_points(spark, sf_dir), "region", (5.0, 20.0, CAP))
    return found.withColumn("same", rounded(F.col("same")))


@query("SELECT d, count(*) AS n, sum((a.block <> b.block)::INT)::BIGINT AS other FROM near JOIN blocks a ON a.entity = src JOIN blocks b ON b.entity = dst JOIN (VALUES (2::DOUBLE), (5), (10), (20)) t(d) ON dist_km < d WHERE place = 1 GROUP BY d", "near", "blocks")
def interblock_contamination(spark, sf_dir):
    nearest = graph.knn(_points(spark, sf_dir), 1, CAP)
    return graph.contamination(nearest, _blocks(spark, sf_dir), (2.0, 5.0, 10.0, 20.0))


@query("SELECT entity, analyte, count(*) AS n, (2 * sum(y) >= count(*))::INT AS y FROM flagged GROUP BY ALL", "flagged")
def build_bipartite(spark, sf_dir):
    return graph.bipartite(targets.flagged_cells(panel.cells(spark, sf_dir)))


@query("SELECT analyte, sum(1 - y)::BIGINT AS neg, sum(y)::BIGINT AS pos, round(coalesce(sum(1 - y) / nullif(sum(y), 0), 1), 6) AS pos_weight FROM (SELECT entity, analyte, (2 * sum(y) >= count(*))::INT AS y FROM flagged GROUP BY ALL) GROUP BY analyte", "flagged")
def pos_weight(spark, sf_dir):
    rows = graph.bipartite(targets.flagged_cells(panel.cells(spark, sf_dir))).groupBy("analyte").agg(F.sum(1 - F.col("y")).alias("neg"), F.sum("y").alias("pos"))
    return rows.withColumn("pos_weight", rounded(F.coalesce(F.try_divide(F.col("neg").cast("double"), F.col("pos").cast("double")), F.lit(1.0))))


@query("SELECT analyte, part, count(*) AS n FROM (SELECT b.analyte, CASE WHEN e.region = 0 THEN 'test' WHEN ((((b.entity % 1000003) * 48317 + 182137) % 1000003) < 150000) THEN 'val' ELSE 'train' END AS part FROM (SELECT DISTINCT entity, analyte FROM cells) b JOIN ents e USING (entity)) GROUP BY ALL", "cells", "ents")
def bipartite_split(spark, sf_dir):
    from paneflow.operators import folds

    rows = panel.cells(spark, sf_dir).select("entity", "analyte").distinct().join(_blocks(spark, sf_dir), "entity")
    held = folds.hashed_holdout(rows, "entity", 0.15, 23)
    part = F.when(F.col("block") == 0, "test").when(F.col("held"), "val").otherwise("train")
    return held.groupBy("analyte", part.alias("part")).agg(F.count("*").alias("n"))
