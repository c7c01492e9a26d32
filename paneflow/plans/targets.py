"""Queries over sources, targets, masks and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneflow.functions.expressions import rounded
from paneflow.operators import folds, targets
from paneflow.plans.base import query
from paneflow.sources import panel


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")
    return rows.where(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).drop("l_shipdate")


@query("SELECT * FROM region")
def scan_fallback(spark, sf_dir):
    return panel.scan_fallback(spark, sf_dir, "region_v2", "region")


@query("SELECT event, entity, ts FROM (SELECT DISTINCT event, entity, ts FROM cells) WHERE entity IN (SELECT entity FROM (SELECT DISTINCT entity FROM cells) ORDER BY ((entity % 1000003) * 48355 + 332598) % 1000003, entity LIMIT 100)", "cells")
def entity_sample(spark, sf_dir):
    rows = panel.cells(spark, sf_dir).select("event", "entity", "ts").distinct()
    return panel.entity_sample(rows, "entity", 100, seed=42)


@query("SELECT event_id, ts, user_id, event_type FROM events")
def clean_drop(spark, sf_dir):
    return panel.clean(panel.scan(spark, sf_dir, "events"), ("props", "value", "not_there"), "ts")


@query("SELECT entity, event, ts, analyte, value, detected::INT AS detected FROM cells", "cells")
def load_cells(spark, sf_dir):
    return panel.cells(spark, sf_dir).withColumn("detected", F.col("detected").cast("int"))


@query("SELECT event, analyte, guarded FROM flagged", "flagged")
def guarded_value(spark, sf_dir):
    return targets.flagged_cells(panel.cells(spark, sf_dir)).select("event", "analyte", "guarded")


@query("SELECT analyte, count(*) AS n, sum(y)::BIGINT AS over, sum(naive)::BIGINT AS naive FROM flagged GROUP BY analyte", "flagged")
def threshold_flag(spark, sf_dir):
    return targets.flagged_cells(panel.cells(spark, sf_dir)).groupBy("analyte").agg(F.count("*").alias("n"), F.sum("y").alias("over"), F.sum("naive").alias("naive"))


@query("SELECT event, round(hazard_index, 6) AS hazard_index FROM targets", "targets")
def hazard_index(spark, sf_dir):
    return targets.event_targets(panel.cells(spark, sf_dir)).select("event", rounded(F.col("hazard_index")).alias("hazard_index"))


@query("SELECT entity, event, t1a, t1a_naive, t1b, t1c FROM targets", "targets")
def target_bundle(spark, sf_dir):
    return targets.event_targets(panel.cells(spark, sf_dir)).select("entity", "event", "t1a", "t1a_naive", "t1b", "t1c")


@query("SELECT 't1a' AS target, count(*) AS n, sum(t1a)::BIGINT AS positives, round(avg(t1a), 6) AS prevalence FROM targets UNION ALL SELECT 't1a_naive', count(*), sum(t1a_naive)::BIGINT, round(avg(t1a_naive), 6) FROM targets UNION ALL SELECT 't1b', count(*), sum(t1b)::BIGINT, round(avg(t1b), 6) FROM targets UNION ALL SELECT 't1c', count(*), sum(t1c)::BIGINT, round(avg(t1c), 6) FROM targets", "targets")
def target_prevalence(spark, sf_dir):
    rows = targets.event_targets(panel.cells(spark, sf_dir))
    long = rows.unpivot("event", ["t1a", "t1a_naive", "t1b", "t1c"], "target", "y")
    return long.groupBy("target").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), rounded(F.avg("y")).alias("prevalence"))


@query("SELECT analyte, count(*) AS measured, round(count(*) / (SELECT count(*) FROM orders), 6) AS measured_share, round(avg(y), 6) AS prevalence, round(avg(naive), 6) AS naive_prevalence, round(avg(hq), 6) AS mean_hazard FROM flagged GROUP BY analyte", "flagged")
def label_prevalence(spark, sf_dir):
    total = panel.events(spark, sf_dir).agg(F.count("*")).scalar()
    rows = targets.flagged_cells(panel.cells(spark, sf_dir)).groupBy("analyte").agg(F.count("*").alias("measured"), F.avg("y").alias("p"), F.avg("naive").alias("q"), F.avg("hq").alias("h"))
    share = rounded(F.col("measured") / total)
    return rows.select("analyte", "measured", share.alias("measured_share"), rounded(F.col("p")).alias("prevalence"), rounded(F.col("q")).alias("naive_prevalence"), rounded(F.col("h")).alias("mean_hazard"))


@query("SELECT o_orderkey AS event, a.analyte, coalesce(f.y, 0) AS y, (f.y IS NOT NULL)::INT AS measured FROM orders CROSS JOIN thr a LEFT JOIN flagged f ON f.event = o_orderkey AND f.analyte = a.analyte", "flagged")
def masked_targets(spark, sf_dir):
    rows = targets.masked_targets(panel.cells(spark, sf_dir), panel.events(spark, sf_dir))
    return rows.withColumn("measured", F.col("measured").cast("int"))


@query("SELECT o_orderkey AS event, sum((f.y IS NOT NULL)::INT)::BIGINT AS measured, sum(coalesce(f.y, 0))::BIGINT AS labels FROM orders LEFT JOIN flagged f ON f.event = o_orderkey GROUP BY ALL", "flagged")
def labels_per_row(spark, sf_dir):
    rows = targets.masked_targets(panel.cells(spark, sf_dir), panel.events(spark, sf_dir))
    return rows.groupBy("event").agg(F.sum(F.col("measured").cast("int")).alias("measured"), F.sum("y").alias("labels"))


@query('SELECT event, max(CASE WHEN analyte = \'AF\' THEN guarded END) AS "AF", max(CASE WHEN analyte = \'AO\' THEN guarded END) AS "AO", max(CASE WHEN analyte = \'NF\' THEN guarded END) AS "NF", max(CASE WHEN analyte = \'NO\' THEN guarded END) AS "NO", max(CASE WHEN analyte = \'RF\' THEN guarded END) AS "RF", max(CASE WHEN analyte = \'RO\' THEN guarded END) AS "RO" FROM flagged GROUP BY event', "flagged")
def long_wide(spark, sf_dir):
    return targets.wide(panel.cells(spark, sf_dir))


@query("SELECT analyte, value FROM flagged WHERE analyte IN ('AF', 'NO')", "flagged")
def wide_long(spark, sf_dir):
    wide = targets.wide(panel.cells(spark, sf_dir), "value")
    return wide.unpivot("event", ["AF", "NO"], "analyte", "value").where("value is not null").select("analyte", "value")


_FRAMEWORKS = [("AF", 40.0, 30.0, 50.0), ("AO", None, 25.0, None), ("NF", 60.0, None, None), ("RO", None, None, None)]


@query("SELECT analyte, coalesce(epa, 20) AS epa, coalesce(nl, 20) AS nl, coalesce(rl, 20) AS rl, coalesce(least(epa, nl, rl), 20) AS strictest FROM (VALUES ('AF', 40::DOUBLE, 30::DOUBLE, 50::DOUBLE), ('AO', NULL, 25, NULL), ('NF', 60, NULL, NULL), ('RO', NULL, NULL, NULL)) t(analyte, epa, nl, rl)")
def threshold_framework(spark, sf_dir):
    return targets.framework_thresholds(spark.createDataFrame(_FRAMEWORKS, "analyte string, epa double, nl double, rl double"))


@query("SELECT f.analyte, t.name AS framework, count(*) AS n, round(avg((guarded > t.thr)::INT), 6) AS prevalence FROM flagged f JOIN (VALUES ('AF', 'epa', 40), ('AF', 'nl', 30), ('AF', 'rl', 50), ('AO', 'epa', 20), ('AO', 'nl', 25), ('AO', 'rl', 20), ('NF', 'epa', 60), ('NF', 'nl', 20), ('NF', 'rl', 20), ('RO', 'epa', 20), ('RO', 'nl', 20), ('RO', 'rl', 20)) t(analyte, name, thr) ON f.analyte = t.analyte GROUP BY ALL HAVING avg((guarded > t.thr)::INT) >= 0.05", "flagged")
def framework_summary(spark, sf_dir):
    limits = targets.framework_thresholds(spark.createDataFrame(_FRAMEWORKS, "analyte string, epa double, nl double, rl double")).drop("strictest")
    limits = limits.unpivot("analyte", ["epa", "nl", "rl"], "framework", "limit")
    rows = targets.flagged_cells(panel.cells(spark, sf_dir)).join(F.broadcast(limits), "analyte")
    found = rows.groupBy("analyte", "framework").agg(F.count("*").alias("n"), F.avg((F.col("guarded") > F.col("limit")).cast("int")).alias("p"))
    return found.where("p >= 0.05").select("analyte", "framework", "n", rounded(F.col("p")).alias("prevalence"))


@query("SELECT event, entity FROM targets WHERE entity IN (SELECT entity FROM ents WHERE segment = 'BUILDING')", "targets", "ents")
def isin_filter(spark, sf_dir):
    keys = panel.entities(spark, sf_dir).where("segment = 'BUILDING'").select("entity")
    return targets.event_targets(panel.cells(spark, sf_dir)).join(keys, "entity", "left_semi").select("event", "entity")


@query("SELECT t.event, e.nation, e.score, f.fold FROM targets t JOIN ents e USING (entity) JOIN folds f USING (entity)", "scored")
def broadcast_lookup(spark, sf_dir):
    return scored(spark, sf_dir).select("event", "nation", F.col("p").alias("score"), "fold")


@query("SELECT entity, n AS n_events FROM ents LEFT JOIN (SELECT entity, n FROM folds) USING (entity)", "folds", "ents")
def align_left(spark, sf_dir):
    rows = folds.group_folds(targets.event_targets(panel.cells(spark, sf_dir)))
    return panel.entities(spark, sf_dir).select("entity").join(rows.select("entity", F.col("n").alias("n_events")), "entity", "left")


@query("SELECT 'train' AS part, fold, count(*) AS n FROM (SELECT t.fold AS own, f.fold FROM scored t CROSS JOIN (SELECT unnest(range(8))::INT AS fold) f) WHERE own <> fold GROUP BY ALL UNION ALL SELECT 'test', fold, count(*) FROM scored GROUP BY ALL", "scored")
def boolean_split(spark, sf_dir):
    rows = targets.event_targets(panel.cells(spark, sf_dir))
    every = folds.fold_rows(rows.select("entity", "event"), folds.group_folds(rows))
    return every.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("part"), "fold").agg(F.count("*").alias("n"))


@query("SELECT entity, n, fold FROM folds", "folds")
def group_kfold(spark, sf_dir):
    return folds.group_folds(targets.event_targets(panel.cells(spark, sf_dir)))


@query("SELECT fold, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS prevalence FROM scored GROUP BY fold", "scored")
def block_prevalence(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), rounded(F.avg("y")).alias("prevalence"))


@query("SELECT entity, count(DISTINCT fold) AS folds FROM scored GROUP BY entity HAVING count(DISTINCT fold) > 1", "scored")
def nunique_guard(spark, sf_dir):
    return folds.straddlers(scored(spark, sf_dir), "entity")


@query("SELECT event, y, ((row_number() OVER (PARTITION BY y, salt ORDER BY ((event % 1000003) * 48281 + 39595) % 1000003, event) - 1 + salt) % 5)::INT AS fold FROM (SELECT event, t1a AS y, (((event % 1000003) * 48277 + 23757) % 1000003) % 64 AS salt FROM targets)", "targets")
def row_kfold(spark, sf_dir):
    rows = targets.event_targets(panel.cells(spark, sf_dir)).select("event", F.col("t1a").alias("y"))
    return folds.row_folds(rows, "event", "y")


@query("SELECT entity, nation AS block, (row_number() OVER (PARTITION BY nation ORDER BY ((entity % 1000003) * 48293 + 87109) % 1000003, entity) <= round(0.18::DOUBLE * count(*) OVER (PARTITION BY nation)))::INT AS held FROM ents", "ents")
def micro_block_holdout(spark, sf_dir):
    rows = folds.holdout(panel.entities(spark, sf_dir).select("entity", F.col("nation").alias("block")), "block", "entity")
    return rows.withColumn("held", F.col("held").cast("int"))


@query("SELECT block, n FROM (SELECT region AS block, count(*) AS n FROM ents GROUP BY region) ORDER BY round(abs(n - 0.18::DOUBLE * (SELECT count(*) FROM ents)), 6), block LIMIT 1", "ents")
def block_val_split(spark, sf_dir):
    return folds.closest_block(panel.entities(spark, sf_dir).withColumn("block", F.col("region")), "block")


def _lloyd_sql(rounds: int = 3) -> str:
    """The rounds of k-means as relations: centres c0 ... and assignments a0 ..."""
    parts = ["c0 AS (SELECT i AS block, 34.0::DOUBLE + 2 * (i // 2) AS a, (-122.0)::DOUBLE + 5 * (i % 2) AS b FROM (SELECT unnest(range(8))::INT AS i))"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT entity, lat, lon, block FROM (SELECT e.entity, e.lat, e.lon, c.block, row_number() OVER (PARTITION BY e.entity ORDER BY pow(lat - c.a, 2) + pow(lon - c.b, 2), c.block) AS place FROM ents e CROSS JOIN c{r} c) WHERE place = 1)")
        parts.append(f"c{r + 1} AS (SELECT c.block, coalesce(round(avg(lat), 6), any_value(c.a)) AS a, coalesce(round(avg(lon), 6), any_value(c.b)) AS b FROM c{r} c LEFT JOIN a{r} USING (block) GROUP BY c.block)")
    return f", {', '.join(parts)} SELECT entity, lat, lon, block FROM a{rounds}"


@query(_lloyd_sql(), "ents")
def spatial_blocks(spark, sf_dir):
    seeds = [(34.0 + 2.0 * (i // 2), -122.0 + 5.0 * (i % 2)) for i in range(8)]
    return folds.lloyd_blocks(panel.entities(spark, sf_dir).select("entity", "lat", "lon"), seeds)


@query("SELECT count(*) AS n, sum((x IN (-999, -9999, -99, 9999, -1))::INT)::BIGINT AS sentinels, sum(isnan(x)::INT)::BIGINT AS nans, sum((NOT isnan(x))::INT)::BIGINT AS known FROM (SELECT CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 THEN -999 ELSE l_quantity END AS x FROM lineitem)")
def nan_policy(spark, sf_dir):
    """NaN and sentinels, planted here, as they stand before the scan's rule makes NaN null."""
    from paneflow.functions.expressions import null_if_nan

    number = F.col("l_linenumber")
    x = F.when(number == 7, F.lit(float("nan"))).when(number == 6, F.lit(-999.0)).otherwise(F.col("l_quantity").cast("double"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(x.alias("x"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("x").isin(-999.0, -9999.0, -99.0, 9999.0, -1.0)).alias("sentinels"), F.count_if(F.isnan("x")).alias("nans"), F.count(null_if_nan(F.col("x"))).alias("known"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, entity, y, p, fold, segment, nation: events with their entity's score and fold."""
    rows = targets.event_targets(panel.cells(spark, sf_dir))
    held = folds.group_folds(rows).select("entity", "fold")
    known = panel.entities(spark, sf_dir).select("entity", F.col("score").alias("p"), "segment", "nation")
    return rows.select("event", "entity", F.col("t1a").alias("y")).join(known, "entity").join(held, "entity").select("event", "entity", "y", "p", "fold", "segment", "nation")


