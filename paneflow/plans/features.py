"""Queries over fold-aware features."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.functions.expressions import rounded
from paneflow.operators import features
from paneflow.plans.base import query
from paneflow.plans.targets import scored
from paneflow.sources import panel

K = 8
_FOLDS = "(SELECT unnest(range(8))::INT AS fold) f"


@query("SELECT o_orderkey AS event, year(o_orderdate)::INT AS year, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos FROM orders")
def add_temporal(spark, sf_dir):
    rows = features.add_temporal(panel.events(spark, sf_dir))
    return rows.select("event", "year", rounded(F.col("month_sin")).alias("month_sin"), rounded(F.col("month_cos")).alias("month_cos"))


@query(f"SELECT fold, category, round(n / sum(n) OVER (PARTITION BY fold), 6) AS freq FROM (SELECT f.fold, segment AS category, count(*) AS n FROM scored s JOIN {_FOLDS} ON s.fold <> f.fold GROUP BY f.fold, segment)", "scored")
def frequency_encode(spark, sf_dir):
    return features.frequency_codes(scored(spark, sf_dir), "segment", K).withColumn("freq", rounded(F.col("freq")))


@query(f"SELECT fold, category, round((s + 20 * (sum(s) OVER w / sum(n) OVER w)) / (n + 20), 6) AS code FROM (SELECT f.fold, nation::VARCHAR AS category, count(*) AS n, sum(y) AS s FROM scored s JOIN {_FOLDS} ON s.fold <> f.fold GROUP BY ALL) WINDOW w AS (PARTITION BY fold)", "scored")
def target_encode(spark, sf_dir):
    return features.target_codes(scored(spark, sf_dir), "nation", "y", K).withColumn("code", rounded(F.col("code")))


@query(f", r AS (SELECT f.fold, s.event, s.nation, s.y, ((((s.event % 1000003) * 48297 + 102947) % 1000003) % 5)::INT AS i FROM scored s JOIN {_FOLDS} ON s.fold <> f.fold), n1 AS (SELECT a.fold, a.i, a.nation, t.n - a.n AS n, t.s - a.s AS s FROM (SELECT fold, i, nation, count(*) AS n, sum(y) AS s FROM r GROUP BY ALL) a JOIN (SELECT fold, nation, count(*) AS n, sum(y) AS s FROM r GROUP BY ALL) t USING (fold, nation)), g AS (SELECT fold, i, (ts - s) / (tn - n) AS mean FROM (SELECT fold, i, count(*) AS n, sum(y) AS s, sum(count(*)) OVER (PARTITION BY fold) AS tn, sum(sum(y)) OVER (PARTITION BY fold) AS ts FROM r GROUP BY fold, i)) SELECT r.fold, r.event, round(CASE WHEN n1.n > 0 THEN (n1.s + 20 * g.mean) / (n1.n + 20) ELSE g.mean END, 6) AS code FROM r JOIN n1 USING (fold, i, nation) JOIN g USING (fold, i)", "scored")
def target_encode_oof(spark, sf_dir):
    return features.target_codes_oof(scored(spark, sf_dir), "event", "nation", "y", K).withColumn("code", rounded(F.col("code")))


_PRICE = "(SELECT s.fold AS own, CASE WHEN l.n IS NULL THEN NULL ELSE ln(1 + o_totalprice) END AS x, s.event FROM scored s JOIN orders ON o_orderkey = s.event LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = s.event)"
_STATS = f"stats AS (SELECT fold, median, missing_share, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS sd FROM (SELECT f.fold, x FROM {_PRICE} p JOIN {_FOLDS} ON own <> f.fold) JOIN (SELECT f.fold, quantile_cont(x, 0.5) AS median, avg((x IS NULL)::INT) AS missing_share FROM {_PRICE} p JOIN {_FOLDS} ON own <> f.fold GROUP BY f.fold) USING (fold) GROUP BY ALL)"


def _priced(spark, sf_dir):
    """Scored events with the order price, unknown where no line was returned."""
    lines = panel.scan(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event")).distinct().withColumn("known", F.lit(True))
    rows = scored(spark, sf_dir).join(panel.events(spark, sf_dir).select("event", "price"), "event").join(lines, "event", "left")
    return rows.withColumn("price", F.when(F.col("known"), F.col("price")))


@query(f", {_STATS} SELECT fold, round(median, 6) AS median, round(missing_share, 6) AS missing_share, round(mean, 6) AS mean, round(sd, 6) AS sd, (missing_share > 0.2)::INT AS indicator FROM stats", "scored")
def impute_scale(spark, sf_dir):
    stats = features.scale_stats(_priced(spark, sf_dir), "price", K)
    return stats.select("fold", "indicator", *(rounded(F.col(c)).alias(c) for c in ("median", "missing_share", "mean", "sd")))


@query(f", {_STATS} SELECT event, round((coalesce(x, median) - mean) / sd, 6) AS scaled FROM {_PRICE} p CROSS JOIN (SELECT * FROM stats WHERE fold = 0)", "scored")
def standard_scaler(spark, sf_dir):
    rows = _priced(spark, sf_dir)
    return features.scaled(rows, features.scale_stats(rows, "price", K), "price", 0).select("event", rounded(F.col("scaled")).alias("scaled"))


@query("SELECT event, " + ", ".join(f"(segment = '{v}')::INT AS \"segment={v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM scored", "scored")
def onehot_train_levels(spark, sf_dir):
    rows = features.one_hot(scored(spark, sf_dir).select("event", "fold", "segment"), "segment", 0)
    return rows.drop("fold", "segment")


@query(f"SELECT f.fold, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS p FROM scored s JOIN {_FOLDS} ON s.fold <> f.fold GROUP BY f.fold", "scored")
def prevalence_baseline(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.col("fold").alias("own"), "y")
    train = rows.groupBy("own").agg(F.count("*").alias("n"), F.sum("y").alias("s")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(K - 1)))).where("fold <> own")
    return train.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("positives")).withColumn("p", rounded(F.col("positives") / F.col("n")))


_FAMILIES = {"amount": ["l_quantity", "l_extendedprice"], "rate": ["l_discount", "l_tax"], "place": ["l_linenumber"], "admin": ["l_returnflag", "l_linestatus", "l_shipdate"]}
_WITHOUT = {"full": set(), "no_admin": {"admin"}, "no_rate": {"rate"}, "amount_only": {"rate", "place", "admin"}}
_FAMILY = "CASE WHEN column_name IN ('l_quantity', 'l_extendedprice') THEN 'amount' WHEN column_name IN ('l_discount', 'l_tax') THEN 'rate' WHEN column_name = 'l_linenumber' THEN 'place' WHEN column_name IN ('l_returnflag', 'l_linestatus', 'l_shipdate') THEN 'admin' END"


def _families(spark, sf_dir):
    """The families, of those columns that the table has."""
    there = set(panel.scan(spark, sf_dir, "lineitem").columns)
    return {f: [c for c in columns if c in there] for f, columns in _FAMILIES.items()}


@query(f"SELECT column_name AS name FROM (SELECT column_name, {_FAMILY} AS family FROM (DESCRIBE lineitem)) WHERE family IN ('amount', 'rate', 'place') AND column_name <> 'l_tax'")
def feature_columns(spark, sf_dir):
    found = features.feature_columns(_families(spark, sf_dir), {"admin": False}, blocked={"l_tax"})
    return spark.createDataFrame([(c,) for c in found], "name string")


@query(f"SELECT config, column_name AS name FROM (SELECT column_name, {_FAMILY} AS family FROM (DESCRIBE lineitem)) JOIN (VALUES ('full', ''), ('no_admin', 'admin'), ('no_rate', 'rate'), ('amount_only', 'rate,place,admin')) t(config, gone) ON NOT list_contains(string_split(gone, ','), family) WHERE family IS NOT NULL")
def ablation_configs(spark, sf_dir):
    found = features.ablations(_families(spark, sf_dir), _WITHOUT)
    return spark.createDataFrame([(name, c) for name, columns in found.items() for c in columns], "config string, name string")


_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(f", {_STATS}, r AS (SELECT s.*, p.x FROM scored s JOIN {_PRICE} p USING (event)), c AS (SELECT nation, (sum(y) + 20 * (SELECT avg(y) FROM r WHERE fold <> 0)) / (count(*) + 20) AS code FROM r WHERE fold <> 0 GROUP BY nation) SELECT event, round((coalesce(x, median) - mean) / sd, 6) AS price_scaled, (x IS NULL)::INT AS price_missing, " + ", ".join(f"(segment = '{v}')::INT AS \"segment={v}\"" for v in _LEVELS) + ", round(coalesce(code, (SELECT avg(y) FROM r WHERE fold <> 0)), 6) AS nation_code FROM r LEFT JOIN c USING (nation) CROSS JOIN (SELECT * FROM stats WHERE fold = 0)", "scored")
def feature_pipeline(spark, sf_dir):
    """Fitted on the training rows of fold 0, applied to all rows: the frozen columns of both."""
    rows = _priced(spark, sf_dir)
    fitted = features.fit(rows.where("fold <> 0"), "event", ["price"], ["segment"], ["nation"], "y", blocked={"t1a", "y"})
    return fitted.transform(rows).withColumn("price_scaled", rounded(F.col("price_scaled"))).withColumn("nation_code", rounded(F.col("nation_code")))


_NODES = "(SELECT entity, region, CASE WHEN count(o_orderkey) > 0 THEN ln(1 + avg(o_totalprice)) END AS x FROM ents LEFT JOIN orders ON o_custkey = entity GROUP BY ALL)"


@query(f"SELECT entity, round((coalesce(x, median) - mean) / sd, 5) AS price_scaled, (x IS NULL)::INT AS price_missing FROM {_NODES} CROSS JOIN (SELECT any_value(median) AS median, avg(coalesce(x, median)) AS mean, stddev_pop(coalesce(x, median)) AS sd FROM {_NODES} CROSS JOIN (SELECT quantile_cont(x, 0.5) AS median FROM {_NODES} WHERE region <> 0) WHERE region <> 0)", "ents")
def node_features(spark, sf_dir):
    """The mean price of each entity, imputed and scaled by the entities outside region 0."""
    prices = panel.events(spark, sf_dir).groupBy("entity").agg(F.avg("price").alias("price"))
    nodes = panel.entities(spark, sf_dir).join(prices, "entity", "left")
    fitted = features.fit(nodes.where("region <> 0"), "entity", ["price"], indicators=["price"])
    return fitted.transform(nodes).withColumn("price_scaled", rounded(F.col("price_scaled"), 5))


@query("SELECT entity, (2 + len(embedding))::INT AS dims, round(score + nation + list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM ents JOIN embeddings ON vec_id = entity", "ents")
def hstack_fuse(spark, sf_dir):
    vectors = panel.scan(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "entity")
    fused = features.fuse(panel.entities(spark, sf_dir), vectors, "entity", ["score", "nation"], "embedding")
    return fused.select("entity", F.size("fused").alias("dims"), rounded(F.aggregate("fused", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(", m AS (SELECT * FROM ents WHERE segment = 'BUILDING'), near5 AS (SELECT src, dst, place, count(*) OVER (PARTITION BY src) AS n FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(dist_km, 6), dst) AS place FROM pairs WHERE dist_km <= 40 AND src IN (SELECT entity FROM m) AND dst IN (SELECT entity FROM m)) WHERE place <= 5) SELECT src AS entity, round(a.lat + u * (b.lat - a.lat), 6) AS lat, round(a.lon + u * (b.lon - a.lon), 6) AS lon FROM near5 JOIN m a ON a.entity = src JOIN m b ON b.entity = dst CROSS JOIN LATERAL (SELECT (((src % 1000003) * 48307 + 142542) % 1000003) / 1000003::DOUBLE AS u) WHERE place = (((src % 1000003) * 48305 + 134623) % 1000003) % n + 1", "pairs")
def smote(spark, sf_dir):
    points = panel.entities(spark, sf_dir).where("segment = 'BUILDING'")
    return features.oversampled(points, 5, 40).select("entity", rounded(F.col("lat")).alias("lat"), rounded(F.col("lon")).alias("lon"))


@query("SELECT event, y::INT AS y, 0 AS pseudo FROM flagged WHERE analyte = 'AF' UNION ALL SELECT event, CASE WHEN p >= 0.85 THEN 1 ELSE 0 END, 1 FROM scored WHERE (p >= 0.85 OR p <= 0.15) AND event NOT IN (SELECT event FROM flagged WHERE analyte = 'AF')", "scored")
def augmentation_stack(spark, sf_dir):
    from paneflow.operators import targets

    known = targets.flagged_cells(panel.cells(spark, sf_dir)).where("analyte = 'AF'").select("event", "y")
    return features.augmented(known, scored(spark, sf_dir).select("event", "p"), "event", "y")


_NEXT = ", r AS (SELECT event, y, p, nation::DOUBLE / 25 AS q, (((event % 1000003) * 48317 + 182137) % 1000003) % 64 AS part, ((event % 1000003) * 48319 + 190056) % 1000003 AS h FROM scored), swapped AS (SELECT 'p' AS name, event, y, lead(p, 1, first) OVER (PARTITION BY part ORDER BY h, event) AS p, q FROM (SELECT *, first_value(p) OVER (PARTITION BY part ORDER BY h, event) AS first FROM r) UNION ALL SELECT 'q', event, y, p, lead(q, 1, first) OVER (PARTITION BY part ORDER BY h, event) FROM (SELECT *, first_value(q) OVER (PARTITION BY part ORDER BY h, event) AS first FROM r) UNION ALL SELECT 'none', event, y, p, q FROM r), s AS (SELECT name, round(0.7::DOUBLE * p + 0.3::DOUBLE * q, 6) AS p, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM swapped GROUP BY ALL), a AS (SELECT name, sum(wins) / nullif(2 * sum(n1) * sum(n0), 0) AS auc FROM (SELECT *, n1 * n0 + 2 * n1 * coalesce(sum(n0) OVER (PARTITION BY name ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins FROM s) GROUP BY name)"


@query(f"{_NEXT} SELECT a.name, round(b.auc - a.auc, 6) AS drop FROM a CROSS JOIN (SELECT auc FROM a WHERE name = 'none') b WHERE a.name <> 'none'", "scored")
def permutation_importance(spark, sf_dir):
    """What the AUC of a given scorer loses where one input comes from another row."""
    from paneflow.operators import models

    rows = scored(spark, sf_dir).select("event", "y", "p", (F.col("nation").cast("double") / 25).alias("q"))
    found = models.permutation_importance(rows, ["p", "q"], "event", lambda df: df.withColumn("p", F.round(0.7 * F.col("p") + 0.3 * F.col("q"), 6)))
    return found.withColumn("drop", rounded(F.col("drop")))
