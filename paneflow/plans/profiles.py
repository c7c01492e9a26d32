"""Queries over aggregates, profiles and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.functions.expressions import rounded, safe_corr
from paneflow.operators import profiling, targets
from paneflow.operators.quantiles import quantiles
from paneflow.plans.base import query
from paneflow.sources import panel

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _profile_sql(c: str) -> str:
    x = f"({c} + 0.0::DOUBLE)"
    return f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::INT), 6) AS null_share, count(DISTINCT {x}) AS \"distinct\", round(min({x}), 6) AS low, round(quantile_cont({x}, 0.5), 6) AS median, round(max({x}), 6) AS high, round(avg({x}), 4) AS mean, round(skewness({x}), 4) + 0.0 AS skew, round(avg(({x} = 0)::INT), 6) AS zero_share, round(avg(({x} < 0)::INT), 6) AS negative_share FROM lineitem"


@query(" UNION ALL ".join(map(_profile_sql, NUMBERS)))
def column_profile(spark, sf_dir):
    rows = profiling.numeric_profile(panel.scan(spark, sf_dir, "lineitem", *NUMBERS), list(NUMBERS))
    digits = {"mean": 4, "skew": 4}
    return rows.select("column", "distinct", *(rounded(F.col(c), digits.get(c, 6)).alias(c) for c in ("null_share", "low", "median", "high", "mean", "skew", "zero_share", "negative_share")))


@query("SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, nation FROM ents GROUP BY nation", "ents")
def group_mean_coords(spark, sf_dir):
    return panel.entities(spark, sf_dir).groupBy("nation").agg(rounded(F.avg("lat")).alias("lat"), rounded(F.avg("lon")).alias("lon"))


@query("SELECT entity, round(mean_price, 6) AS mean_price, priority, ts FROM (SELECT o_custkey AS entity, avg(o_totalprice) AS mean_price, list_sort(list(o_orderdate))[count(*) // 2 + 1] AS ts FROM orders GROUP BY 1) JOIN (SELECT entity, priority FROM (SELECT o_custkey AS entity, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1) USING (entity)")
def entity_agg(spark, sf_dir):
    rows = panel.events(spark, sf_dir)
    middle = F.element_at(F.array_sort(F.collect_list("ts")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return rows.groupBy("entity").agg(rounded(F.avg("price")).alias("mean_price"), F.mode("priority", True).alias("priority"), middle.alias("ts"))


@query("SELECT nation, segment FROM (SELECT nation, segment, row_number() OVER (PARTITION BY nation ORDER BY count(*) DESC, segment) AS r FROM ents GROUP BY 1, 2) WHERE r = 1", "ents")
def group_mode(spark, sf_dir):
    return panel.entities(spark, sf_dir).groupBy("nation").agg(F.mode("segment", True).alias("segment"))


@query("SELECT entity, count(*) AS n, (2 * sum(t1a) >= count(*))::INT AS t1a FROM targets GROUP BY entity", "targets")
def majority_label(spark, sf_dir):
    return targets.majority(targets.event_targets(panel.cells(spark, sf_dir)), "entity", "t1a")


@query("SELECT entity, analyte, count(*) AS n, (2 * sum(y) >= count(*))::INT AS y FROM flagged GROUP BY ALL", "flagged")
def masked_majority(spark, sf_dir):
    from paneflow.operators import graph

    return graph.bipartite(targets.flagged_cells(panel.cells(spark, sf_dir)))


@query("SELECT entity, max(t1a) AS any_t1a, max(t1c) AS any_t1c FROM targets GROUP BY entity", "targets")
def any_per_group(spark, sf_dir):
    return targets.event_targets(panel.cells(spark, sf_dir)).groupBy("entity").agg(F.max("t1a").alias("any_t1a"), F.max("t1c").alias("any_t1c"))


@query("SELECT o_custkey AS entity, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS priority, min(o_orderdate) AS ts FROM orders GROUP BY 1")
def first_per_group(spark, sf_dir):
    return panel.events(spark, sf_dir).groupBy("entity").agg(F.min_by("priority", F.struct("ts", "event")).alias("priority"), F.min("ts").alias("ts"))


@query("SELECT count(*) AS entities, min(n) AS low, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, max(n) AS high, sum((n > 1)::INT)::BIGINT AS repeated FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def group_size(spark, sf_dir):
    sizes = panel.events(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    # one row per size from here on
    c = F.col("c")
    return sizes.agg(F.sum(c).alias("entities"), F.min("n").alias("low"), F.percentile("n", F.lit(0.5), c).alias("median"), rounded(F.sum(F.col("n") * c) / F.sum(c)).alias("mean"), F.max("n").alias("high"), F.sum(F.when(F.col("n") > 1, c).otherwise(0)).alias("repeated"))


@query("SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_rows, sum(n - 1)::BIGINT AS repeated FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def distinct_rows(spark, sf_dir):
    return profiling.duplicate_rows(panel.scan(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    rows = panel.scan(spark, sf_dir, "events", "event_type")
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n")).select("value", "n", rounded(F.col("n") / total).alias("share"))


def _counted(table: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {table} GROUP BY ALL"


_FLAGS = ("l_returnflag", "l_linestatus", "l_linenumber")


@query("SELECT \"column\", value, n, round(n / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS r, sum(n) OVER (PARTITION BY \"column\") AS total FROM (" + " UNION ALL ".join(_counted("lineitem", c) for c in _FLAGS) + ")) WHERE r = 1")
def quasi_constant(spark, sf_dir):
    rows = profiling.top_share(panel.scan(spark, sf_dir, "lineitem", *_FLAGS), list(_FLAGS))
    return rows.select("column", "value", "n", rounded(F.col("share")).alias("share"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(({c} IS NULL)::INT)::BIGINT AS kinds, (count(DISTINCT {c}) + max(({c} IS NULL)::INT) <= 1)::INT AS constant FROM lineitem" for c in _FLAGS))
def constant_columns(spark, sf_dir):
    return profiling.constant_columns(panel.scan(spark, sf_dir, "lineitem", *_FLAGS), list(_FLAGS))


@query("SELECT 'l_partkey' AS a, 'l_suppkey' AS b, min((l_partkey IS NOT DISTINCT FROM l_suppkey)::INT) AS equal FROM lineitem UNION ALL SELECT 'l_partkey', 'part2', min((l_partkey IS NOT DISTINCT FROM l_partkey)::INT) FROM lineitem UNION ALL SELECT 'l_suppkey', 'part2', min((l_suppkey IS NOT DISTINCT FROM l_partkey)::INT) FROM lineitem")
def duplicate_columns(spark, sf_dir):
    rows = panel.scan(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").withColumn("part2", F.col("l_partkey"))
    return profiling.equal_columns(rows, ["l_partkey", "l_suppkey", "part2"])


@query("SELECT analyte, count(*) AS measured, round(avg(detected::INT), 6) AS detected_share, quantile_cont(value, 0.5) FILTER (WHERE detected) AS median, round(quantile_cont(value, 0.95) FILTER (WHERE detected), 6) AS p95, max(value) AS high FROM flagged GROUP BY analyte", "flagged")
def analyte_stats(spark, sf_dir):
    cells = panel.cells(spark, sf_dir)
    counts = cells.where("detected").groupBy("analyte", F.col("value").cast("double").alias("x")).agg(F.count("*").alias("n"))
    whole = cells.groupBy("analyte").agg(F.count("*").alias("measured"), rounded(F.avg(F.col("detected").cast("int"))).alias("detected_share"), F.max("value").alias("high"))
    return whole.join(quantiles(counts, ["analyte"], {"median": 0.5, "p95": 0.95}), "analyte", "left").select("analyte", "measured", "detected_share", "median", rounded(F.col("p95")).alias("p95"), "high")


@query("SELECT analyte, detected::INT AS detected, count(*) AS n, sum((value = 0)::INT)::BIGINT AS zeros, sum((value > 0)::INT)::BIGINT AS positive FROM cells GROUP BY ALL", "cells")
def nondetect_encoding(spark, sf_dir):
    return panel.cells(spark, sf_dir).groupBy("analyte", F.col("detected").cast("int").alias("detected")).agg(F.count("*").alias("n"), F.count_if(F.col("value") == 0).alias("zeros"), F.count_if(F.col("value") > 0).alias("positive"))


@query("SELECT count(*) AS n, round(corr(s, o_totalprice), 6) AS corr, round(max(abs(s - o_totalprice)), 2) AS max_gap FROM (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey")
def sum_reconstruction(spark, sf_dir):
    sums = panel.scan(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice").groupBy(F.col("l_orderkey").alias("event")).agg(F.sum("l_extendedprice").alias("s"))
    rows = sums.join(panel.events(spark, sf_dir).select("event", "price"), "event")
    return rows.agg(F.count("*").alias("n"), rounded(safe_corr(F.col("s"), F.col("price"))).alias("corr"), F.round(F.max(F.abs(F.col("s") - F.col("price"))), 2).alias("max_gap"))


@query("SELECT analyte, sum(naive)::BIGINT AS raw, sum(y)::BIGINT AS guarded, sum(naive - y)::BIGINT AS lost FROM flagged GROUP BY analyte", "flagged")
def guard_impact(spark, sf_dir):
    return targets.flagged_cells(panel.cells(spark, sf_dir)).groupBy("analyte").agg(F.sum("naive").alias("raw"), F.sum("y").alias("guarded"), F.sum(F.col("naive") - F.col("y")).alias("lost"))


_W = targets.ANALYTES


@query("SELECT a.analyte AS a, b.analyte AS b, count(*) AS n, round(corr(a.y, b.y), 6) AS corr FROM flagged a JOIN flagged b ON a.event = b.event AND a.analyte < b.analyte GROUP BY ALL", "flagged")
def corr_matrix(spark, sf_dir):
    rows = targets.flagged_cells(panel.cells(spark, sf_dir)).select("event", "analyte", "y")
    other = rows.select("event", F.col("analyte").alias("b"), F.col("y").alias("y2"))
    # at most as many pairs per event as there are pairs of analytes
    pairs = rows.join(other, "event").where(F.col("analyte") < F.col("b"))
    return pairs.groupBy(F.col("analyte").alias("a"), "b").agg(F.count("*").alias("n"), rounded(safe_corr(F.col("y"), F.col("y2"))).alias("corr"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS a, 'late' AS b, round(corr({c}, late), 6) AS corr FROM (SELECT *, (l_shipdate >= TIMESTAMP '1996-01-01')::INT AS late FROM lineitem)" for c in NUMBERS))
def corr_scan(spark, sf_dir):
    rows = panel.scan(spark, sf_dir, "lineitem", *NUMBERS, "l_shipdate").withColumn("late", (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).cast("int"))
    found = profiling.correlations(rows, list(NUMBERS), "late")
    return found.withColumn("corr", rounded(F.col("corr")))


@query("SELECT 'segment' AS category, round(sqrt(greatest(0, (sum(n * (m - g) * (m - g))) / nullif(max(ss), 0))), 6) AS eta FROM (SELECT segment, count(*) AS n, avg(y) AS m FROM scored GROUP BY segment) CROSS JOIN (SELECT avg(y) AS g, var_pop(y) * count(*) AS ss FROM scored) UNION ALL SELECT 'nation', round(sqrt(greatest(0, (sum(n * (m - g) * (m - g))) / nullif(max(ss), 0))), 6) FROM (SELECT nation, count(*) AS n, avg(y) AS m FROM scored GROUP BY nation) CROSS JOIN (SELECT avg(y) AS g, var_pop(y) * count(*) AS ss FROM scored)", "scored")
def eta_ratio(spark, sf_dir):
    from paneflow.plans.targets import scored

    rows = scored(spark, sf_dir)
    return profiling.eta(rows, "segment", "y").unionByName(profiling.eta(rows, "nation", "y")).withColumn("eta", rounded(F.col("eta")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", sum(({c} IN (-999, -9999, -99, 9999, -1))::INT)::BIGINT AS n FROM lineitem" for c in ("l_quantity", "l_linenumber")))
def sentinel_scan(spark, sf_dir):
    columns = ["l_quantity", "l_linenumber"]
    return profiling.sentinels(panel.scan(spark, sf_dir, "lineitem", *columns), columns)


@query("SELECT 'l' AS family, count(*) AS columns FROM (DESCRIBE lineitem) WHERE column_name LIKE 'l\\_%' ESCAPE '\\'")
def family_select(spark, sf_dir):
    columns = [c for c in panel.scan(spark, sf_dir, "lineitem").columns if c.startswith("l_")]
    return spark.createDataFrame([("l", len(columns))], "family string, columns bigint")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_pairs(spark, sf_dir):
    return panel.scan(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
