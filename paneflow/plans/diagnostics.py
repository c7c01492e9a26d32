"""Queries over audits, run flags, exact tests and multilabel aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.functions.expressions import rounded
from paneflow.operators import diagnostics, evaluate, folds, graph, profiling, targets
from paneflow.plans.base import query
from paneflow.plans.evaluation import _AUC, _MULTI, _TWO, _WINS, _two_models
from paneflow.plans.profiles import NUMBERS
from paneflow.plans.targets import scored
from paneflow.sources import panel

_LATE = "(SELECT *, (l_shipdate >= TIMESTAMP '1996-01-01')::INT AS late FROM lineitem)"
_IMPORTANCE = "(" + " UNION ALL ".join(f"SELECT '{c}' AS name, abs(corr({c}, late)) AS importance FROM {_LATE}" for c in (*NUMBERS, "l_linenumber")) + ")"


def _importance(spark, sf_dir):
    """name, importance: the absolute correlation of line columns with a late date."""
    columns = [*NUMBERS, "l_linenumber"]
    rows = panel.scan(spark, sf_dir, "lineitem", *columns, "l_shipdate").withColumn("late", (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")).cast("int"))
    return profiling.correlations(rows, columns, "late").select(F.col("a").alias("name"), F.abs("corr").alias("importance"))


@query(f"SELECT name, round(importance, 6) AS importance, row_number() OVER (ORDER BY round(importance, 9) DESC, name)::INT AS place FROM {_IMPORTANCE}")
def rank_features(spark, sf_dir):
    from pyspark.sql import Window

    # one row per feature
    place = F.row_number().over(Window.orderBy(F.desc(F.round("importance", 9)), "name"))
    return _importance(spark, sf_dir).select("name", rounded(F.col("importance")).alias("importance"), place.alias("place"))


@query(f"SELECT name, round(importance, 6) AS importance FROM {_IMPORTANCE} ORDER BY round(importance, 9) DESC, name LIMIT 3")
def top_associations(spark, sf_dir):
    return diagnostics.ranked(_importance(spark, sf_dir), "importance", 3).withColumn("importance", rounded(F.col("importance")))


_FAMILY = "CASE WHEN name LIKE 'l\\_quantity%' ESCAPE '\\' THEN 'amount' WHEN name LIKE 'l\\_extended%' ESCAPE '\\' THEN 'amount' WHEN name LIKE 'l\\_discount%' ESCAPE '\\' THEN 'rate' WHEN name LIKE 'l\\_tax%' ESCAPE '\\' THEN 'rate' ELSE 'other' END"


@query(f"SELECT {_FAMILY} AS family, round(sum(importance) / (SELECT sum(importance) FROM {_IMPORTANCE}), 6) AS share FROM {_IMPORTANCE} GROUP BY 1")
def family_share(spark, sf_dir):
    found = diagnostics.family_share(_importance(spark, sf_dir), "name", "importance", {"l_quantity": "amount", "l_extended": "amount", "l_discount": "rate", "l_tax": "rate"})
    return found.withColumn("share", rounded(F.col("share")))


@query("SELECT min(k)::INT AS k FROM (SELECT row_number() OVER w AS k, sum(v) OVER w AS upto, sum(v) OVER () AS total FROM (SELECT dim, round(var_pop(x), 9) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY dim) WINDOW w AS (ORDER BY v DESC, dim ROWS UNBOUNDED PRECEDING)) WHERE upto >= 0.95::DOUBLE * total")
def cumvar_cut(spark, sf_dir):
    each = panel.scan(spark, sf_dir, "embeddings", "embedding").select(F.posexplode("embedding").alias("dim", "x"))
    return diagnostics.cumulative_cut(each.groupBy("dim").agg(F.round(F.var_pop(F.col("x").cast("double")), 9).alias("v")), "v", "dim")


@query("SELECT analyte, measured_share, prevalence FROM (SELECT analyte, round(count(*) / (SELECT count(*) FROM orders), 6) AS measured_share, round(avg(y), 6) AS prevalence FROM flagged GROUP BY analyte) WHERE measured_share >= 0.4 AND prevalence >= 0.05", "flagged")
def label_curation(spark, sf_dir):
    total = panel.events(spark, sf_dir).agg(F.count("*")).scalar()
    found = targets.flagged_cells(panel.cells(spark, sf_dir)).groupBy("analyte").agg(rounded(F.count("*") / total).alias("measured_share"), rounded(F.avg("y")).alias("prevalence"))
    return diagnostics.curated(found, least_measured=0.4)


_DIST = "111::DOUBLE * sqrt(pow(b.lat - a.lat, 2) + pow((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2))"


@query(f"SELECT src, dst, round({_DIST}, 5) AS km, round(dist_km, 5) AS great_circle_km FROM edges JOIN ents a ON a.entity = src JOIN ents b ON b.entity = dst", "edges", "ents")
def equirectangular(spark, sf_dir):
    points = panel.entities(spark, sf_dir)
    edges = graph.undirected(graph.knn(points, 8, 40))
    ends = graph.with_ends(edges, points.withColumn("at", F.struct("lat", "lon")).select("entity", "at"), "at")
    km = diagnostics.equirectangular_km(F.col("at_src.lat"), F.col("at_src.lon"), F.col("at_dst.lat"), F.col("at_dst.lon"))
    return ends.select("src", "dst", rounded(km, 5).alias("km"), rounded(F.col("dist_km"), 5).alias("great_circle_km"))


def _hash_sql(key: str, seed: int) -> str:
    return f"((({key} % 1000003) * {48271 + 2 * seed} + {seed * 7919}) % 1000003)"


_DRAWN = f"(SELECT ({_hash_sql('i', 42)} * 31 + {_hash_sql('i', 49)}) % n + 1 AS src, ({_hash_sql('i', 43)} * 31 + {_hash_sql('i', 50)}) % n + 1 AS dst FROM (SELECT unnest(range(20000)) AS i) CROSS JOIN (SELECT max(c_custkey) AS n FROM customer))"


@query(f"SELECT CASE WHEN km < 5 THEN 0 WHEN km < 20 THEN 5 WHEN km < 100 THEN 20 WHEN km < 1000 THEN 100 ELSE 1000 END::INT AS band, count(*) AS pairs, round(avg((a.segment = b.segment)::INT), 6) AS equal FROM (SELECT src, dst FROM {_DRAWN} WHERE src <> dst) d JOIN ents a ON a.entity = d.src JOIN ents b ON b.entity = d.dst CROSS JOIN LATERAL (SELECT {_DIST} AS km) GROUP BY 1", "ents")
def random_pairs(spark, sf_dir):
    points = panel.entities(spark, sf_dir)
    pairs = diagnostics.random_pairs(20_000, panel.scan(spark, sf_dir, "customer", "c_custkey"), "c_custkey")
    held = points.select("entity", F.struct("lat", "lon", "segment").alias("at"))
    ends = graph.with_ends(pairs, held, "at")
    km = diagnostics.equirectangular_km(F.col("at_src.lat"), F.col("at_src.lon"), F.col("at_dst.lat"), F.col("at_dst.lon"))
    band = F.when(km < 5, 0).when(km < 20, 5).when(km < 100, 20).when(km < 1000, 100).otherwise(1000)
    return ends.groupBy(band.alias("band")).agg(F.count("*").alias("pairs"), rounded(F.avg((F.col("at_src.segment") == F.col("at_dst.segment")).cast("int"))).alias("equal"))


_FITTED = "SELECT f.fold, p, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM (SELECT s.*, s.fold AS own FROM scored s) s JOIN (SELECT unnest(range(8))::INT AS fold) f ON own <> f.fold GROUP BY f.fold, p"


@query(f", held AS ({_AUC}), fit AS (SELECT fold, sum(wins) / nullif(2 * sum(n1) * sum(n0), 0) AS auc FROM (SELECT *, {_WINS.format(g='fold')} AS wins FROM ({_FITTED})) GROUP BY fold) SELECT fold, round(fit.auc, 6) AS fit, round(held.auc, 6) AS held, round(fit.auc - held.auc, 6) AS gap FROM fit JOIN held USING (fold)", "bysc")
def overfit_gap(spark, sf_dir):
    rows = scored(spark, sf_dir).select("fold", "y", "p")
    train = rows.withColumnRenamed("fold", "own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(7)))).where("own <> fold")
    found = diagnostics.gap(evaluate.roc_auc(train, "fold"), evaluate.roc_auc(rows, "fold"), "fold", "auc")
    return found.select("fold", *(rounded(F.col(c)).alias(c) for c in ("fit", "held", "gap")))


_HISTORY = "(SELECT c_mktsegment AS run, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS epoch, avg(o_totalprice) AS metric FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def _history(spark, sf_dir):
    """run, epoch, metric: the mean price per segment and month stands for a training curve."""
    known = panel.entities(spark, sf_dir).select("entity", F.col("segment").alias("run"))
    rows = panel.events(spark, sf_dir).join(known, "entity")
    return rows.groupBy("run", (F.year("ts") * 12 + F.month("ts")).alias("epoch")).agg(F.avg("price").alias("metric"))


_PLACED = f"(SELECT run, epochs, best_epoch, most, least, coalesce((best_epoch - low)::DOUBLE / nullif(high - low, 0), 1) AS place FROM (SELECT run, count(*) AS epochs, min(epoch) AS low, max(epoch) AS high, max(metric) AS most, min(metric) AS least FROM {_HISTORY} GROUP BY run) JOIN (SELECT run, epoch AS best_epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(metric, 9) DESC, epoch) AS r FROM {_HISTORY}) WHERE r = 1) USING (run))"


@query(f"SELECT run, epochs, best_epoch, (place >= 0.8::DOUBLE)::INT AS unconverged FROM {_PLACED}")
def convergence_flag(spark, sf_dir):
    return diagnostics.run_flags(_history(spark, sf_dir), "run", "epoch", "metric").drop("undertrained")


@query(f"SELECT run, best_epoch, (place <= 0.5::DOUBLE AND (most - least) / abs(most) < 0.5)::INT AS undertrained FROM {_PLACED}")
def undertrained_flag(spark, sf_dir):
    return diagnostics.run_flags(_history(spark, sf_dir), "run", "epoch", "metric", early=0.5, flat=0.5).select("run", "best_epoch", "undertrained")


def _codes_sql(rows: str, group: str, fold: str) -> str:
    """The SQL of diagnostics.group_codes over (y, group, fold)."""
    return (f"SELECT r.y, round((s_all - s + 20 * (s_every - s_fold)::DOUBLE / (n_every - n_fold)) / (n_all - n + 20), 6) AS p, r.{fold} AS part FROM ({rows}) r "
            f"JOIN (SELECT {group} AS g, {fold} AS f, count(*) AS n, sum(y) AS s FROM ({rows}) GROUP BY ALL) o ON o.g = r.{group} AND o.f = r.{fold} "
            f"JOIN (SELECT {group} AS g, count(*) AS n_all, sum(y) AS s_all FROM ({rows}) GROUP BY ALL) w ON w.g = r.{group} "
            f"JOIN (SELECT {fold} AS f, count(*) AS n_fold, sum(y) AS s_fold FROM ({rows}) GROUP BY ALL) t ON t.f = r.{fold} CROSS JOIN (SELECT count(*) AS n_every, sum(y) AS s_every FROM ({rows}))")


def _auc_sql(rows: str) -> str:
    return f"(SELECT sum(wins) / nullif(2 * sum(n1) * sum(n0), 0) AS auc FROM (SELECT *, {_WINS.format(g='1')} AS wins FROM (SELECT p, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM ({rows}) GROUP BY p)))"


_BY_ROW = "SELECT entity, y, (" + _hash_sql("event", 3) + " % 5)::INT AS part FROM scored"
_BY_ENTITY = "SELECT entity, nation, y, fold AS part FROM scored"


@query(f"SELECT round(a.auc, 6) AS by_row, round(b.auc, 6) AS by_entity, round(a.auc - b.auc, 6) AS gain, round(m.share, 6) AS multi_event_share FROM {_auc_sql(_codes_sql(_BY_ROW, 'entity', 'part'))} a CROSS JOIN {_auc_sql(_codes_sql(_BY_ENTITY, 'nation', 'part'))} b CROSS JOIN (SELECT sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS share FROM (SELECT count(*) AS n FROM scored GROUP BY entity)) m", "scored")
def pseudo_replicate_leak(spark, sf_dir):
    from paneflow.functions.expressions import bucket_hash

    rows = scored(spark, sf_dir).select("entity", "event", "nation", "y", "fold")
    by_row = diagnostics.group_codes(rows.withColumn("part", F.pmod(bucket_hash(F.col("event"), 3), F.lit(5)).cast("int")), "entity", "y", "part")
    by_entity = diagnostics.group_codes(rows.withColumn("part", F.col("fold")), "nation", "y", "part")
    sizes = rows.groupBy("entity").agg(F.count("*").alias("n"))
    share = sizes.agg(rounded(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("multi_event_share"))
    found = diagnostics.arm_gap(by_row, by_entity, ("by_row", "by_entity"))
    return found.select(*(rounded(F.col(c)).alias(c) for c in found.columns)).crossJoin(share)  # one row each


_REGION = "SELECT s.segment, s.y, e.region AS part FROM scored s JOIN ents e USING (entity)"
_GROUPED = "SELECT segment, y, fold AS part FROM scored"


@query(f", far AS ({_codes_sql(_REGION, 'segment', 'part')}) SELECT part AS block, count(*) AS n, round(avg(y), 6) AS prevalence, round(any_value(near.auc), 6) AS by_entity, round(any_value(whole.auc), 6) AS by_block, round(any_value(near.auc - whole.auc), 6) AS inflation FROM far CROSS JOIN {_auc_sql(_codes_sql(_GROUPED, 'segment', 'part'))} near CROSS JOIN {_auc_sql('SELECT y, p FROM far')} whole GROUP BY part", "scored", "ents")
def spatial_inflation(spark, sf_dir):
    rows = scored(spark, sf_dir).select("entity", "segment", "y", "fold")
    region = panel.entities(spark, sf_dir).select("entity", F.col("region").alias("part"))
    near = diagnostics.group_codes(rows.withColumn("part", F.col("fold")), "segment", "y", "part")
    far = diagnostics.group_codes(rows.join(region, "entity"), "segment", "y", "part")
    arms = diagnostics.arm_gap(near, far, ("by_entity", "by_block")).withColumnRenamed("gain", "inflation")
    blocks = far.groupBy(F.col("part").alias("block")).agg(F.count("*").alias("n"), rounded(F.avg("y")).alias("prevalence"))
    return blocks.crossJoin(arms.select(*(rounded(F.col(c)).alias(c) for c in arms.columns)))  # one row of arms


@query("SELECT k, fold, count(*) AS entities, sum(n)::BIGINT AS n, round(sum(positives) / sum(n), 6) AS prevalence FROM (SELECT k, entity, n, positives, ((row_number() OVER (PARTITION BY k, n, salt ORDER BY entity) - 1 + salt) % k)::INT AS fold FROM (SELECT entity, count(*) AS n, sum(t1a) AS positives, (((entity % 1000003) * 48285 + 55433) % 1000003) % 64 AS salt FROM targets GROUP BY entity) CROSS JOIN (SELECT unnest([5, 8, 10])::INT AS k)) GROUP BY ALL", "targets")
def block_proposals(spark, sf_dir):
    rows = targets.event_targets(panel.cells(spark, sf_dir)).select("entity", F.col("t1a").alias("y"))
    positives = rows.groupBy("entity").agg(F.sum("y").alias("positives"))
    found = []
    for k in (5, 8, 10):
        sized = folds.group_folds(rows, k=k).join(positives, "entity")
        found.append(sized.groupBy("fold").agg(F.count("*").alias("entities"), F.sum("n").alias("n"), rounded(F.sum("positives") / F.sum("n")).alias("prevalence")).withColumn("k", F.lit(k)))
    return profiling.union_all(found)


@query("SELECT 'entity' AS arm, fold, 0::BIGINT AS shared FROM (SELECT DISTINCT fold FROM scored) UNION ALL SELECT 'row', part, sum(more)::BIGINT FROM (SELECT entity, part, (count(*) OVER (PARTITION BY entity) > 1)::INT AS more FROM (SELECT DISTINCT entity, (" + _hash_sql("event", 3) + " % 5)::INT AS part FROM scored)) GROUP BY part", "scored")
def fold_overlap(spark, sf_dir):
    from paneflow.functions.expressions import bucket_hash

    rows = scored(spark, sf_dir).select("entity", "event", "fold")
    by_row = rows.withColumn("part", F.pmod(bucket_hash(F.col("event"), 3), F.lit(5)).cast("int"))
    one = diagnostics.shared_keys(rows, "entity", "fold").withColumn("arm", F.lit("entity"))
    return one.unionByName(diagnostics.shared_keys(by_row, "entity", "part").withColumn("arm", F.lit("row")))


@query("SELECT (SELECT count(*) FROM (SELECT entity FROM ents WHERE region < 3 INTERSECT SELECT entity FROM ents WHERE region >= 3)) AS shared_entities, count(*) AS edges_cut FROM twoway JOIN ents a ON a.entity = src JOIN ents b ON b.entity = dst WHERE (a.region < 3) <> (b.region < 3)", "twoway", "ents")
def embed_fit_disjoint(spark, sf_dir):
    points = panel.entities(spark, sf_dir).withColumn("fit", F.col("region") < 3)
    shared = points.where("fit").select("entity").intersect(points.where("not fit").select("entity")).agg(F.count("*").alias("shared_entities"))
    edges = graph.symmetrised(graph.undirected(graph.knn(points, 8, 40)))
    cut = graph.with_ends(edges, points, "fit").agg(F.count_if(F.col("fit_src") != F.col("fit_dst")).alias("edges_cut"))
    return shared.crossJoin(cut)  # one row each


_TABLES = ("region", "nation", "customer", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM (DESCRIBE {t})) AS columns, (SELECT count(*) FROM (DESCRIBE {t}) WHERE column_type IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') OR column_type LIKE 'DECIMAL%') AS numeric_columns" for t in _TABLES))
def structure_summary(spark, sf_dir):
    from pyspark.sql.types import NumericType

    found = []
    for t in _TABLES:
        rows = panel.scan(spark, sf_dir, t)
        numbers = sum(isinstance(f.dataType, NumericType) for f in rows.schema)
        found.append(rows.agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows", F.lit(len(rows.columns)).cast("long").alias("columns"), F.lit(numbers).cast("long").alias("numeric_columns")))
    return profiling.union_all(found)


_LABEL_AUC = "(SELECT analyte, sum(wins) / nullif(2 * sum(n1) * sum(n0), 0) AS auc FROM (SELECT *, " + _WINS.format(g="analyte") + f" AS wins FROM (SELECT analyte, p, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM {_MULTI} GROUP BY ALL)) GROUP BY analyte)"
_LABEL_AP = f"(SELECT analyte, sum(n1 * tp / seen) / nullif(sum(n1), 0) AS ap FROM (SELECT *, sum(n1) OVER w AS tp, sum(n1 + n0) OVER w AS seen FROM (SELECT analyte, p, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM {_MULTI} GROUP BY ALL) WINDOW w AS (PARTITION BY analyte ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY analyte)"


def _label_scores(spark, sf_dir):
    known = panel.entities(spark, sf_dir).select("entity", F.col("score").alias("p"))
    return targets.flagged_cells(panel.cells(spark, sf_dir)).select("event", "entity", "analyte", "y").join(known, "entity")


@query(f"SELECT analyte, round(auc, 6) AS auc, round(ap, 6) AS ap FROM {_LABEL_AUC} JOIN {_LABEL_AP} USING (analyte)", "flagged", "ents")
def per_label_ranking(spark, sf_dir):
    rows = _label_scores(spark, sf_dir)
    return evaluate.roc_auc(rows, "analyte").join(evaluate.average_precision(rows, "analyte"), "analyte").select("analyte", rounded(F.col("auc")).alias("auc"), rounded(F.col("ap")).alias("ap"))


@query(f"SELECT round((SELECT avg(auc) FROM {_LABEL_AUC}), 6) AS macro_auc, round((SELECT avg(ap) FROM {_LABEL_AP}), 6) AS macro_ap, round(avg(wrong), 6) AS hamming, round((SELECT avg((misses = 0)::INT) FROM (SELECT event, sum((y <> (score >= 0.5)::INT)::INT) AS misses FROM flagged JOIN ents USING (entity) GROUP BY event)), 6) AS exact_match, round((SELECT avg((misses = 0)::INT) FROM (SELECT event, sum((y <> (score >= 0.5)::INT)::INT) AS misses, count(*) AS n FROM flagged JOIN ents USING (entity) WHERE analyte IN ('AF', 'RF') GROUP BY event) WHERE n = 2), 6) AS subset_accuracy FROM (SELECT (y <> (p >= 0.5)::INT)::INT AS wrong FROM {_MULTI})", "flagged", "ents")
def multilabel_aggregate(spark, sf_dir):
    rows = _label_scores(spark, sf_dir).withColumn("wrong", (F.col("y") != (F.col("p") >= 0.5).cast("int")).cast("int"))
    auc = evaluate.roc_auc(rows, "analyte").agg(rounded(F.avg("auc")).alias("macro_auc"))
    ap = evaluate.average_precision(rows, "analyte").agg(rounded(F.avg("ap")).alias("macro_ap"))
    asked = F.col("analyte").isin("AF", "RF")
    by_event = rows.groupBy("event").agg(F.sum("wrong").alias("misses"), F.count("*").alias("n"), F.sum(F.when(asked, F.col("wrong"))).alias("panel_misses"), F.count_if(asked).alias("panel_n"))
    # one row each: the full-panel rows are those with both asked labels measured
    exact = by_event.agg(rounded(F.avg((F.col("misses") == 0).cast("int"))).alias("exact_match"), rounded(F.avg(F.when(F.col("panel_n") == 2, (F.col("panel_misses") == 0).cast("int")))).alias("subset_accuracy"), (F.sum("misses") / F.sum("n")).alias("wrong"))
    return auc.crossJoin(ap).crossJoin(exact.select("exact_match", "subset_accuracy", rounded(F.col("wrong")).alias("hamming")))


@query(f"{_TWO}, d AS (SELECT round(auc_a - auc_b, 9) AS d FROM two), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, row_number() OVER (ORDER BY abs(d), d) - 1 AS i FROM d WHERE d <> 0), w AS (SELECT count(*) AS n_pairs, sum(r) AS total, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))::DOUBLE AS w FROM r) SELECT n_pairs, w, round(CASE WHEN n_pairs >= 4 THEN p END, 6) AS p FROM w CROSS JOIN (SELECT avg((least(plus, total - plus) <= w)::INT) AS p FROM (SELECT s, sum(CASE WHEN (s >> i) & 1 = 1 THEN r ELSE 0 END) AS plus FROM (SELECT unnest(range((1 << (SELECT n_pairs FROM w))::BIGINT)) AS s) CROSS JOIN r GROUP BY s) CROSS JOIN w)", "bysc")
def wilcoxon_exact(spark, sf_dir):
    return diagnostics.signed_rank_p(_two_models(spark, sf_dir), "auc_a", "auc_b").withColumn("p", rounded(F.col("p")))


_T7 = "1 - 2 / pi() * (a + sin(a) * (cos(a) + 2 / 3::DOUBLE * pow(cos(a), 3) + 8 / 15::DOUBLE * pow(cos(a), 5)))"


@query(f"{_TWO} SELECT round(t, 4) AS t, round({_T7}, 5) AS p FROM (SELECT t, atan(abs(t) / sqrt(7)) AS a FROM (SELECT avg(auc_a - auc_b) / sqrt((1 / count(*) + 1 / 7::DOUBLE) * var_samp(auc_a - auc_b)) AS t FROM two))", "bysc")
def nadeau_bengio_p(spark, sf_dir):
    found = evaluate.corrected_t(_two_models(spark, sf_dir), "auc_a", "auc_b", 1 / 7)
    return found.select(rounded(F.col("t"), 4).alias("t"), rounded(diagnostics.student_p(F.col("t"), 7), 5).alias("p"))


@query("SELECT count(auc) AS replicates, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM (SELECT replicate, sum(wins) / nullif(2 * sum(n1) * sum(n0), 0) AS auc FROM (SELECT *, " + _WINS.format(g="replicate") + " AS wins FROM (SELECT replicate, p, sum(y * w)::BIGINT AS n1, sum((1 - y) * w)::BIGINT AS n0 FROM (SELECT *, CASE WHEN u < 367880 THEN 0 WHEN u < 735761 THEN 1 WHEN u < 919701 THEN 2 WHEN u < 981014 THEN 3 ELSE 4 END AS w FROM (SELECT s.*, replicate, (((((entity % 1000003) * 48273 + 7919) % 1000003) * 69621 + (replicate + 1) * 16807) % 1000003) AS u FROM scored s CROSS JOIN (SELECT unnest(range(100))::INT AS replicate))) WHERE w > 0 GROUP BY ALL)) GROUP BY replicate)", "scored")
def bootstrap_interval(spark, sf_dir):
    found = evaluate.bootstrap_interval(scored(spark, sf_dir), "entity", 100)
    return found.select("replicates", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"))


@query(f"{_TWO} SELECT 'score' AS model, fold, 'auc' AS metric, round(auc_a, 6) AS value FROM two UNION ALL SELECT 'complement', fold, 'auc', round(auc_b, 6) FROM two", "bysc")
def consolidated_table(spark, sf_dir):
    two = _two_models(spark, sf_dir)
    return profiling.union_all([two.select(F.lit(m).alias("model"), "fold", F.lit("auc").alias("metric"), rounded(F.col(c)).alias("value")) for m, c in (("score", "auc_a"), ("complement", "auc_b"))])


@query(f"{_TWO} SELECT count(*) AS folds, sum((auc_a > auc_b)::INT)::BIGINT AS wins, round(avg(auc_a - auc_b), 6) AS mean_delta, round(min(auc_a - auc_b), 6) AS worst, round(max(auc_a - auc_b), 6) AS best FROM two", "bysc")
def matched_ablation(spark, sf_dir):
    d = F.col("auc_a") - F.col("auc_b")
    return _two_models(spark, sf_dir).agg(F.count("*").alias("folds"), F.count_if(d > 0).alias("wins"), rounded(F.avg(d)).alias("mean_delta"), rounded(F.min(d)).alias("worst"), rounded(F.max(d)).alias("best"))


_CAL = "(1 / (1 + exp(-(4 * p - 1.5::DOUBLE))))"


@query(f"SELECT round(avg(pow(q - y, 2)), 6) AS brier, round((SELECT sum(n * abs(mp - my)) / sum(n) FROM (SELECT least(floor(q * 10), 9) AS bin, count(*) AS n, avg(q) AS mp, avg(y) AS my FROM (SELECT y, {_CAL} AS q FROM scored) GROUP BY 1)), 6) AS ece, round(avg(pow(p - y, 2)), 6) AS raw_brier FROM (SELECT y, p, {_CAL} AS q FROM scored)", "scored")
def calibrated_scores(spark, sf_dir):
    """Brier and calibration error of given calibrated scores; the ranking stays that of the raw ones."""
    q = 1 / (1 + F.exp(-(4 * F.col("p") - 1.5)))
    rows = scored(spark, sf_dir).select("y", "p", q.alias("q"))
    ece = evaluate.expected_calibration_error(rows.select("y", F.coalesce("q", "p").alias("p")), 10)
    brier = rows.agg(rounded(F.avg(F.pow(F.col("q") - F.col("y"), 2))).alias("brier"), rounded(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("raw_brier"))
    return brier.crossJoin(ece.select(rounded(F.col("ece")).alias("ece")))  # one row each
