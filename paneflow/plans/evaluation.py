"""Queries over evaluation operators: ranking, thresholds, calibration, paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.functions.expressions import entropy, rounded
from paneflow.operators import evaluate, targets
from paneflow.plans.base import query
from paneflow.plans.targets import scored
from paneflow.sources import panel

_WINS = "n1 * n0 + 2 * n1 * coalesce(sum(n0) OVER (PARTITION BY {g} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_AUC = "SELECT fold, sum(n1 + n0)::BIGINT AS n, sum(wins) / nullif(2 * sum(n1) * sum(n0), 0) AS auc FROM (SELECT *, " + _WINS.format(g="fold") + " AS wins FROM bysc) GROUP BY fold"
_CONF = "SELECT fold, sum(y * h)::BIGINT AS tp, sum((1 - y) * h)::BIGINT AS fp, sum(y * (1 - h))::BIGINT AS fn, sum((1 - y) * (1 - h))::BIGINT AS tn FROM (SELECT *, (p >= 0.5)::INT AS h FROM scored) GROUP BY fold"


@query(f"SELECT fold, n, round(auc, 6) AS auc FROM ({_AUC})", "bysc")
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(scored(spark, sf_dir), "fold").withColumn("auc", rounded(F.col("auc")))


@query("SELECT fold, round(sum(n1 * tp / seen) / nullif(sum(n1), 0), 6) AS ap FROM (SELECT *, sum(n1) OVER w AS tp, sum(n1 + n0) OVER w AS seen FROM bysc WINDOW w AS (PARTITION BY fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY fold", "bysc")
def pr_auc(spark, sf_dir):
    return evaluate.average_precision(scored(spark, sf_dir), "fold").withColumn("ap", rounded(F.col("ap")))


_RATES = "tp, fp, fn, tn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy"


def _rated(rows):
    return rows.select(*(c for c in rows.columns if c not in ("f1", "precision", "recall", "accuracy", "balanced_accuracy")), *(rounded(F.col(c)).alias(c) for c in ("f1", "precision", "recall", "accuracy", "balanced_accuracy")))


@query(f"SELECT fold, {_RATES} FROM ({_CONF})", "scored")
def binary_metrics(spark, sf_dir):
    return _rated(evaluate.rates(evaluate.confusion(scored(spark, sf_dir), F.lit(0.5), "fold")))


_MULTI = "(SELECT f.analyte, f.y, e.score AS p FROM flagged f JOIN ents e USING (entity))"


@query(f"SELECT analyte, {_RATES} FROM (SELECT analyte, sum(y * h)::BIGINT AS tp, sum((1 - y) * h)::BIGINT AS fp, sum(y * (1 - h))::BIGINT AS fn, sum((1 - y) * (1 - h))::BIGINT AS tn FROM (SELECT *, (p >= 0.5)::INT AS h FROM {_MULTI}) GROUP BY GROUPING SETS ((analyte), ()))", "flagged", "ents")
def multilabel_metrics(spark, sf_dir):
    known = panel.entities(spark, sf_dir).select("entity", F.col("score").alias("p"))
    rows = targets.flagged_cells(panel.cells(spark, sf_dir)).select("entity", "analyte", "y").join(known, "entity")
    counts = evaluate.confusion(rows, F.lit(0.5), "analyte")
    micro = counts.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).withColumn("analyte", F.lit(None).cast("string"))
    return _rated(evaluate.rates(counts.unionByName(micro)))


@query("SELECT fold, t, round(f1, 6) AS f1 FROM (SELECT fold, t, f1, row_number() OVER (PARTITION BY fold ORDER BY round(f1, 9) DESC, t) AS r FROM (SELECT fold, t, coalesce(2 * sum(n1 * h) / nullif(2 * sum(n1 * h) + sum(n0 * h) + sum(n1 * (1 - h)), 0), 0) AS f1 FROM (SELECT b.*, t, (p >= t)::INT AS h FROM bysc b CROSS JOIN (SELECT round(0.1::DOUBLE + i * 0.01::DOUBLE, 6) AS t FROM (SELECT unnest(range(81)) AS i))) GROUP BY fold, t)) WHERE r = 1", "bysc")
def threshold_search(spark, sf_dir):
    return evaluate.threshold_search(scored(spark, sf_dir), 81, 0.1, 0.9, "fold").withColumn("f1", rounded(F.col("f1")))


@query("SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM scored GROUP BY 1", "scored")
def reliability(spark, sf_dir):
    rows = evaluate.reliability(scored(spark, sf_dir))
    return rows.select("bin", "n", rounded(F.col("mean_p")).alias("mean_p"), rounded(F.col("mean_y")).alias("mean_y"))


@query("SELECT fold, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM (SELECT fold, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY ALL) GROUP BY fold", "scored")
def ece(spark, sf_dir):
    return evaluate.expected_calibration_error(scored(spark, sf_dir), 10, "fold").withColumn("ece", rounded(F.col("ece")))


@query("SELECT percent, k, round(hits / positives, 6) AS gain, round(hits / positives / (percent / 100), 6) AS lift FROM (SELECT percent, k, sum(y) AS hits, (SELECT sum(y) FROM scored) AS positives FROM (SELECT y, row_number() OVER (ORDER BY p DESC, event) AS place FROM scored) JOIN (SELECT percent, greatest(1, floor((SELECT count(*) FROM scored) * percent / 100))::BIGINT AS k FROM (VALUES (1), (5), (10), (20)) t(percent)) ON place <= k GROUP BY percent, k)", "scored")
def topk_gain(spark, sf_dir):
    rows = evaluate.topk_gain(scored(spark, sf_dir), (1, 5, 10, 20), "event")
    return rows.select("percent", F.col("k").cast("bigint").alias("k"), rounded(F.col("gain")).alias("gain"), rounded(F.col("lift")).alias("lift"))


@query("SELECT replicate, round(sum(wins) / nullif(2 * sum(n1) * sum(n0), 0), 6) AS auc FROM (SELECT *, " + _WINS.format(g="replicate") + " AS wins FROM (SELECT replicate, p, sum(y * w)::BIGINT AS n1, sum((1 - y) * w)::BIGINT AS n0 FROM (SELECT *, CASE WHEN u < 367880 THEN 0 WHEN u < 735761 THEN 1 WHEN u < 919701 THEN 2 WHEN u < 981014 THEN 3 ELSE 4 END AS w FROM (SELECT s.*, replicate, (((((entity % 1000003) * 48273 + 7919) % 1000003) * 69621 + (replicate + 1) * 16807) % 1000003) AS u FROM scored s CROSS JOIN (SELECT unnest(range(20))::INT AS replicate))) WHERE w > 0 GROUP BY ALL)) GROUP BY replicate", "scored")
def bootstrap_ci(spark, sf_dir):
    return evaluate.bootstrap_auc(scored(spark, sf_dir), "entity").withColumn("auc", rounded(F.col("auc")))


_TWO = ", a AS (" + _AUC + "), b AS (SELECT fold, sum(n1 + n0)::BIGINT AS n, sum(wins) / nullif(2 * sum(n1) * sum(n0), 0) AS auc FROM (SELECT *, " + _WINS.format(g="fold") + " AS wins FROM (SELECT fold, p, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM (SELECT fold, y, round(1 - p, 6) AS p FROM scored) GROUP BY ALL)) GROUP BY fold), two AS (SELECT fold, a.auc AS auc_a, b.auc AS auc_b FROM a JOIN b USING (fold))"


def _two_models(spark, sf_dir):
    """fold, auc_a, auc_b: the score and its complement."""
    rows = scored(spark, sf_dir)
    a = evaluate.roc_auc(rows, "fold").select("fold", F.col("auc").alias("auc_a"))
    b = evaluate.roc_auc(rows.withColumn("p", F.round(1 - F.col("p"), 6)), "fold").select("fold", F.col("auc").alias("auc_b"))
    return a.join(b, "fold")


@query(f"{_TWO} SELECT fold, round(auc_a - auc_b, 6) AS delta FROM two", "bysc")
def delta_arms(spark, sf_dir):
    return _two_models(spark, sf_dir).select("fold", rounded(F.col("auc_a") - F.col("auc_b")).alias("delta"))


@query(f"{_TWO} SELECT count(*) AS n_folds, round(avg(auc_a - auc_b), 6) AS mean_gain, round(avg(auc_a - auc_b) / sqrt((1 / count(*) + 1 / 7::DOUBLE) * var_samp(auc_a - auc_b)), 4) AS t FROM two", "bysc")
def nadeau_bengio(spark, sf_dir):
    found = evaluate.corrected_t(_two_models(spark, sf_dir), "auc_a", "auc_b", 1 / 7)
    return found.select("n_folds", rounded(F.col("mean_gain")).alias("mean_gain"), rounded(F.col("t"), 4).alias("t"))


@query(f"{_TWO} SELECT count(*) AS n_pairs, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0))::DOUBLE AS w FROM (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM (SELECT round(auc_a - auc_b, 9) AS d FROM two) WHERE d <> 0)", "bysc")
def wilcoxon(spark, sf_dir):
    return evaluate.signed_rank(_two_models(spark, sf_dir), "auc_a", "auc_b")


@query(f"SELECT count(auc) AS folds, round(coalesce(avg(auc), 0.5), 6) AS mean_auc, round(stddev_pop(auc), 6) AS sd FROM ({_AUC})", "bysc")
def fold_mean_std(spark, sf_dir):
    rows = evaluate.roc_auc(scored(spark, sf_dir), "fold")
    return rows.agg(F.count("auc").alias("folds"), rounded(F.coalesce(F.avg("auc"), F.lit(0.5))).alias("mean_auc"), rounded(F.stddev_pop("auc")).alias("sd"))


@query(f"{_TWO} SELECT (avg(auc_a - auc_b) > 0.03 AND abs(avg(auc_a - auc_b) / sqrt((1 / count(*) + 1 / 7::DOUBLE) * var_samp(auc_a - auc_b))) > 2.365)::INT AS better FROM two", "bysc")
def verdict(spark, sf_dir):
    found = evaluate.corrected_t(_two_models(spark, sf_dir), "auc_a", "auc_b", 1 / 7)
    return found.select(F.coalesce(((F.col("mean_gain") > 0.03) & (F.abs("t") > 2.365)).cast("int"), F.lit(0)).alias("better"))


_E = "-(q{0} * ln(q{0}) + (1 - q{0}) * ln(1 - q{0}))"


@query("SELECT event, round((p + 1 - p + r) / 3, 6) AS mean, round(sqrt((p * p + (1 - p) * (1 - p) + r * r) / 3 - pow((1 + r) / 3, 2)), 4) AS sd, round(abs(p - (1 - p)), 6) AS gap_ab, round(abs(p - r), 6) AS gap_ac, round((" + " + ".join(map(_E.format, "abc")) + ") / 3, 6) AS entropy FROM (SELECT event, p, r, greatest(1e-9, least(1 - 1e-9, p)) AS qa, greatest(1e-9, least(1 - 1e-9, 1 - p)) AS qb, greatest(1e-9, least(1 - 1e-9, r)) AS qc FROM (SELECT event, p, 0.4::DOUBLE * p AS r FROM scored))", "scored")
def meta_features(spark, sf_dir):
    p = F.col("p")
    a, b, c = p, 1 - p, F.lit(0.4) * p
    variance = (a * a + b * b + c * c) / 3 - F.pow((1 + c) / 3, 2)
    return scored(spark, sf_dir).select("event", rounded((a + b + c) / 3).alias("mean"), rounded(F.sqrt(variance), 4).alias("sd"), rounded(F.abs(a - b)).alias("gap_ab"), rounded(F.abs(a - c)).alias("gap_ac"), rounded((entropy(a) + entropy(b) + entropy(c)) / 3).alias("entropy"))


@query("SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q)) * pow(CASE WHEN y = 1 THEN 1 - q ELSE q END, 2)), 6) AS focal, round(avg(pow(p - y, 2)), 6) AS brier FROM (SELECT *, greatest(1e-9, least(1 - 1e-9, p)) AS q FROM scored)", "scored")
def focal_bce(spark, sf_dir):
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    loss = -(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))
    return scored(spark, sf_dir).agg(rounded(F.avg(loss * F.pow(F.when(F.col("y") == 1, 1 - q).otherwise(q), 2))).alias("focal"), rounded(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"))


@query("SELECT segment, ntile(4) OVER (ORDER BY n DESC, segment)::INT AS class FROM (SELECT segment, count(*) AS n FROM scored GROUP BY segment)", "scored")
def class_split(spark, sf_dir):
    from pyspark.sql import Window

    # one row per label: a handful
    counts = scored(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("n"))
    return counts.select("segment", F.ntile(4).over(Window.orderBy(F.desc("n"), "segment")).alias("class"))
