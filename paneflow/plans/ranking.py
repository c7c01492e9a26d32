"""Queries over rankings of scores as they stand: finer than any rounding, and rare.

The score is the entity's share of the range of balances, cubed and divided by 10^7: it lies
below 1e-7, so at six digits all rows would tie.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.functions.expressions import rounded
from paneflow.operators import evaluate, folds, targets
from paneflow.plans.base import NEEDS, RELATIONS, query
from paneflow.plans.evaluation import _WINS
from paneflow.sources import panel

RELATIONS["fine"] = "SELECT t.event, t.entity, t.t1a AS y, f.fold, r * r * r / 10000000 AS p FROM targets t JOIN folds f USING (entity) JOIN (SELECT c_custkey AS entity, (c_acctbal - lo) / (hi - lo) AS r FROM customer CROSS JOIN (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)) USING (entity)"
RELATIONS["byfine"] = "SELECT fold, p, sum(y)::BIGINT AS n1, sum(1 - y)::BIGINT AS n0 FROM fine GROUP BY ALL"
NEEDS |= {"fine": ("targets", "folds"), "byfine": ("fine",)}


def fine(spark, sf_dir):
    """event, entity, y, fold, p: events with the fine score of their entity."""
    rows = targets.event_targets(panel.cells(spark, sf_dir))
    customer = panel.scan(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    low, high = customer.agg(F.min("c_acctbal")).scalar(), customer.agg(F.max("c_acctbal")).scalar()
    known = customer.select(F.col("c_custkey").alias("entity"), ((F.col("c_acctbal") - low) / (high - low)).alias("r"))
    r = F.col("r")
    return rows.join(known, "entity").join(folds.group_folds(rows).select("entity", "fold"), "entity").select("event", "entity", F.col("t1a").alias("y"), "fold", (r * r * r / 10_000_000).alias("p"))


@query("SELECT fold, sum(n1 + n0)::BIGINT AS n, round(sum(wins) / nullif(2 * sum(n1) * sum(n0), 0), 6) AS auc FROM (SELECT *, " + _WINS.format(g="fold") + " AS wins FROM byfine) GROUP BY fold", "byfine")
def roc_auc_exact(spark, sf_dir):
    return evaluate.roc_auc(fine(spark, sf_dir), "fold").withColumn("auc", rounded(F.col("auc")))


@query("SELECT fold, round(sum(n1 * tp / seen) / nullif(sum(n1), 0), 6) AS ap FROM (SELECT *, sum(n1) OVER w AS tp, sum(n1 + n0) OVER w AS seen FROM byfine WINDOW w AS (PARTITION BY fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY fold", "byfine")
def pr_auc_exact(spark, sf_dir):
    return evaluate.average_precision(fine(spark, sf_dir), "fold").withColumn("ap", rounded(F.col("ap")))


@query("SELECT percent, k, round(hits / positives, 6) AS gain, round(hits / positives / (percent / 100), 6) AS lift FROM (SELECT percent, k, sum(y) AS hits, (SELECT sum(y) FROM fine) AS positives FROM (SELECT y, row_number() OVER (ORDER BY p DESC, event) AS place FROM fine) JOIN (SELECT percent, greatest(1, floor((SELECT count(*) FROM fine) * percent / 100))::BIGINT AS k FROM (VALUES (1), (2), (5), (10), (50), (100)) t(percent)) ON place <= k GROUP BY percent, k)", "fine")
def topk_gain_exact(spark, sf_dir):
    rows = evaluate.topk_gain(fine(spark, sf_dir), (1, 2, 5, 10, 50, 100), "event")
    return rows.select("percent", F.col("k").cast("bigint").alias("k"), rounded(F.col("gain")).alias("gain"), rounded(F.col("lift")).alias("lift"))


@query("SELECT count(auc) AS replicates, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM (SELECT replicate, sum(wins) / nullif(2 * sum(n1) * sum(n0), 0) AS auc FROM (SELECT *, " + _WINS.format(g="replicate") + " AS wins FROM (SELECT replicate, p, sum(y * w)::BIGINT AS n1, sum((1 - y) * w)::BIGINT AS n0 FROM (SELECT *, CASE WHEN u < 367880 THEN 0 WHEN u < 735761 THEN 1 WHEN u < 919701 THEN 2 WHEN u < 981014 THEN 3 ELSE 4 END AS w FROM (SELECT s.*, replicate, (((((entity % 1000003) * 48273 + 7919) % 1000003) * 69621 + (replicate + 1) * 16807) % 1000003) AS u FROM fine s CROSS JOIN (SELECT unnest(range(50))::INT AS replicate))) WHERE w > 0 GROUP BY ALL)) GROUP BY replicate)", "fine")
def bootstrap_exact(spark, sf_dir):
    found = evaluate.bootstrap_interval(fine(spark, sf_dir), "entity", 50)
    return found.select("replicates", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"))


@query("SELECT fold, t, round(balanced_accuracy, 6) AS balanced_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(balanced_accuracy, 9) DESC, t) AS r FROM (SELECT fold, t, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy FROM (SELECT fold, t, sum(n1 * h) AS tp, sum(n0 * h) AS fp, sum(n1 * (1 - h)) AS fn, sum(n0 * (1 - h)) AS tn FROM (SELECT b.*, t, (p >= t)::INT AS h FROM bysc b CROSS JOIN (SELECT round(0.05::DOUBLE + i * 0.02::DOUBLE, 6) AS t FROM (SELECT unnest(range(46)) AS i))) GROUP BY fold, t))) WHERE r = 1", "bysc")
def threshold_balanced(spark, sf_dir):
    """The threshold of the best balanced accuracy, where F1 is not what is asked for."""
    from paneflow.plans.targets import scored

    found = evaluate.threshold_search(scored(spark, sf_dir), 46, 0.05, 0.95, "fold", metric="balanced_accuracy")
    return found.withColumn("balanced_accuracy", rounded(F.col("balanced_accuracy")))


@query(", other AS (SELECT f.fold, s.y, s.p FROM scored s JOIN (SELECT DISTINCT fold FROM scored) f ON s.fold <> f.fold) SELECT fold, t, round(f1, 6) AS f1 FROM (SELECT fold, t, f1, row_number() OVER (PARTITION BY fold ORDER BY round(f1, 9) DESC, t) AS r FROM (SELECT fold, t, coalesce(2 * sum(y * h) / nullif(2 * sum(y * h) + sum((1 - y) * h) + sum(y * (1 - h)), 0), 0) AS f1 FROM (SELECT o.*, t, (p >= t)::INT AS h FROM other o CROSS JOIN (SELECT round(0.1::DOUBLE + i * 0.01::DOUBLE, 6) AS t FROM (SELECT unnest(range(81)) AS i))) GROUP BY fold, t)) WHERE r = 1", "scored")
def threshold_crossed(spark, sf_dir):
    """A threshold for each fold from the rows of the others."""
    from paneflow.plans.targets import scored

    return evaluate.crossed_thresholds(scored(spark, sf_dir), "fold").withColumn("f1", rounded(F.col("f1")))
