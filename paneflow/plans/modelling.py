"""Queries over fitted models: rows only, as training is not SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneflow.operators import evaluate, models, targets, trees, tuning
from paneflow.operators.tables import settled
from paneflow.plans.base import query
from paneflow.plans.targets import scored
from paneflow.sources import panel

K, LABELS = 4, ["AF", "NO"]
ALL = ["AF", "AO", "NF", "NO", "RF", "RO"]


def _rows(spark, sf_dir, labels=LABELS):
    """event, fold, numeric features and one nullable column per label; computed once, as every fit reads them."""
    rows = scored(spark, sf_dir).withColumn("fold", F.col("fold") % K)
    price = panel.events(spark, sf_dir).select("event", (F.col("price") / 100_000).alias("price"))
    wide = targets.wide(panel.cells(spark, sf_dir), "y").select("event", *labels)
    return settled(rows.join(price, "event").join(wide, "event", "left").withColumn("nation", F.col("nation").cast("double")).select("event", "entity", "fold", "y", F.col("p").alias("score"), "price", "nation", *labels))


FEATURES = ["score", "price", "nation"]


@query()
def lr_out_of_fold(spark, sf_dir):
    rows = models.out_of_fold(_rows(spark, sf_dir), FEATURES, "y", K)
    return rows.select("event", "fold", "y", "p")


@query()
def binary_relevance(spark, sf_dir):
    return models.binary_relevance(_rows(spark, sf_dir), FEATURES, LABELS, K)


@query()
def pseudo_label(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    known = rows.where("AF is not null")
    p = models.fit_predict(known, rows, FEATURES, "AF")
    return models.pseudo_labels(p.select("event", "AF", "p"), "AF")


@query()
def embedding_pca(spark, sf_dir):
    return models.components(panel.scan(spark, sf_dir, "embeddings"), "embedding", 8).select("vec_id", "label", "pc")


@query()
def classifier_chain(spark, sf_dir):
    return models.chain(_rows(spark, sf_dir), FEATURES, LABELS, K)


@query()
def ensemble_chains(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return models.ensemble([models.chain(rows, FEATURES, order, K) for order in (LABELS, LABELS[::-1])])


@query()
def frequency_class_chain(spark, sf_dir):
    """A chain over all labels, in four classes of falling prevalence."""
    rows = _rows(spark, sf_dir, ALL)
    order = [label for group in models.label_classes(rows, ALL) for label in group]
    return models.chain(rows, FEATURES, order, K)


@query()
def oof_backbone(spark, sf_dir):
    return models.backbone(_rows(spark, sf_dir), FEATURES, "y", K)


@query()
def stacking(spark, sf_dir):
    base = models.backbone(_rows(spark, sf_dir), FEATURES, "y", K)
    return models.stacked(base, K).select("event", "fold", "y", "p")


@query()
def random_search(spark, sf_dir):
    given, mean = models.random_search(_rows(spark, sf_dir), FEATURES, "y", list(range(K)), "lr", {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}, 3)
    return spark.createDataFrame([(k, float(v), mean) for k, v in sorted(given.items())], "parameter string, value double, mean_auc double")


@query()
def nested_cv(spark, sf_dir):
    return models.nested(_rows(spark, sf_dir), FEATURES, "y", 3, "lr", {"regParam": [0.0, 0.01, 0.1]}, 2)


@query()
def evaluate_model(spark, sf_dir):
    """Out-of-fold scores, a threshold per label and fold from the other folds, and the metrics at it."""
    scores = models.binary_relevance(_rows(spark, sf_dir), FEATURES, LABELS, K)
    best = evaluate.crossed_thresholds(scores, "fold", "label").select("label", "fold", "t")
    counts = evaluate.confusion(scores.join(F.broadcast(best), ["label", "fold"]), F.col("t"), "label")  # labels x folds
    return evaluate.rates(counts).join(evaluate.roc_auc(scores, "label").select("label", "auc"), "label")


def _boosted(spark, sf_dir):
    """(rows, the trees of each fold's model, or its constant)."""
    rows = _rows(spark, sf_dir)
    fitted = {f: models._fitted(models._assembled(rows.where(F.col("fold") != f), FEATURES), "y", "boosted", None, {}) for f in range(K)}
    return rows, {f: m if isinstance(m, float) else trees.boosted_trees(m) for f, m in fitted.items()}


@query()
def boosting_curves(spark, sf_dir):
    """Log-loss and AUC of each fold's boosted model on training and held rows, round by round."""
    rows, grown = _boosted(spark, sf_dir)
    return trees.boosting_curves(rows, FEATURES, "y", grown)


@query()
def tree_attribution(spark, sf_dir):
    """What each feature adds to the margin of each event under its own fold's model."""
    rows, grown = _boosted(spark, sf_dir)
    out = None
    for f, own in grown.items():
        if isinstance(own, float):
            continue
        part = trees.attributions(rows.where(F.col("fold") == f), "event", FEATURES, own, rows.where(F.col("fold") != f)).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    added = [F.col("contributions")[i].alias(f"by_{c}") for i, c in enumerate(FEATURES)]
    return out.select("event", "fold", "base", *added)


@query()
def adaptive_search(spark, sf_dir):
    """Trials of an adaptive search, in order, with their mean AUC."""
    space = {"regParam": (0.0, 1.0), "elasticNetParam": [0.0, 0.5, 1.0]}
    rows = _rows(spark, sf_dir)
    done = tuning.parzen_search(tuning.fold_auc(rows, FEATURES, "y", list(range(K)), "lr"), space, 8, startup=4, batch=2)
    return spark.createDataFrame([(i, float(g["regParam"]), float(g["elasticNetParam"]), v) for i, (g, v) in enumerate(done)], "trial int, reg double, elastic double, mean_auc double")


@query()
def platt_calibration(spark, sf_dir):
    rows = models.out_of_fold(_rows(spark, sf_dir), FEATURES, "y", K).select("event", "fold", "y", "p")
    return models.platt(rows, K)


@query()
def pseudo_refit(spark, sf_dir):
    return models.refitted(_rows(spark, sf_dir), FEATURES, "AF", 0.3, 0.5).select("event", "AF", "p")


@query()
def train_pca(spark, sf_dir):
    rows = panel.scan(spark, sf_dir, "embeddings")
    return models.train_components(rows.where("vec_id % 5 <> 0"), rows, "embedding").select("vec_id", F.size("pc").alias("components"), "pc")
