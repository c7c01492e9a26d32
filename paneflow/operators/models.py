"""MLlib estimators over fold tables: out-of-fold scores, label order, calibration, components.

Fits are driver loops over a fixed number of folds and labels; the rows stay in
Spark. Scores of a single-class training slice are its constant.
"""

from __future__ import annotations

import random
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from paneflow.functions.expressions import entropy
from paneflow.operators import evaluate
from paneflow.operators.features import permuted
from paneflow.operators.tables import settled


def _constant(train: DataFrame, label: str) -> float | None:
    """The score of a slice that cannot be fitted, else None."""
    n, s = train.agg(F.count(label), F.sum(label)).first()
    return None if n and 0 < s < n else (float(s or 0) / n if n else 0.5)


#: Fits of folds that are submitted at once.
AT_ONCE = 4
#: Estimators by name: a function of (label, parameters).
ESTIMATORS = {
    "lr": lambda label, **given: LogisticRegression(featuresCol="_x", labelCol=label, **({"maxIter": 20, "regParam": 0.01} | given)),
    "forest": lambda label, **given: RandomForestClassifier(featuresCol="_x", labelCol=label, seed=42, **({"numTrees": 20, "maxDepth": 5} | given)),
    "boosted": lambda label, **given: GBTClassifier(featuresCol="_x", labelCol=label, seed=42, **({"maxIter": 8, "maxDepth": 3} | given)),
}


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error").transform(rows)


def _fitted(train: DataFrame, label: str, kind: str, weight: str | None, given: dict):
    """A model of assembled rows, or the constant of a slice that cannot be fitted."""
    if (p := _constant(train, label)) is not None:
        return p
    return _model(train, label, kind, given | ({"weightCol": weight} if weight else {}))


def _model(train: DataFrame, label: str, kind: str, given: dict):
    return ESTIMATORS[kind](label, **given).fit(train).setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_probability")


def _fold_constants(rows: DataFrame, label: str, fold: str, folds: list) -> dict:
    """The score of each fold's training rows that cannot be fitted, else None: one pass, a fold's training counts are the total less its own."""
    own = {r[0]: (r[1], r[2] or 0) for r in rows.groupBy(fold).agg(F.count(label), F.sum(label)).collect()}
    n, s = (sum(c[i] for c in own.values()) for i in (0, 1))
    left = {f: (n - own.get(f, (0, 0))[0], s - own.get(f, (0, 0))[1]) for f in folds}
    return {f: None if m and 0 < t < m else (float(t) / m if m else 0.5) for f, (m, t) in left.items()}


def _with_scores(model, rows: DataFrame, name: str) -> DataFrame:
    if isinstance(model, float):
        return rows.withColumn(name, F.lit(model))
    return model.transform(rows).withColumn(name, vector_to_array("_probability")[1]).drop("_probability")


def _logistic(model: LogisticRegressionModel, features: list[str]) -> Column:
    """The score of a fitted logistic regression, from the features' own columns; one that is missing is refused, as by the assembler."""
    margin = F.lit(float(model.intercept))
    for c, w in zip(features, model.coefficients, strict=True):
        margin = margin + F.lit(float(w)) * F.col(c).cast("double")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return F.when(p.isNotNull() & ~F.isnan(p), p).otherwise(F.raise_error(F.lit(f"a feature is missing among {', '.join(features)}")).cast("double"))


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, weight: str | None = None, kind: str = "lr", **given) -> DataFrame:
    """``test`` with ``p``: an estimator fitted on the rows of ``train``."""
    return _with_scores(_fitted(_assembled(train, features), label, kind, weight, given), _assembled(test, features), "p").drop("_x")


def out_of_fold(rows: DataFrame, features: list[str], label: str, folds, fold: str = "fold", kind: str = "lr", **given) -> DataFrame:
    """Every row scored by the model of the other ``folds`` (a number of them, or a list), learned where the label is known.

    All models are applied in one pass over the rows, and each row keeps the score of its
    fold's, so the plan does not grow with every fold's copy of the rows. Logistic regressions are
    expressions of the features, of which a row computes its fold's alone: a chain reads them again and again.
    """
    listed = list(range(folds)) if isinstance(folds, int) else list(folds)
    out = _assembled(rows, features)
    train = out.where(F.col(label).isNotNull())
    constants = _fold_constants(train, label, fold, listed)

    def fit(f):
        return constants[f] if constants[f] is not None else _model(train.where(F.col(fold) != f), label, kind, given)

    # fits wait for many small jobs: some go on at once
    with ThreadPool(min(AT_ONCE, max(1, len(listed)))) as pool:
        models = dict(zip(listed, pool.map(inheritable_thread_target(rows.sparkSession)(fit), listed), strict=True))
    scores = {}
    for f, model in models.items():
        if isinstance(model, LogisticRegressionModel):
            scores[f] = _logistic(model, features)
        else:
            out, scores[f] = _with_scores(model, out, f"_p{f}"), F.col(f"_p{f}")
    own = F.coalesce(*(F.when(F.col(fold) == f, scores[f]) for f in listed))
    return out.withColumn("p", own).drop("_x", *(f"_p{f}" for f in listed))


def binary_relevance(rows: DataFrame, features: list[str], labels: list[str], k: int) -> DataFrame:
    """event, label, fold, y, p: one model per label on its measured rows."""
    out = None
    for label in labels:
        part = out_of_fold(rows.where(F.col(label).isNotNull()), features, label, k).select("event", F.lit(label).alias("label"), "fold", F.col(label).alias("y"), "p")
        out = part if out is None else out.unionByName(part)
    return out


def chain_order(rows: DataFrame, labels: list[str]) -> list[str]:
    """Labels by training prevalence, highest first, names on ties."""
    found = rows.agg(*(F.avg(c).alias(c) for c in labels)).first()
    return sorted(labels, key=lambda c: (-(found[c] or 0.0), c))


def pseudo_labels(scored: DataFrame, label: str, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """``scored`` (label null where not measured, p) with calibrated p and ``pseudo``: confident labels for the rest."""
    known = scored.where(F.col(label).isNotNull())
    model = IsotonicRegression(labelCol=label, featuresCol="p").fit(known.select(F.col(label).cast("double").alias(label), "p"))
    rows = model.transform(scored).withColumnRenamed("prediction", "calibrated")
    sure = F.when(F.col("calibrated") >= high, 1).when(F.col("calibrated") <= low, 0)
    return rows.withColumn("pseudo", F.when(F.col(label).isNull(), sure))


def components(rows: DataFrame, column: str, k: int) -> DataFrame:
    """``rows`` with ``pc``, the first k principal components of an array column (signs are arbitrary)."""
    from pyspark.ml.functions import array_to_vector

    x = rows.withColumn("_x", array_to_vector(F.col(column).cast("array<double>")))
    return PCA(k=k, inputCol="_x", outputCol="_pc").fit(x).transform(x).withColumn("pc", vector_to_array("_pc")).drop("_x", "_pc")


def chain(rows: DataFrame, features: list[str], labels: list[str], k: int, key: str = "event") -> DataFrame:
    """key, label, fold, y, p: each label learns from the earlier ones' out-of-fold scores and from whether they were measured.

    A row without a measured label is scored for the labels behind, but not returned for it.
    """
    held, known, out = rows, list(features), None
    for label in labels:
        held = out_of_fold(held, known, label, k).withColumnRenamed("p", f"p_{label}").withColumn(f"m_{label}", F.col(label).isNotNull().cast("double"))
        known += [f"p_{label}", f"m_{label}"]
        part = held.where(F.col(label).isNotNull()).select(key, F.lit(label).alias("label"), "fold", F.col(label).alias("y"), F.col(f"p_{label}").alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


def by_outer(rows: DataFrame, features: list[str], key: str = "entity", kind: str = "lr", **given) -> DataFrame:
    """key, block, y, p: for each ``outer`` block, its own rows scored by a model of the other blocks' rows under that outer block.

    ``rows`` has outer, block, y and features that may differ by outer block (:func:`encoder.hybrid_features`).
    """
    out = None
    for outer in [r.outer for r in rows.select("outer").distinct().orderBy("outer").limit(64).collect()]:
        own = rows.where(F.col("outer") == F.lit(outer))
        part = fit_predict(own.where((F.col("block") != F.lit(outer)) & F.col("y").isNotNull()), own.where(F.col("block") == F.lit(outer)), features, "y", kind=kind, **given).select(key, "block", "y", "p")
        out = part if out is None else out.unionByName(part)
    return out


def ensemble(scores: list[DataFrame], key: str = "event") -> DataFrame:
    """key, label, fold, y, p: the mean score over several chains."""
    every = reduce(DataFrame.unionByName, scores)
    return every.groupBy(key, "label", "fold", "y").agg(F.avg("p").alias("p"))


def label_classes(rows: DataFrame, labels: list[str], classes: int = 4) -> list[list[str]]:
    """Labels by falling prevalence in at most ``classes`` groups of even size: a chain goes from group to group."""
    ordered = chain_order(rows, labels)
    size = -(-len(ordered) // classes)
    return [ordered[i : i + size] for i in range(0, len(ordered), size)]


def random_search(rows: DataFrame, features: list[str], label: str, folds: list[int], kind: str, space: dict[str, list], draws: int, seed: int = 42) -> tuple[dict, float]:
    """The best of some seeded draws of parameters by the mean AUC over ``folds`` (those of one class count as none)."""
    chosen, best = {}, -1.0
    rng = random.Random(seed)
    for _ in range(draws):
        given = {name: rng.choice(values) for name, values in space.items()}
        scored = out_of_fold(rows.where(F.col("fold").isin(folds)), features, label, folds, kind=kind, **given).select("fold", F.col(label).alias("y"), "p")
        mean = evaluate.roc_auc(scored, "fold").agg(F.coalesce(F.avg("auc"), F.lit(0.5))).first()[0]
        if mean > best:
            chosen, best = given, float(mean)
    return chosen, best


def nested(rows: DataFrame, features: list[str], label: str, k: int, kind: str, space: dict[str, list], draws: int) -> DataFrame:
    """fold, y, p, threshold, inner_auc: per outer fold, parameters and threshold from the others alone, one refit, one scoring."""
    out = None
    for f in range(k):
        inner = [g for g in range(k) if g != f]
        given, mean = random_search(rows, features, label, inner, kind, space, draws, seed=42 + f)
        train = rows.where(F.col("fold") != f)
        fitted = out_of_fold(train.where(F.col("fold").isin(inner)), features, label, inner, kind=kind, **given)
        found = evaluate.threshold_search(fitted.select(F.col(label).alias("y"), "p")).first()
        part = fit_predict(train, rows.where(F.col("fold") == f), features, label, kind=kind, **given)
        part = part.select("event", "fold", F.col(label).alias("y"), "p", F.lit(float(found.t)).alias("threshold"), F.lit(mean).alias("inner_auc"))
        out = part if out is None else out.unionByName(part)
    return out


def backbone(rows: DataFrame, features: list[str], label: str, k: int, kinds: tuple[str, ...] = ("lr", "forest", "boosted"), key: str = "event") -> DataFrame:
    """key, fold, y and one out-of-fold score per estimator: what fusion and stacking share."""
    out = rows.select(key, "fold", *features, F.col(label).alias("_y"))
    for kind in kinds:
        # no fit reads the scores before it, so they are not computed for it
        out = out_of_fold(out, features, "_y", k, kind=kind).withColumnRenamed("p", f"p_{kind}")
    return out.select(key, "fold", F.col("_y").alias("y"), *(f"p_{kind}" for kind in kinds))


def stacked(base: DataFrame, k: int, kinds: tuple[str, ...] = ("lr", "forest", "boosted")) -> DataFrame:
    """``base`` with meta-features of its scores and ``p``, a logistic regression over them by fold.

    The scores are computed once, as every fit reads them twice and more.
    """
    ps = [F.col(f"p_{kind}") for kind in kinds]
    mean = sum(ps[1:], ps[0]) / len(ps)
    spread = F.sqrt(sum(((p - mean) * (p - mean) for p in ps[1:]), (ps[0] - mean) * (ps[0] - mean)) / len(ps))
    made = {"mean": mean, "spread": spread, "doubt": sum((entropy(p) for p in ps[1:]), entropy(ps[0])) / len(ps)}
    made |= {f"gap_{a}_{b}": F.abs(F.col(f"p_{a}") - F.col(f"p_{b}")) for i, a in enumerate(kinds) for b in kinds[i + 1 :]}
    rows = settled(base).withColumns(made)
    return out_of_fold(rows, [*(f"p_{kind}" for kind in kinds), *made], "y", k)


def platt(scored: DataFrame, k: int) -> DataFrame:
    """``scored`` (y, p, fold) with ``p_cal``: a one-dimensional logistic regression on the other folds' scores."""
    rows = scored.withColumnRenamed("p", "raw")
    return out_of_fold(rows, ["raw"], "y", k, regParam=0.0).withColumnsRenamed({"p": "p_cal", "raw": "p"})


def permutation_importance(rows: DataFrame, features: list[str], key: str, predict) -> DataFrame:
    """name, drop: the AUC of ``predict`` (rows -> rows with y, p) less that with one feature permuted."""
    arms = [predict(rows).select(F.lit("").alias("name"), "y", "p")]
    arms += [predict(permuted(rows, c, key)).select(F.lit(c).alias("name"), "y", "p") for c in features]
    found = evaluate.roc_auc(reduce(DataFrame.unionByName, arms), "name")
    whole = found.where("name = ''").agg(F.first("auc")).scalar()
    return found.where("name <> ''").select("name", (whole - F.col("auc")).alias("drop"))


def refitted(rows: DataFrame, features: list[str], label: str, low: float = 0.15, high: float = 0.85, key: str = "event") -> DataFrame:
    """``rows`` with ``p`` of a model refitted on measured rows and on confident pseudo-labels of the others."""
    first = fit_predict(rows.where(F.col(label).isNotNull()), rows, features, label)
    sure = pseudo_labels(first, label, low, high).withColumn(label, F.coalesce(label, "pseudo")).where(F.col(label).isNotNull())
    return fit_predict(sure.select(key, label, *features), rows, features, label)


def train_components(train: DataFrame, rows: DataFrame, column: str, share: float = 0.95, most: int = 64) -> DataFrame:
    """``rows`` with ``pc``: components of the training rows alone, the fewest that hold ``share`` of their variance."""
    from pyspark.ml.functions import array_to_vector

    vector = lambda df: df.withColumn("_x", array_to_vector(F.col(column).cast("array<double>")))
    width = train.select(F.size(column)).first()[0]
    model = PCA(k=min(most, width), inputCol="_x", outputCol="_pc").fit(vector(train))
    held, k = 0.0, 0
    for v in model.explainedVariance:
        held, k = held + v, k + 1
        if held >= share:
            break
    return model.transform(vector(rows)).withColumn("pc", F.slice(vector_to_array("_pc"), 1, k)).drop("_x", "_pc")
