"""Audits of splits, runs and scores: what leaks, what overfits, what has not converged.

Everything is aggregates and equi-joins; windows span one group whose size the
data model bounds (folds, epochs of a run, labels).
"""

from __future__ import annotations

from math import pi, prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneflow.functions.expressions import bucket_hash
from paneflow.operators import evaluate


def curated(prevalence: DataFrame, least_measured: float = 0.5, least_prevalence: float = 0.05) -> DataFrame:
    """Labels that are measured and present often enough to be learned."""
    return prevalence.where((F.col("measured_share") >= least_measured) & (F.col("prevalence") >= least_prevalence))


def ranked(importance: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """``importance`` by falling absolute ``value``, names on ties; ``top`` keeps the first, without a full sort."""
    ordered = importance.orderBy(F.desc(F.round(F.abs(value), 9)), *[c for c in importance.columns if c != value])
    return ordered.limit(top) if top else ordered


def family_share(importance: DataFrame, name: str, value: str, families: dict[str, str]) -> DataFrame:
    """family, share: the share of all importance that columns of a family hold, by name prefix; others are 'other'."""
    family = F.coalesce(*(F.when(F.col(name).startswith(prefix), F.lit(label)) for prefix, label in families.items()), F.lit("other"))
    sums = importance.groupBy(family.alias("family")).agg(F.sum(F.abs(value)).alias("held"))
    total = sums.agg(F.sum("held")).scalar()
    return sums.select("family", F.try_divide(F.col("held"), total).alias("share"))


def cumulative_cut(variances: DataFrame, value: str, key: str, share: float = 0.95) -> DataFrame:
    """k: the fewest components whose variances, largest first, hold ``share`` of all. One row per component."""
    order = Window.orderBy(F.desc(value), key)
    upto = F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = variances.agg(F.sum(value)).scalar()
    placed = variances.select(F.row_number().over(order).alias("k"), (upto >= F.lit(share) * total).alias("enough"))
    return placed.where("enough").agg(F.min("k").alias("k"))


def gap(fit: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    """key, fit, held, gap: a metric on training rows minus the same on held rows."""
    both = fit.select(key, F.col(value).alias("fit")).join(held.select(key, F.col(value).alias("held")), key)
    return both.withColumn("gap", F.col("fit") - F.col("held"))


def run_flags(history: DataFrame, run: str, epoch: str, metric: str, tail: float = 0.2, early: float = 0.15, flat: float = 0.02) -> DataFrame:
    """run, epochs, best_epoch, unconverged, undertrained, from one row per epoch of a run.

    Unconverged: the best epoch lies in the last ``tail`` of the run. Undertrained: it
    lies in the first ``early``, and the metric moves by less than ``flat`` of its largest value.
    """
    best = F.max(F.struct(F.round(metric, 9).alias("m"), (-F.col(epoch)).alias("e")))
    found = history.groupBy(run).agg(F.count("*").alias("epochs"), F.min(epoch).alias("low"), F.max(epoch).alias("high"), (-best["e"]).alias("best_epoch"), F.max(metric).alias("most"), F.min(metric).alias("least"))
    span = (F.col("high") - F.col("low")).cast("double")
    place = F.coalesce(F.try_divide((F.col("best_epoch") - F.col("low")).cast("double"), span), F.lit(1.0))
    moved = F.try_divide(F.col("most") - F.col("least"), F.abs("most"))
    return found.select(run, "epochs", "best_epoch", (place >= 1 - tail).cast("int").alias("unconverged"), F.coalesce((place <= early) & (moved < flat), F.lit(False)).cast("int").alias("undertrained"))


def group_codes(rows: DataFrame, group: str, label: str, fold: str, smooth: float = 20.0) -> DataFrame:
    """``rows`` with ``p``: the smoothed mean of a group's label over the rows of other folds; the overall mean where there are none.

    ``p`` has six digits, so groups that differ by less tie in a ranking.
    """
    own = rows.groupBy(group, fold).agg(F.count(label).alias("n"), F.sum(label).alias("s"))
    whole = own.groupBy(group).agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    totals = own.groupBy(fold).agg(F.sum("n").alias("n_fold"), F.sum("s").alias("s_fold"))
    every = own.agg(F.sum("n")).scalar(), own.agg(F.sum("s")).scalar()
    prior = F.lit(smooth) * (every[1] - F.col("s_fold")).cast("double") / (every[0] - F.col("n_fold"))
    n, s = F.col("n_all") - F.col("n"), F.col("s_all") - F.col("s")
    # as SQL engines round: the product to the nearest whole number, halves away from zero
    code = F.round((s + prior) / (n + F.lit(smooth)) * F.lit(1e6)) / F.lit(1e6)
    codes = own.join(whole, group).join(F.broadcast(totals), fold).select(group, fold, code.alias("p"))
    return rows.join(codes, [group, fold])


def arm_gap(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The AUC of two scored arms (y, p) side by side, and what the first gains."""
    a = evaluate.roc_auc(left).agg(F.first("auc").alias(names[0]))
    b = evaluate.roc_auc(right).agg(F.first("auc").alias(names[1]))
    return a.crossJoin(b).withColumn("gain", F.col(names[0]) - F.col(names[1]))  # one row each


def random_pairs(n_pairs: int, keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """src, dst: seeded random pairs of ``keys``, whose values are 1 ... n; pairs of one with itself go."""
    spark = keys.sparkSession
    n = keys.agg(F.max(key)).scalar()
    i = F.col("id")
    at = [F.pmod(bucket_hash(i, seed + k) * F.lit(31) + bucket_hash(i, seed + 7 + k), n) + 1 for k in (0, 1)]
    return spark.range(n_pairs).select(at[0].alias("src"), at[1].alias("dst")).where("src <> dst")


def equirectangular_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane of 111 km a degree, longitudes shrunk at the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(111.0) * F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(dx, 2))


def shared_keys(rows: DataFrame, key: str, fold: str) -> DataFrame:
    """fold, shared: keys of a fold's rows that stand in other folds too."""
    each = rows.groupBy(key).agg(F.collect_set(fold).alias("folds"))
    return each.select(F.explode("folds").alias("fold"), (F.size("folds") > 1).cast("long").alias("more")).groupBy("fold").agg(F.sum("more").alias("shared"))


def student_p(t: Column, df: int) -> Column:
    """The two-sided p of Student's t with a whole number of degrees of freedom, as the finite series."""
    angle = F.atan(F.abs(t) / F.sqrt(F.lit(float(df))))
    sine, cosine = F.sin(angle), F.cos(angle)
    if df % 2:
        terms = [F.lit(prod(range(2, k, 2)) / prod(range(3, k + 1, 2))) * F.pow(cosine, k) for k in range(1, df - 1, 2)]
        inside = F.lit(2 / pi) * (angle + sine * sum(terms, F.lit(0.0)))
    else:
        terms = [F.lit(prod(range(1, k, 2)) / prod(range(2, k + 1, 2))) * F.pow(cosine, k) for k in range(2, df - 1, 2)]
        inside = sine * sum(terms, F.lit(1.0))
    return 1 - inside


#: Up to so many pairs the p of signed ranks is exact; beyond, the normal form with the ties' correction.
EXACT_PAIRS = 100


def signed_rank_p(folds: DataFrame, a: str, b: str, least: int = 4) -> DataFrame:
    """n_pairs, w, p: the two-sided p of the signed ranks; null for fewer than ``least`` pairs.

    All 2**n signs are counted by their rank sums, one rank after the other: a rank adds to a sum or
    does not. Ranks are doubled, as tied ones may be halves.
    """
    rows = folds.select(F.round(F.col(a) - F.col(b), 9).alias("d")).where("d <> 0")
    size = F.abs("d")
    mean = F.rank().over(Window.orderBy(size)) + (F.count("*").over(Window.partitionBy(size)) - 1) / 2.0  # one row per pair of runs
    held = rows.withColumn("r", mean).agg(F.count("*").alias("n_pairs"), F.collect_list((2 * F.col("r")).cast("int")).alias("ranks"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("plus"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("all"), F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("squares"))
    held = held.withColumn("w", F.least(F.col("plus"), F.col("all") - F.col("plus")))
    total = (2 * F.col("all")).cast("int")
    start = F.transform(F.sequence(F.lit(0), total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    chance = F.aggregate("ranks", start, lambda held, r: F.transform(held, lambda v, s: 0.5 * v + 0.5 * F.when(s >= r, F.get(held, s - r)).otherwise(0.0)))
    tail = F.aggregate(F.transform(chance, lambda v, s: F.when(F.least(s, total - s) <= 2 * F.col("w"), v).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    z = F.least(F.lit(0.0), F.try_divide(F.col("w") - F.col("all") / 2, F.sqrt(F.col("squares") / 4)))
    p = F.when(F.col("n_pairs") < least, None).when(F.col("n_pairs") <= EXACT_PAIRS, tail).otherwise(2 * normal_cdf(z))
    return held.select("n_pairs", "w", p.alias("p"))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function at z <= 0, by Gauss-Legendre steps of the density down from z; within 1e-12."""
    # The nodes and weights of the 5-point rule on [-1, 1].
    nodes = ((0.0, 0.5688888888888889), (0.5384693101056831, 0.47862867049936647), (-0.5384693101056831, 0.47862867049936647), (0.906179845938664, 0.23692688505618908), (-0.906179845938664, 0.23692688505618908))
    half = 0.125
    step = lambda i: sum((F.lit(w) * F.exp(-F.pow(z - half * (2 * i + 1) + F.lit(half * x), 2) / 2) for x, w in nodes[1:]), F.lit(nodes[0][1]) * F.exp(-F.pow(z - half * (2 * i + 1), 2) / 2))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(47)), step), F.lit(0.0), lambda x, y: x + y) * F.lit(half) / F.sqrt(2 * F.pi())
