"""Exact ranking, threshold and calibration metrics of scored rows (y, p), per group.

Rows are first summed by distinct score, as it stands. Scores are then dealt into ranges:
what a ranking needs of other ranges is sums, so no window orders more than one range.
NaN scores count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneflow.operators.quantiles import at_ranks, before, ranged
from paneflow.operators.tables import settled


def _known(rows: DataFrame) -> DataFrame:
    return rows.where("p is not null and not isnan(p)")


def by_score(rows: DataFrame, *group: str) -> DataFrame:
    """group, p, n1, n0: positives and negatives of each distinct score."""
    return _known(rows).groupBy(*group, F.col("p").cast("double").alias("p")).agg(F.sum("y").cast("long").alias("n1"), F.sum(1 - F.col("y")).cast("long").alias("n0"))


def _auc(scores: DataFrame, *group: str) -> DataFrame:
    """group, n, auc from (group, p, n1, n0): wins inside a range, and against the negatives of all ranges below."""
    below = F.coalesce(F.sum("n0").over(Window.partitionBy(*group, "_bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = ranged(scores, "p").withColumn("wins", 2 * wide("n1") * below + wide("n1") * F.col("n0"))
    sums = ranked.groupBy(*group, "_bin").agg(*(F.sum(c).alias(c) for c in ("n1", "n0", "wins")))
    whole = before(sums, list(group), ["n0"]).withColumn("wins", F.col("wins").cast("double") + 2.0 * F.col("n1") * F.col("n0_before"))
    pairs = 2.0 * F.sum("n1") * F.sum("n0")
    return whole.groupBy(*group).agg((F.sum("n1") + F.sum("n0")).alias("n"), F.try_divide(F.sum("wins"), pairs).alias("auc"))


def roc_auc(rows: DataFrame, *group: str) -> DataFrame:
    """group, n, auc: ties count half; null with one class."""
    return _auc(by_score(rows, *group), *group)


def average_precision(rows: DataFrame, *group: str) -> DataFrame:
    """group, ap: the step rule over distinct scores."""
    binned = ranged(by_score(rows, *group), "p")
    sums = before(binned.groupBy(*group, "_bin").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), list(group), ["n1", "n0"], falling=True)
    upto = Window.partitionBy(*group, "_bin").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.withColumns({"tp": F.sum("n1").over(upto), "seen": F.sum(F.col("n1") + F.col("n0")).over(upto)})
    ranked = ranked.join(sums.select(*group, "_bin", F.col("n1_before").alias("b1"), F.col("n0_before").alias("b0")), [*group, "_bin"])
    gain = F.sum(F.col("n1") * F.try_divide((F.col("tp") + F.col("b1")).cast("double"), (F.col("seen") + F.col("b1") + F.col("b0")).cast("double")))
    return ranked.groupBy(*group).agg(F.try_divide(gain, F.sum("n1").cast("double")).alias("ap"))


def confusion(rows: DataFrame, threshold: Column, *group: str) -> DataFrame:
    hit = (F.col("p") >= threshold).cast("int")
    return _known(rows).groupBy(*group).agg(
        F.sum(F.col("y") * hit).alias("tp"), F.sum((1 - F.col("y")) * hit).alias("fp"), F.sum(F.col("y") * (1 - hit)).alias("fn"), F.sum((1 - F.col("y")) * (1 - hit)).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Confusion counts with f1, precision, recall, accuracy, balanced_accuracy; 0 for an empty division."""

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"f1": share(2 * tp, 2 * tp + fp + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "accuracy": share(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (share(tp, tp + fn) + share(tn, tn + fp)) / 2})


def _grid(steps: int, low: float, high: float) -> list[float]:
    return [round(low + i * (high - low) / (steps - 1), 6) for i in range(steps)]


def _reached(rows: DataFrame, grid: list[float], *group: str) -> DataFrame:
    """group, reached, n1, n0: rows by how many thresholds of the grid they reach, so a group has a bounded number of counts."""
    low, steps = grid[0], len(grid)
    p, ts = F.col("p").cast("double"), F.array(*map(F.lit, grid))
    near = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor((p - low) * F.lit((steps - 1) / (grid[-1] - low))).cast("int")))
    # the nearest step may be one off: of the few around, as many as are reached
    first = F.greatest(near - 1, F.lit(0))
    reached = first + F.size(F.filter(F.slice(ts, first + 1, F.lit(4)), lambda t: t <= p))
    return _known(rows).groupBy(*group, reached.alias("reached")).agg(F.sum("y").cast("long").alias("n1"), F.sum(1 - F.col("y")).cast("long").alias("n0"))


def _best(reached: DataFrame, grid: list[float], metric: str, *group: str) -> DataFrame:
    """group, t, metric: the first maximum, from counts by :func:`_reached`."""
    steps = F.explode(F.transform(F.array(*map(F.lit, grid)), lambda t, i: F.struct(i.alias("i"), t.alias("t"))))
    each = reached.withColumn("s", steps).select(*group, "n1", "n0", (F.col("reached") > F.col("s.i")).cast("int").alias("hit"), F.col("s.t").alias("t"))
    counts = each.groupBy(*group, "t").agg(*(F.sum(F.col(n) * (F.col("hit") if on else 1 - F.col("hit"))).alias(c) for c, n, on in (("tp", "n1", 1), ("fp", "n0", 1), ("fn", "n1", 0), ("tn", "n0", 0))))
    best = Window.partitionBy(*group).orderBy(F.desc(F.round(metric, 9)), "t")
    return rates(counts).withColumn("place", F.row_number().over(best)).where("place = 1").select(*group, "t", metric)


def threshold_search(rows: DataFrame, steps: int = 81, low: float = 0.1, high: float = 0.9, *group: str, metric: str = "f1") -> DataFrame:
    """group, t and a rate of :func:`rates`: its first maximum on a grid of ``steps`` thresholds."""
    grid = _grid(steps, low, high)
    return _best(_reached(rows, grid, *group), grid, metric, *group)


def crossed_thresholds(rows: DataFrame, fold: str, *group: str, steps: int = 81, low: float = 0.1, high: float = 0.9, metric: str = "f1") -> DataFrame:
    """group, fold, t, metric: the threshold for each fold, chosen on the rows of the group's other folds; none where those have no rows.

    A fold's counts are the total less its own, so rows are counted once.
    """
    grid = _grid(steps, low, high)
    own = _reached(rows, grid, *group, fold)
    every = own.groupBy(*group, "reached").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    folds = own.select(*group, fold).distinct()
    sums = (folds.join(every, list(group)) if group else folds.crossJoin(every)).unionByName(own.select(*group, fold, "reached", (-F.col("n1")).alias("n1"), (-F.col("n0")).alias("n0")))
    other = sums.groupBy(*group, fold, "reached").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where("n1 + n0 > 0")
    return _best(other, grid, metric, *group, fold)


def reliability(rows: DataFrame, bins: int = 10, *group: str) -> DataFrame:
    """group, bin, n, mean_p, mean_y: equal bins, the last one closed."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return _known(rows).groupBy(*group, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def expected_calibration_error(rows: DataFrame, bins: int = 10, *group: str) -> DataFrame:
    found = reliability(rows, bins, *group)
    return found.groupBy(*group).agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))), F.sum("n")).alias("ece"))


def topk_gain(rows: DataFrame, percents: tuple[int, ...], key: str) -> DataFrame:
    """percent, k, gain, lift: share of all positives among the best-scored percent, ties by key.

    Sums of ranges tell in which range each percent is full, that range's scores at which score,
    and the key of the last row is an order statistic of the rows of that score. So neither all
    scores, nor all rows, nor those of one score are ranked in one task.
    """
    size = F.col("n1") + F.col("n0")
    binned = settled(ranged(by_score(rows).withColumn("size", size), "p"))  # each step below reads it
    sums = before(binned.groupBy("_bin").agg(F.sum("size").alias("size"), F.sum("n1").alias("n1")), [], ["size", "n1"], falling=True)  # one row per range
    n, positives = binned.agg(F.sum("size")).scalar(), binned.agg(F.sum("n1")).scalar()
    each = sums.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("k", F.greatest(F.lit(1), F.floor(n * F.col("percent") / 100)).cast("long"))
    full = each.where((F.col("k") > F.col("size_before")) & (F.col("k") <= F.col("size_before") + F.col("size"))).select("percent", "k", "_bin", "size_before", "n1_before")
    order = Window.partitionBy("_bin").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    upto = binned.withColumns({"upto": F.sum("size").over(order), "hits": F.sum("n1").over(order)}).join(F.broadcast(full), "_bin")
    upto = upto.withColumns({"upto": F.col("upto") + F.col("size_before"), "hits": F.col("hits") + F.col("n1_before")})
    cuts = upto.where((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("size"))).select("percent", "k", "p", (F.col("hits") - F.col("n1")).alias("above"), (F.col("k") - F.col("upto") + F.col("size") - 1).alias("rank"))
    tied = _known(rows).select(F.col("p").cast("double").alias("p"), F.col(key).alias("x"), "y").join(F.broadcast(cuts.select("p").distinct()), "p")
    last = at_ranks(tied.groupBy("p", "x").agg(F.count("*").alias("n")), ["p"], cuts.select("p", F.col("percent").alias("name"), "rank"))
    last = cuts.join(last.select(F.col("name").alias("percent"), F.col("x").alias("last")), "percent")
    inside = tied.join(F.broadcast(last.select("percent", "p", "last")), "p").where(F.col("x") <= F.col("last")).groupBy("percent").agg(F.sum("y").alias("among"))
    hits = last.join(inside, "percent").select("percent", "k", (F.col("above") + F.col("among")).alias("hits"), positives.alias("positives"))
    gain = F.try_divide(F.col("hits").cast("double"), F.col("positives").cast("double"))
    return hits.select("percent", "k", gain.alias("gain"), (gain / (F.col("percent") / 100.0)).alias("lift"))


def bootstrap_auc(rows: DataFrame, entity: str, replicates: int = 20) -> DataFrame:
    """replicate, auc: whole entities drawn with replacement by a seeded Poisson(1) weight."""
    from paneflow.functions.expressions import bucket_hash

    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.pmod(bucket_hash(F.col(entity), 1) * F.lit(69_621) + (F.col("replicate") + 1) * F.lit(16_807), F.lit(1_000_003))
    # cumulative Poisson(1) in units of 1 / 1000003
    weight = F.when(u < 367_880, 0).when(u < 735_761, 1).when(u < 919_701, 2).when(u < 981_014, 3).otherwise(4)
    weighted = _known(drawn).withColumn("w", weight).where("w > 0")
    return _auc(weighted.groupBy("replicate", F.col("p").cast("double").alias("p")).agg(F.sum(F.col("y") * F.col("w")).cast("long").alias("n1"), F.sum((1 - F.col("y")) * F.col("w")).cast("long").alias("n0")), "replicate").drop("n")


def bootstrap_interval(rows: DataFrame, entity: str, replicates: int = 300) -> DataFrame:
    """replicates, low, high: the 2.5 and 97.5 percentiles of the replicates' AUC."""
    auc = bootstrap_auc(rows, entity, replicates)
    return auc.agg(F.count("auc").alias("replicates"), F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"))


def corrected_t(folds: DataFrame, a: str, b: str, test_to_train: float) -> DataFrame:
    """n_folds, mean_gain, t: paired differences with the variance corrected for overlapping training sets."""
    d = F.col(a) - F.col(b)
    k = F.count(d)
    spread = F.sqrt((F.try_divide(F.lit(1.0), k) + F.lit(test_to_train)) * F.var_samp(d))
    return folds.agg(k.alias("n_folds"), F.avg(d).alias("mean_gain"), F.try_divide(F.avg(d), spread).alias("t"))


def signed_rank(folds: DataFrame, a: str, b: str) -> DataFrame:
    """n_pairs, w: Wilcoxon's statistic over the non-zero differences, tied ones sharing their mean rank."""
    rows = folds.select(F.round(F.col(a) - F.col(b), 9).alias("d")).where("d <> 0")
    # one row per fold: a handful, so one window over all is bounded
    size = F.abs("d")
    mean = F.rank().over(Window.orderBy(size)) + (F.count("*").over(Window.partitionBy(size)) - 1) / 2.0
    ranked = rows.withColumn("r", mean)
    plus, minus = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("r"))), F.lit(0.0))
    return ranked.agg(F.count("*").alias("n_pairs"), F.least(plus, minus).alias("w"))
