"""Fold-aware features: all folds in one pass, statistics from training rows only.

``parts`` is rows with their own fold. A training statistic of fold f is the total
minus what fold f holds, so counts and sums need one aggregate, not one per fold.
Order statistics come from histograms that are shared by all folds (:mod:`quantiles`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneflow.functions.expressions import bucket_hash, month_cycle
from paneflow.operators.quantiles import quantiles, training_quantiles

MISSING = "__nan__"


def add_temporal(rows: DataFrame, ts: str = "ts") -> DataFrame:
    sine, cosine = month_cycle(F.col(ts))
    return rows.withColumns({"year": F.year(ts), "month_sin": sine, "month_cos": cosine})


def frequency_codes(parts: DataFrame, category: str, k: int) -> DataFrame:
    """fold, category, freq: its share of the training rows of each fold; unseen ones are 0 after a left join."""
    value = F.coalesce(F.col(category).cast("string"), F.lit(MISSING))
    own = parts.groupBy(value.alias("category"), "fold").agg(F.count("*").alias("n"))
    grid = own.groupBy("category").agg(F.sum("n").alias("all")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    train = grid.join(own, ["category", "fold"], "left").withColumn("train", F.col("all") - F.coalesce("n", F.lit(0)))
    totals = train.groupBy("fold").agg(F.sum("train").alias("total"))
    return train.where("train > 0").join(F.broadcast(totals), "fold").select("fold", "category", F.try_divide(F.col("train").cast("double"), F.col("total").cast("double")).alias("freq"))


def target_codes(parts: DataFrame, category: str, label: str, k: int, smooth: float = 20.0) -> DataFrame:
    """fold, category, code: the smoothed mean (n * mean + smooth * global) / (n + smooth) of training rows."""
    value = F.coalesce(F.col(category).cast("string"), F.lit(MISSING))
    own = parts.groupBy(value.alias("category"), "fold").agg(F.count(label).alias("n"), F.sum(label).alias("s"))
    every = own.groupBy("category").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    train = every.join(own, ["category", "fold"], "left").select("fold", "category", (F.col("n_all") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("s_all") - F.coalesce("s", F.lit(0))).alias("s"))
    totals = train.groupBy("fold").agg(F.try_divide(F.sum("s").cast("double"), F.sum("n").cast("double")).alias("overall"))
    code = (F.col("s") + F.lit(smooth) * F.col("overall")) / (F.col("n") + F.lit(smooth))
    return train.where("n > 0").join(F.broadcast(totals), "fold").select("fold", "category", code.alias("code"))


def target_codes_oof(parts: DataFrame, key: str, category: str, label: str, k: int, inner: int = 5, smooth: float = 20.0) -> DataFrame:
    """fold, key, code: training rows of each outer fold coded from the other inner folds alone.

    Two fold keys in one aggregate: sums per (outer own, inner own, category), the
    training sums of (f, i) being the total minus f's minus i's plus both.
    """
    value = F.coalesce(F.col(category).cast("string"), F.lit(MISSING))
    rows = parts.select(key, F.col("fold").alias("own"), F.pmod(bucket_hash(F.col(key), 13), F.lit(inner)).cast("int").alias("inner"), value.alias("category"), F.col(label).cast("long").alias("y"))
    sums = rows.groupBy("own", "inner", "category").agg(F.count("y").alias("n"), F.sum("y").alias("s"))
    outer = sums.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("fold <> own").groupBy("fold", "inner", "category").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    held = outer.groupBy("fold", "category").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    base = outer.groupBy("fold", "inner").agg(F.sum("n").alias("n_in"), F.sum("s").alias("s_in"))
    whole = base.groupBy("fold").agg(F.sum("n_in").alias("n_fold"), F.sum("s_in").alias("s_fold"))
    means = base.join(F.broadcast(whole), "fold").select("fold", "inner", F.try_divide((F.col("s_fold") - F.col("s_in")).cast("double"), (F.col("n_fold") - F.col("n_in")).cast("double")).alias("mean"))
    coded = outer.join(held, ["fold", "category"]).join(F.broadcast(means), ["fold", "inner"])
    n, s = F.col("n_all") - F.col("n"), F.col("s_all") - F.col("s")
    coded = coded.select("fold", "inner", "category", F.when(n > 0, (s + F.lit(smooth) * F.col("mean")) / (n + F.lit(smooth))).otherwise(F.col("mean")).alias("code"))
    train = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("fold <> own")
    return train.join(coded, ["fold", "inner", "category"]).select("fold", key, "code")


def scale_stats(parts: DataFrame, column: str, k: int, log: bool = True, missing_over: float = 0.20) -> DataFrame:
    """fold, median, mean, sd, missing_share, indicator: of the training rows, after log1p and imputing."""
    x = F.col(column).cast("double")
    x = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0)))) if log else x
    counts = parts.select(F.col("fold").alias("own"), x.alias("x")).groupBy("own", "x").agg(F.count("*").alias("n"))
    medians = training_quantiles(counts.where("x is not null"), k, {"median": 0.5})
    known, n = F.col("x").isNotNull(), F.col("n")
    own = counts.groupBy("own").agg(F.sum(n).alias("rows"), F.sum(F.when(known, n).otherwise(0)).alias("held"), F.coalesce(F.sum(F.col("x") * n), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("x") * F.col("x") * n), F.lit(0.0)).alias("q"))
    # a handful of rows: one per fold, dealt to the other folds
    sums = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("fold <> own").groupBy("fold").agg(*(F.sum(c).alias(c) for c in ("rows", "held", "s", "q")))
    sums = sums.join(medians, "fold", "left")
    fill, gone = F.coalesce("median", F.lit(0.0)), F.col("rows") - F.col("held")
    mean = (F.col("s") + gone * fill) / F.col("rows")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") + gone * fill * fill) / F.col("rows") - mean * mean))
    stats = sums.select("fold", "median", (gone / F.col("rows")).alias("missing_share"), mean.alias("mean"), spread.alias("sd"))
    return stats.withColumn("sd", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)).withColumn("indicator", (F.col("missing_share") > missing_over).cast("int"))


def scaled(parts: DataFrame, stats: DataFrame, column: str, fold: int, log: bool = True) -> DataFrame:
    """Rows with ``scaled``: log1p, imputed and standardised by the statistics of ``fold``."""
    x = F.col(column).cast("double")
    x = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0)))) if log else x
    own = stats.where(F.col("fold") == fold).withColumnRenamed("fold", "_fold")
    rows = parts.withColumn("_fold", F.lit(fold)).join(F.broadcast(own), "_fold").drop("_fold")
    return rows.withColumn("scaled", (F.coalesce(x, F.col("median")) - F.col("mean")) / F.col("sd")).drop("median", "mean", "sd", "missing_share", "indicator")


def one_hot(parts: DataFrame, category: str, fold: int, limit: int = 64) -> DataFrame:
    """Rows with one column per level that the training rows of ``fold`` hold; other levels are all 0."""
    value = F.coalesce(F.col(category).cast("string"), F.lit(MISSING))
    levels = [r.v for r in parts.where(F.col("fold") != fold).select(value.alias("v")).distinct().orderBy("v").limit(limit + 1).collect()]
    if len(levels) > limit:
        raise ValueError(f"{category} has over {limit} levels: encode it by frequency or target")
    return parts.withColumns({f"{category}={v}": (value == v).cast("int") for v in levels})


def leak_guard(columns: list[str], blocked: set[str]) -> None:
    """Raise before any job where a feature is on the block list."""
    if bad := sorted(blocked.intersection(columns)):
        raise ValueError(f"blocked columns among the features: {', '.join(bad)}")


def feature_columns(families: dict[str, list[str]], on: dict[str, bool], blocked: set[str] = frozenset()) -> list[str]:
    """The columns of the families that are switched on, in the order given; blocked ones never."""
    return [c for name, columns in families.items() if on.get(name, True) for c in columns if c not in blocked]


def ablations(families: dict[str, list[str]], without: dict[str, set[str]]) -> dict[str, list[str]]:
    """Named column sets: all families but those that each set leaves out."""
    return {name: feature_columns(families, {f: False for f in gone}) for name, gone in without.items()}


@dataclass(frozen=True)
class Fitted:
    """What :func:`fit` learned from training rows; ``columns`` is the frozen order of the output."""

    key: str
    columns: list[str]
    numbers: dict[str, tuple[float, float, float, bool]]
    levels: dict[str, list[str]]
    codes: dict[str, tuple[DataFrame, float]]

    def transform(self, rows: DataFrame) -> DataFrame:
        """key and the feature columns of any rows; what training has not seen is 0, or the overall mean for codes.

        A table of codes has a row per level: it is broadcast only where Spark knows it to be small.
        """
        out = rows
        for c, (table, overall) in self.codes.items():
            value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            out = out.withColumn("_level", value).join(table, "_level", "left").withColumn(f"{c}_code", F.coalesce("_code", F.lit(overall))).drop("_level", "_code")
        made = {}
        for c, (median, mean, sd, indicator) in self.numbers.items():
            x = _logged(c)
            if indicator:
                made[f"{c}_missing"] = x.isNull().cast("int")
            made[f"{c}_scaled"] = (F.coalesce(x, F.lit(median)) - F.lit(mean)) / F.lit(sd)
        for c, found in self.levels.items():
            value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
            made |= {f"{c}={v}": (value == v).cast("int") for v in found}
        return out.withColumns(made).select(self.key, *self.columns)


def _logged(column: str):
    x = F.col(column).cast("double")
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def fit(train: DataFrame, key: str, numbers: list[str], onehot: list[str] = (), coded: list[str] = (), label: str | None = None, blocked: set[str] = frozenset(), missing_over: float = 0.20, smooth: float = 20.0, limit: int = 64, indicators: list[str] | None = None) -> Fitted:
    """Learn imputing, scaling, indicators, levels and target codes from training rows alone.

    Numbers take one pass for the medians of all columns and one for means and spreads; levels and
    codes one small table each, with at most ``limit`` levels of a one-hot column. A missing indicator
    goes with numbers that miss in over ``missing_over`` of the rows, or with those named in
    ``indicators``, so that the columns do not depend on the rows.
    """
    leak_guard([*numbers, *onehot, *coded], blocked | ({label} if label else set()))
    learned: dict[str, tuple[float, float, float, bool]] = {}
    if numbers:
        long = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), _logged(c).alias("x")) for c in numbers))).alias("v")).select("v.*")
        counts = long.groupBy("name", "x").agg(F.count("*").alias("n"))
        medians = dict.fromkeys(numbers, 0.0) | {r.name: r.median for r in quantiles(counts.where("x is not null"), ["name"], {"median": 0.5}).collect()}
        filled = {c: F.coalesce(_logged(c), F.lit(medians[c])) for c in numbers}
        second = train.agg(*(x for c in numbers for x in (F.avg(filled[c]).alias(f"{c}|a"), F.stddev_pop(filled[c]).alias(f"{c}|d"), F.avg(_logged(c).isNull().cast("int")).alias(f"{c}|s")))).first()
        marked = {c: (second[f"{c}|s"] or 0.0) > missing_over if indicators is None else c in indicators for c in numbers}
        learned = {c: (medians[c], second[f"{c}|a"] or 0.0, second[f"{c}|d"] or 1.0, marked[c]) for c in numbers}
    levels = {}
    for c in onehot:
        value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        levels[c] = [r.v for r in train.select(value.alias("v")).distinct().orderBy("v").limit(limit + 1).collect()]
        if len(levels[c]) > limit:
            raise ValueError(f"{c} has over {limit} levels: encode it by frequency or target")
    codes = {}
    for c in coded:
        value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        overall = float(train.agg(F.avg(label)).first()[0] or 0.0)
        sums = train.groupBy(value.alias("_level")).agg(F.sum(label).alias("s"), F.count(label).alias("n"))
        codes[c] = (sums.select("_level", ((F.col("s") + F.lit(smooth * overall)) / (F.col("n") + F.lit(smooth))).alias("_code")), overall)
    columns = [x for c in numbers for x in ([f"{c}_scaled", f"{c}_missing"] if learned[c][3] else [f"{c}_scaled"])]
    columns += [f"{c}={v}" for c in onehot for v in levels[c]] + [f"{c}_code" for c in coded]
    return Fitted(key, columns, learned, levels, codes)


def fuse(left: DataFrame, right: DataFrame, key: str, columns: list[str], block: str) -> DataFrame:
    """key, fused: numeric ``columns`` of one table beside the array ``block`` of another, for keys in both."""
    head = F.array(*(F.col(c).cast("double") for c in columns))
    return left.select(key, head.alias("_head")).join(right.select(key, F.col(block).cast("array<double>").alias("_tail")), key).select(key, F.concat("_head", "_tail").alias("fused"))


def oversampled(points: DataFrame, k: int, cap_km: float, seed: int = 17) -> DataFrame:
    """entity, lat, lon of one synthetic point per minority point: on the way to one of its ``k`` nearest, by seeded hashes.

    A point without a neighbour within ``cap_km`` gives none.
    """
    from paneflow.operators.graph import knn

    near = knn(points, k, cap_km)
    sizes = near.groupBy("src").agg(F.count("*").alias("n"))
    chosen = near.join(sizes, "src").where(F.col("place") == F.pmod(bucket_hash(F.col("src"), seed), F.col("n")) + 1)
    a = points.select(F.col("entity").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = points.select(F.col("entity").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    u = bucket_hash(F.col("src"), seed + 1) / F.lit(1_000_003.0)
    return chosen.join(a, "src").join(b, "dst").select(F.col("src").alias("entity"), (F.col("lat1") + u * (F.col("lat2") - F.col("lat1"))).alias("lat"), (F.col("lon1") + u * (F.col("lon2") - F.col("lon1"))).alias("lon"))


def augmented(measured: DataFrame, scored: DataFrame, key: str, label: str, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Measured rows and, of the others, those whose score ``p`` is sure: key, label, pseudo."""
    sure = F.when(F.col("p") >= high, 1).when(F.col("p") <= low, 0)
    more = scored.join(measured.select(key), key, "left_anti").select(key, sure.alias(label), F.lit(1).alias("pseudo")).where(F.col(label).isNotNull())
    return measured.select(key, F.col(label).cast("int").alias(label), F.lit(0).alias("pseudo")).unionByName(more)


def permuted(rows: DataFrame, column: str, key: str, seed: int = 23, parts: int = 64) -> DataFrame:
    """``rows`` with ``column`` taken from another row: the next one, in hash order, of a hash part. No window spans all rows."""
    part = F.pmod(bucket_hash(F.col(key), seed), F.lit(parts))
    order = Window.partitionBy(part).orderBy(bucket_hash(F.col(key), seed + 1), key)
    first = F.first(column).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = F.lead(F.struct(column)).over(order)
    return rows.withColumn(column, F.when(after.isNotNull(), after[column]).otherwise(first))
