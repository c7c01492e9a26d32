"""Exact ranks, running sums and order statistics without a task that holds all values.

Values are dealt into ranges: the bounds are a bottom-k sample by hash, so they are the same
whenever they are computed, and ranges hold about equal numbers of distinct values, whatever
their scale. What crosses ranges is sums of ranges, some BINS rows a group; order inside a
range is a window over (group, range) alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, about; a square.
BINS = 1024
_STEP = 32


def ranged(rows: DataFrame, value: str = "x", bin_col: str = "_bin") -> DataFrame:
    """``rows``, one per distinct value (and group), with the range of each value: ranges are in the order of values."""
    drawn = rows.select(F.col(value).alias("b")).where("b is not null").orderBy(F.xxhash64("b"), "b").limit(BINS - 1)
    bounds = drawn.agg(F.sort_array(F.collect_set("b")).alias("fine"))
    bounds = bounds.select(F.struct("fine", F.filter("fine", lambda _, i: i % _STEP == _STEP - 1).alias("coarse"))).scalar()
    x = F.col(value)
    # no subquery may stand inside a lambda, so the bounds are a column for a moment
    major = F.coalesce(F.size(F.filter("_bounds.coarse", lambda b: b < x)), F.lit(0))
    own = F.slice("_bounds.fine", _STEP * F.col("_major") + 1, F.lit(_STEP))
    found = rows.withColumn("_bounds", bounds).withColumn("_major", major)
    return found.withColumn(bin_col, _STEP * F.col("_major") + F.coalesce(F.size(F.filter(own, lambda b: b < x)), F.lit(0))).drop("_major", "_bounds")


def before(sums: DataFrame, group: list[str], columns: list[str], bin_col: str = "_bin", falling: bool = False) -> DataFrame:
    """Sums of ranges (group, bin, columns) with <column>_before: those of all ranges before, or behind if ``falling``."""
    order = Window.partitionBy(*group).orderBy(F.desc(bin_col) if falling else bin_col).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(order), F.lit(0)) for c in columns})


def at_ranks(counts: DataFrame, group: list[str], ranks: DataFrame, name: str = "name") -> DataFrame:
    """group, name, x: the value at each of ``ranks`` (group, name, rank from 0) of ``counts`` (group, x, n)."""
    binned = ranged(counts)
    sums = before(binned.groupBy(*group, "_bin").agg(F.sum("n").alias("_held")), group, ["_held"])
    asked = sums.join(ranks, group).where((F.col("rank") >= F.col("_held_before")) & (F.col("rank") < F.col("_held_before") + F.col("_held")))
    inside = binned.withColumn("_upto", F.sum("n").over(Window.partitionBy(*group, "_bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    met = inside.join(asked.select(*group, "_bin", name, (F.col("rank") - F.col("_held_before")).alias("_at")), [*group, "_bin"])
    return met.where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("n"))).select(*group, name, "x")


def _ends(wanted: dict[str, float], total: Column) -> Column:
    """The two ranks around each quantile, as rows (_name, rank)."""
    place = {name: (total - 1) * F.lit(q) for name, q in wanted.items()}
    return F.explode(F.array(*(F.struct(F.lit(f"{name}|{end}").alias("_name"), at.cast("long").alias("rank")) for name, p in place.items() for end, at in (("a", F.floor(p)), ("b", F.ceil(p))))))


def _between(totals: DataFrame, found: DataFrame, group: list[str], wanted: dict[str, float]) -> DataFrame:
    """Quantiles from the values (group, _name, x) at the ranks of :func:`_ends`, linear between neighbours."""
    wide = found.groupBy(*group).agg(*(F.max(F.when(F.col("_name") == f"{name}|{end}", F.col("x"))).alias(f"{name}|{end}") for name in wanted for end in "ab"))
    low, place = {name: F.col(f"{name}|a") for name in wanted}, {name: (F.col("_n") - 1) * F.lit(q) for name, q in wanted.items()}
    return totals.join(wide, group).select(*group, *((low[name] + (F.col(f"{name}|b") - low[name]) * (place[name] - F.floor(place[name]))).alias(name) for name in wanted))


def quantiles(counts: DataFrame, group: list[str], wanted: dict[str, float]) -> DataFrame:
    """group and a column per wanted quantile of ``counts`` (group, x, n), linear between neighbours."""
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_n"))
    found = at_ranks(counts, group, totals.select(*group, _ends(wanted, F.col("_n")).alias("r")).select(*group, "r.*"), "_name")
    return _between(totals, found, group, wanted)


def training_quantiles(counts: DataFrame, k: int, wanted: dict[str, float]) -> DataFrame:
    """fold and a column per wanted quantile of the values outside each of ``k`` folds, from ``counts`` (own, x, n).

    The ranges are shared by all folds, and a fold's training histogram is the total less its own one; so
    only the ranges that hold a wanted rank are looked into, and there each value has its total and what
    each fold holds of it: no value is dealt out per fold.
    """
    binned = ranged(counts)
    own = binned.groupBy("own", "_bin").agg(F.sum("n").alias("n"))
    every = own.groupBy("_bin").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("own", "n"))).alias("held"))  # a handful of folds
    train = every.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("fold", "_bin", (F.col("n") - F.coalesce(F.try_element_at("held", "fold"), F.lit(0))).alias("n"))
    sums = before(train, ["fold"], ["n"])
    totals = train.groupBy("fold").agg(F.sum("n").alias("_n")).where("_n > 0")
    ranks = totals.select("fold", _ends(wanted, F.col("_n")).alias("r")).select("fold", "r.*")
    asked = sums.join(ranks, "fold").where((F.col("rank") >= F.col("n_before")) & (F.col("rank") < F.col("n_before") + F.col("n"))).select("fold", "_name", "_bin", (F.col("rank") - F.col("n_before")).alias("_at"))
    values = binned.groupBy("_bin", "x").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col("own") == f, F.col("n")).otherwise(0)).alias(f"_n{f}") for f in range(k)))
    values = values.join(F.broadcast(asked.select("_bin").distinct()), "_bin")  # two ranges a fold and quantile at most
    upto = Window.partitionBy("_bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumns({f"_u{f}": F.sum(F.col("n") - F.col(f"_n{f}")).over(upto) for f in range(k)})
    folds = F.array(*(F.struct(F.lit(f).alias("fold"), (F.col("n") - F.col(f"_n{f}")).alias("n"), F.col(f"_u{f}").alias("upto")) for f in range(k)))
    inside = values.select("_bin", "x", F.explode(folds).alias("f")).select("_bin", "x", "f.*")
    met = inside.join(F.broadcast(asked), ["fold", "_bin"]).where((F.col("_at") < F.col("upto")) & (F.col("_at") >= F.col("upto") - F.col("n")))
    return _between(totals, met.select("fold", "_name", "x"), ["fold"], wanted)
