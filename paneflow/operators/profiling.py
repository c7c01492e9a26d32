"""Column profiles and leakage audits, each one aggregate over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions.expressions import adjusted_skew, safe_corr
from paneflow.operators.quantiles import quantiles


def _stacked(row: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """A one-row aggregate with <column>__<name> fields as one row per column."""
    items = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{n}").alias(n) for n in names)) for c in columns))
    return row.select(F.explode(items).alias("x")).select("x.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, x, n: how often each column holds each number; nulls are left out."""
    items = F.array(*(F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") + F.lit(0.0)).alias("x")) for c in columns))
    return df.select(F.explode(items).alias("i")).select("i.*").where("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, null_share, distinct, low, median, high, mean, skew, zero_share, negative_share."""
    n, aggs = F.count(F.lit(1)).cast("double"), []
    for c in columns:
        x = F.col(c).cast("double") + F.lit(0.0)
        found = {
            "null_share": F.try_divide(F.count_if(x.isNull()).cast("double"), n), "low": F.min(x), "high": F.max(x), "mean": F.avg(x),
            "skew": adjusted_skew(x), "zero_share": F.try_divide(F.count_if(x == 0).cast("double"), n), "negative_share": F.try_divide(F.count_if(x < 0).cast("double"), n)}
        aggs += [v.alias(f"{c}__{k}") for k, v in found.items()]
    counts = value_counts(df, columns)
    kinds = counts.groupBy("column").agg(F.count("*").alias("distinct")).join(quantiles(counts, ["column"], {"median": 0.5}), "column")
    return _stacked(df.agg(*aggs), columns, list(found)).join(F.broadcast(kinds), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))


def top_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n, share: the most frequent value of each column, the smallest on ties; nulls are a value."""
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = df.select(F.explode(items).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    most = counts.groupBy("column").agg(F.max("n").alias("n"), F.sum("n").alias("total"))  # one row per column
    least = F.min(F.struct(F.col("value").isNotNull().alias("known"), "value"))["value"]
    found = counts.join(F.broadcast(most), ["column", "n"]).groupBy("column", "n", "total").agg(least.alias("value"))
    return found.select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, kinds, constant: distinct values with null as one."""
    aggs = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long").alias(f"{c}__kinds") for c in columns]
    return _stacked(df.agg(*aggs), columns, ["kinds"]).withColumn("constant", (F.col("kinds") <= 1).cast("int"))


def equal_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, equal for each pair of columns, nulls being equal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = [F.min((F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))).cast("int")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    items = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("equal")) for i, (a, b) in enumerate(pairs)))
    return df.agg(*aggs).select(F.explode(items).alias("x")).select("x.*")


def correlations(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """a, b, corr of all pairs, or of every column with the target."""
    pairs = [(c, target) for c in columns if c != target] if target else [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(safe_corr(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    items = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(items).alias("x")).select("x.*")


def eta(df: DataFrame, category: str, value: str) -> DataFrame:
    """category, eta: sqrt of the share of variance between the levels."""
    y = F.col(value).cast("double")
    groups = df.where(y.isNotNull()).groupBy(F.coalesce(F.col(category).cast("string"), F.lit("__nan__")).alias("g")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    total = F.sum("n")
    mean = F.sum("s") / total
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - total * mean * mean
    whole = F.sum("q") - total * mean * mean
    return groups.agg(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(between, whole))).alias("eta")).select(F.lit(category).alias("category"), "eta")


def sentinels(df: DataFrame, columns: list[str], values: tuple[float, ...] = (-999, -9999, -99, 9999, -1)) -> DataFrame:
    """column, n: numbers that often stand for a missing value."""
    row = df.agg(*(F.count_if(F.col(c).cast("double").isin(*map(float, values))).alias(f"{c}__n") for c in columns))
    return _stacked(row, columns, ["n"])


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, distinct_rows, repeated: over the listed columns, nulls being equal."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum(F.col("n") - 1).alias("repeated"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
