"""Censored-threshold targets and masks over long cells (entity, event, analyte, value, detected)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions.expressions import flag, guarded

#: Threshold and health-based weight by analyte; what has no threshold falls back to FALLBACK.
REGULATED = {"AF": (40.0, 120.0), "AO": (40.0, 120.0), "NF": (40.0, 120.0), "NO": (40.0, 120.0)}
FALLBACK = 20.0
PAIR, SUM_LIMIT = ("AF", "NO"), 100.0
ANALYTES = ("AF", "AO", "NF", "NO", "RF", "RO")


def thresholds(spark) -> DataFrame:
    """analyte, thr (null where it falls back), hbwc: a few literal rows."""
    return spark.createDataFrame([(a, *REGULATED.get(a, (None, None))) for a in ANALYTES], "analyte string, thr double, hbwc double")


def flagged_cells(cells: DataFrame) -> DataFrame:
    """Cells with thr, guarded value, guarded flag, naive flag and hazard quotient."""
    rows = cells.join(F.broadcast(thresholds(cells.sparkSession)), "analyte", "left")
    rows = rows.withColumn("thr", F.coalesce("thr", F.lit(FALLBACK))).withColumn("guarded", guarded(F.col("value"), F.col("detected")))
    return rows.withColumns({"y": flag(F.col("guarded") > F.col("thr")), "naive": flag(F.col("value") > F.col("thr")), "hq": F.coalesce(F.try_divide("guarded", "hbwc"), F.lit(0.0))})


def event_targets(cells: DataFrame) -> DataFrame:
    """Per event: hazard index and the targets t1a, t1a_naive, t1b, t1c with their parts."""
    rows = flagged_cells(cells)
    pair = F.col("analyte").isin(*PAIR)
    naive_hq = F.coalesce(F.try_divide("value", "hbwc"), F.lit(0.0))
    out = rows.groupBy("entity", "event").agg(
        F.sum("hq").alias("hazard_index"),
        F.max(F.when(pair, F.col("y")).otherwise(0)).alias("pair_hit"),
        F.sum(naive_hq).alias("naive_index"),
        F.max(F.when(pair, F.col("naive")).otherwise(0)).alias("naive_hit"),
        F.sum("value").alias("total"),
        F.max(F.col("detected").cast("int")).alias("t1c"),
    )
    return out.select(
        "entity",
        "event",
        "hazard_index",
        "total",
        flag((F.col("pair_hit") == 1) | (F.round("hazard_index", 9) >= 1)).alias("t1a"),
        flag((F.col("naive_hit") == 1) | (F.round("naive_index", 9) >= 1)).alias("t1a_naive"),
        flag(F.col("total") > SUM_LIMIT).alias("t1b"),
        "t1c",
    )


def masked_targets(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Every event by every analyte: y (0 where not measured) and measured; analytes are a fixed few."""
    grid = events.select("event").withColumn("analyte", F.explode(F.array(*map(F.lit, ANALYTES))))
    rows = flagged_cells(cells).select("event", "analyte", "y")
    return grid.join(rows, ["event", "analyte"], "left").select("event", "analyte", F.coalesce("y", F.lit(0)).alias("y"), F.col("y").isNotNull().alias("measured"))


def wide(cells: DataFrame, value: str = "guarded") -> DataFrame:
    """One row per event, a column per analyte; null where not measured."""
    return flagged_cells(cells).groupBy("event").pivot("analyte", list(ANALYTES)).agg(F.first(value))


def framework_thresholds(frameworks: DataFrame) -> DataFrame:
    """(analyte, epa, nl, rl) with ``strictest``, and each falling back to FALLBACK."""
    found = F.least("epa", "nl", "rl")
    return frameworks.select("analyte", *(F.coalesce(c, F.lit(FALLBACK)).alias(c) for c in ("epa", "nl", "rl")), F.coalesce(found, F.lit(FALLBACK)).alias("strictest"))


def majority(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Per key: 1 where at least half of the labels are; from integer sums, so ties are exact."""
    return rows.groupBy(key).agg(F.count(label).alias("n"), (2 * F.sum(label) >= F.count(label)).cast("int").alias(label))
