"""Leakage-safe folds: whole entities, spatial blocks, and guards over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneflow.functions.expressions import bucket_hash

SALTS = 64


def group_folds(rows: DataFrame, key: str = "entity", k: int = 8) -> DataFrame:
    """(key, n, fold): entities of a size are dealt in turn, so folds hold as many of each size.

    Ranks are taken per size and salt, never over all entities at once.
    """
    sized = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("_salt", F.pmod(bucket_hash(F.col(key), 7), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("n", "_salt").orderBy(key)) - 1
    return sized.withColumn("fold", F.pmod(place + F.col("_salt"), F.lit(k)).cast("int")).drop("_salt")


def row_folds(rows: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Stratified folds of single rows, for audits of what entity leakage is worth."""
    salt = F.pmod(bucket_hash(F.col(key), 3), F.lit(SALTS))
    place = F.row_number().over(Window.partitionBy(label, salt).orderBy(bucket_hash(F.col(key), 5), key)) - 1
    return rows.withColumn("fold", F.pmod(place + salt, F.lit(k)).cast("int"))


def fold_rows(rows: DataFrame, folds: DataFrame, key: str = "entity", k: int = 8) -> DataFrame:
    """Every row in every fold with ``is_test``: k rows from each."""
    own = rows.join(folds.select(key, F.col("fold").alias("_own")), key)
    return own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("is_test", F.col("fold") == F.col("_own")).drop("_own")


def straddlers(rows: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """Entities in more than one fold: must be empty."""
    return rows.groupBy(key).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def lloyd_blocks(points: DataFrame, seeds: list[tuple[float, float]], rounds: int = 3) -> DataFrame:
    """(entity, lat, lon, block): k-means over entity positions from given seeds, a fixed number of rounds.

    The centres are k rows of literals, refreshed by one aggregate per round.
    """
    centres = list(seeds)
    for turn in range(rounds + 1):
        away = [F.struct((F.pow(F.col("lat") - a, 2) + F.pow(F.col("lon") - b, 2)).alias("d"), F.lit(i).alias("block")) for i, (a, b) in enumerate(centres)]
        placed = points.withColumn("block", F.array_min(F.array(*away))["block"])
        if turn < rounds:
            means = placed.groupBy("block").agg(F.round(F.avg("lat"), 6).alias("a"), F.round(F.avg("lon"), 6).alias("b")).collect()
            for r in means:
                centres[r.block] = (r.a, r.b)
    return placed


def holdout(rows: DataFrame, block: str, key: str, share: float = 0.18, seed: int = 11) -> DataFrame:
    """``rows`` with ``held``: ``share`` of each block, the first keys by hash; at least one row of a block stays out.

    Blocks are small groups of neighbouring entities, so a block is ordered in one task.
    """
    order = Window.partitionBy(block).orderBy(bucket_hash(F.col(key), seed), key)
    least = F.round(F.lit(share) * F.count("*").over(Window.partitionBy(block)))
    return rows.withColumn("held", F.row_number().over(order) <= least)


def hashed_holdout(rows: DataFrame, key: str, share: float, seed: int = 11) -> DataFrame:
    """``rows`` with ``held``: about ``share`` of the keys, by a seeded hash alone, so nothing is ordered or shuffled."""
    return rows.withColumn("held", bucket_hash(F.col(key), seed) < F.lit(round(share * 1_000_000)))


def closest_block(rows: DataFrame, block: str, share: float = 0.18) -> DataFrame:
    """The block whose size is nearest to ``share`` of all rows."""
    sizes = rows.groupBy(block).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    gap = F.abs(F.col("n") - F.lit(share) * total)
    return sizes.withColumn("gap", gap).orderBy(F.round("gap", 6), block).limit(1).select(block, "n")
