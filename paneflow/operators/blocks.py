"""Converged spatial blocks: k-means of entity positions, many clusterings at once.

A clustering is a (group, restart): all restarts of all groups take each pass over the points
together. Centres are groups x restarts x k rows, so a pass sends sums of clusters alone:
a point finds its nearest centre of every restart of its group, and counts and sums are
combined in its task before they are shuffled. Seeds come from k-means||: a few passes draw
points far from all seeds so far, and what they draw, weighted by the points nearest to it,
is cut down to k. Points are dealt to all cores once, as their file may be a few splits, and
a task compares batches of them with one centre after the other as arrays.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.functions.expressions import bucket_hash
from paneflow.operators.quantiles import at_ranks
from paneflow.operators.tables import settled

#: Clusterings times centres that one pass holds as a table.
LIMIT = 200_000
SIZE = 1_000_003


def _arrays(held: dict) -> dict[str, list[np.ndarray]]:
    """The centres of each group and restart as arrays, for the tasks."""
    if sum(len(c) for starts in held.values() for c in starts) > LIMIT:
        raise ValueError(f"over {LIMIT} centres in one pass: cluster fewer groups at once")
    return {g: [np.array(c, dtype=float).reshape(-1, 2) for c in starts] for g, starts in held.items()}


def _nearest(lat: np.ndarray, lon: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(d, i) of the nearest of some centres; the first on ties."""
    d, i = np.full(len(lat), np.inf), np.zeros(len(lat), dtype=np.int32)
    for at, (a, b) in enumerate(centres):
        own = (lat - a) ** 2 + (lon - b) ** 2
        i[own < d] = at
        np.minimum(d, own, out=d)
    return d, i


def _batches(batches, centres: dict) -> Iterator[tuple]:
    """(batch of one group, group, its lat, its lon) of the groups that have centres."""
    for batch in batches:
        groups = batch.column("grp").unique().to_pylist()
        for g in groups:
            if g in centres:
                own = batch if len(groups) == 1 else batch.filter(pc.equal(batch.column("grp"), g))
                yield own, g, *(own.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))


def _met(points: DataFrame, held: dict, *carried: str) -> DataFrame:
    """Points by clustering: grp, entity, lat, lon, start, d, i and what is carried."""
    centres, names, kinds = _arrays(held), ["grp", "entity", "lat", "lon", *carried], dict(points.dtypes)

    def meet(batches):
        for own, g, lat, lon in _batches(batches, centres):
            for start, c in enumerate(centres[g]):
                d, i = _nearest(lat, lon, c)
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), pa.array(np.full(len(d), start, np.int32)), pa.array(d), pa.array(i)], names=[*names, "start", "d", "i"])

    return points.select(*names).mapInArrow(meet, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "start int", "d double", "i int"]))


def _sums(points: DataFrame, held: dict) -> DataFrame:
    """grp, start, i, n, lat, lon, d: what each centre is nearest to, as counts and sums; centres of nothing are left out."""
    centres = _arrays(held)

    def add(batches):
        sums = {}
        for _, g, lat, lon in _batches(batches, centres):
            for start, c in enumerate(centres[g]):
                d, i = _nearest(lat, lon, c)
                own = np.array([np.bincount(i, w, len(c)) for w in (None, lat, lon, d)])
                sums[g, start] = sums[g, start] + own if (g, start) in sums else own
        for (g, start), own in sums.items():
            at = np.flatnonzero(own[0])
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(np.full(len(at), start, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[0][at].astype(np.int64)), *(pa.array(x[at]) for x in own[1:])], names=["grp", "start", "i", "n", "lat", "lon", "d"])

    parts = points.select("grp", "lat", "lon").mapInArrow(add, "grp string, start int, i int, n long, lat double, lon double, d double")
    return parts.groupBy("grp", "start", "i").agg(*(F.sum(c).alias(c) for c in ("n", "lat", "lon", "d")))


def _drawn(points: DataFrame, held: dict, costs: dict, often: float, seed: int) -> DataFrame:
    """grp, start, entity, lat, lon of the points drawn by a seeded hash, each by ``often`` times its share of its clustering's cost."""
    centres, kind = _arrays(held), dict(points.dtypes)["entity"]

    def draw(batches):
        for own, g, lat, lon in _batches(batches, centres):
            key = own.column("entity").to_numpy(zero_copy_only=False).astype(np.int64) % SIZE
            for start, c in enumerate(centres[g]):
                # bucket_hash of entity * 131 + start
                u = ((key * 131 + start) % SIZE * (48_271 + 2 * seed) + seed * 7919) % SIZE / float(SIZE)
                at = np.flatnonzero(u * costs[g, start] < often * _nearest(lat, lon, c)[0])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(np.full(len(at), start, np.int32)), own.column("entity").take(pa.array(at)), pa.array(lat[at]), pa.array(lon[at])], names=["grp", "start", "entity", "lat", "lon"])

    return points.select("grp", "entity", "lat", "lon").mapInArrow(draw, f"grp string, start int, entity {kind}, lat double, lon double")


def _chosen(weighted: list[tuple[float, float, float]], k: int, rng: random.Random) -> list[tuple[float, float]]:
    """k of some weighted points, each drawn by its weight times its squared distance to those drawn before."""
    left = [w for *_, w in weighted]
    out: list[tuple[float, float]] = []
    gaps = [math.inf] * len(weighted)
    while len(out) < min(k, len(weighted)) and sum(left) > 0:
        a, b, _ = rng.choices(weighted, left)[0]
        out.append((a, b))
        gaps = [min(g, (x - a) ** 2 + (y - b) ** 2) for g, (x, y, _) in zip(gaps, weighted, strict=True)]
        left = [w * g for (*_, w), g in zip(weighted, gaps, strict=True)]
    return out


def seeds(points: DataFrame, k: int, restarts: int, seed: int = 42, passes: int = 3) -> dict[str, list[list[tuple[float, float]]]]:
    """Per group the seeds of each restart, by k-means||; a pass draws 2k points a clustering on average."""
    key = F.col("entity")
    first = points.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))).groupBy("grp", "s").agg(F.min_by(F.struct("lat", "lon"), F.struct(bucket_hash(key * 31 + F.col("s"), seed), "entity")).alias("p"))
    held: dict[str, list] = {}
    for r in first.orderBy("grp", "s").collect():  # groups x restarts rows
        held.setdefault(r.grp, []).append([(r.p.lat, r.p.lon)])
    for turn in range(passes):
        costs = {(r.grp, r.start): r.cost for r in _sums(points, held).groupBy("grp", "start").agg(F.sum("d").alias("cost")).collect()}  # a row per clustering
        drawn = _drawn(points, held, costs, 2 * k, seed + 7 * turn + 1)
        for r in drawn.orderBy("grp", "start", "entity").collect():  # 2k a clustering, about
            held[r.grp][r.start].append((r.lat, r.lon))
    weights = {(r.grp, r.start, r.i): r.n for r in _sums(points, held).collect()}  # a row per seed
    rng = random.Random(seed)
    return {g: [_chosen([(a, b, weights.get((g, s, i), 0)) for i, (a, b) in enumerate(c)], k, rng) for s, c in enumerate(starts)] for g, starts in sorted(held.items())}


def refine(points: DataFrame, held: dict) -> tuple[dict, dict]:
    """One Lloyd step of all clusterings: the new centres, and the inertia under the old ones, per (group, restart)."""
    moved, cost = {g: [list(c) for c in starts] for g, starts in held.items()}, {}
    for r in _sums(points, held).collect():  # one row per centre
        moved[r.grp][r.start][r.i] = (r.lat / r.n, r.lon / r.n)
        cost[r.grp, r.start] = cost.get((r.grp, r.start), 0.0) + r.d
    return moved, cost


def clusters(points: DataFrame, k: int, group: str | None = None, restarts: int = 10, rounds: int = 50, tolerance: float = 1e-4, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """((entity, group,) lat, lon, block, and the log): the best of ``restarts`` k-means of each group.

    A round goes on with the clusterings whose inertia still falls by more than ``tolerance`` of it; the
    others rest. The log has one row per round and clustering: grp, start, round, inertia. Blocks are
    numbered by their centres' latitude, then longitude. Points without a position are left out; a group
    with fewer places than k has as many blocks as places.
    """
    own = [group] if group else []
    rows = points.where("entity is not null and lat is not null and lon is not null")
    rows = rows.select("entity", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), *own, (F.col(group).cast("string") if group else F.lit("")).alias("grp")).where("grp is not null")
    rows = settled(rows.repartition(points.sparkSession.sparkContext.defaultParallelism))
    held = seeds(rows, k, restarts, seed)
    log, best, moving = [], {}, {g: list(range(len(starts))) for g, starts in held.items()}
    for turn in range(rounds + 1):
        part = {g: [held[g][s] for s in own] for g, own in moving.items() if own}
        if not part:
            break
        moved, cost = refine(rows, part)
        for g, starts in part.items():
            still = []
            for place, (s, centres) in enumerate(zip(moving[g], starts, strict=True)):
                inertia = cost.get((g, place), 0.0)
                log.append({"grp": g, "start": s, "round": turn, "inertia": inertia})
                before = best.get((g, s), (math.inf,))[0]
                best[g, s] = (inertia, centres)
                if inertia > 0 and before - inertia > tolerance * inertia:
                    held[g][s] = moved[g][place]
                    still.append(s)
            moving[g] = still
    chosen = {g: [sorted(min((best[g, s] for s in range(len(starts))), key=lambda x: x[0])[1])] for g, starts in held.items()}
    placed = _met(rows, chosen, *own).withColumnRenamed("i", "block") if chosen else rows.withColumn("block", F.lit(0))
    return placed.select("entity", *own, "lat", "lon", "block"), log


def micro_holdout(points: DataFrame, block: str = "block", micro: int = 6, share: float = 0.18, restarts: int = 4, seed: int = 42) -> DataFrame:
    """entity, <block>, micro, held: each block is clustered into ``micro`` small ones, and ``share`` of each is held out by hash.

    All blocks are clustered at once. A micro-block of two points or more has one held out at least, and keeps one.
    The cut is the order statistic of the hashes, so no micro-block is ordered in one task.
    """
    found, _ = clusters(points.withColumnRenamed(block, "_of"), micro, "_of", restarts, seed=seed)
    hashed = found.select("entity", "_of", F.col("block").alias("micro"), (bucket_hash(F.col("entity"), seed + 1) + F.pmod(F.col("entity"), F.lit(SIZE)) / F.lit(2.0 * SIZE)).alias("x"))
    sizes = hashed.groupBy("_of", "micro").agg(F.count("*").alias("n"))
    take = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.round(F.lit(share) * F.col("n")))).cast("long")
    ranks = sizes.where("n > 1").select("_of", "micro", F.lit("cut").alias("name"), (take - 1).alias("rank"))
    cuts = at_ranks(hashed.groupBy("_of", "micro", "x").agg(F.count("*").alias("n")), ["_of", "micro"], ranks).select("_of", "micro", F.col("x").alias("cut"))
    rows = hashed.join(cuts, ["_of", "micro"], "left").select("entity", "_of", "micro", F.coalesce(F.col("x") <= F.col("cut"), F.lit(False)).alias("held"))
    return rows.withColumnRenamed("_of", block)
