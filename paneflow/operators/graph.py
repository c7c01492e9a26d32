"""Distance-capped neighbour graphs as edge tables, and what is computed on them.

Pairs within a cap are found by an equi-join on grid cells of at least the cap, each
point looking into the cells around its own, then a haversine filter; no pair beyond
neighbouring cells is formed. The k nearest take the same way where cells hold few
points; where some are dense, they start from small cells and widen the search only
for the points that have not found k yet (:func:`nearest`).
"""

from __future__ import annotations

from math import asin, ceil, cos, floor, log2, radians, sin

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneflow.functions.expressions import EARTH_KM, bucket_hash, gaussian_decay, haversine_km, rounded
from paneflow.operators.tables import settled

KM_PER_DEGREE = 111.19


def _gridded(points: DataFrame, cap_km: float, *columns: str, same: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows by the cells that they look into (lat1, lon1 and <column>1), and by the cell that they are in (lat2, lon2, <column>2); ``same`` keeps its name.

    Cells are as wide as the cap is at the highest latitude there, and meet across the
    180th meridian. Points beyond 85 degrees are refused: there the cells would be the whole circle.
    """
    top_lat = points.agg(F.max(F.abs("lat"))).first()[0] or 0.0
    if top_lat > 85:
        raise ValueError(f"neighbours are not searched beyond 85 degrees of latitude: {top_lat}")
    dlat = cap_km / KM_PER_DEGREE * 1.001
    around_lat = max(1, floor(360 / (cap_km / (KM_PER_DEGREE * cos(radians(min(89.0, top_lat + dlat)))) * 1.001)))
    dlon = 360 / around_lat  # a whole number of cells goes around
    extra, columns = [same] if same else [], ("lat", "lon", *columns)
    rows = points.select(*columns, *extra, F.floor(F.col("lat") / dlat).alias("gy"), F.pmod(F.floor(F.col("lon") / dlon), F.lit(around_lat)).alias("gx"))
    rows = rows.where(F.col(same).isNotNull()) if same else rows
    # with under three cells around, a step must not reach the same cell twice
    around = F.array(*(F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (range(around_lat) if around_lat < 3 else (-1, 0, 1))))
    left = rows.withColumn("step", F.explode(around)).select(*(F.col(c).alias(f"{c}1") for c in columns), *extra, (F.col("gy") + F.col("step.dy")).alias("gy"), F.pmod(F.col("gx") + F.col("step.dx"), F.lit(around_lat)).alias("gx"))
    return left, rows.select(*(F.col(c).alias(f"{c}2") for c in columns), *extra, "gy", "gx")


def near_pairs(points: DataFrame, cap_km: float, same: str | None = None) -> DataFrame:
    """src, dst, dist_km of all ordered pairs within ``cap_km`` (of equal ``same``, never null)."""
    left, right = _gridded(points, cap_km, "entity", same=same)
    pairs = left.join(right, ["gy", "gx", *([same] if same else [])]).where(F.col("entity1") != F.col("entity2"))
    return pairs.select(F.col("entity1").alias("src"), F.col("entity2").alias("dst"), haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("dist_km")).where(F.col("dist_km") <= cap_km)


#: Places of a cell that one task compares with those that look into it; fuller cells are dealt to several.
SHARE = 2_000


def _place_pairs(places: DataFrame, cap_km: float, *columns: str, same: str | None = None) -> DataFrame:
    """lat1, lon1, lat2, lon2, dist_km and <column>1, <column>2 of all ordered pairs of places about within ``cap_km``, each with itself too.

    A few pairs may be a hair beyond the cap. They come out of the join by their straight distance, so that the
    exact one is computed once, for those that are near. Nothing of a pair is shuffled or kept.
    """
    left, right = _gridded(places, cap_km, *columns, same=same)
    keys, n = ["gy", "gx", *([same] if same else [])], 8 * places.sparkSession.sparkContext.defaultParallelism
    full = F.broadcast(right.groupBy(*keys).count().where(F.col("count") > SHARE).select(*keys, F.ceil(F.col("count") / SHARE).alias("shares")))  # a row per SHARE places at most
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    left = left.join(full, keys, "left").withColumn("share", F.pmod(F.xxhash64("lat1", "lon1"), shares))
    right = right.join(full, keys, "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    keys.append("share")

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        # by number, as their bytes are few and their pairs are many
        at = rows.drop("shares").repartition(n, *keys)
        return at.select("*", *_sphere(f"lat{side}", f"lon{side}", str(side)))

    gap = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "yz"), (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")))
    pairs = dealt(left, 1).join(dealt(right, 2), keys).where(gap <= _chord(cap_km) ** 2 * (1 + 1e-9) + 1e-15)
    return pairs.select("lat1", "lon1", "lat2", "lon2", *(f"{c}{i}" for c in columns for i in (1, 2)), haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("dist_km"))


def _known(points: DataFrame, *columns: str) -> DataFrame | None:
    """Points with an id and a position, or None if ids stand more than once."""
    rows = points.where("entity is not null and lat is not null and lon is not null").select("entity", "lat", "lon", *columns)
    return rows if points.groupBy("entity").count().where("count > 1").isEmpty() else None


def near_totals(points: DataFrame, cap_km: float) -> DataFrame:
    """src, n, total_km: neighbours of each point within ``cap_km`` and the sum of their distances, each to six digits; none without one.

    Points at one place have the same neighbours, so places meet, with the number of points there, and a place's sums
    go to its points. Sums are of whole millionths: the same in any order.
    """
    if (rows := _known(points)) is None:
        return near_pairs(points, cap_km).groupBy("src").agg(F.count("*").alias("n"), rounded(F.sum(F.round("dist_km", 6))).alias("total_km"))
    pairs = _place_pairs(rows.groupBy("lat", "lon").agg(F.count("*").alias("n")), cap_km, "n")
    near = F.col("dist_km") <= cap_km
    sums = pairs.groupBy(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")).agg(F.sum(F.when(near, F.col("n2"))).alias("n"), F.sum(F.when(near, F.col("n2") * F.floor(F.col("dist_km") * 1e6 + 0.5))).alias("total"))
    return rows.join(sums.where("n > 1"), ["lat", "lon"]).select(F.col("entity").alias("src"), (F.col("n") - 1).alias("n"), (F.col("total") / 1e6).alias("total_km"))


def near_concordance(points: DataFrame, value: str, bands: tuple[float, ...], least: int = 50) -> DataFrame:
    """:func:`concordance` of all pairs within the last band: places meet, with their numbers of points, and only sums leave a task."""
    cap_km = bands[-1]
    if (rows := _known(points, value)) is None:
        return concordance(near_pairs(points, cap_km).where("src < dst"), points, value, bands, least)
    places = rows.groupBy("lat", "lon").agg(F.count("*").alias("n"), F.count(value).alias("k"))
    alike = rows.where(F.col(value).isNotNull()).groupBy("lat", "lon", value).agg(F.count("*").alias("m"))

    def by_band(pairs: DataFrame, *columns: str) -> DataFrame:
        """One row: per column the sums of products of both places, one for each band."""
        within = [F.col("dist_km") <= top if i == 0 else (F.col("dist_km") > bands[i - 1]) & (F.col("dist_km") <= top) for i, top in enumerate(bands)]
        return pairs.agg(*(F.array(*(F.coalesce(F.sum(F.when(w, F.col(f"{c}1") * F.col(f"{c}2"))), F.lit(0)) for w in within)).alias(c) for c in columns))

    found = by_band(_place_pairs(places, cap_km, "n", "k"), "n", "k").crossJoin(by_band(_place_pairs(alike, cap_km, "m", same=value), "m"))
    self = rows.agg(F.count("*").alias("all"), F.count(value).alias("known"))  # what met itself, in the first band
    each = found.crossJoin(self).select("all", "known", F.posexplode(F.arrays_zip(F.array(*map(F.lit, bands)).alias("band"), "n", "k", "m")).alias("at", "x"))

    def once(c: str, own: str):
        return F.floor((F.col(f"x.{c}") - F.when(F.col("at") == 0, F.col(own)).otherwise(0)) / 2)

    return each.select(F.col("x.band").alias("band"), once("n", "all").alias("n"), F.try_divide(once("m", "known").cast("double"), once("k", "known").cast("double")).alias("same")).where(F.col("n") > least)


#: A cell with more points than DENSE is searched by :func:`nearest`.
DENSE = 400
#: How much wider that search gets from round to round.
_WIDER = 2


def knn(points: DataFrame, k: int, cap_km: float | None = None, same: str | None = None) -> DataFrame:
    """src, dst, dist_km, place: the k nearest of each point (of equal ``same``, never null), nearer ids first on ties.

    Only neighbours within ``cap_km`` count, if it is given.
    """
    if cap_km is None or _fullest(points, _chord(cap_km), same) > DENSE:
        return nearest(points, k, cap_km, same)
    pairs = near_pairs(points, cap_km, **({"same": same} if same else {}))
    return _placed(pairs).where(F.col("place") <= k)


def _placed(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(rounded(F.col("dist_km")), "dst")))


def _chord(km: float) -> float:
    """The straight distance, on a sphere of radius 1, of points ``km`` apart."""
    return 2 * sin(min(km / EARTH_KM, 3.141592653589793) / 2)


def _sphere(lat: str = "lat", lon: str = "lon", side: str = "") -> list:
    """x, y, z of a position on a sphere of radius 1: no poles, no meridian."""
    lat, lon = F.radians(lat), F.radians(lon)
    return [(F.cos(lat) * F.cos(lon)).alias(f"x{side}"), (F.cos(lat) * F.sin(lon)).alias(f"y{side}"), F.sin(lat).alias(f"z{side}")]


def _fullest(points: DataFrame, side: float, same: str | None) -> int:
    """The most points in a cube of the given side."""
    cells = points.select(*([same] if same else []), *_sphere()).groupBy(*([same] if same else []), *(F.floor(F.col(c) / side).alias(f"g{c}") for c in "xyz")).count()
    return cells.agg(F.max("count")).first()[0] or 0


def nearest(points: DataFrame, k: int, cap_km: float | None = None, same: str | None = None, per_cell: int | None = None) -> DataFrame:
    """src, dst, dist_km, place of the k nearest, by searches that widen for the points that still lack some.

    Cubes on the sphere are made small enough to hold about ``per_cell`` points, 2k if not given. A point looks into the eight
    cubes that a ball of half their side around it touches; if that ball holds k others, they are its nearest.
    The others go on with cubes _WIDER times as wide, so dense places are never searched with wide cubes and
    sparse points see few others. Of many points at one place only the k + 1 smallest ids can be anyone's
    nearest, so no more of them are searched.
    """
    extra, per_cell = [same] if same else [], per_cell or max(8, 2 * k)
    rows = points.where(F.col(same).isNotNull()) if same else points
    rows = settled(rows.where("lat is not null and lon is not null").select("entity", "lat", "lon", *extra, *_sphere()))
    turn = F.row_number().over(Window.partitionBy("lat", "lon", *extra).orderBy("entity"))
    targets = settled(rows.withColumn("turn", turn).where(F.col("turn") <= k + 1).drop("turn"))
    most = min(2.0, _chord(cap_km) if cap_km is not None else 2.0)
    side = 4.0
    while (full := _fullest(targets, side, same)) > 2 * per_cell and side > 1e-9:
        side /= 2 ** max(1, ceil(log2(full / per_cell) / 2))
    open_, found = rows, []
    while True:
        last = side / 2 >= most
        radius = most if last else side / 2
        side = 2 * radius if last else side
        km = 2 * EARTH_KM * asin(min(1.0, radius / 2))
        met = _within(open_, targets, side, extra).where(F.col("dist_km") <= (km if cap_km is None or not last else cap_km))
        top = settled(_placed(met).where(F.col("place") <= k))
        if last:
            return _union([*found, top])
        # a k-th one well inside the ball: nothing outside of it is as near
        done = top.where((F.col("place") == k) & (F.col("dist_km") < km - 1e-5)).select("src")
        found.append(top.join(done, "src", "left_semi"))
        open_ = settled(open_.join(done.withColumnRenamed("src", "entity"), "entity", "left_anti"))
        if open_.isEmpty():
            return _union(found)
        side *= _WIDER


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("src", "dst", "dist_km", "place")


def _within(left: DataFrame, right: DataFrame, side: float, extra: list[str]) -> DataFrame:
    """src, dst, dist_km of the points of ``left`` and those of ``right`` in the eight cubes nearest to each."""
    def low(c: str):
        return F.floor(F.col(c) / side - 0.5)

    steps = F.explode(F.array(*(F.struct(F.lit(i & 1).alias("x"), F.lit(i >> 1 & 1).alias("y"), F.lit(i >> 2).alias("z")) for i in range(8))))
    a = left.withColumn("step", steps).select(F.col("entity").alias("src"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), *extra, *((low(c) + F.col(f"step.{c}")).alias(f"g{c}") for c in "xyz"))
    b = right.select(F.col("entity").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *extra, *(F.floor(F.col(c) / side).alias(f"g{c}") for c in "xyz"))
    pairs = a.join(b, ["gx", "gy", "gz", *extra]).where("src <> dst")
    return pairs.select("src", "dst", haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("dist_km"))


def undirected(edges: DataFrame) -> DataFrame:
    """src < dst once per pair."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.groupBy(a.alias("src"), b.alias("dst")).agg(F.min("dist_km").alias("dist_km"))


def symmetrised(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "dist_km").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist_km"))


def with_ends(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Edges with the value of both ends, as <value>_src and <value>_dst."""
    src = nodes.select(F.col("entity").alias("src"), F.col(value).alias(f"{value}_src"))
    dst = nodes.select(F.col("entity").alias("dst"), F.col(value).alias(f"{value}_dst"))
    return edges.join(src, "src").join(dst, "dst")


def cut(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Only edges inside a block."""
    return with_ends(edges, blocks, "block").where("block_src = block_dst").drop("block_src", "block_dst")


def weighted(edges: DataFrame, cap_km: float) -> DataFrame:
    return edges.withColumn("weight", gaussian_decay(F.col("dist_km"), cap_km))


def neighbour_mean(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """entity, n, mean over neighbours; nodes without one have null."""
    sent = edges.join(nodes.select(F.col("entity").alias("src"), F.col(value).alias("x")), "src")
    got = sent.groupBy(F.col("dst").alias("entity")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return nodes.select("entity").join(got, "entity", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def normalised_sum(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """entity, out: sum of w / sqrt(d_src * d_dst) * x with self loops of weight 1, d the weighted degree."""
    loops = nodes.select(F.col("entity").alias("src"), F.col("entity").alias("dst"), F.lit(1.0).alias("weight"))
    every = edges.select("src", "dst", "weight").unionByName(loops)
    degree = every.groupBy("dst").agg(F.sum("weight").alias("d"))
    rows = every.join(degree, "dst").join(degree.select(F.col("dst").alias("src"), F.col("d").alias("d_src")), "src")
    rows = rows.join(nodes.select(F.col("entity").alias("src"), F.col(value).alias("x")), "src")
    return rows.groupBy(F.col("dst").alias("entity")).agg(F.sum(F.col("weight") * F.col("x") / F.sqrt(F.col("d") * F.col("d_src"))).alias("out"))


def fanout(edges: DataFrame, limit: int, seed: int = 17) -> DataFrame:
    """At most ``limit`` incoming edges of each node, by a seeded hash."""
    turn = bucket_hash(F.col("src") * 31 + F.col("dst"), seed)
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy(turn, "src"))).where(F.col("place") <= limit).drop("place")


def drop_edges(edges: DataFrame, share: float = 0.2, seed: int = 19) -> DataFrame:
    return edges.where(bucket_hash(F.col("src") * 31 + F.col("dst"), seed) >= F.lit(int(share * 1_000_003)))


def morans_i(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """n, w, morans_i with binary weights over directed edges."""
    z = nodes.select("entity", (F.col(value) - nodes.agg(F.avg(value)).scalar()).alias("z"))
    n, zz = z.agg(F.count("*")).scalar(), z.agg(F.sum(F.col("z") * F.col("z"))).scalar()
    cross = with_ends(edges, z, "z").agg(F.count("*").alias("w"), F.sum(F.col("z_src") * F.col("z_dst")).alias("zij"))
    return cross.select(n.alias("n"), "w", F.try_divide(n * F.col("zij"), F.col("w") * zz).alias("morans_i"))


def concordance(pairs: DataFrame, nodes: DataFrame, value: str, bands: tuple[float, ...], least: int = 50) -> DataFrame:
    """band, n, same: share of pairs with equal values by distance band; thin bands are left out."""
    band = F.lit(None).cast("double")
    for top in reversed(bands):
        band = F.when(F.col("dist_km") <= top, F.lit(top)).otherwise(band)
    rows = with_ends(pairs, nodes, value).withColumn("band", band).where("band is not null")
    same = (F.col(f"{value}_src") == F.col(f"{value}_dst")).cast("int")
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.avg(same).alias("same")).where(F.col("n") > least)


def contamination(nearest: DataFrame, blocks: DataFrame, distances: tuple[float, ...]) -> DataFrame:
    """d, n, other: nearest neighbours nearer than d, and those in another block."""
    rows = with_ends(nearest, blocks, "block").withColumn("d", F.explode(F.array(*map(F.lit, distances)))).where(F.col("dist_km") < F.col("d"))
    return rows.groupBy("d").agg(F.count("*").alias("n"), F.sum((F.col("block_src") != F.col("block_dst")).cast("int")).alias("other"))


def bipartite(cells: DataFrame) -> DataFrame:
    """entity, analyte, n, y: an edge per measured entity and analyte with its majority flag."""
    return cells.groupBy("entity", "analyte").agg(F.count("y").alias("n"), (2 * F.sum("y") >= F.count("y")).cast("int").alias("y"))


RELATIONS = ("near", "same_group")


def build(points: DataFrame, blocks: DataFrame, relation: str, k: int, cap_km: float, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges both ways inside blocks, audit) of one relation; an unknown one is refused.

    The audit is one row: relation, nodes, undirected, removed, kept, crossing. The last is
    counted again on what is kept and must be 0.
    """
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation}: one of {', '.join(RELATIONS)}")
    if (relation == "same_group") != (group is not None):
        raise ValueError("a group column goes with the relation same_group alone")
    every = undirected(knn(points, k, cap_km, **({"same": group} if group else {})))
    kept = cut(every, blocks)
    ends = with_ends(every, blocks, "block").agg(F.count("*").alias("undirected"), F.count_if(F.col("block_src") != F.col("block_dst")).alias("removed"))
    again = with_ends(symmetrised(kept), blocks, "block").agg(F.count_if(F.col("block_src") != F.col("block_dst")).alias("crossing"))
    audit = points.agg(F.count("*").alias("nodes")).crossJoin(ends).crossJoin(again)  # one row each
    return symmetrised(kept), audit.select(F.lit(relation).alias("relation"), "nodes", "undirected", "removed", (F.col("undirected") - F.col("removed")).alias("kept"), "crossing")
