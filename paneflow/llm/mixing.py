"""Mixing sources to target weights by capped water-filling (operator 2).

Each source gets a share of the whole size in proportion to its weight, at most
``max_epochs`` times its own size; what a clamped source cannot take goes to the
others by weight until no source is above its cap. A source whose target is r
times its size repeats every document floor(r) times, and a seeded choice of
documents that holds the fraction r - floor(r) of its size once more.

The choice goes through a source's documents in the order of a seeded 64-bit hash and
takes each that fits into what is left of the quota. That is done in passes over the
whole source at once: the documents that fit are taken up to a cut, the first that no
longer fits is passed over, and the next pass goes on behind the cut with those that fit
now, until what is left is below TOLERANCE of the quota, or nothing fits. A cut is found
from sums over hash bins, refined inside the one bin that holds it until few documents
are left there, so neither a source with a third of all rows nor its size makes a hot
task. Equal rows (one hash) are taken together or not at all.

Null texts have size 0 and are never taken, as are other texts without words; the null
source is a source of its own and comes last; an empty table gives an empty mix. Very
long texts are only counted. Extra columns may have any names: a row is carried as one
struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, as_struct, join_checked

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash by which bins are refined at a time, and the rows of a bin that one task orders.
BIN_BITS, BIN_ROWS = 10, 50_000
SEED = 20
#: What may be left of a source's quota, as a share of it.
TOLERANCE = 0.001
_CUTS = "array<struct<after:bigint,upto:bigint,fits:bigint>>"
#: The last mark: a source whose passes came so far is done.
_END = (1 << 63) - 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float, total: float | None = None) -> DataFrame:
    """``sources`` (weight, source_size) with ``target``; ``total`` is the sum of their sizes, if it is known.

    Each round is one aggregate over the sources: those whose share reaches the
    cap are clamped for good, and the level for the others rises. No more rounds
    than sources are needed; in practice it is a few.
    """
    capped = sources.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    ratio = F.col("cap") / F.col("weight")
    if total is None:
        total = float(capped.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:
        held, weight = capped.agg(
            F.coalesce(F.sum(F.when(ratio <= level, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(ratio > level, F.col("weight").cast("double"))), F.lit(0.0)),
        ).first()
        higher = (total - held) / weight if weight else level
        if higher <= level:
            break
        level = higher
    return capped.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("cap")


def _placed(sources: DataFrame, space: Workspace) -> tuple[DataFrame, int, int]:
    """``sources`` with ``place``, their rank by code point, null last; how many they are, and their size.

    Ranges are ranked apart, and the ranges' counts are summed.
    """
    low = F.col("_source").isNull()
    # the upper bits of this id are the partition, the lower 33 the place inside it
    ranged = sources.repartitionByRange(low, "_source").sortWithinPartitions(low, "_source").withColumn("_at", F.monotonically_increasing_id())
    ranged = space.table(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33))
    base, at, total = {}, 0, 0
    parts = ranged.groupBy("_part").agg(F.count("*").alias("rows"), F.sum("source_size").alias("size"))
    for r in sorted(parts.collect(), key=lambda r: r._part):  # one row per partition
        base[r._part], at, total = at, at + r.rows, total + r["size"]
    bases = space.spark.createDataFrame([*base.items()], "_part long, _base long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(bases), "_part").withColumn("place", F.col("_base") + inside).drop("_part", "_base", "_at"), at, total


def _bin(level: int) -> Column:
    """The first ``level`` * BIN_BITS bits of the mark, in the order of the marks."""
    return F.shiftrightunsigned(F.col("_mark").bitwiseXOR(F.lit(-(1 << 63))), 64 - level * BIN_BITS)


def _going() -> Column:
    """Sources whose quota has something left, and documents that were not looked at."""
    return (F.col("left") > 0) & (F.col("left") > TOLERANCE * F.col("_quota")) & (F.coalesce("after", F.lit(0)) < _END)


def _fitting(rows: DataFrame, state: DataFrame, n: int, level: int) -> DataFrame:
    """The documents that fit into what is left of their source's quota, behind its last cut; after the first ``level`` in the bin of its edge alone."""
    going = state.where(_going()).select("_source", "left", "after", *(["below", "edge"] if level else [F.lit(0).cast("long").alias("below")]))
    behind = F.col("after").isNull() | (F.col("_mark") > F.col("after"))
    found = _by_source(rows, going, n).where(behind & (F.col("_size") > 0) & (F.col("_size") <= F.col("left")))
    return found.where(_bin(level) == F.col("edge")) if level else found


def _pass(rows: DataFrame, state: DataFrame, n: int, space: Workspace, turn: int) -> DataFrame:
    """The written ``state`` of the ``n`` sources after one more pass over the written ``rows``.

    A source's edge is the bin in which its quota is passed, ``below`` the size of what comes before it; without
    an edge all that fits is taken. Each step of a pass is one written table with a row per source.
    """
    level, held = 0, state.withColumns({"every": F.lit(None).cast("long"), "crowd": F.lit(None).cast("long")})
    while True:
        level += 1
        bins = _fitting(rows, held, n, level - 1).groupBy("_source", "left", "below", _bin(level).alias("bin")).agg(F.sum("_size").alias("size"), F.count("*").alias("rows"))
        run = Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("sum", F.col("below") + F.sum("size").over(run)).withColumn("before", F.col("sum") - F.col("size"))
        passed = (F.col("sum") > F.col("left")) & (F.col("before") <= F.col("left"))
        ends = bins.groupBy("_source").agg(F.max("sum").alias("_sum"), F.max(F.when(passed, F.struct("before", "bin", "rows"))).alias("_at"))
        edge = [F.coalesce("_sum", "every").alias("every"), F.col("_at.before").alias("below"), F.col("_at.bin").alias("edge"), F.col("_at.rows").alias("crowd")]
        held = space.table(_by_source(held, ends, n, "left").select(*state.columns, *edge), f"edges{turn}-{level}")
        if (level + 1) * BIN_BITS > 63 or held.where(F.col("crowd") > BIN_ROWS).isEmpty():
            break
    ordered = Window.partitionBy("_source").orderBy("_mark").rangeBetween(Window.unboundedPreceding, 0)
    inside = _fitting(rows, held, n, level).withColumn("sum", F.col("below") + F.sum("_size").over(ordered))
    fits = F.col("sum") <= F.col("left")
    inside = inside.groupBy("_source").agg(F.max(F.when(fits, F.col("_mark"))).alias("last"), F.max(F.when(fits, F.col("sum"))).alias("most"), F.min(F.when(~fits, F.col("_mark"))).alias("past"))
    # below the edge everything is taken: up to the last mark of the bin before it
    first, cut = F.shiftleft(F.col("edge"), 64 - level * BIN_BITS).bitwiseXOR(F.lit(-(1 << 63))), F.col("edge").isNotNull()
    upto = F.when(cut, F.coalesce("last", F.when(F.col("edge") > 0, first - 1))).when(F.col("every").isNotNull(), F.lit(_END))
    got = F.when(cut, F.coalesce("most", "below")).otherwise(F.coalesce("every", F.lit(0)))
    taken = F.when(upto.isNotNull(), F.array_append("_cuts", F.struct("after", upto.alias("upto"), F.col("left").alias("fits")))).otherwise(F.col("_cuts"))
    # a source in which nothing fits is done too
    new = {"left": F.col("left") - got, "after": F.coalesce("past", F.lit(_END)), "_cuts": taken.cast(_CUTS)}
    return space.table(_by_source(held, inside, n, "left").withColumns(new).select(*state.columns), f"state{turn}")


def _source_plan(rows: DataFrame, space: Workspace, max_epochs: float, weights: tuple[int, ...]) -> tuple[DataFrame, int]:
    """One written row per source of the written rows (_source, _size, _mark), with ``_cuts``: what each pass takes. And how many they are."""
    sums = space.table(rows.groupBy("_source").agg(F.sum("_size").alias("source_size")), "sums")
    listed = F.array(*map(F.lit, weights))
    sources, n, total = _placed(sums, space)
    sources = sources.withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    sources = water_fill(space.table(sources, "weights"), max_epochs, float(total))
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    quota = F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size"))
    sources = sources.drop("weight").withColumn("_whole", F.floor(ratio + 1e-9)).withColumn("_quota", quota)
    state = space.table(sources.select("*", F.floor("_quota").alias("left"), F.lit(None).cast("long").alias("after"), F.array().cast(_CUTS).alias("_cuts")), "state0")
    turn = 0
    while not state.where(_going()).isEmpty():
        turn += 1
        state = _pass(rows, state, n, space, turn)
    return state.drop("_quota", "left", "after"), n


def _extra() -> Column:
    """1 where the fractional repetition takes a row: one of the passes does."""
    mark = F.col("_mark")
    taken = F.exists("_cuts", lambda c: (c["after"].isNull() | (mark > c["after"])) & (mark <= c["upto"]) & (F.col("_size") <= c["fits"]))
    return (taken & (F.col("_size") > 0)).cast("long")


def _by_source(left: DataFrame, right: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Join the few columns of a table with at most ``n`` sources by source, null with null."""
    right = right.withColumnRenamed("_source", "_source2")
    return join_checked(left, right, F.col("_source").eqNullSafe(F.col("_source2")), how, rows=n).drop("_source2")


def mixed_rows(docs: DataFrame, max_epochs: float = 3.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` with _size, source_size, target, _whole and _extra: the mix takes _whole + _extra copies of a row.

    ``weights`` repeat over the sources by code point, null last.
    """
    space = Workspace(docs.sparkSession, "mix")
    marked = docs.withColumn("_source", F.col(source_col)).withColumn("_size", word_count(F.col(text_col))).withColumn("_mark", F.xxhash64(id_col, "_size", F.lit(seed)))
    rows = space.table(marked.select("_source", "_size", "_mark"), "sizes")
    plan, n = _source_plan(rows, space, max_epochs, weights)
    return _by_source(marked, plan, n).withColumn("_extra", _extra()).withColumn("_whole", F.when(F.col("_size") > 0, F.col("_whole")).otherwise(0)).drop("_cuts")


def mix_plan(docs: DataFrame, max_epochs: float = 3.0, **names) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words, repeats counted), source."""
    rows = mixed_rows(docs.select(*dict.fromkeys([names.get("id_col", "doc_id"), names.get("text_col", "text"), names.get("source_col", "source")])), max_epochs, **names)
    taken = F.col("_size") * (F.col("_whole") + F.col("_extra"))
    return rows.select(F.col(names.get("id_col", "doc_id")).alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), F.col("_source").alias("source"))


def mix(docs: DataFrame, max_epochs: float = 3.0, **names) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its columns unchanged."""
    # the row goes along as one struct: its columns clash with nothing
    needed = dict.fromkeys([names.get("id_col", "doc_id"), names.get("text_col", "text"), names.get("source_col", "source")])
    rows = mixed_rows(docs.select(*needed, as_struct(docs).alias("_row")), max_epochs, **names)
    times = F.explode(F.array_repeat(F.lit(0), (F.col("_whole") + F.col("_extra")).cast("int"))).alias("_copy")
    return rows.select("_row", times).select("_row.*")
