"""MinHash near-duplicates with sequential Bayesian verification (operator 10).

1. One pass over the texts gives each row its set of word shingles, a 128-bit
   digest of that set, one band hash per BANDS and one byte per MinHash value.
   Rows with equal sets form a class; from here on only classes are compared.
2. Classes that share a band are candidates. In each bucket every class is paired
   with two leaders: the first by a hash, and the class that meets
   most others. So a bucket gives twice as many pairs as it has rows at most.
3. A pair's MinHash bytes are compared in batches. With m of n equal the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair is dropped as
   soon as the posterior of a similarity at or over the threshold is below MISS.
4. What survives is verified on the full shingle sets of the texts.
5. Classes of buckets that then still hold several components meet once more, by
   an exact prefix filter instead of all pairs of a bucket: shingles are ordered
   by how rare they are among these classes, and two sets can only reach the
   threshold if the first few in that order, as many as their sizes leave room
   for, have one in common. Classes of one size class are dealt by those shingles;
   pairs across components that meet there, within the bounds that the sizes and
   the places of the shingle set, go through 3 and 4, each once. Pairs inside a
   component need no test, as they cannot change the result.

With BANDS bands of ROWS rows, a pair at a similarity of exactly 0.8 shares no
band with probability (1 - 0.8**5)**40 = 1e-7; step 5 finds every pair among the
classes that it looks at.

Null texts, empty texts and texts of separators only have an empty set and are
linked with nothing. Texts of fewer words than a shingle are one shingle as a
whole; very long texts are taken whole, one at a time. Repeated rows are one
class; rows of one id with other texts are apart. A null id takes part and is
smaller than nothing: a component's id is its smallest non-null id, or null. Ties
have no effect on the result. Extra columns may have any names: ``keep_one``
carries a row as one struct. An empty table gives nothing.
"""

from __future__ import annotations

import hashlib
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, as_struct, join_checked, session_conf, slot_counts, text_chunks
from paneflow.llm.components import components
from paneflow.llm.wordhash import combine, mix, words

ROWS, BANDS = 5, 40
SEED = 10
#: Chance to drop a pair whose similarity reaches the threshold.
MISS = 1e-6
#: MinHash values compared at a time.
BATCH = 20
#: Counters of shingles (2**SLOT_BITS bytes, broadcast), and the width of size classes, for step 5.
SLOT_BITS, SIZE_STEP = 22, 1.05
SIGNED = "doc_id {id}, mark long, n_shingles long, k binary, sketch binary, bands array<long>"


def row_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, bounds = words(texts)
    grams, out = combine(h, n), []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        else:
            out.append(combine(h[lo:hi], max(1, hi - lo)))
    return out


@cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, c = rng.integers(0, 1 << 32, (2, ROWS * BANDS), dtype=np.uint64).astype(np.uint32)
    return a | np.uint32(1), c


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets x ROWS * BANDS) of non-empty sets."""
    a, c = _family()
    x = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out, held = np.empty((len(sets), len(a)), dtype=np.uint32), np.empty_like(x)
    for j in range(len(a)):
        np.multiply(x, a[j], out=held)
        np.add(held, c[j], out=held)
        out[:, j] = np.minimum.reduceat(held, starts)
    return out


def sign(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, mark (a hash of the text), n_shingles, class key, sketch, bands (each value stands for its band too)."""

    def task(batches):
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                sets = row_sets(texts, n)
                some = [i for i, s in enumerate(sets) if len(s)]
                sketch, bands = [None] * len(sets), [None] * len(sets)
                if some:
                    values = min_hashes([sets[i] for i in some])
                    small = (mix(values.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(some), 1))
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9FB21C651E98DF25) + values[:, r::ROWS])
                    key = key.astype(np.int64)
                    for at, i in enumerate(some):
                        sketch[i], bands[i] = small[at].tobytes(), key[at]
                part = batch.slice(first, last - first)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "n_shingles", "k", "sketch", "bands"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, SIGNED.format(id=dict(docs.dtypes)[id_col]))


def posterior_over(threshold: float, m: int, n: int) -> float:
    """P(similarity >= threshold) after m of n equal values, from a uniform prior."""
    grid = threshold + (1 - threshold) * (np.arange(4000) + 0.5) / 4000
    log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
    return float(np.exp(log).sum() * (1 - threshold) / 4000)


def least_equal(threshold: float, n: int, miss: float) -> int:
    """The smallest m for which a pair with m of n equal values goes on."""
    return next(m for m in range(n + 1) if posterior_over(threshold, m, n) >= miss)


def survives(left: np.ndarray, right: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Which pairs of sketches (pairs x values) pass every batch."""
    going, equal = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for n in range(BATCH, left.shape[1] + 1, BATCH):
        equal = equal + (left[going, n - BATCH : n] == right[going, n - BATCH : n]).sum(axis=1)
        stay = equal >= least_equal_cached(threshold, n, miss)
        going, equal = going[stay], equal[stay]
    out = np.zeros(len(left), dtype=bool)
    out[going] = True
    return out


least_equal_cached = cache(least_equal)


def _sketch_test(pairs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the threshold."""
    held = shapes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = shapes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.join(held, "a").join(other, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def task(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, ROWS * BANDS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(survives(left, right, percent / 100)))

    return rows.select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def _exact_test(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold; ``texts`` has (c, text) of every class in a pair."""
    rows = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")

    def task(batches):
        for batch in batches:
            keys = [batch.column("a").to_pylist(), batch.column("b").to_pylist()]
            sets: dict[int, np.ndarray] = {}
            for listed, column in zip(keys, ("ta", "tb"), strict=True):
                at = {k: i for i, k in enumerate(listed) if k not in sets}
                fresh = batch.select([column]).take(pa.array(list(at.values()), pa.int64()))
                got = [s for _, _, part in text_chunks(fresh, column) for s in row_sets(part, n)]
                sets.update(zip(at, got, strict=True))
            keep = []
            for a, b in zip(*keys, strict=True):
                x, y = sets[a], sets[b]
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


@cache
def size_bounds() -> np.ndarray:
    """The least size of each size class; single sizes first, then steps of SIZE_STEP."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * SIZE_STEP)))
    return np.array(out, dtype=np.int64)


def least_overlap(n, m, percent: int):
    """The fewest common shingles of sets of n and m shingles that reach the threshold."""
    return -(-percent * (n + m) // (100 + percent))


def _slots(sets: list[np.ndarray]) -> np.ndarray:
    return (np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def prefix_keys(grams: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, side) of the shingles by which a set of ``grams`` can meet others.

    ``counts`` orders the shingles, rare ones first. For each size class that may
    reach the threshold with this set, the shingles up to the last place at which a
    first common one may stand are keyed by both size classes. A count of 1 says that
    no other set has the shingle. Side 0 is the smaller size class, 1 the larger, 2 both.
    """
    n, bounds = len(grams), size_bounds()
    own = int(np.searchsorted(bounds, n, "right")) - 1
    low, high = -(-percent * n // 100), 100 * n // percent
    others = np.arange(np.searchsorted(bounds, low, "right") - 1, np.searchsorted(bounds, high, "right"))
    room = n - least_overlap(n, np.maximum(bounds[others], low), percent) + 1
    order = np.lexsort((grams, counts))[: max(0, int(room.max()))]
    keys, places, sides = [], [], []
    some = np.flatnonzero(counts[order] > 1)
    for other, k in zip(others.tolist(), room.tolist(), strict=True):
        at = some[: np.searchsorted(some, k)]
        pair = np.uint64(min(own, other) << 20 | max(own, other))
        keys.append(mix(grams[order[at]] + mix(np.full(len(at), pair, dtype=np.uint64))))
        places.append(at)
        sides.append(np.full(len(at), 2 if own == other else int(own > other), dtype=np.int8))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(sides)


def _across(texts: DataFrame, known: DataFrame, space: Workspace, percent: int, n: int) -> DataFrame:
    """Pairs (a, b) of the classes in the written ``texts`` (c, text) that step 5 lets through; ``known`` has (c, comp)."""

    def slots(batch):
        return (_slots(row_sets(part, n)) for _, _, part in text_chunks(batch, "text"))

    counts = space.spark.sparkContext.broadcast(slot_counts(texts.select("text"), slots, SLOT_BITS))

    def task(batches):
        for batch in batches:
            for first, last, part in text_chunks(batch, "text"):
                sets = row_sets(part, n)
                held = np.split(counts.value[_slots(sets)], np.cumsum([len(x) for x in sets])[:-1])
                found = [prefix_keys(x, k, percent) for x, k in zip(sets, held, strict=True)]
                key, place, side = (np.concatenate(x) for x in zip(*found, strict=True))
                times = [len(x[0]) for x in found]
                c = np.repeat(batch.column("c").slice(first, last - first).to_numpy(), times)
                size = np.repeat([len(x) for x in sets], times)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.astype(np.int64)), "c": pa.array(c, pa.int64()), "n": pa.array(size, pa.int64()), "place": pa.array(place, pa.int64()), "side": pa.array(side, pa.int8())})

    keyed = texts.select("c", "text").mapInArrow(task, "key long, c long, n long, place long, side byte")
    keyed = space.table(join_checked(keyed, known, "c"), "keyed")
    # keys of several components; what is not of a key's largest component meets all of the key
    parts = keyed.groupBy("key", "comp").agg(F.count("*").alias("rows"))
    main = parts.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    main = space.table(main.select("key", F.col("main.comp").alias("main")), "main")
    keyed = space.table(join_checked(keyed, main, "key"), "meeting")
    space.drop("keyed", "main")
    other = keyed.select("key", *(F.col(x).alias(f"{x}2") for x in ("c", "n", "place", "side", "comp", "main")))
    need = -F.floor(-percent * (F.col("n") + F.col("n2")) / (100 + percent))
    room = 1 + F.least(F.col("n") - 1 - F.col("place"), F.col("n2") - 1 - F.col("place2"))
    fits = (F.col("comp") != F.col("comp2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (room >= need)
    fits &= ((F.col("side") == 0) & (F.col("side2") == 1)) | ((F.col("side") == 2) & (F.col("side2") == 2))
    minor = keyed.where("comp <> main").join(other, "key").where(fits & ((F.col("comp2") == F.col("main2")) | (F.col("side") == 0) | (F.col("c") < F.col("c2"))))
    major = keyed.where("comp = main and side = 0").join(other.where("comp2 <> main2"), "key").where(fits)
    return minor.unionAll(major).select(*_ordered(F.col("c"), F.col("c2"))).distinct()


def _merged(fresh: DataFrame, known: DataFrame, space: Workspace) -> DataFrame | None:
    """(comp, end): what the components that the written edges ``fresh`` touch become by them; None without edges.

    ``known`` has (c, comp) of every class in an edge. Only components that met are joined anew, not all edges again.
    """
    if fresh.isEmpty():
        return None
    nodes = known.count()
    drawn = join_checked(fresh, known.select(F.col("c").alias("a"), F.col("comp").alias("x")), "a", rows=nodes)
    drawn = join_checked(drawn, known.select(F.col("c").alias("b"), F.col("comp").alias("y")), "b", rows=nodes)
    edges = space.table(drawn.select(*_ordered(F.col("x"), F.col("y"))).where("a <> b").distinct(), "met")
    ends = components(edges, space, "second")
    space.drop("met")
    return ends.select(F.col("k").alias("comp"), F.col("comp").alias("end"))


class _Verifier:
    """Steps 3 and 4 for one table of pairs after the other."""

    def __init__(self, space: Workspace, docs: DataFrame, shapes: DataFrame, percent: int, n: int):
        self.space, self.docs, self.shapes, self.percent, self.n = space, docs, shapes, percent, n

    def likely(self, pairs: DataFrame, name: str) -> DataFrame:
        return self.space.table(_sketch_test(pairs, self.shapes, self.percent), f"likely-{name}")

    def texts(self, met: DataFrame, name: str) -> DataFrame:
        """The text of one row of each class in ``met`` (c), written; equal rows are each there, which only repeats pairs."""
        need = self.space.table(met.distinct().join(self.shapes.select("c", "first"), "c"), f"need-{name}")
        rows = self.docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("first"), "text")
        return self.space.table(join_checked(rows, need, "first").select("c", "text"), f"texts-{name}")

    def exact(self, likely: DataFrame, texts: DataFrame, name: str) -> DataFrame:
        with session_conf(self.space.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}):
            return self.space.table(_exact_test(likely, texts, self.percent, self.n), name)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, mark (xxhash64 of the text)."""
    space = Workspace(docs.sparkSession, "near")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = space.table(sign(docs, n), "signed")
    # equal sets: partial aggregates, so a class of any size is cheap
    some = signed.where(F.col("n_shingles") > 0).withColumn("first", F.struct("doc_id", "mark"))
    classes = some.groupBy("k").agg(F.min("first").alias("first"), F.min("doc_id").alias("low"))
    classes = space.table(classes, "classes")
    # a class is named by a 64-bit hash of its digest where pairs are formed
    shapes = some.drop("doc_id", "mark").withColumnRenamed("n_shingles", "n").join(classes.hint("merge"), ["k", "first"]).dropDuplicates(["k", "first"])
    shapes = space.table(shapes.withColumn("c", F.xxhash64("k")), "whole-shapes")
    # tables go as soon as no later step reads them, and with them sketches and bands, most of the bytes
    signed = space.table(signed.select("doc_id", "mark", "n_shingles", "k"), "rows")
    space.drop("signed", "classes")

    banded = shapes.select("c", F.explode("bands").alias("v"))
    shared = space.table(banded.groupBy("v").count().where("count > 1").select("v"), "shared")
    members = space.table(join_checked(banded, shared, "v"), "members")
    shapes = space.table(shapes.drop("bands"), "shapes")
    space.drop("shared", "whole-shapes")
    turn = F.xxhash64("c", F.lit(SEED))
    buckets = members.groupBy("v").agg(F.count("*").alias("rows"), F.min(F.struct(turn.alias("turn"), "c")).alias("leader"))
    buckets = space.table(buckets.select("v", "rows", F.col("leader.c").alias("leader")), "buckets")
    led = space.table(join_checked(members, buckets, "v"), "led")
    # a class that meets many others is near the middle of its group: it leads each of its buckets too
    central = space.table(led.groupBy("c").agg(F.sum("rows").alias("met")), "central")
    hubs = led.select("v", "c").join(central, "c").groupBy("v").agg(F.max(F.struct("met", "c")).alias("hub"))
    hubs = space.table(hubs.select("v", F.col("hub.c").alias("hub")), "hubs")
    to = led.select("c", F.col("leader").alias("to")).unionAll(join_checked(members, hubs, "v").select("c", F.col("hub").alias("to")))
    stars = space.table(to.where(F.col("c") != F.col("to")).select(*_ordered(F.col("c"), F.col("to"))).distinct(), "stars")
    space.drop("buckets", "led", "central", "hubs")
    verify = _Verifier(space, docs, shapes, percent, n)
    likely = verify.likely(stars, "stars")
    texts = verify.texts(likely.select(F.col("a").alias("c")).unionAll(likely.select(F.col("b").alias("c"))), "stars")
    edges = verify.exact(likely, texts, "edges")
    space.drop("texts-stars", "need-stars", "likely-stars")
    comps = components(edges, space, "first")

    # classes of buckets that still hold several components
    placed = members.join(comps.withColumnRenamed("k", "c"), "c", "left").select("v", "c", F.coalesce("comp", "c").alias("comp"))
    placed = space.table(placed, "placed")
    mixed = placed.groupBy("v").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("v")
    mixed = space.table(mixed, "mixed")
    n_mixed, merged = mixed.count(), None
    if n_mixed:
        known = join_checked(placed, mixed, "v", rows=n_mixed).select("c", "comp").distinct()
        known = space.table(known, "known")
        space.drop("members", "placed", "mixed")
        texts = verify.texts(known.select("c"), "across")
        cross = space.table(_across(texts, known, space, percent, n).join(stars, ["a", "b"], "left_anti"), "cross")
        space.drop("meeting")
        if not cross.isEmpty():
            fresh = verify.exact(verify.likely(cross, "cross"), texts, "edges-cross")
            merged = _merged(fresh, known, space)
        space.drop("texts-across", "need-across", "known", "cross", "likely-cross", "edges-cross")
    space.drop("members", "placed", "mixed", "stars")

    whole = shapes.select("k", "c", "low").join(comps.withColumnRenamed("k", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    if merged is not None:
        whole = join_checked(whole, merged, "comp", "left").withColumn("comp", F.coalesce("end", "comp"))
    whole = space.table(whole.select("k", "low", "comp"), "whole")
    space.drop("shapes")
    low = space.table(whole.groupBy("comp").agg(F.min("low").alias("component_id")), "low")
    ids = space.table(join_checked(whole, low, "comp").select("k", "component_id"), "ids")
    space.drop("whole", "low")
    rows = join_checked(signed, ids, "k", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "mark")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one id of each component, the smallest; empty texts all stay."""
    found = near_duplicates(docs, n, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("id2"), F.col("mark").alias("mark2")).distinct()
    gone = Workspace(docs.sparkSession, "near-gone").table(found, "gone")
    # the row goes along as one struct: its columns clash with nothing
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), as_struct(docs).alias("row"))
    return join_checked(rows, gone, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left_anti").select("row.*")
