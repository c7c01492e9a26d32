"""Toxicity scores by FTRL-proximal logistic regression (operator 5).

Features are the presence of hashed words, word pairs and skip-pairs (one word
left out) of the whole text. Training keeps per-coordinate sums z and n, so each
coordinate has its own rate, and the L1 term leaves a weight at zero until its
evidence exceeds it; what remains is a small table that is broadcast.

Labelled rows are dealt over tasks of about PER_SHARD rows, at least one. Each task
runs through its rows from the shared state, and where tasks met a coordinate their
states are averaged, ROUNDS times; a state has a fixed size. The bias starts at the
logarithm of the classes' odds, so what has no evidence scores as the base rate. At
most MAX_TRAIN labelled ids, about, are learned from, chosen by a seeded hash: the
one bound, a parameter.

Null and empty texts get the score of the bias alone; ids repeat freely, and each
different text of a labelled id is learned from once; labels that are null are left out, an id with several labels counts as toxic if one
says so; with no label of either class the score is the share of toxic rows (0.5
without any). Very long texts are scored whole, one at a time; a column that has the
name of the score is replaced, all others pass through whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from paneflow.llm.common import Workspace, give_back, small_batches, text_chunks
from paneflow.llm.wordhash import mix, row_of, words

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
PER_SHARD, ROUNDS, MAX_TRAIN, SEED = 4_000, 4, 16_000, 5
THRESHOLD = 0.3
#: Marks that a task remembers, so as to give a repeated row once.
_SEEN = 1 << 16
_KINDS = ((0, 0x51ED270B), (1, 0x2545F491), (2, 0x6C8E9CF5))


def features(texts: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, coordinate) arrays for words, pairs and skip-pairs."""
    h, bounds = words(texts)
    rows, out = row_of(bounds), []
    shift = np.uint64(64 - bits)
    for step, salt in _KINDS:
        if step == 0:
            out.append((rows, (mix(h + np.uint64(salt)) >> shift).astype(np.int32)))
        elif len(h) > step:
            same = rows[:-step] == rows[step:]
            pair = mix(h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:] + np.uint64(salt))
            out.append((rows[:-step][same], (pair[same] >> shift).astype(np.int32)))
    return out


def row_features(texts: pa.Array, bits: int = BITS) -> list[np.ndarray]:
    """The distinct coordinates of each row."""
    found = features(texts, bits)
    rows, at = np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])
    keys = np.unique(rows.astype(np.int64) << bits | at)
    cuts = np.searchsorted(keys, np.arange(1, len(texts), dtype=np.int64) << bits)
    return np.split(keys & ((1 << bits) - 1), cuts) if len(texts) else []


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed form of the weights: zero within L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def bias_of(z: np.ndarray, n: np.ndarray, prior: float) -> float:
    """The bias: the last coordinate, without L1, beside the prior log-odds."""
    return float(prior - z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2))


def learn(z: np.ndarray, n: np.ndarray, rows: Iterable[np.ndarray], labels: np.ndarray, prior: float = 0.0) -> None:
    """One pass over rows, in place."""
    for at, y in zip(rows, labels, strict=True):
        w = weights_of(z[at], n[at])
        bias = bias_of(z, n, prior)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
        root = np.sqrt(n[at])
        z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
        n[at] += g * g
        z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / ALPHA * (bias - prior)
        n[-1] += g * g


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never taken from; a null id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(mark, y, at): labelled, not held-out rows with their coordinates, of about MAX_TRAIN ids at most.

    Of rows with one mark (id and text) a task gives one, and :func:`learn` gets one: no aggregate needs to sort coordinates.
    """
    key, mark = F.col(id_col), F.xxhash64(F.col("key"), F.lit(SEED))
    known = labels.select(key.alias("key"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("key").isNotNull() & ~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.max("y").alias("y"))
    share = MAX_TRAIN / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(mark, F.lit(1 << 20)) < int(share * (1 << 20)))
    mark = F.xxhash64("key", "text", F.lit(SEED))
    rows = docs.select(key.alias("key"), F.col(text_col).alias("text")).join(F.broadcast(known), "key")

    def task(batches):
        seen: set[int] = set()
        for batch in batches:
            fresh = [mark not in seen and not seen.add(mark) for mark in batch.column("mark").to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            if len(seen) > _SEEN:
                seen.clear()
            for first, last, texts in text_chunks(batch, "text"):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_pydict({"mark": part.column("mark"), "y": part.column("y"), "at": pa.array([pack(x) for x in row_features(texts)], pa.binary())})

    return rows.select(mark.alias("mark"), "y", "text").mapInArrow(task, "mark long, y int, at binary")


def pack(at: np.ndarray) -> bytes:
    """Sorted coordinates as compressed differences."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), dtype="<u4"), dtype=np.int64)


def once(group: pa.Table) -> pa.Table:
    """The first of the rows with equal marks, which stand together."""
    marks = group.column("mark").to_numpy()
    fresh = np.ones(len(marks), dtype=bool)
    np.not_equal(marks[1:], marks[:-1], out=fresh[1:])
    return group.filter(pa.array(fresh))


def _pass_from(state, prior: float):
    """One pass over a shard's rows from the broadcast state; the coordinates that it met."""

    def one_pass(group: pa.Table) -> pa.Table:
        z, n = (x.copy() for x in state.value)
        before = n.copy()
        group = once(group.sort_by("mark"))
        # one row's coordinates at a time
        learn(z, n, (unpack(x.as_py()) for x in group.column("at")), group.column("y").to_numpy(), prior)
        met = np.flatnonzero(n != before)  # 2**BITS at most, so exact as a 32-bit float too
        held = np.empty((3, len(met)), dtype="<f4")
        held[0], held[1], held[2] = met, z[met], n[met]
        packed = zlib.compress(held.tobytes(), 1)
        del z, n, before, met, held
        give_back()
        return pa.table({"state": pa.array([packed], pa.binary())})

    return one_pass


def train(docs: DataFrame, labels: DataFrame, **names) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) of the model, at most 2**BITS of them."""
    spark = docs.sparkSession
    space = Workspace(spark, "toxicity")
    rows = space.table(sample(docs, labels, **names), "sample")
    n_rows, n_toxic = rows.groupBy("mark").agg(F.max("y").alias("y")).agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n_toxic in (0, n_rows):
        share = n_toxic / n_rows if n_rows else 0.5
        return np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    prior = float(np.log(n_toxic / (n_rows - n_toxic)))
    rows = rows.withColumn("shard", F.pmod("mark", F.lit(-(-n_rows // PER_SHARD))))
    for turn in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))
        # written first: a few small files, read one after the other, not a job for each partition of a shuffle
        states = space.table(rows.groupBy("shard").applyInArrow(_pass_from(state, prior), "state binary"), f"states{turn}")
        # one row a shard, each at most 2**BITS + 1 coordinates: bounded whatever the documents are
        # the arrays are broadcast as they were; here they become the sums, so that the driver holds no others
        shards = np.zeros(len(z), dtype=np.int32)
        for (held,) in states.toLocalIterator():
            raw = zlib.decompress(held)
            size = len(raw) // 12
            at = np.frombuffer(raw, dtype="<f4", count=size).astype(np.int32)
            fresh = shards[at] == 0
            for k, total in enumerate((z, n), 1):
                total[at[fresh]] = 0.0
                total[at] += np.frombuffer(raw, dtype="<f4", count=size, offset=4 * size * k)
            shards[at] += 1
            del held, raw, at, fresh
        np.maximum(shards, 1, out=shards)
        z /= shards
        n /= shards
        del shards
        give_back()
        state.destroy()
        space.drop(f"states{turn}")
    at = np.flatnonzero(np.abs(z[:-1]) > L1)
    return at, weights_of(z[at], n[at]), bias_of(z, n, prior)


def score_rows(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores of one array of texts; ``weights`` by coordinate."""
    keys = [np.zeros(0, dtype=np.int64)]
    for rows, at in features(texts):
        hit = np.flatnonzero(weights[at])
        keys.append(rows[hit].astype(np.int64) << BITS | at[hit])
    keys = np.unique(np.concatenate(keys))
    total = np.bincount(keys >> BITS, weights[keys & ((1 << BITS) - 1)], minlength=len(texts)) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str | None = "score", keep_text: bool = True, below: float | None = None) -> DataFrame:
    """``docs`` with ``score_col`` (replaced if there; none if None); with ``below``, only rows that score less."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    # columns go to Python by their places, whatever their names
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    kept = [c for c in docs.columns if c != score_col and (keep_text or c != text_col)]
    text, others = place[text_col], [place[c] for c in kept]

    def task(batches):
        at, w, bias = held.value
        weights = np.zeros(1 << BITS)
        weights[at] = w
        for batch in batches:
            for first, last, texts in text_chunks(batch, text):
                got = score_rows(texts, weights, bias)
                out = batch.slice(first, last - first).select(others)
                if score_col is not None:
                    out = pa.RecordBatch.from_arrays([*out.columns, pa.array(got)], names=[*others, "score"])
                yield out if below is None else out.filter(pa.array(got < below))

    schema = StructType([StructField(place[f.name], f.dataType, f.nullable) for f in docs.schema if f.name in kept])
    if score_col is not None:
        schema.add("score", "double", False)
    scored = docs.toDF(*place.values()).select(*dict.fromkeys([text, *others])).mapInArrow(task, schema)
    return scored.toDF(*kept, *([score_col] if score_col is not None else []))
