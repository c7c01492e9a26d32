"""Stupid-backoff language-model scores by exchanged n-gram counts (operator 7).

With counts over all documents, a word scores count(n-gram) / count(its context)
if the longest n-gram that ends with it, of at most ``order`` words, occurs at
least ``least`` times; else BACKOFF times the score with one word less; a single
word scores count / words. The first words of a text have shorter n-grams only,
which costs no backoff. A document's score is the sum of the logarithms.

The steps are a count table, a join and a sum, on packed rows:

1. One pass writes the texts as *blocks* of about BLOCK_BYTES: the distinct words'
   64-bit hashes, and the text as places among them, frequent words first, then
   by hash, so that places and differences of hashes are small numbers and compress. Nothing later reads a text.
2. Each block sends every distinct n-gram that it has, with its count, to one of
   many partitions by ranges of the n-gram's hash. An n-gram is sent once per
   block, however often it occurs, so none makes a partition hot.
3. A partition adds the counts up and answers each block, in the same order. The
   answers go straight to the blocks; they are not written as a table before.
4. A block joined to its answers knows the counts at each of its words, and sums
   the scores per document.

An n-gram is named by a 64-bit hash of its words' whole 64-bit hashes. Scoring the
texts that the model counts, an n-gram seen once is the text's own, so ``least`` is
2 by default; 1 is the plain formula. With ``corpus`` given, the counts come from
there instead; a word that it lacks counts as once seen.

Null and empty texts have no words: score 0, mean null. Words are runs of
characters other than space and 0x09-0x0D, A-Z lower-cased. Repeated rows count
and are scored each; ids may be null or repeat; a very long text is a block of its
own; only the id and the text are read, so the names of other columns clash with
nothing. An empty table gives nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, give_back, text_chunks
from paneflow.llm.wordhash import combine, row_of, words

LEAST, BACKOFF, ORDER = 2, 0.4, 2
BLOCK_BYTES = 4 << 20
#: Words of the corpus per partition of the count tables, times the order: the n-grams there are at most as many.
PER_PART = 3_000_000


def pack(values: np.ndarray) -> bytes:
    """How many whole numbers, then these by planes of bytes, compressed."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return len(wide).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(wide.T), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    planes = pa.decompress(packed[8:], decompressed_size=8 * int.from_bytes(packed[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def blocks(rows: DataFrame) -> DataFrame:
    """(block, ids, sizes, vocab, places): the texts of ``rows`` (doc_id, text) as words' places among the block's distinct words."""
    limit = BLOCK_BYTES

    def task(batches):
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text", limit):
                h, bounds = words(texts)
                vocab, places, times = np.unique(h, return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                vocab, places = vocab[order], rank[places]
                ids = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), batch.column("doc_id").slice(first, last - first))
                sizes = pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), pa.array(np.diff(bounds), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([n]), ids, sizes, pa.array([pack(np.diff(vocab, prepend=np.uint64(0)))]), pa.array([pack(places)])], names=["block", "ids", "sizes", "vocab", "places"])
                n += 1

    return rows.mapInArrow(task, f"block long, ids array<{dict(rows.dtypes)['doc_id']}>, sizes array<long>, vocab binary, places binary")


def ngrams(vocab: bytes, places: bytes, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length 1 ... order: (last words of the n-grams inside texts, their hashes)."""
    h = np.cumsum(unpack(vocab), dtype=np.uint64)[unpack(places)]  # differences modulo 2**64
    row, out = row_of(np.concatenate([[0], np.cumsum(sizes)])), []
    for n in range(1, order + 1):
        inside = np.flatnonzero(row[: max(0, len(h) - n + 1)] == row[n - 1 :])
        out.append((inside + n - 1, combine(h, n)[inside] if n > 1 else h[inside]))
    return out


def _asked(held: DataFrame, parts: int, order: int, counted: bool, answered: bool) -> DataFrame:
    """(part, block, n, grams, counts): the distinct n-grams of each block by ranges of their hash."""

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for n, (_, grams) in enumerate(ngrams(row["vocab"], row["places"], np.array(row["sizes"], dtype=np.int64), order), 1):
                    grams, counts = np.unique(grams, return_counts=True)
                    part = ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                    cuts = np.flatnonzero(np.diff(part, prepend=-1))
                    ends = np.append(cuts[1:], len(part))[: len(cuts)]
                    found = [(int(part[a]), row["block"] if answered else None, n, pack(np.diff(grams[a:b], prepend=np.uint64(0))), pack(counts[a:b] if counted else counts[a:b] * 0)) for a, b in zip(cuts, ends, strict=True)]
                    if found:
                        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["part", "block", "n", "grams", "counts"])

    return held.select("block", "sizes", "vocab", "places").mapInArrow(task, "part int, block long, n int, grams binary, counts binary")


def totals(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of ``grams``, sorted runs one after the other, the sum of the counts of all that equal it."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = np.ones(len(grams), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del ordered
    starts = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], starts, dtype=np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(grams), dtype=np.int64)
    out[order] = np.repeat(total, np.diff(starts, append=len(grams)))
    return out


def _answers(asked: DataFrame, parts: int) -> DataFrame:
    """(part, block, n, counts): the counts over all blocks, for each block in the order of its n-grams."""

    def task(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for part, block, n, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "n", "grams", "counts")), strict=True):
                held.setdefault((part, n), []).append((block, np.cumsum(unpack(grams), dtype=np.uint64), unpack(counts).astype(np.uint32)))  # a block has fewer than 2**32 words
        for part, n in sorted(held):
            found = held.pop((part, n))
            listed, cuts = [b for b, _, _ in found], np.cumsum([0, *(len(g) for _, g, _ in found)])
            grams, counts = (np.concatenate([x[i] for x in found]) for i in (1, 2))
            del found
            told = totals(grams, counts)
            for block, begin, end in zip(listed, cuts[:-1], cuts[1:], strict=True):
                if block is not None:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int32()), "counts": [pack(told[begin:end])]})
            del grams, counts, told
            give_back()

    return asked.repartitionById(parts, "part").mapInArrow(task, "part int, block long, n int, counts binary")


def log_scores(found: list[tuple[np.ndarray, np.ndarray]], total: float, size: int, least: int) -> np.ndarray:
    """The logarithm of each word's score, from (last words, counts) of the n-grams per length."""
    score, before = np.zeros(size), np.zeros(size)
    for n, (at, counts) in enumerate(found, 1):
        if n == 1:
            score[at] = np.log(np.maximum(counts, 1) / total)
        else:
            seen = (counts >= least) & (counts > 0)
            score[at[~seen]] += np.log(BACKOFF)
            score[at[seen]] = np.log(counts[seen] / before[at[seen] - 1])
        before = np.zeros(size)
        before[at] = counts
    return score


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, least: int = LEAST, corpus: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, n_words, log_score, mean_log_score."""
    space, kind = Workspace(docs.sparkSession, "lm"), dict(docs.dtypes)[id_col]
    columns = F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    held = space.table(blocks(docs.select(*columns)), "blocks")
    model = held if corpus is None else space.table(blocks(corpus.select(F.lit(None).cast(kind).alias("doc_id"), columns[1])), "corpus")
    size = F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    total = int(model.agg(size).first()[0])
    asking = total if corpus is None else total + int(held.agg(size).first()[0])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), asking * order // PER_PART + 1)
    asked = _asked(held, parts, order, corpus is None, True)
    if corpus is not None:
        asked = asked.unionAll(_asked(model, parts, order, True, False))
    answers = _answers(asked, parts)

    def sums(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        sizes = np.array(row["sizes"], dtype=np.int64)
        told = right.sort_by([("n", "ascending"), ("part", "ascending")])
        lengths, packed = told.column("n").to_pylist(), told.column("counts").to_pylist()
        found = []
        for n, (at, grams) in enumerate(ngrams(row["vocab"], row["places"], sizes, order), 1):
            counts = np.concatenate([np.zeros(0, dtype=np.uint64), *(unpack(x) for k, x in zip(lengths, packed, strict=True) if k == n)])
            found.append((at, counts[np.unique(grams, return_inverse=True)[1]].astype(np.float64)))
        by_word = log_scores(found, max(1, total), int(sizes.sum()), least)
        by_doc = np.bincount(row_of(np.concatenate([[0], np.cumsum(sizes)])), by_word, minlength=len(sizes)).astype(np.float64)
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(sizes), pa.array(by_doc)], names=["doc_id", "n_words", "log_score"])

    out = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sums, f"doc_id {kind}, n_words long, log_score double")
    return out.select("doc_id", "n_words", "log_score", F.try_divide("log_score", F.col("n_words").cast("double")).alias("mean_log_score"))
