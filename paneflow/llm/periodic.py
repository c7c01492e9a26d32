"""Periodic run detection by the runs theorem (operator 12).

A run is a stretch of words that repeats with a smallest period q and that no neighbour
extends. Every run of exponent 2 or more holds a Lyndon root that is the longest Lyndon
word at its start, under the order of the symbols or under the reversed one. So:

1. words become symbols, and their suffixes are ranked by prefix doubling, each text in
   a block of ranks of its own, its end below everything;
2. the longest Lyndon word at a position ends at the next smaller rank (first order) or at
   the next greater one (second order): two candidates a position;
3. a candidate whose root is not followed by five equal words lies in no run that is asked
   for (length of MIN_LENGTH = 6 at least and MIN_EXPONENT = 4 periods at least);
4. the others are extended to both sides by longest common extensions: range minima over
   the LCP arrays of the text and of its reverse, from a sparse table over blocks;
5. stretches found more than once keep their smallest period.

All of it is linear or n log n in the words of a text, with some 150 bytes a word. A batch
of texts is ranked at once; Spark deals the texts, and nothing is shuffled.

Words are runs of code points other than space and 0x09-0x0D and are compared as they
stand. Null and empty texts have no words, no runs and an empty ``collapsed``; repeated
rows each get the same answer; an empty table gives nothing; only the id and the text are
read, so other columns clash with nothing. Ids may be of any type, or null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import small_batches, text_chunks
from paneflow.llm.wordhash import SPACE, buffers, named, row_of, runs

#: Least words of a run, and least periods in it.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Equal words behind the root of the first Lyndon root of any such run: max(6, 4q) - 2q + 1 is 5 at least.
_AHEAD = 5
#: Words under one minimum of the sparse table, and ranges answered at a time.
_BLOCK, _AT_ONCE = 32, 1 << 15

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
WORD = r"[^\x20\x09-\x0D]+"


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """The rank of each suffix, by prefix doubling; only suffixes that still tie are sorted again.

    No suffix may be a prefix of another one that has its end inside: each text ends with a symbol
    that occurs once.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    held = symbols[order]
    head = np.concatenate(([0], np.flatnonzero(held[1:] != held[:-1]) + 1)) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(head, n))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(head, sizes)
    active = order[np.repeat(sizes > 1, sizes)]
    step = 1
    while len(active):
        group, after = rank[active], rank[active + step]
        turn = np.lexsort((after, group))
        active, group, after = active[turn], group[turn], after[turn]
        first = np.ones(len(active), dtype=bool)
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= after[1:] != after[:-1]
        at, heads = np.flatnonzero(new), np.flatnonzero(first)
        sizes = np.diff(np.append(at, len(active)))
        in_group = np.repeat(heads, np.diff(np.append(heads, len(active))))
        rank[active] = group + np.repeat(at, sizes) - in_group
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
    return rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The place of the next smaller value of each, or the number of values: pointers jump over what is known to be larger."""
    n = len(values)
    ends = np.append(values, np.iinfo(values.dtype).min)
    at = np.arange(1, n + 1)
    open_ = np.flatnonzero(ends[at] > values)
    while len(open_):
        at[open_] = at[at[open_]]
        open_ = open_[ends[at[open_]] > values[open_]]
    return at


class Extensions:
    """Longest common extensions to the right between suffixes of one sequence whose ranks are known."""

    def __init__(self, symbols: np.ndarray, rank: np.ndarray):
        n = len(symbols)
        self.rank, self.size = rank, n
        x, ranks, order = symbols.tolist(), rank.tolist(), np.argsort(rank).tolist()
        lcp, h = [0] * n, 0  # lcp[r]: of the suffixes of ranks r - 1 and r
        for i in range(n):
            r = ranks[i]
            if r:
                j = order[r - 1]
                while i + h < n and j + h < n and x[i + h] == x[j + h]:
                    h += 1
                lcp[r] = h
                h -= h > 0
            else:
                h = 0
        blocks = -(-n // _BLOCK)
        top = np.iinfo(np.int32).max
        self.lcp = np.append(np.array(lcp, dtype=np.int32), np.full(blocks * _BLOCK - n + _BLOCK, top, dtype=np.int32))
        level = self.lcp[: blocks * _BLOCK].reshape(-1, _BLOCK).min(axis=1)
        self.table = [level]
        while 2 << (len(self.table) - 1) <= blocks:
            half = 1 << (len(self.table) - 1)
            level = np.minimum(level[:-half], level[half:])
            self.table.append(level)

    def _minima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of lcp[low:high], for ranges that are not empty."""
        cells = low[:, None] + np.arange(_BLOCK)
        out = np.where(cells < high[:, None], self.lcp[cells], np.iinfo(np.int32).max).min(axis=1)
        cells = np.maximum(high[:, None] - 1 - np.arange(_BLOCK), low[:, None])
        out = np.minimum(out, self.lcp[cells].min(axis=1))
        first, last = -(-low // _BLOCK), high // _BLOCK
        wide = np.flatnonzero(last > first)
        if len(wide):
            first, last = first[wide], last[wide]
            level = np.frexp(last - first)[1] - 1
            for k in np.unique(level):
                own = level == k
                a, b = first[own], last[own] - (1 << int(k))
                out[wide[own]] = np.minimum(out[wide[own]], np.minimum(self.table[k][a], self.table[k][b]))
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols from i and j on; i differs from j, and a place at the end has none."""
        out = np.zeros(len(i), dtype=np.int64)
        inside = np.flatnonzero((i < self.size) & (j < self.size))
        for k in range(0, len(inside), _AT_ONCE):
            own = inside[k : k + _AT_ONCE]
            a, b = self.rank[i[own]], self.rank[j[own]]
            out[own] = self._minima(np.minimum(a, b) + 1, np.maximum(a, b) + 1)
        return out


def _own_ranks(symbols: np.ndarray) -> np.ndarray:
    """Ranks 0 ... of the suffixes of one sequence, a shorter one first where it is a prefix."""
    ended = np.append(symbols + 1, 0)
    return suffix_ranks(ended)[:-1] - 1


def extended(symbols: np.ndarray, i: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that hold the candidates (i, q), by start, then period."""
    n = len(symbols)
    ahead = Extensions(symbols, _own_ranks(symbols))(i, i + q)
    turned = np.ascontiguousarray(symbols[::-1])
    behind = Extensions(turned, _own_ranks(turned))(n - i, n - i - q)
    start, end = i - behind, i + q + ahead
    kept = end - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
    best: dict[tuple[int, int], int] = {}
    for s, e, p in zip(start[kept].tolist(), end[kept].tolist(), q[kept].tolist(), strict=True):
        best[s, e] = min(p, best.get((s, e), p))
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def batch_runs(symbols: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of each row that has some; a row's symbols stand in symbols[bounds[r]:bounds[r + 1]]."""
    rows = len(bounds) - 1
    n, width = len(symbols), int(symbols.max(initial=0)) + 2
    if not n:
        return {}
    # every row is followed by its own end, which is smaller than all its words
    places = np.arange(n) + row_of(bounds)
    stops = bounds[1:] + np.arange(rows)
    x = np.empty(n + rows, dtype=np.int64)
    x[places] = row_of(bounds) * width + 1 + symbols
    x[stops] = np.arange(rows) * width
    rank = suffix_ranks(x)
    stop = np.repeat(stops, np.diff(bounds))
    padded = np.append(x, np.full(2 * _AHEAD, -1))
    firsts, periods = [], []
    for values in (rank, -rank):
        q = np.minimum(next_smaller(values)[places], stop) - places
        i = places
        for k in range(_AHEAD):
            if not len(i):
                break
            same = padded[i + k] == padded[np.minimum(i + q + k, n + rows)]
            i, q = i[same], q[same]
        firsts.append(i)
        periods.append(q)
    i, q = np.concatenate(firsts), np.concatenate(periods)
    row = np.searchsorted(stops, i, side="right")
    turn = np.argsort(row, kind="stable")
    i, q, row = i[turn], q[turn], row[turn]
    out = {}
    for r in np.unique(row).tolist():
        a, b = np.searchsorted(row, (r, r + 1))
        own = symbols[bounds[r] : bounds[r + 1]]
        _, own = np.unique(own, return_inverse=True)
        if found := extended(own, i[a:b] - (bounds[r] + r), q[a:b]):
            out[r] = found
    return out


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The words of each row with one space between."""
    sizes = ends - starts + 1
    out_at = np.concatenate(([0], np.cumsum(sizes)))
    source = np.repeat(starts - out_at[:-1], sizes) + np.arange(out_at[-1])
    text = np.append(data, np.uint8(0x20))[np.minimum(source, len(data))]
    text[out_at[1:] - 1] = 0x20
    first = out_at[bounds[:-1]]
    last = np.maximum(out_at[bounds[1:]] - 1, first)  # the space behind the last word goes
    cuts = np.empty(2 * len(first) + 1, dtype=np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = first, last, len(text)
    pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text)])
    return pieces.take(pa.array(np.arange(0, 2 * len(first), 2))).cast(pa.string())


def _found(texts: pa.Array) -> tuple[np.ndarray, list[list[dict]], pa.Array]:
    """Of each text: the number of words, the runs, and the words left."""
    data, offs = buffers(texts)
    starts, ends = runs(~SPACE[data], offs)
    bounds = np.searchsorted(starts, offs)
    # equal numbers for words of equal bytes
    symbols = named(data, starts, ends).indices.to_numpy().astype(np.int64)
    listed: list[list[dict]] = [[] for _ in range(len(texts))]
    gone = np.zeros(len(starts) + 1, dtype=np.int64)
    for r, every in batch_runs(symbols, bounds).items():
        listed[r] = [{"start": s, "length": n, "period": p} for s, n, p in every]
        for s, n, p in every:
            gone[bounds[r] + s + p] += 1
            gone[bounds[r] + s + n] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    left = _joined(data, starts[kept], ends[kept], np.searchsorted(kept, bounds))
    return np.diff(bounds), listed, left


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, runs (start, length, period, by start, then period), and collapsed.

    Starts are word numbers from 0. ``collapsed`` has the words, joined by one space, that no run
    holds behind its first period.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                sizes, every, left = _found(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(sizes, pa.int64()), pa.array(every, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), left], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words bigint, runs {_RUNS}, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: one row in ten, by the checksum of its id, goes over into repeats of its own words.

    With h = crc32 of the decimal id, g = floor(h / 10) and n words: where h % 10 = 0, word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Rows with a null
    id or without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))

    def source(word: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), word).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))

    return rows.select("doc_id", F.when(n > 0, F.array_join(F.transform("words", source), " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_runs, the longest run, and digests of all runs and of the words left."""
    found = find(docs, id_col, text_col)
    # the longest: ties go to the smaller start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
