"""Repeated line chunks, cut where their content says so (operator 6).

A line ends a chunk where a rolling hash over the last SPAN line hashes is a
multiple of MEAN, so an insertion moves no boundary beyond its neighbourhood.
A line of at least LONG words is a chunk of its own. Chunks of at least two lines
or LONG words are *heavy*; where the same heavy chunk stands at several places,
every place but the first (by id, then text hash, then line) is removed.

Chunks miss short passages over several lines, so with ``passage`` words given the
*windows* are compared too: from each line on, and back from each line, the fewest
lines that hold so many words. Any repeated run of lines of so many words is the
union of the windows inside it, whatever stands around it and however it is laid
out. A window that overlaps the first one of its kind in the same text (a run of
one line) is no repeat of it. Windows neither begin nor end with an empty line.

A first pass only counts the 64-bit hashes of all pieces in a fixed number of slots.
A second one hands on the pieces whose slot occurs again, the bytes of chunks and the
SHA-256 digests of windows, which overlap; these are compared as group keys, whole. The
texts themselves are shuffled once, to meet the places that are removed.

Null texts stay null and empty texts empty, both without chunks. Repeated rows are
alike, so both keep a first chunk; a null id comes first. Ties of a place are the same
place. Very long texts are cut into lines one at a time. Only the id and the text are
read, so the names of other columns clash with nothing. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, slot_counts, text_chunks
from paneflow.llm.wordhash import SPACE, buffers, mix, runs, span_hash

SPAN, MEAN, LONG = 2, 3, 20
#: Words of a passage that is found however its lines are laid out.
PASSAGE = 50
#: Slots (2**SLOT_BITS bytes, broadcast) in which the hashes of pieces are counted.
SLOT_BITS = 24
_WINDOW = np.uint64(0xA0761D6478BD642F)


def _lines(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(bytes, row offsets, row, first byte, end byte, words of each line, first line of each row)."""
    data, offs = buffers(texts)
    n_rows = len(offs) - 1
    ends = np.flatnonzero(data == 0x0A)
    # a line ends at a line feed or at the end of its row
    row_of_end = np.searchsorted(offs, ends, side="right") - 1
    stops = np.concatenate([ends, offs[1:]])
    rows = np.concatenate([row_of_end, np.arange(n_rows)])
    order = np.lexsort((stops, rows))
    stops, rows = stops[order], rows[order]
    first_line = np.searchsorted(rows, np.arange(n_rows))
    starts = np.empty_like(stops)
    starts[1:] = stops[:-1] + 1
    starts[first_line] = offs[:-1]
    heads, _ = runs(~SPACE[data], offs)
    words = np.searchsorted(heads, stops) - np.searchsorted(heads, starts)
    return data, offs, rows, starts, stops, words, first_line


def chunks(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """All heavy chunks: (row, first line, lines, first byte, end byte in the row, hash), in order."""
    return _chunks(*_lines(texts))


def _chunks(data, offs, rows, starts, stops, words, first_line) -> tuple[np.ndarray, ...]:
    h = span_hash(data, starts, stops)
    rolled = h.copy()
    for back in range(1, SPAN):
        rolled[back:] = mix(rolled[back:] * np.uint64(0x9FB21C651E98DF25) + h[:-back])
    long = words >= LONG
    last = np.ones(len(rows), dtype=bool)
    last[:-1] = rows[1:] != rows[:-1]
    # the first lines of a row have no SPAN lines before them inside it
    inside = np.arange(len(rows)) - first_line[rows] >= SPAN - 1
    cut = last | (inside & (rolled % np.uint64(MEAN) == 0)) | long
    cut[:-1] |= long[1:]
    stop_line = np.flatnonzero(cut)
    start_line = np.concatenate([[0], stop_line[:-1] + 1]) if len(stop_line) else stop_line
    size = stop_line - start_line + 1
    total = np.concatenate([[0], np.cumsum(words)])
    heavy = (size >= 2) | (total[stop_line + 1] - total[start_line] >= LONG)
    heavy &= total[stop_line + 1] > total[start_line]
    start_line, stop_line, size = start_line[heavy], stop_line[heavy], size[heavy]
    row = rows[start_line]
    a, b = starts[start_line], stops[stop_line]
    return row, start_line - first_line[row], size, a - offs[row], b - offs[row], span_hash(data, a, b).astype(np.int64)


def _windows(data, offs, rows, starts, stops, words, first_line, passage: int) -> tuple[np.ndarray, ...]:
    """The windows of at least ``passage`` words, as :func:`chunks` gives chunks."""
    total = np.concatenate([[0], np.cumsum(words)])
    some = np.flatnonzero(words > 0)
    # the fewest lines from a line on, and back from a line
    last = np.searchsorted(total, total[some] + passage, "left") - 1
    head = np.searchsorted(total, total[some + 1] - passage, "right") - 1
    fits, back = last < len(rows), head >= 0
    begin = np.concatenate([some[fits], head[back]])
    end = np.concatenate([last[fits], some[back]])
    inside = rows[begin] == rows[end]
    # a window of both kinds stands once
    pairs = np.unique(np.stack([begin[inside], end[inside]]), axis=1) if inside.any() else np.zeros((2, 0), np.int64)
    begin, end = pairs
    row = rows[begin]
    a, b = starts[begin], stops[end]
    return row, begin - first_line[row], end - begin + 1, a - offs[row], b - offs[row], (span_hash(data, a, b) ^ _WINDOW).astype(np.int64)


def pieces(texts: pa.Array, passage: int) -> tuple[np.ndarray, ...]:
    """Chunks and, if ``passage``, windows: as :func:`chunks`, then whether a window, and each row's first piece; a row's pieces stand together by first line."""
    held = _lines(texts)
    found = _chunks(*held)
    n = len(found[0])
    if passage:
        found = tuple(map(np.concatenate, zip(found, _windows(*held, passage), strict=True)))
    window = np.arange(len(found[0])) >= n
    order = np.lexsort((found[2], window, found[1], found[0]))
    found = tuple(x[order] for x in found)
    return *found, window[order], np.searchsorted(found[0], np.arange(len(texts)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _with_pieces(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """``rows`` with ``ats``, the places of their pieces in the written ``listed`` (doc_id, mark, at)."""
    grouped = listed.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    grouped = grouped.withColumnsRenamed({"doc_id": "doc_id2", "mark": "mark2"})
    # the lists grow with the documents: both sides are dealt by row at every size
    same = F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("mark") == F.col("mark2"))
    return rows.join(grouped.hint("merge"), same, how).drop("doc_id2", "mark2")


def _listed(part: pa.RecordBatch, heads: np.ndarray) -> np.ndarray:
    """The indexes among all pieces of those in the rows' ``ats``."""
    lists = part.column("ats").fill_null([]) if part.column("ats").null_count else part.column("ats")
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(heads, n) + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _pull(rows: DataFrame, kind: str, passage: int, sieve) -> DataFrame:
    """The pieces in slots that occur again: (doc_id, mark, at, line, size, h, digest, bytes); a window has a digest only."""

    def task(batches):
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                row, line, size, a, b, h, window, heads = pieces(texts, passage)
                some = np.flatnonzero(sieve.value[_slots(h)])
                row = row[some]
                data, offs = buffers(texts)
                cut = [data[x:y].tobytes() for x, y in zip(offs[row] + a[some], offs[row] + b[some], strict=True)]
                digests = [hashlib.sha256(x).digest() for x in cut]
                cut = [b"" if w else x for x, w in zip(cut, window[some], strict=True)]
                keys = batch.slice(first, last - first).select(["doc_id", "mark"]).take(pa.array(row, pa.int64()))
                numbers = [pa.array(x, pa.int32()) for x in (some - heads[row], line[some], size[some])]
                yield pa.RecordBatch.from_arrays([*keys.columns, *numbers, pa.array(h[some], pa.int64()), pa.array(digests, pa.binary()), pa.array(cut, pa.binary())], names=["doc_id", "mark", "at", "line", "size", "h", "digest", "bytes"])

    return rows.mapInArrow(task, f"doc_id {kind}, mark long, at int, line int, size int, h long, digest binary, bytes binary")


def repeats(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text", passage: int = 0) -> DataFrame:
    """The written (doc_id, mark, at): the pieces to remove; mark is xxhash64 of the text."""
    rows, kind = _keyed(docs, id_col, text_col), dict(docs.dtypes)[id_col]

    def slots(batch):
        return (_slots(pieces(texts, passage)[5]) for _, _, texts in text_chunks(batch, "text"))

    sieve = docs.sparkSession.sparkContext.broadcast(slot_counts(rows.select("text"), slots, SLOT_BITS) > 1)
    pulled = space.table(_pull(rows, kind, passage, sieve), "pulled")
    place = F.struct("doc_id", "mark", "line")
    # partial aggregates, so a chunk that stands everywhere is no hot group; equal digests are equal bytes from here on
    equal = pulled.groupBy("h", "digest", "bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = space.table(equal.select("h", "digest", "first"), "equal")
    # what overlaps the first place is no repeat of it
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    removed = pulled.drop("bytes").join(equal.hint("merge"), ["h", "digest"]).where(~own | (F.col("line") >= F.col("first.line") + F.col("size")))
    out = space.table(removed.select("doc_id", "mark", "at").distinct(), "removed")
    for name in ("pulled", "equal"):
        space.drop(name)
    return out


def without(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 0) -> DataFrame:
    """Per row: doc_id, text (what stays), n_lines, removed_lines, spans (first-last of each removed piece, overlapping ones as one, comma-joined)."""
    rows = _with_pieces(_keyed(docs, id_col, text_col), removed, "left")

    def task(batches):
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                part = batch.slice(first, last - first)
                known = part.column("text").is_valid().to_pylist()
                row, line, size, _, _, _, _, heads = pieces(texts, passage)
                at = _listed(part, heads)
                gone: list[list[tuple[int, int]]] = [[] for _ in known]
                for r, x, n in zip(row[at].tolist(), line[at].tolist(), size[at].tolist(), strict=True):
                    if gone[r] and x < sum(gone[r][-1]):
                        x, n = gone[r][-1][0], max(sum(gone[r][-1]), x + n) - gone[r][-1][0]
                        gone[r].pop()
                    gone[r].append((x, n))
                kept, n_lines = [], []
                for text, ok, spans in zip(texts.to_pylist(), known, gone, strict=True):
                    lines = text.split("\n")
                    n_lines.append(len(lines) if ok else 0)
                    for x, n in reversed(spans):
                        del lines[x : x + n]
                    kept.append("\n".join(lines) if ok else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array([sum(n for _, n in s) for s in gone], pa.int64()), pa.array([",".join(f"{x}-{x + n - 1}" for x, n in s) for s in gone], pa.string())],
                    names=["doc_id", "text", "n_lines", "removed_lines", "spans"],
                )

    return rows.mapInArrow(task, f"doc_id {dict(docs.dtypes)[id_col]}, text string, n_lines long, removed_lines long, spans string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 0) -> DataFrame:
    """:func:`repeats`, then :func:`without`."""
    space = Workspace(docs.sparkSession, "lines")
    removed = repeats(docs, space, id_col, text_col, passage)
    return without(docs, removed, id_col, text_col, passage)
