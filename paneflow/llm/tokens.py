"""Token ids as flat binary files with document offsets (operator 9).

``write_tokens`` ranges the documents by id, and each task writes

* ``*.bin`` - the ids of its documents, one after the other, as little-endian
  unsigned integers of 2 bytes (4 where the vocabulary needs them),
* ``*.idx`` - one 64-bit offset per document plus the end, in ids,
* ``*.ids`` - one (valid byte, 64-bit id) pair of arrays per document,

and returns one manifest row per file. The base of each file is the prefix sum
of the counts before it, so a global position is base + offset. ``read_tokens``
memory-maps the files again.

Null texts count as empty (the end id alone), null ids come first, repeated ids
are ordered by their texts; an empty table gives no file. Very long texts are cut
and encoded in parts of SEGMENT characters with the same ids. Other columns are
not read, so their names clash with nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import CHUNK_BYTES, Workspace, text_chunks
from paneflow.llm.wordhash import buffers

#: Bytes of pieces and ids that a worker process remembers from task to task, at most; what of a piece's use still counts a batch later.
MEMO_BYTES, FADING = 8 << 20, np.float32(0.9)
#: Characters of the longest piece that is remembered, and of the text that is cut into pieces at a time.
SHORT, SEGMENT = 64, 1 << 20
#: Bytes of one remembered piece besides its characters and ids, with its place in the dictionary of a batch.
_OVERHEAD = 40
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")
# The bytes that are white space, and the longer forms of white space in UTF-8.
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_KIND = np.zeros(256, dtype=np.uint8)
for _signs, _kind in ((range(0x21, 0x7F), 3), (range(0x30, 0x3A), 2), (range(0x41, 0x5B), 1), (range(0x61, 0x7B), 1)):
    _KIND[[*_signs]] = _kind
_LONG_WHITE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(bytes([0xE2, 0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: A line feed behind a piece, and what stands between the two.
_FEED = (pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
MANIFEST = "part int, path string, documents long, tokens long"


def segments(text: str):
    """A long text in parts of about SEGMENT characters, cut where a piece begins anyway."""
    at = 0
    while len(text) - at > SEGMENT and (found := _BETWEEN.search(text, at + SEGMENT)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    out = _WHITE[data]
    for form in _LONG_WHITE:
        at = np.flatnonzero(data[: len(data) - len(form) + 1] == form[0]) if len(data) >= len(form) else np.zeros(0, dtype=np.int64)
        for k, x in enumerate(form):
            at = at[data[at + k] == x]
        for k in range(len(form)):
            out[at + k] = True
    return out


def kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each byte of UTF-8 is to the byte behind it and to the one before it: 1 of a letter, 2 a digit, 3 a sign, 0 unsaid.

    An apostrophe is a sign to the byte before it and unsaid to the one behind. Letters beyond ASCII are those up to U+017F.
    """
    left, right = _KIND[data], _KIND[data]
    left[data == 0x27] = 0
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] | 0x20) != 0xB7)]  # the signs of multiplication and division
    left[lead + 1] = right[lead] = 1
    return left, right


def _places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of ``counts`` ids each from ``first`` on, one after the other; ``first`` is written over."""
    first += counts
    first -= np.cumsum(counts, dtype=counts.dtype)
    place = np.repeat(first, counts)
    place += np.arange(len(place), dtype=place.dtype)
    return place


class Encoder:
    """Ids of whole texts, through a tokenizers file.

    A byte-level pre-tokenizer always starts a piece at a single space between two other
    characters, and around a single line feed between two others, none of them white space
    of any kind; by its own pattern also where letters, digits and signs meet, but behind an
    apostrophe. Texts are cut there, the cuts of many texts at once, and each distinct piece
    is encoded once. The short pieces that were used most and latest are remembered, as arrays.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(self.model.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end_id = end_id
        # a token's bytes: a character each in the byte-level alphabet, but added tokens are plain text
        added = self.model.get_added_tokens_decoder()
        contents = {i: t.content.encode() for i, t in added.items()}
        self.added = sorted(set(contents.values()) - {b""})
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(contents.get(i, token))
        before = self.model.pre_tokenizer
        own = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and self.model.normalizer is None
        self.by_kind = own and not any(t.single_word or t.lstrip or t.rstrip for t in added.values())
        # what is remembered: pieces, the ids of all, how many each has, how much each was used; the first ``older`` were known before the last batch
        self.pieces, self.ids = pa.array([], pa.large_binary()), np.zeros(0, dtype=self.kind)
        self.counts, self.uses, self.older = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32), 0

    @property
    def young(self) -> list[bytes]:
        """Remembered pieces that the last batch brought."""
        return self.pieces[self.older :].to_pylist()

    @property
    def old(self) -> list[bytes]:
        """Remembered pieces of the batches before it."""
        return self.pieces[: self.older].to_pylist()

    def _joined(self, pieces: pa.Array, feed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first of each piece, number of each) of pieces that are pieces of their joined text too: that is encoded at once, and dealt by the tokens' bytes."""
        data, offs = buffers(pc.binary_join_element_wise(pieces, *_FEED) if feed else pieces)
        ids = np.array(self.model.encode_batch_fast([data.tobytes().decode()], add_special_tokens=False)[0].ids, dtype=np.int64)
        reached, ends = np.append(0, np.cumsum(self.sizes[ids])), offs[1:] - feed
        if reached[-1] != len(data):
            return self._apart(pieces)
        first, last = np.searchsorted(reached, offs[:-1]), np.searchsorted(reached, ends)
        if (reached[first] != offs[:-1]).any() or (reached[last] != ends).any():
            return self._apart(pieces)
        return ids.astype(self.kind), first, last - first

    def _apart(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [x.ids for x in self.model.encode_batch_fast([p.decode() for p in pieces.to_pylist()], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=self.kind, count=int(counts.sum())), np.cumsum(counts) - counts, counts

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_joined`, of distinct pieces of any kind."""
        data, offs = buffers(pieces)
        led = data[offs[:-1]] == 0x20
        whole = (np.add.reduceat(white_space(data), offs[:-1], dtype=np.int32) == led) & (np.diff(offs) > led)
        first, counts, out, at = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64), [], 0
        # a line feed between pieces that no space leads is a piece of its own
        for kind, encode in ((led & whole, self._joined), (~led & whole, lambda part: self._joined(part, True)), (~whole, self._apart)):
            own = np.flatnonzero(kind)
            for k in range(0, len(own), 4096):
                some = own[k : k + 4096]
                ids, first[some], counts[some] = encode(pieces.take(pa.array(some)))
                first[some] += at
                at += len(ids)
                out.append(ids)
        return np.concatenate(out), first, counts

    def _remember(self, pieces: pa.Array, ids: np.ndarray, first: np.ndarray, counts: np.ndarray, uses: np.ndarray) -> None:
        """Keep the short ones of these pieces, of which those remembered so far are the first; if they are too many, those of most use."""
        known, uses = len(self.pieces), uses.astype(np.float32)
        uses[:known] += FADING * self.uses
        lengths = np.diff(buffers(pieces)[1])
        kept = np.flatnonzero(lengths <= SHORT)
        held = (lengths + counts * self.kind.itemsize + _OVERHEAD)[kept]
        if held.sum() > MEMO_BYTES:
            order = np.argsort(-uses[kept], kind="stable")
            kept = np.sort(kept[order[: np.searchsorted(np.cumsum(held[order]), MEMO_BYTES)]])
        self.pieces, self.uses, self.counts = pieces.take(pa.array(kept)), uses[kept], counts[kept].astype(np.int32)
        self.ids = ids[_places(first[kept], counts[kept])]
        self.older = int(np.searchsorted(kept, known))

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where the pieces of rows begin, and the end of the last."""
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offs[:-1]] = True
        cut[n] = False
        if n > 2:
            white = white_space(data)
            inner, feed = data[1:-1], data[1:-1] == 0x0A
            mark = inner == 0x20
            mark |= feed
            for beside in (white[:-2], white[2:], cut[1 : n - 1], cut[2:n]):
                mark &= ~beside
            feed &= mark
            del white, inner
            if self.by_kind:
                left, right = kinds(data)
                left, right = left[:-1], right[1:]
                cut[1:n] |= (left != right) & (left > 0) & (right > 0)
                del left, right
            cut[1 : n - 1] |= mark
            cut[2:n] |= feed
            text = data.tobytes() if self.added else b""
            for token in self.added:
                at = text.find(token)
                while at >= 0:
                    cut[at + 1 : at + len(token)] = False
                    at = text.find(token, at + 1)
            cut[offs[:-1]] = True
        cut[n] = True
        return np.flatnonzero(cut)

    def _rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with the end id behind each, where each row's ids end) of a large_string array without nulls."""
        data, offs = buffers(texts)
        rows = len(texts)
        if not len(data):
            return np.full(rows, self.end_id, dtype=self.kind), np.arange(1, rows + 1)
        at = self._cuts(data, offs)
        starts = at[:-1]
        last = np.searchsorted(starts, offs[1:]) + np.arange(rows)  # the place of each row's end id among the pieces
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
        # one dictionary of what is remembered, which comes first in it, and of the pieces
        found = pa.chunked_array([self.pieces, pieces]).dictionary_encode().chunks[-1]
        index, distinct, known = found.indices.to_numpy(), found.dictionary, len(self.pieces)
        del at, starts, pieces, found
        ids, first, sizes = self.ids, np.cumsum(self.counts) - self.counts, self.counts
        if known < len(distinct):
            more, from_, count = self._encoded(distinct[known:])
            first, sizes = np.concatenate([first, from_ + len(ids)]), np.concatenate([sizes, count])
            ids = np.concatenate([ids, more])
            del more, from_, count
        uses = np.bincount(index, minlength=len(distinct))
        total = int(uses @ sizes) + rows
        self._remember(distinct, ids, first, sizes, uses)
        # the pieces of each row and then its end, as numbers of what is in the pool
        turn = np.full(len(index) + rows, len(distinct), dtype=np.int32)
        own = np.ones(len(turn), dtype=bool)
        own[last] = False
        turn[own] = index
        del index, distinct, own, uses
        pool, first, sizes = np.append(ids, self.kind.type(self.end_id)), np.append(first, len(ids)), np.append(sizes, 1)
        kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
        first, size = first.astype(kind)[turn], sizes.astype(kind)[turn]
        del turn
        ends = np.cumsum(size, dtype=kind)[last].astype(np.int64)
        return pool[_places(first, size)], ends

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_rows`; a row of over SEGMENT bytes is encoded part by part."""
        _, offs = buffers(texts)
        long = np.flatnonzero(np.diff(offs) > SEGMENT).tolist()
        ids, ends, at, first = [], [], 0, 0
        for i in [*long, len(texts)]:
            if i > first:
                got, where = self._rows(texts.slice(first, i - first))
                ids.append(got)
                ends.append(where + at)
                at += len(got)
            if i < len(texts):
                parts = [self._rows(pa.array([part], pa.large_string()))[0] for part in segments(texts[i].as_py())]
                ids += [*(p[:-1] for p in parts[:-1]), parts[-1]]
                at += sum(map(len, parts)) - len(parts) + 1
                ends.append(np.array([at]))
            first = i + 1
        return np.concatenate([np.zeros(0, dtype=self.kind), *ids]), np.concatenate([np.zeros(0, dtype=np.int64), *ends])

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.arrays(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, ends)[:-1]]


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """The one encoder of a worker process."""
    return Encoder(path, end_id)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below ``folder`` (a shared one); the manifest rows, lazily."""

    def task(batches):
        context = TaskContext.get()
        part = context.partitionId()
        encode = encoder(tokenizer, end_id)
        fs, root = pafs.FileSystem.from_uri(folder)
        stem = f"{root}/part-{part:06d}-{context.taskAttemptId()}"
        out, ends, valid, ids, at = None, [0], [], [], 0
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text", 4 * CHUNK_BYTES):
                if out is None:
                    out = fs.open_output_stream(f"{stem}.bin")
                got, where = encode.arrays(texts)
                out.write(got.tobytes())
                ends += (where + at).tolist()
                at += len(got)
                keys = batch.column("key").slice(first, last - first)
                valid.append(keys.is_valid().to_numpy(zero_copy_only=False))
                ids.append(keys.fill_null(0).to_numpy())
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{stem}.idx") as f:
            f.write(np.array(ends, dtype="<i8").tobytes())
        with fs.open_output_stream(f"{stem}.ids") as f:
            f.write(np.concatenate(valid).astype("u1").tobytes())
            f.write(np.concatenate(ids).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{stem.rsplit('/', 1)[1]}"], "documents": pa.array([len(ends) - 1], pa.int64()), "tokens": pa.array([at], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return rows.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(task, MANIFEST)


def _bytes(path: str) -> np.ndarray:
    """A file's bytes: mapped into memory where the file system is a mounted one."""
    fs, name = pafs.FileSystem.from_uri(path)
    if not fs.get_file_info(name).size:
        return np.zeros(0, dtype="u1")
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype="u1", mode="r")
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), dtype="u1")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Manifest rows with ``base``, the ids in all files before. One row per file, so the driver sums."""
    files = sorted(manifest.collect(), key=lambda r: r.part)
    bases = np.cumsum([0, *(r.tokens for r in files)])
    rows = [(*r, int(b)) for r, b in zip(files, bases, strict=False)]
    return manifest.sparkSession.createDataFrame(rows, f"{MANIFEST}, base long")


def read_tokens(manifest: DataFrame, width: int | None = None, id_type: str = "long") -> DataFrame:
    """Per document of the files in ``manifest`` (with bases): doc_id, start, n_tokens, ids_crc32.

    ids_crc32 is the unsigned crc32 of the ids as little-endian 32-bit integers. ``width`` is the
    bytes of an id; without it each file's size tells, as every document has an end id.
    """

    def task(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                flat, ends = _bytes(f"{path}.bin"), _bytes(f"{path}.idx").view("<i8")
                flat = flat.view(f"<u{width or len(flat) // int(ends[-1])}")
                keys, n = _bytes(f"{path}.ids"), len(ends) - 1
                ok, keys = keys[:n].astype(bool), keys[n:].view("<i8") if n % 8 == 0 else keys[n:].copy().view("<i8")
                for i in range(0, n, 10_000):
                    j = min(n, i + 10_000)
                    crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[i:j], ends[i + 1 : j + 1], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[i:j], pa.int64(), mask=~ok[i:j]), "start": pa.array(ends[i:j] + base, pa.int64()), "n_tokens": pa.array(np.diff(ends[i : j + 1]), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    files = manifest.repartition(max(1, manifest.count()), "part")
    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(id_type))


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents as token files and read them back: one row per document."""
    space = Workspace(docs.sparkSession, "tokens")
    files = with_bases(space.table(write_tokens(docs, space.folder("files"), tokenizer, end_id, id_col, text_col), "manifest"))
    return read_tokens(files, id_type=dict(docs.dtypes)[id_col])
