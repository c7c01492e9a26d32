"""Media columns: interleaved document sequences with payloads by digest (operator 4).

``store`` writes payloads as media, here 8-bit greyscale PNG images of WIDTH
samples a row, into one container file per task, and returns where each medium
lies and its SHA-256. ``sequences`` parses HTML into ordered structs, text and
media references, with captions beside the medium they belong to. ``resolve``
joins the references to the store by digest, so a medium that many documents
show is stored and read for one place; positions and captions stay with the
reference. ``read_media`` decodes each distinct medium once and computes its
features.

A null payload is an empty one, stored as one row of zeros. References whose
digest is not in the store stay, with null media columns. Null or empty HTML is an
empty sequence. Repeated rows and ids are each answered; equal payloads are one
medium; an empty table gives nothing. Very long texts are encoded and decoded one at a
time. Only the id and the text are read, so the names of other columns clash with
nothing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, text_chunks

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PART = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
MEDIA = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(data: bytes) -> bytes:
    """``data``, padded with zeros, as the samples of a PNG; its own length is a text field."""
    padded = data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))
    rows = np.zeros((len(padded) // WIDTH, WIDTH + 1), dtype=np.uint8)  # the first byte of a row: no filter
    rows[:, 1:] = np.frombuffer(padded, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(length before padding, samples) of what :func:`encode` made; checksums are verified."""
    if not media.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, parts = len(_SIGNATURE), {}
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum of {kind!r}")
        parts[kind] = body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), dtype=np.uint8).reshape(-1, WIDTH + 1)
    return int(parts[b"tEXt"].partition(b"\0")[2]), rows[:, 1:].reshape(-1)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and which columns are brighter than the mean."""
    share = np.bincount(samples, minlength=256) / len(samples)
    some = share[share > 0]
    mean = float(samples.mean())
    columns = samples.reshape(-1, WIDTH).mean(axis=0) > mean
    return f"{mean:.6f};{samples.std():.6f};{-(some * np.log2(some)).sum() + 0.0:.6f};{np.packbits(columns).tobytes().hex()}"


def store(rows: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts as media below ``folder``; per row: key, digest, path, at, size, lazily."""
    kind = dict(rows.dtypes)[id_col]

    def task(batches):
        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"media-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        out, end, held = None, 0, {}
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}")
                found = []
                for text in texts.to_pylist():
                    media = encode(text.encode())
                    digest = hashlib.sha256(media).hexdigest()
                    if digest not in held:
                        out.write(media)
                        held[digest] = end
                        end += len(media)
                    found.append((digest, held[digest], len(media)))
                digests, at, size = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, last - first), pa.array(digests), pa.array([f"{folder}/{name}"] * len(found)), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["key", "digest", "path", "at", "size"])
        if out is not None:
            out.close()

    return rows.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(task, f"key {kind}, digest string, path string, at long, size long")


class _Sequence(HTMLParser):
    """Ordered parts of one HTML text; a figure's caption goes to its media."""

    MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
    SILENT = {"script", "style", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.text, self.silent, self.figure, self.caption = [], [], 0, None, None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.parts.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "figure":
            self.flush()
            self.figure = len(self.parts)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.MEDIA_TAGS and given.get("src"):
            self.flush()
            self.parts.append({"kind": self.MEDIA_TAGS[tag], "text": None, "ref": given["src"], "caption": given.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for part in self.parts[self.figure :] if self.figure is not None and text else []:
                if part["ref"] is not None:
                    part["caption"] = text
            self.caption = None
        elif tag == "figure":
            self.flush()
            self.figure = self.caption = None

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.text.append(data)


def parts_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, **part} for i, part in enumerate(parser.parts)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: key and ``parts``, its ordered text and media-reference structs."""
    fields = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def task(batches):
        for batch in batches:
            for first, last, texts in text_chunks(batch, "html"):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, last - first), pa.array([parts_of(t) for t in texts.to_pylist()], fields)], names=["key", "parts"])

    rows = pages.select(F.col(id_col).alias("key"), F.col(html_col).alias("html"))
    return rows.mapInArrow(task, f"key {dict(pages.dtypes)[id_col]}, parts {PART}")


def read_media(places: DataFrame) -> DataFrame:
    """Per digest of ``places`` (digest, path, at, size), one row each: its payload and features."""

    def task(batches):
        names = MEDIA.replace(",", "").split()[::2]
        for batch in batches:
            paths, found = batch.column("path").to_pylist(), []
            where = zip(batch.column("digest").to_pylist(), paths, batch.column("at").to_pylist(), batch.column("size").to_pylist(), strict=True)
            opened, file = None, None
            for digest, path, at, size in where:
                if path != opened:
                    if file is not None:
                        file.close()
                    fs, name = pafs.FileSystem.from_uri(path)
                    opened, file = path, fs.open_input_file(name)
                media = file.read_at(size, at)
                own = hashlib.sha256(media).hexdigest()
                if own != digest:
                    raise ValueError(f"{path} at {at}: the medium has another digest")
                n, samples = decode(media)
                payload = samples.tobytes()
                found.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), own, feature(samples)))
            if file is not None:
                file.close()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)

    # whole files stay together, in order
    return places.repartition("path").sortWithinPartitions("path", "at").select("digest", "path", "at", "size").mapInArrow(task, MEDIA)


def resolve(parts: DataFrame, media: DataFrame) -> DataFrame:
    """One row per part of :func:`sequences`, with the columns of the medium that it shows."""
    each = parts.select("key", F.explode("parts").alias("part")).select("key", "part.*")
    each = each.withColumn("digest", F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1))
    return each.join(media, "digest", "left")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as the medium of a small HTML document, stored, referenced, resolved and read: one row per document."""
    space = Workspace(docs.sparkSession, "media")
    placed = space.table(store(docs, space.folder("files"), id_col, text_col), "places")
    distinct = placed.groupBy("digest").agg(F.min(F.struct("path", "at", "size")).alias("place")).select("digest", "place.*")
    media = space.table(read_media(distinct), "features")
    html = F.concat(F.lit('<article><figure><img src="sha256:'), "digest", F.lit('"><figcaption>The text of document '), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("</figcaption></figure></article>"))
    pages = placed.select("key", html.alias("html"))
    shown = resolve(sequences(pages, "key", "html"), media).where(F.col("ref").isNotNull())
    return shown.select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
