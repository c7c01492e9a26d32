"""WARC archives: a monolithic-gzip normaliser with an offset index (operator 1).

``write_monolithic`` stores one WARC record per row, each task one ``.warc.gz``
that is a single gzip stream - the form that cannot be read at an offset.
``normalise`` inflates each such file once, as a stream, rewrites every record as
a gzip member of its own and writes a sidecar index with each member's offset and
length. ``read_archive`` opens records through that index alone.

``mark_revisits`` finds equal payloads by their SHA-256: of those of at least
``least`` bytes the rows of the smallest id are responses, the others revisits
that carry the digest and length of the payload but not the payload.

A null payload is empty; a null id is in no order, so it never is referred to
unless no other id has that payload, when all its rows are responses; repeated
rows of the smallest id are all responses, as ties are; a null url is written as empty
and read as null; an empty table gives no file. Records are written, inflated and read
one at a time, so a very long page is held once. Only id, url and html are read, so the
names of other columns clash with nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, join_checked, text_chunks

FILES = "path string, records long"
READ = "id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"
STEP = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, space: Workspace, least: int = 100) -> DataFrame:
    """(id, url, html) rows with digest, size and, for revisits, refers_to."""
    rows = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    same = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = join_checked(rows, space.table(same, "same"), "digest", "left")
    copy = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(copy, F.col("first"))).drop("first")


def _name(key) -> str:
    return "" if key is None else f"<urn:x-page:{quote(str(key), safe='')}>"


def _key(name: str) -> str | None:
    return unquote(name[len("<urn:x-page:") : -1]) if name else None


def record(key, url, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    """One WARC/1.1 record with its two closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(key)}",
        f"WARC-Target-URI: {quote(url or '', safe=''':/?#[]@!$&'()*+,;=%~''')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[4:4] = [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def parse(raw: bytes) -> dict:
    """One record: its WARC fields, and what its HTTP block holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": _fields(http), "payload": payload}


def split_stream(chunks):
    """Whole records of an inflated stream, held one at a time."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(_fields(bytes(held[:at]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"the archive ends inside a record: {len(held)} bytes are left")


def inflate(stream):
    """The bytes of all gzip members of a stream, in pieces of bounded size."""
    engine = zlib.decompressobj(wbits=31)
    while data := stream.read(STEP):
        while data:
            yield engine.decompress(data, STEP)
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(wbits=31)
    yield engine.flush()


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Rows of :func:`mark_revisits` as one gzip stream per task; a row per file, lazily."""

    def task(batches):
        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"whole-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, n, engine = None, 0, zlib.compressobj(6, wbits=31)
        for batch in batches:
            for first, last, _ in text_chunks(batch, "html"):
                if out is None:
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                for row in batch.slice(first, last - first).to_pylist():
                    payload = b"" if row["refers_to"] is not None else row["html"].encode()
                    out.write(engine.compress(record(row["id"], row["url"], payload, row["digest"], row["size"], row["refers_to"])))
                    n += 1
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    return rows.select("id", "url", "html", "digest", "size", "refers_to").mapInArrow(task, FILES)


def _each_file(files: DataFrame) -> DataFrame:
    return files.select("path").repartition(max(1, files.count()), "path")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Every record a member of its own, with a sidecar ``.idx``; a row per file, lazily."""

    def task(batches):
        attempt = TaskContext.get().taskAttemptId()
        to, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                stem = f"{name.rpartition('/')[2].removesuffix('.warc.gz')}-{attempt}"
                at, n = 0, 0
                with fs.open_input_stream(name, compression=None) as source, to.open_output_stream(f"{root}/{stem}.warc.gz", compression=None) as out, to.open_output_stream(f"{root}/{stem}.idx") as index:
                    for raw in split_stream(inflate(source)):
                        engine = zlib.compressobj(6, wbits=31)
                        member = engine.compress(raw) + engine.flush()
                        out.write(member)
                        fields = _fields(raw.partition(b"\r\n\r\n")[0])
                        index.write(f"{at}\t{len(member)}\t{fields['warc-type']}\t{fields['warc-record-id']}\n".encode())
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{stem}"], "records": pa.array([n], pa.int64())})

    return _each_file(files).mapInArrow(task, FILES)


def read_archive(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of normalised archives, through their indexes; ``payloads`` adds the bytes."""
    schema = READ + (", payload binary" if payloads else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def task(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(f"{name}.idx") as f:
                    places = [line.split("\t")[:2] for line in f.read().decode().splitlines()]
                with fs.open_input_file(f"{name}.warc.gz") as archive:
                    found, held = [], 0
                    for at, n in places:
                        found.append(_row(parse(zlib.decompress(archive.read_at(int(n), int(at)), wbits=31)), payloads))
                        held += found[-1]["payload_bytes"] if payloads else 0
                        if len(found) >= 500 or held >= STEP:
                            yield _batch(found, columns)
                            found, held = [], 0
                    if found:
                        yield _batch(found, columns)

    return _each_file(files).mapInArrow(task, schema)


def _batch(found: list[dict], columns: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in found], kinds.get(c, pa.string())) for c in columns})


def _row(got: dict, payloads: bool) -> dict:
    revisit = got["warc-type"] == "revisit"
    # a revisit holds no payload: its length and digest are the fields of the record
    size = int(got["http"]["content-length"]) if revisit else len(got["payload"])
    digest = got["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(got["payload"]).hexdigest()
    return {
        "id": _key(got["warc-record-id"]),
        "url": got["warc-target-uri"] or None,
        "record_type": got["warc-type"],
        "refers_to": _key(got.get("warc-refers-to", "")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit or not payloads else got["payload"],
    }


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Write ``pages`` as archives, normalise these; one row per normalised file (path, records)."""
    space = Workspace(pages.sparkSession, "warc")
    rows = mark_revisits(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), space, least)
    whole = space.table(write_monolithic(rows, space.folder("whole")), "whole-files")
    files = space.table(normalise(whole, space.folder("members")), "member-files")
    space.drop("whole")
    return files


def round_trip(pages: DataFrame, id_col: str = "page_id", **names) -> DataFrame:
    """Archive ``pages`` and read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    kind = dict(pages.dtypes)[id_col]
    got = read_archive(archive(pages, id_col, **names))
    return got.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url")
