import hashlib
import zlib

from pyspark.sql import functions as F

from paneflow.llm import media


def png_samples(stored):
    """(width, height, samples, text fields) of an 8-bit greyscale PNG without filters, read by hand."""
    assert stored[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, packed, fields, size = 8, b"", {}, None
    while at < len(stored):
        n, kind = int.from_bytes(stored[at : at + 4]), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        assert int.from_bytes(stored[at + 8 + n : at + 12 + n]) == zlib.crc32(kind + body)
        if kind == b"IHDR":
            size = int.from_bytes(body[:4]), int.from_bytes(body[4:8])
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        elif kind == b"IDAT":
            packed += body
        elif kind == b"tEXt":
            key, value = body.split(b"\0")
            fields[key] = value
        at += 12 + n
    flat = zlib.decompress(packed)
    lines = [flat[i : i + size[0] + 1] for i in range(0, len(flat), size[0] + 1)]
    assert len(lines) == size[1] and all(line[0] == 0 for line in lines)
    return *size, b"".join(line[1:] for line in lines), fields


def plain_feature(samples):
    from math import log2, sqrt

    n = len(samples)
    mean = sum(samples) / n
    share = [samples.count(bytes([v])) / n for v in set(samples)]
    columns = [sum(samples[c::64]) / (n // 64) > mean for c in range(64)]
    bits = "".join("01"[b] for b in columns)
    return mean, sqrt(sum((v - mean) ** 2 for v in samples) / n), -sum(p * log2(p) for p in share), f"{int(bits, 2):016x}"


def brute(key, text):
    data = (text or "").encode()
    padded = data + b"\0" * (-len(data) % 64) if data else b"\0" * 64
    stored = media.encode(data)
    width, height, samples, fields = png_samples(stored)
    assert width == 64 and samples == padded and fields[b"bytes"] == str(len(data)).encode()
    return key, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest()


def check(spark, rows, schema="doc_id long, text string, digest string"):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    got = media.text_media(docs).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted((brute(*r) for r in rows), key=str)
    return got


def test_odd_rows(spark):
    got = check(spark, [(1, None), (2, ""), (3, "\0"), (4, "a" * 64), (5, "a" * 64), (5, "a" * 64), (None, "é" * 100_000), (6, "\0" * 64)])
    assert all(r.feature for r in got)
    assert {r.caption for r in got if r.doc_id == 5} == {"The text of document 5"}
    assert check(spark, []) == []


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_sequence_keeps_order_and_captions(spark):
    html = "<head><title>no</title></head><p>one &amp; two</p><figure><img src='sha256:%s' alt='x'><figcaption>first <b>one</b></figcaption></figure>tail<img src='other.png' alt='second'><script>no()</script><video src='v.mp4'></video>" % ("a" * 64)
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    parts = media.sequences(pages)
    found = {r.key: [(p.position, p.kind, p.text or p.ref, p.caption) for p in r.parts] for r in parts.collect()}
    assert found == {1: [(0, "text", "one & two", None), (1, "image", "sha256:" + "a" * 64, "first one"), (2, "text", "tail", None), (3, "image", "other.png", "second"), (4, "video", "v.mp4", None)], 2: [], 3: []}
    known = spark.createDataFrame([("a" * 64, 7)], "digest string, n_bytes long")
    shown = media.resolve(parts, known).orderBy("position").select("position", "n_bytes", "caption").collect()
    assert [tuple(r) for r in shown] == [(0, None, None), (1, 7, "first one"), (2, None, None), (3, None, "second"), (4, None, None)]


def test_features_by_hand(spark):
    texts = ["a", "text " * 40, "\0\x01" * 64, "é😀" * 33, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.text_media(docs).collect():
        data = texts[r.doc_id].encode()
        mean, deviation, entropy, columns = plain_feature(data + b"\0" * (-len(data) % 64 if data else 64))
        got = r.feature.split(";")
        assert abs(float(got[0]) - mean) < 2e-6 and abs(float(got[1]) - deviation) < 2e-6 and abs(float(got[2]) - entropy) < 2e-6 and got[3] == columns


def test_damage_is_found():
    stored = bytearray(media.encode(b"text"))
    stored[-20] ^= 1
    try:
        media.decode(bytes(stored))
    except ValueError:
        return
    raise AssertionError("no error")


def test_equal_texts_equal_values(spark):
    rows = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "doc_id long, text string")
    assert media.text_media(rows).select(*[F.col(c) for c in ("n_bytes", "media_sha256", "feature")]).distinct().count() == 3
