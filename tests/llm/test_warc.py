import hashlib
import zlib

from paneflow.llm import warc
from paneflow.llm.common import Workspace

SCHEMA = "page_id long, url string, html string, refers_to string"


def brute(rows):
    first, out = {}, []
    data = [(k, u, (h or "").encode()) for k, u, h in rows]
    for k, _, b in data:
        if len(b) >= 100 and k is not None:
            first[b] = min(first.get(b, k), k)
    for k, _, b in data:
        low = first.get(b)
        again = low is not None and low != k
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


def check(spark, rows):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = warc.round_trip(pages).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    return got


def test_round_trip_of_odd_rows(spark):
    long, copy = "é\r\n\r\nWARC/1.1\r\n" * 20_000, "x" * 99 + "é"
    rows = [(5, "http://a/ b\nc?q=ü%20", copy), (3, None, copy), (9, "u", copy), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", long), (8, "u", long), (8, "u", long), (None, "u", copy), (None, "v", "y" * 100), (None, "w", "y" * 100), (3, None, copy)]
    got = check(spark, rows)
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%20b%0Ac?q=%C3%BC%20"}


def test_empty_table(spark):
    assert check(spark, []) == []


def test_pages(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    check(spark, rows)


def test_each_record_is_a_member(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = warc.archive(pages).collect()
    n = 0
    for f in files:
        path = f.path.removeprefix("file://")
        places = [line.split("\t") for line in open(f"{path}.idx").read().splitlines()]
        data = open(f"{path}.warc.gz", "rb").read()
        assert sum(int(p[1]) for p in places) == len(data)
        for at, size, kind, name in places:
            got = warc.parse(zlib.decompress(data[int(at) : int(at) + int(size)], wbits=31))
            assert (got["warc-type"], got["warc-record-id"]) == (kind, name)
            n += 1
    assert n == pages.count() == sum(f.records for f in files)
    back = warc.read_archive(Workspace(spark, "test").table(spark.createDataFrame(files), "files"), payloads=True)
    assert {int(r.id): r.payload.decode() for r in back.where("payload is not null").collect()}.items() <= {r.page_id: r.html for r in pages.collect()}.items()
