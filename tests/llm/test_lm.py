import re
from collections import Counter
from math import isclose, log
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneflow.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, order=lm.ORDER, least=lm.LEAST, corpus=None):
    seen = [split(t) for _, t in (rows if corpus is None else corpus)]
    count = Counter(tuple(t[i : i + n]) for n in range(1, order + 1) for t in seen for i in range(len(t) - n + 1))
    total = max(1, sum(map(len, seen)))

    def back_off(gram):
        if len(gram) == 1:
            return log(max(1, count[gram]) / total)
        if count[gram] >= max(1, least):
            return log(count[gram] / count[gram[:-1]])
        return log(lm.BACKOFF) + back_off(gram[1:])

    out = []
    for k, text in rows:
        t = split(text)
        s = sum(back_off(tuple(t[max(0, i - order + 1) : i + 1])) for i in range(len(t)))
        out.append((k, len(t), s, s / len(t) if t else None))
    return sorted(out, key=str)


def check(spark, rows, corpus=None, **choice):
    make = lambda some: spark.createDataFrame([(*r, 1, "clash") for r in some], "doc_id long, text string, key int, w string")
    got = sorted(map(tuple, lm.score(make(rows), corpus=None if corpus is None else make(corpus), **choice).collect()), key=str)
    want = brute(rows, corpus=corpus, **choice)
    by = lambda r: (str(r[0]), r[1], round(r[2], 6))
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:2] == w[:2] and isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9)
        assert (g[3] is None) == (w[3] is None) and (g[3] is None or isclose(g[3], w[3], rel_tol=1e-9))


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "one"), (4, "The cat sat the CAT sat"), (4, "The cat sat the CAT sat"), (None, "the cat"), (None, None), (5, "É é " * 30_000), (6, " \n")])
    check(spark, [])


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


@pytest.mark.parametrize("choice", [{"order": 3}, {"order": 3, "least": 1}, {"order": 1}, {"order": 4, "least": 3}])
def test_orders_in_small_blocks(spark, sf_dir, monkeypatch, choice):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(lm, "PER_PART", 3_000)
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 1500).collect()], **choice)


def test_another_corpus(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 1500).collect()]
    check(spark, [*rows[:30], (7, None), (8, "unheard-of words the in")], corpus=[*rows[20:], (None, None)], order=3, least=1)
    check(spark, rows[:3], corpus=[], order=2)


def test_planes():
    x = np.array([0, 1, 255, 256, (1 << 64) - 1], dtype=np.uint64)
    assert (lm.unpack(lm.pack(x)) == x).all() and len(lm.unpack(lm.pack(x[:0]))) == 0


def test_words_that_share_half_a_hash(spark):
    import pyarrow as pa
    from paneflow.llm import wordhash

    # two words of equal upper 32 bits by the birthday bound
    listed = [f"{a}{b}" for a in range(1000) for b in "abcdefghijklmnopqrstuvwxyz"]
    listed = [f"{w}{i}" for w in listed for i in range(10)]
    h, _ = wordhash.words(pa.array([" ".join(listed)], pa.large_string()))
    top = h >> np.uint64(32)
    order = np.argsort(top, kind="stable")
    same = np.flatnonzero(top[order][1:] == top[order][:-1])
    one, two = next((listed[order[k]], listed[order[k + 1]]) for k in same if h[order[k]] != h[order[k + 1]])
    check(spark, [(1, f"{one} x {one} y {one}"), (2, f"z {two}"), (3, f"{one} x"), (4, f"{two} x")])


def test_places_take_few_bytes_and_answers_are_not_written(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words, size = lm.blocks(docs.select("doc_id", "text")).select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.length("places"))).first()
    assert words > 10_000 and size < 2 * words
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.glob("lm-*/*"))
    lm.score(docs).count()
    assert [x.name for x in set(root.glob("lm-*/*")) - before] == ["blocks"]


def test_totals_of_sorted_runs():
    got = lm.totals(np.array([1, 5, 9, 2, 5, 5], dtype=np.uint64), np.array([3, 1, 1 << 31, 2, 4, 1 << 31], dtype=np.uint32))
    assert got.tolist() == [3, 5 + (1 << 31), 1 << 31, 2, 5 + (1 << 31), 5 + (1 << 31)] and len(lm.totals(np.zeros(0, np.uint64), np.zeros(0, np.uint32))) == 0
