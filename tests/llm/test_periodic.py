"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from paneflow.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x):
    out, seen = [], set()
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            # a stretch of a smaller period was met before
            if i + q - s >= max(6, 4 * q) and (s, i + q) not in seen:
                seen.add((s, i + q))
                out.append((s, i + q - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_batches_equal_plain_search():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            x = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
            if x and rng.random() < 0.6:
                a = rng.randrange(len(x))
                p = 1 + (len(x) - a) // rng.randint(2, 8)
                x = x[:a] + [x[a + (i - a) % p] for i in range(a, len(x))]
            docs.append(x)
        got = periodic.batch_runs(np.array([w for x in docs for w in x], dtype=np.int64), np.concatenate(([0], np.cumsum([len(x) for x in docs]))))
        assert [got.get(r, []) for r in range(len(docs))] == [plain_runs(x) for x in docs]


@pytest.mark.parametrize("x", [np.zeros(30_000), np.arange(30_000), -np.arange(30_000), np.arange(30_000) % 7, np.arange(30_000) % 7_000])
def test_long_texts(x):
    got = periodic.batch_runs((x - x.min()).astype(np.int64), np.array([0, len(x)]))
    q = len(np.unique(x))
    assert got == ({0: [(0, 30_000, q)]} if 4 * q <= 30_000 else {})


def test_range_minima():
    x = np.random.default_rng(3).integers(0, 2, 700)
    ext = periodic.Extensions(x, periodic._own_ranks(x))
    i, j = np.triu_indices(701, 1)
    got = ext(i, j)
    for k in range(0, len(i), 97):
        a, b = int(i[k]), int(j[k])
        n = next((d for d in range(700) if b + d >= 700 or x[a + d] != x[b + d]), 0)
        assert got[k] == n


def test_find_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 7), (4, "a " * 7), (None, "x y x y x y x y z"), (5, "é b é b é b é b é b é b"), (6, "A a A a A a")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, runs int, collapsed int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find(docs).collect()), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 7, [(0, 7, 1)], "a"), (4, 7, [(0, 7, 1)], "a"), (None, 9, [(0, 8, 2)], "x y z"), (5, 6, [(0, 6, 1)], "é b"), (6, 6, [], "A a A a A a")]
    assert got == sorted(want, key=str)
    assert periodic.find(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op12_periodic(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = WORD.findall(d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        number = {x: k for k, x in enumerate(dict.fromkeys(w))}
        found = plain_runs([number[x] for x in w])
        some += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left(w, found).encode()).hexdigest()
    assert some > 5
