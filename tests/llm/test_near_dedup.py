import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneflow.llm import common, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    """(doc_id, text) rows -> sorted (doc_id, size, component)."""
    sets = [shingles(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            same = len(x & y)
            if same and 100 * same >= percent * (len(x) + len(y) - same):
                comp[root(i)] = root(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), key), key)
    return sorted((key, len(sets[i]), low[root(i)], low[root(i)] == key) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("n", [2, 5])
def test_equals_all_pairs(spark, sf_dir, n):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.near_duplicates(docs, n).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows, n, 80)


def test_chain_and_odd_rows(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(12):  # each is near the next; the ends are far apart
        base = base[:]
        base[i * 8] = f"x{i}"
        base[i * 8 + 3] = f"y{i}"
        rows.append((100 - i, " ".join(base)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (7, "long " * 50_000), (8, "long " * 49_000)]
    docs = spark.createDataFrame([(*r, "en", None, None) for r in rows], SCHEMA).withColumn("mark", F.lit("clash"))
    got = near_dedup.near_duplicates(docs, 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 80)
    kept = near_dedup.keep_one(docs, 2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, _, c, _ in brute(rows, 2, 80) if k == c]


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d"), (9, "a b c d"), (9, "a b c d"), (9, "other words here"), (None, None)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    got = near_dedup.near_duplicates(docs, 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 3, 9, False), (9, 3, 9, True), (9, 3, 9, True), (9, 2, 9, True), (None, 0, None, True)], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_pruning_bound():
    need = [near_dedup.least_equal(0.8, n, near_dedup.MISS) for n in range(20, 201, 20)]
    assert need == sorted(need) and need[0] > 0
    # the chance that a pair at the threshold has fewer equal values than needed
    from math import comb

    for n, m in zip(range(20, 201, 20), need, strict=True):
        assert sum(comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(m)) < 1e-4


def _changed(base, rng, share):
    """A copy of ``base`` with single words replaced, so that about ``share`` of its word pairs are new."""
    out = list(base)
    for i in rng.choice(len(base), max(1, int(share * len(base) / 2)), replace=False):
        out[i] = f"x{rng.integers(1 << 40)}"
    return out


def test_a_large_group_around_the_threshold(spark):
    """600 copies, most of them too far from the base and from each other to be linked, some linked with one other only."""
    rng = np.random.default_rng(10)
    base = [f"w{i}" for i in range(110)]
    copies = [_changed(base, rng, s) for s in rng.uniform(0.05, 0.35, 540)]
    copies += [_changed(copies[i], rng, 0.08) for i in range(0, 540, 9)]
    rows = [(i, " ".join(c)) for i, c in enumerate(copies)]
    docs = spark.createDataFrame([(*r, "en", None, None) for r in rows], SCHEMA)
    got = near_dedup.near_duplicates(docs, 2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = brute(rows, 2, 80)
    assert sorted(map(tuple, got)) == want and 50 < len({r[2] for r in want}) < 600


def test_sets_over_the_threshold_meet_in_a_prefix():
    """Every pair that reaches the threshold has a common key whose places leave room for it."""
    rng = np.random.default_rng(11)
    met = 0
    for _ in range(400):
        n = int(rng.integers(1, 90))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.12], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)]))
        same = len(np.intersect1d(x, y))
        if not same or 100 * same < 80 * (len(x) + len(y) - same):
            continue
        count = lambda s: 2 + (s % np.uint64(5)).astype(np.uint8)
        (kx, px, sx), (ky, py, sy) = (near_dedup.prefix_keys(s, count(s), 80) for s in (x, y))
        need = near_dedup.least_overlap(len(x), len(y), 80)
        pairs = [(i, j) for i in range(len(kx)) for j in np.flatnonzero(ky == kx[i]) if 1 + min(len(x) - 1 - px[i], len(y) - 1 - py[j]) >= need]
        assert any({int(sx[i]), int(sy[j])} in ({0, 1}, {2}) for i, j in pairs)
        met += 1
    assert met > 100


def test_internal_names_as_extra_columns(spark):
    names = ["_id", "_mark", "id", "mark", "id2", "mark2", "row", "first", "k", "c", "v", "comp", "a.b", "text2"]
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string").select("doc_id", "text", *(F.lit(n).alias(n) for n in names))
    kept = near_dedup.keep_one(docs, 2)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d", *names), (3, None, *names)]


def test_only_what_the_result_reads_stays_on_disk(spark, sf_dir, monkeypatch):
    spaces = []

    class Noted(near_dedup.Workspace):
        def __init__(self, *args):
            super().__init__(*args)
            spaces.append(self)

    monkeypatch.setattr(near_dedup, "Workspace", Noted)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_dedup.near_duplicates(docs, 2)
    left = {p.name for p in Path(spaces[0].path.removeprefix("file:").replace("//", "/")).iterdir()}
    # components keep the few rows of their rounds
    assert {x for x in left if not x.startswith(("first-", "second-"))} == {"rows", "ids", "edges"}
    assert found.count() == docs.count()


def test_a_small_table_takes_few_jobs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.sparkContext.setJobGroup("few-jobs", "near duplicates of a small table")
    try:
        near_dedup.near_duplicates(docs, n=5)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 110  # 124 when every joined table was counted and all edges were linked twice
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_that_new_edges_join(spark, tmp_path):
    space = common.Workspace(spark, "merged-test")
    known = space.table(spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (7, 5), (8, 8), (9, 9)], "c long, comp long"), "known")
    fresh = space.table(spark.createDataFrame([(2, 4), (3, 7), (8, 9)], "a long, b long"), "fresh")
    got = {(r.comp, r.end) for r in near_dedup._merged(fresh, known, space).collect()}
    assert got == {(1, 1), (3, 1), (5, 1), (8, 8), (9, 8)}
    assert near_dedup._merged(space.table(fresh.limit(0), "none"), known, space) is None
