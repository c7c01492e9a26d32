import re
from collections import Counter, defaultdict

from paneflow.llm import mixing
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, _size int, weight string"


def targets(sizes, cap=3.0):
    """Water-filling by hand over {source: size}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight, total, fixed = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    got, again = mixing.mix_plan(docs).collect(), mixing.mix_plan(docs.repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(mixed[r.doc_id] == 0 for r in got if not r.size and sum(x[0] == r.doc_id for x in rows) == 1)
    for r in got:
        if r.size and r.doc_id is not None and sum(x[0] == r.doc_id for x in rows) == 1:
            assert mixed[r.doc_id] * r.size == r.taken
    return want, taken


def test_documents(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want, taken = check(spark, rows)
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in want.items())


def test_odd_rows_and_caps(spark):
    rows = [(i, "w " * 10, "big") for i in range(60)] + [(100, "x y", "aa"), (101, None, "aa"), (102, "", None), (103, "long " * 50_000, None), (104, "p q", "aa"), (104, "p q", "aa"), (None, "n", "zz"), (105, " \n", "empty")]
    want, taken = check(spark, rows)
    assert want["aa"] <= 3 * 6 + 1e-6 and taken["empty"] == 0
    assert mixing.mix_plan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_quota_is_filled_behind_a_long_document(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 4)
    rows = [(i, "w " * (i % 7 + 1), "s" if i % 3 else "t") for i in range(600)]
    rows += [(1000 + i, "long " * 700, "s") for i in range(3)] + [(2000, "five of them here now", "t")] * 200 + [(3000 + i, "x " * 40, "u") for i in range(400)]
    want, taken = check(spark, rows)
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in want.items() if t < 3 * 10**9), (want, taken)


def test_many_sources_are_ranked_by_code_point(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i * 37 % 501}" if i % 50 else None) for i in range(1503)]
    check(spark, rows)


def test_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 5, "w")], SCHEMA).withColumn("target", F.lit("mine"))
    assert mixing.mix(docs).columns == docs.columns


def test_a_mix_takes_few_jobs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spark.sparkContext.setJobGroup("few-jobs-of-a-mix", "the mix of a small table")
    try:
        mixing.mix_plan(docs)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs-of-a-mix")) < 100  # about 200 when every small table of a pass was counted and broadcast by itself
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
