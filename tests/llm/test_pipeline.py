import corpus_pipeline
from pyspark.sql import functions as F
from test_near_dedup import brute as near_brute


#: Names that the stages use themselves, as extra columns.
NAMES = ["_score", "score", "_id", "_mark", "_row", "_size", "_source", "_copy", "id", "mark", "row", "key", "item_id", "items", "k", "c", "v", "at", "a.b"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("*", *(F.lit(n).alias(n) for n in NAMES))
    odd = [(10**9, None, "en", None, None), (10**9 + 1, "", None, "src0", 0), (10**9 + 2, "word " * 40_000, "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame([(*r, *NAMES) for r in odd], docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = [(r.doc_id, r.text) for r in out.collect()] if name != "tokens" else out.collect()
        if name == "near_dedup":
            want = [k for k, _, c, _ in near_brute(kept["toxicity"], 5, 80) if k == c]
            assert sorted(k for k, _ in kept[name]) == sorted(want)
        if name == "tokens":
            break
        docs = out
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()} - {k for k, _ in kept["toxicity"]}
    assert len(gone - toxic) <= 0.05 * 200 and 10**9 in {k for k, _ in kept["toxicity"]}
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(item in (t or "") for _, t in kept["decontaminate"] for item in items)
    assert {k for k, t in kept["near_dedup"] if any(item in (t or "") for item in items)} == {k for k, _ in kept["near_dedup"]} - {k for k, _ in kept["decontaminate"]}
    assert {k for k, _ in kept["mix"]} <= {k for k, _ in kept["decontaminate"]} - {10**9, 10**9 + 1}
    assert sorted(r.doc_id for r in kept["tokens"]) == sorted(k for k, _ in kept["mix"])


def test_run_is_the_stages_and_empty_tables_pass(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_a_reader_holds_few_texts(spark, sf_dir):
    reader = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(reader)
    corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert int(spark.conf.get(reader)) <= 512  # 4,096 by Spark
