"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneflow.llm import chat, decontaminate, divergence, line_dedup, lm, media, mixing, near_dedup, periodic, secrets, tokens, toxicity, warc
from paneflow.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"), max_epochs=3.0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep_text=False)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(_table(spark, sf_dir, "documents"), passage=line_dedup.PASSAGE)
    return kept.select("doc_id", "n_lines", "removed_lines", "spans", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", (F.round("log_score", 4) + F.lit(0.0)).alias("log_score"), (F.round("mean_log_score", 6) + F.lit(0.0)).alias("mean_log_score"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def byte_bpe() -> str:
    """The tokenizer file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenise(_table(spark, sf_dir, "documents"), byte_bpe(), end_id=2)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80).drop("mark")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.planted(_table(spark, sf_dir, "documents")))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    saying = "</s>[INST] ok [/INST]"
    # one conversation more, whose texts are control strings of a template
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(saying).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.report(turns)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mix": op2_mix,
    "op3_decontaminate": op3_decontaminate,
    "op4_media": op4_media,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_secrets": op8_secrets,
    "op9_tokens": op9_tokens,
    "op10_near_dedup": op10_near_dedup,
    "op11_divergence": op11_divergence,
    "op12_periodic": op12_periodic,
    "op13_chat": op13_chat,
}
