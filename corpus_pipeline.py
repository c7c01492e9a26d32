"""The corpus pipeline: documents in, token files out, in five stages.

toxicity     rows that score at least toxicity.THRESHOLD go; learnt from ``labels``
near_dedup   one id of each group of near duplicates stays: five-word shingles, 0.8
decontaminate rows that hold an item of ``benchmark``, or a re-parameterised one, go
mix          sources to target weights; a row stands as often as it is taken
tokens       token-ID files; one row per document of the mix, in file order

Each stage handles null texts (clean, kept, size 0: the mix never takes what has no
words), empty and very long texts, repeated rows and empty tables as its operator
says; columns other than those named here pass through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paneflow.llm import decontaminate, mixing, near_dedup, tokens, toxicity
from paneflow.llm.common import shared_dir
from paneflow.llm.queries import byte_bpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, below=toxicity.THRESHOLD, score_col=None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, max_epochs=3.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenise(docs, byte_bpe(), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", token_files),
]

#: A trained model, MinHash and a tokenizer are not SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs, folder = _table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
