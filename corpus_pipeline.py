"""The training-data pipeline: documents in, packed token ids out.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``.

1. language ID: documents whose language can't be told go.
2. n-gram Jaccard join: of each group of near duplicates the smallest id stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. mixing: documents are drawn so that sources, languages and topics meet their targets.
5. token-ID output: each remaining document as patched frame-of-reference blocks.

Nulls, empty texts, repeated rows, empty tables and extra columns are treated as the
operators' docstrings say: a null or empty text is rejected by the first stage; extra
columns pass unchanged to the last stage, which returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import decontaminate, jaccard, language, mixing, token_ids
from loomspan.session import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_ids", write_token_ids),
]

#: Support vector machines, edit alignments and byte-pair ids are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    import uuid

    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
