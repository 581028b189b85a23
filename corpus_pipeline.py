"""The training-corpus pipeline: every stage reads what its predecessor kept and wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.common import written
from cuemill.llm.decontaminate import decontaminate
from cuemill.llm.mixing import mix_documents
from cuemill.llm.quality import quality_filter
from cuemill.llm.simhash import simhash_dedup
from cuemill.llm.tokens import read_token_documents, write_token_shards
from cuemill.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, keeps."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those of sources above their target may go."""
    return mix_documents(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards; one row per document copy in them."""
    path = scratch_path(spark, "tokens")
    # Executors still hold what the stages before took, so workers keep fewer words.
    write_token_shards(docs, path, public_tokenizers.path("byte_bpe_50k.json"), kept_words=120_000)
    return read_token_documents(spark, path)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_files),
]

#: The classifier, the fingerprints and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
