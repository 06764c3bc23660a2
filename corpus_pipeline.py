"""The corpus pipeline: five stages from raw documents to sampled token sequences.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``:

1. ``quality`` drops documents the classifier rejects (score below 0.7);
2. ``near_duplicates`` keeps one document of each group at Jaccard 0.8 or more on five-word shingles;
3. ``benchmark`` drops documents that hold ten consecutive words of a benchmark item;
4. ``secrets`` masks secrets, at whatever depth they are encoded;
5. ``pieces`` gives sampled segmentations with their piece ids.

Null texts are rejected by no stage on their own account: they score as the classifier's bias.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from worklens.llm import decontaminate, minhash, pieces, quality, secrets
from worklens.llm.common import stage
from worklens.llm.queries import PIECES


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.sample(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", masked_secrets),
    ("pieces", sampled_pieces),
]

#: A trained classifier and random segmentations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
