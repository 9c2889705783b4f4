"""From raw documents to encoded training text, in five stages.

Each stage's rows are written as Parquet and reread as the next one's documents. `run` does that in the
shared checkpoint folder and applies all stages to `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvec.llm import bpe, exact_dedup, mixing, simhash, toxicity
from sparkvec.llm.common import store, table
from sparkvec.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more the document with the smallest id."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; sources are repeated up to twice towards equal weights."""
    return mixing.mix(docs, max_repetition=2.0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the text decoded from them, one row per copy."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"), bpe.digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies),
          ("source mixing", mix_sources), ("bpe", encode)]

# The toxicity classifier, SimHash and BPE can't be expressed in SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
