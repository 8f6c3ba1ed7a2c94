"""The training-data pipeline: documents in, packed pieces out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet below the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents.

1. toxicity: documents that the pattern grammar rejects go. The grammar is learned on the labelled rows of docs.
2. exact: of equal texts the row with the largest doc_id stays.
3. near: of each group of documents linked at 80 % of their five-word shingles the smallest doc_id stays.
4. mixing: each document comes as often as the entropy-balanced mix of the sources has copies of it.
5. packing: pieces of at most 2048 tokens in sequences of at most 2048.

An empty docs gives an empty result in every stage; null texts count as empty and stay where a stage filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from pulseframe.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(docs, limit=2048)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The grammar, the shingle sets and the token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
