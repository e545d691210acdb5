"""A corpus pipeline: toxic documents go, near duplicates leave one of each group, repeated passages are cut, personal
data is replaced, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns a DataFrame; all but the last
return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, pii, substring, toxicity
from tidemark.llm._common import bounded_batches, written
from tidemark.llm.queries import pii_key, word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    bounded_batches(spark)
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id, and those with a null id."""
    bounded_batches(spark)
    gone = minhash.near_duplicate_documents(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut from all but their first occurrence."""
    bounded_batches(spark)
    return substring.without_repeats(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    return pii.counted(pii.pseudonymised(docs, pii_key(spark)).select(*docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    bounded_batches(spark)
    return packing.pack_documents(docs, word_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("pii_surrogates", replace_personal_data),
    ("pack_sequences", pack),
]

#: SQL can't express the first stage, nor the token ids of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order, over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
