"""From raw documents to token ids: toxic texts go, one of each group of near-duplicates stays, byte
passages that an earlier document holds are cut, benchmark copies go, and the rest is encoded.

Every stage but the last returns the columns of `documents`; its result is written as Parquet and
read again as the next one's input. Rows without an id go in the first stage; null texts are empty
texts; a document that loses all its text in a cut stays with an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, decontaminate, near_duplicates, run_index, toxicity
from tidewatch.llm.queries import benchmark, documents, importable, labels, tokenizer_path
from tidewatch.session import checkpointed


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, labels(importable(spark), sf_dir))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def without_earlier_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return run_index.cut_earlier_passages(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, benchmark(spark, sf_dir))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("suffix_array_dedup", without_earlier_bytes),
    ("decontamination", without_benchmark),
    ("bpe", token_ids),
]

#: Classifier, sketches and byte-level BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; the last stage's rows."""
    docs = documents(importable(spark), sf_dir)
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
