"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    bpe, conversation_repair, decontaminate, hard_negatives, line_rules, near_duplicates, quality, run_index, token_counts,
    token_files, toxicity, warc, word_automaton,
)
from tidewatch.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def importable(spark: SparkSession) -> SparkSession:
    """Python workers look for this package where the driver found it, unless told otherwise."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(importable(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query("op1_quality_scores")
def op1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, labels(spark, sf_dir)))


@query("op2_toxicity_scores")
def op2(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@query("op3_contaminated_documents", decontaminate.SQL)
def op3(spark, sf_dir):
    return decontaminate.find_contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


@query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query("op5_near_duplicates")
def op5(spark, sf_dir):
    return near_duplicates.find_classes(documents(spark, sf_dir))


@query("op6_repeated_words")
def op6(spark, sf_dir):
    found = word_automaton.remove_repeated_words(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_token_files")
def op7(spark, sf_dir):
    path, end_id = tokenizer_path("word_bpe_49k.json"), 2
    folder = scratch_path(spark, "token-files")
    bases = token_files.write_token_files(documents(spark, sf_dir), folder, path, end_id)
    return token_files.read_token_files(spark, folder, bases, token_files.id_kind(path, end_id))


@query("op8_earlier_bytes")
def op8(spark, sf_dir):
    found = run_index.remove_earlier_bytes(documents(spark, sf_dir))
    removed = F.col("n_bytes") - F.octet_length("kept")
    spans = F.size("begins").cast("long")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_line_rules", line_rules.SQL)
def op9(spark, sf_dir):
    return line_rules.apply_rules(documents(spark, sf_dir))


@query("op10_bpe_round_trip")
def op10(spark, sf_dir):
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), with_texts=False)


@query("op11_hard_negatives", hard_negatives.SQL)
def op11(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", shifted.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("op12_page_archives", warc.SQL)
def op12(spark, sf_dir):
    folder = scratch_path(spark, "archives")
    ranges = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = warc.read_archives(ranges, f"{folder}/members")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_repaired_conversations", conversation_repair.SQL)
def op13(spark, sf_dir):
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair(rows, F.col("lost"))
