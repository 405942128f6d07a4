"""Labelled rows for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.blocks import id_and_text


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of all training: crc32 of its id as text is divisible by 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], max_bytes: int) -> DataFrame:
    """At most `per_class` labelled rows of each class, texts of 1 to `max_bytes` bytes: doc_id, text, label.

    Rows that are held out are never chosen. The choice follows a hash of the id, so it does not
    depend on order; documents labelled twice count by their smallest label.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(*per_class) & ~held_out())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    chosen = None
    for value, most in per_class.items():
        rows = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = rows if chosen is None else chosen.union(rows)
    texts = id_and_text(docs).where(F.octet_length("text").between(1, max_bytes))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most the sum of `per_class` rows
