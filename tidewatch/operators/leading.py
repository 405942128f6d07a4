"""The most frequent terms without a shuffle of the vocabulary.

Every task keeps a summary of at most `capacity` counters (Misra and Gries): when there are more, the
count of the first one too many is taken off all, and counters that reach zero go. What was taken off is
the task's error: a count is too low by no more than that. Summaries add up, errors too. If the error
parts the leaders from terms that no summary holds, the terms that can be leaders are counted
exactly in a second pass; if it does not, all terms are. Where every task's vocabulary fits there is no
error and the summaries are the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpointed

#: Counters of a task, terms added to them at a time, and candidates listed in a plan (more are joined).
CAPACITY = 1 << 16
_SLICE = 1 << 20
_LISTED = 2000


def summaries(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(topic, term, n) of the rows (topic, terms): per task at most `capacity` counters, and one row without
    a term that tells the task's error. Topics share the counters."""
    kind = dict(rows.dtypes)["topic"]

    # Within, so that workers need not have this module.
    def reduced(rows: pa.Table) -> tuple[pa.Table, int]:
        """At most `capacity` of the counters, and what was taken off them."""
        rows = rows.group_by(["topic", "term"]).aggregate([("n", "sum")]).rename_columns(["topic", "term", "n"])
        if rows.num_rows <= capacity:
            return rows, 0
        off = int(np.partition(rows["n"].to_numpy(), -capacity - 1)[-capacity - 1])
        left = pc.subtract(rows["n"], off)
        return rows.set_column(2, "n", left).filter(pc.greater(left, 0)), off

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error = None, 0
        for batch in batches:
            lists = batch.column("terms")
            terms, owners = lists.flatten(), pc.list_parent_indices(lists)
            for begin in range(0, len(terms), _SLICE):
                part = terms.slice(begin, _SLICE)
                topics = batch.column("topic").take(owners.slice(begin, _SLICE))
                new = pa.table({"topic": topics, "term": part}).filter(pc.is_valid(part))
                new = new.group_by(["topic", "term"]).aggregate([([], "count_all")]).rename_columns(["topic", "term", "n"])
                held, off = reduced(new if held is None else pa.concat_tables([held, new]))
                error += off
        if held is None:
            return
        if error:
            none = {"topic": pa.nulls(1, held["topic"].type), "term": pa.nulls(1, held["term"].type), "n": pa.array([error], pa.int64())}
            held = pa.concat_tables([held, pa.table(none)])
        yield from held.combine_chunks().to_batches()

    return rows.select("topic", "terms").mapInArrow(run, f"topic {kind}, term string, n long")


def summed(rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The summaries of (topic, terms) added up, as (topic, term, n), and by how much a count may be too low."""
    found = checkpointed(summaries(rows, capacity).groupBy("topic", "term").agg(F.sum("n").alias("n")))
    error = found.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("error")).first()["error"]
    return found.where("term IS NOT NULL"), error


def occurrences(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(topic, term): a row per term of (topic, terms), all or those in the table `of` (term)."""
    found = rows.select("topic", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")
    if of is None:
        return found
    listed = [r["term"] for r in of.limit(_LISTED + 1).collect()]
    if len(listed) <= _LISTED:
        return found.where(F.col("term").isin(listed))
    return found.join(of, "term", "left_semi").select("topic", "term")


def leading_terms(rows: DataFrame, n: int, capacity: int = CAPACITY) -> DataFrame:
    """(term, total): exact counts of the n most frequent terms in the arrays `terms`, of all that tie with the
    last of them, and perhaps of further ones. Null arrays and null terms count for nothing."""
    rows = rows.select(F.lit(0).alias("topic"), "terms")
    counts, error = summed(rows, capacity)
    if not error:
        return counts.select("term", F.col("n").alias("total"))
    best = counts.orderBy(F.desc("n")).limit(n).agg(F.count(F.lit(1)).alias("terms"), F.min("n").alias("last")).first()
    hopeful = None
    if best["terms"] == n and best["last"] > error:
        hopeful = counts.where(F.col("n") >= best["last"] - error).select("term")
    found = occurrences(rows, hopeful).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    return checkpointed(found)


def counts_of_leaders(rows: DataFrame, lengths: DataFrame, mean_length: Column, top_n: int, capacity: int = CAPACITY) -> DataFrame:
    """(topic, term, n): exact counts, in all topics, of terms among which are each topic's `top_n` best ones.

    `rows`: topic, terms; `lengths`: topic, length. A term's score is n / length * ln(1 + mean_length / f), f its
    count in all topics. It is least where n is as counted and f as large as the errors allow, most where n is
    as large and f is n. Terms whose most is below the `top_n`th least of a topic are no leaders there.
    """
    counts, error = summed(rows, capacity)
    if not error:
        return counts
    topics = lengths.where("topic IS NOT NULL AND length > 0").count()
    everywhere = counts.groupBy("term").agg(F.sum("n").alias("f"))
    bounded = counts.join(everywhere, "term").join(lengths, "topic").withColumn("mean_length", mean_length)
    most = f"(n + {error}) / length * ln(1 + mean_length / (n + {error}))"
    bounded = checkpointed(
        bounded.selectExpr("topic", "term", "length", "mean_length", f"n / length * ln(1 + mean_length / (f + {error * (topics + 1)})) AS least", f"{most} AS most")
    )
    # The best of 64 parts of a topic first, so that no topic is ranked whole by one task.
    part = F.pmod(F.xxhash64("term"), F.lit(64))
    narrow = _first(bounded.select("topic", "length", "mean_length", "least", part.alias("part")), ["topic", "part"], top_n)
    last = _first(narrow, ["topic"], top_n).groupBy("topic").agg(
        F.count(F.lit(1)).alias("terms"), (F.min("least") - 1e-9).alias("last"),  # scores are compared at ten digits
        F.first("length").alias("length"), F.first("mean_length").alias("mean_length"),
    )
    unseen = f"{error} / length * ln(1 + mean_length / {error})"
    parted = checkpointed(last.where(f"terms = {top_n} AND last > {unseen}").select("topic", "last"))
    hopeful = None
    if parted.count() == topics:
        hopeful = bounded.join(parted, "topic").where("most >= last").select("term").distinct()
    return checkpointed(occurrences(rows, hopeful).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n")))


def _first(rows: DataFrame, group: list[str], n: int) -> DataFrame:
    """The n rows of greatest `least` in each group."""
    order = Window.partitionBy(*group).orderBy(F.desc("least"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")
