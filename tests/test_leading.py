"""Leading terms through bounded summaries, against plain counts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import keywords, leading, topics


def skewed(seed, rows, vocabulary):
    random.seed(seed)
    return [[f"w{min(int(random.paretovariate(0.7)), vocabulary)}" for _ in range(random.randint(0, 40))] for _ in range(rows)]


def frame(spark, arrays, parts=5):
    return spark.createDataFrame([(a,) for a in arrays], "terms array<string>").repartition(parts)


def top(counts, n):
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.mark.parametrize("capacity", [1, 50, 1 << 16])
def test_leading_terms_against_counts(spark, capacity):
    arrays = skewed(3, 600, 5000) + [None, [], [None, "w1", None]]
    counts = Counter(t for a in arrays for t in a or [] if t is not None)
    for n in (5, 9000):
        found = {r["term"]: r["total"] for r in leading.leading_terms(frame(spark, arrays), n, capacity).collect()}
        assert top(found, n) == top(counts, n)
        assert all(counts[t] == total for t, total in found.items())
        last = min(total for _, total in top(counts, n))
        assert {t for t, total in counts.items() if total >= last} <= set(found) or n > len(counts)


def test_summaries_are_bounded_and_bound_the_counts(spark):
    arrays = skewed(5, 800, 100_000) + [[f"once{i}" for i in range(2000)]]
    counts = Counter(t for a in arrays for t in a)
    rows = frame(spark, arrays, 4).select(F.lit(0).alias("topic"), "terms")
    shipped = leading.summaries(rows, 64).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert all(r["count"] <= 65 for r in shipped)
    found, error = leading.summed(rows, 64)
    low = {r["term"]: r["n"] for r in found.collect()}
    assert 0 < error <= sum(counts.values()) / 64
    assert all(low.get(t, 0) <= n <= low.get(t, 0) + error for t, n in counts.items())


def test_second_count_reads_few_terms(spark):
    """Where the error parts the leaders, only they are counted again."""
    arrays = [["solar", "grid", "wind"] * 5 + [f"rare{i}"] for i in range(2000)]
    found = leading.leading_terms(frame(spark, arrays), 3, 100).collect()
    assert {r["term"]: r["total"] for r in found} == {"solar": 10000, "grid": 10000, "wind": 10000}


def test_ties_and_terms_seen_once_are_whole(spark):
    arrays = [[f"t{i}"] for i in range(500)]
    found = leading.leading_terms(frame(spark, arrays), 3, 4)
    assert found.count() == 500 and found.where("total <> 1").count() == 0
    assert keywords.top_terms(frame(spark, arrays).withColumnRenamed("terms", "tokens"), 3, 4) == ["t0", "t1", "t10"]


def test_empty_tables(spark):
    none = frame(spark, [None, []])
    assert leading.leading_terms(none, 3, 4).count() == 0
    assert leading.leading_terms(none.where("false"), 3, 4).count() == 0
    assert keywords.top_terms(none.withColumnRenamed("terms", "tokens"), 3, 4) == []
    assert keywords.frequent_words(spark.createDataFrame([(None,), ("",)], "text string"), 3, 4).count() == 0


@pytest.mark.parametrize("capacity", [2, 40])
def test_words_and_pairs_do_not_depend_on_the_capacity(spark, capacity):
    arrays = skewed(7, 400, 300)
    counts = Counter(t for a in arrays for t in a)
    counts.update(f"{x} {y}" for a in arrays for x, y in zip(a, a[1:]))
    tokens = frame(spark, arrays).withColumnRenamed("terms", "tokens")
    for n in (4,):
        assert keywords.top_terms(tokens, n, capacity) == [t for t, _ in top(counts, n)]


@pytest.mark.parametrize("capacity", [3, 200, 1 << 16])
def test_topic_terms_do_not_depend_on_the_capacity(spark, capacity):
    kinds = [0, 0, 0, 1, 1, 2, None]
    rows = [(kinds[i % 7], [f"{'abc'[(kinds[i % 7] or 0) * (len(w) % 2)]}{w}" for w in a]) for i, a in enumerate(skewed(11, 700, 2000))]
    rows += [(3, []), (3, None)]
    documents = spark.createDataFrame(rows, "topic_index int, tokens array<string>").repartition(4)
    counts = {t: Counter() for t in (0, 1, 2, None)}
    for t, a in rows:
        counts.setdefault(t, Counter()).update([*(a or []), *(f"{x} {y}" for x, y in zip(a or [], (a or [])[1:]))])
    found = topics.topic_terms(documents, 5, capacity=capacity).collect()
    every = sum(counts.values(), Counter())
    lengths = [sum(c.values()) for t, c in counts.items()]
    mean = math.floor(np.mean(lengths))
    for t in (0, 1, 2):
        score = {w: n / sum(counts[t].values()) * math.log(1 + mean / every[w]) for w, n in counts[t].items()}
        best = sorted(score, key=lambda w: (-round(score[w], 10), w))[:5]
        assert [r["word"] for r in sorted(found, key=lambda r: r["rank"]) if r["topic_index"] == t] == best
