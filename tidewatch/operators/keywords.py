"""Corpus keywords by TF-IDF, and hashtag counts with growth.

Only `max_features` terms survive, so the terms are found first and the weights computed for them
alone. A pair of words is never more frequent than either word: once the words are counted, only
pairs of words at or above the last place can enter, which keeps the pair count small and exact. Both
are counted through summaries of bounded size (see `leading`), so no task ships its whole vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import text as T
from tidewatch.functions.numeric import round_exact
from tidewatch.operators.leading import CAPACITY, leading_terms
from tidewatch.session import checkpointed

_MAX_LISTED_WORDS = 2000  # beyond this the frequent words are joined instead of listed


def _exploded(array: Column, name: str, rows: DataFrame) -> DataFrame:
    """One row per element. The outer form keeps Spark from testing the array's size in a filter of
    its own, which would compute the tokens twice."""
    return rows.select(F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def _count(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("total"))


def _top(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.desc("total"), "term").limit(n)


def top_terms(tokens: DataFrame, max_features: int, capacity: int = CAPACITY) -> list[str]:
    """The most frequent words and pairs of `tokens` (column `tokens`); ties by term.

    Returns at most `max_features` strings.
    """
    words = leading_terms(tokens.select(F.col("tokens").alias("terms")), max_features, capacity)
    ranked = _top(words, max(_MAX_LISTED_WORDS, max_features) + 1).collect()
    leaders = ranked[:max_features]
    floor = leaders[-1]["total"] if len(leaders) == max_features else 0
    # A pair that reaches the last place consists of words that do.
    frequent = [r["term"] for r in ranked if r["total"] >= floor]
    following = F.slice("tokens", 2, F.greatest(F.size("tokens"), F.lit(1)))
    if len(frequent) < len(ranked) or len(ranked) <= _MAX_LISTED_WORDS:
        # Each word is looked up once, and pairs are put together of those found.
        found = F.transform("tokens", lambda w: F.when(w.isin(frequent), w))
        after = F.slice("found", 2, F.greatest(F.size("found"), F.lit(1)))
        joined = F.zip_with("found", after, lambda a, b: F.concat(a, F.lit(" "), b))
        arrays = tokens.select(found.alias("found")).select(F.filter(joined, lambda p: p.isNotNull()).alias("terms"))
        counted = leading_terms(arrays, max_features, capacity)
    else:  # too many words share the last place to list them
        zipped = F.arrays_zip(F.col("tokens").alias("a"), following.alias("b"))
        pairs = _exploded(zipped, "p", tokens).select("p.a", "p.b").where(F.col("b").isNotNull())
        known = words.where(F.col("total") >= floor).select("term")
        for side in ("a", "b"):
            pairs = pairs.join(known.withColumnRenamed("term", side), side, "left_semi")
        counted = _count(pairs.select(F.concat_ws(" ", "a", "b").alias("term")))
    pair_leaders = _top(counted, max_features).collect()
    best = sorted([*leaders, *pair_leaders], key=lambda r: (-r["total"], r["term"]))
    return [r["term"] for r in best[:max_features]]


def extract_keywords(
    texts: DataFrame,
    top_n: int = 50,
    max_features: int = 100,
    stop_words: list[str] | tuple = tuple(V.STOP_WORDS),
) -> DataFrame:
    """Best terms by mean TF-IDF over all rows of the column `text`.

    Columns: keyword, keyword_type (`ngram` for a pair), frequency among the blank-separated words
    (1 when it never occurs so), tfidf_score. Without any term, frequent long words are listed.
    """
    # Texts are cut into words once; all that follows reads the tokens, and then the hits, as stored.
    prepared = checkpointed(texts.select(*keyword_words(F.col("text"), stop_words)))
    return keywords_of_words(prepared, top_n, max_features)


def keyword_words(text: Column, stop_words: list[str] | tuple = tuple(V.STOP_WORDS)) -> list[Column]:
    """What `keywords_of_words` reads of a text: its `tokens`, and `raw`, the text with its blank-separated words."""
    text = F.coalesce(text, F.lit(""))
    return [T.keyword_tokens(text, stop_words).alias("tokens"), text.alias("raw")]


def _hits(terms: list[str]):
    """The function of a task: of (tokens, raw), each term among the tokens and their neighbouring pairs with its number,
    and the same of the words of the text `raw`. Python cuts at the white space that `V.SPACE` lists."""
    words = sorted({w for t in terms for w in t.split(" ")})
    place = {w: i for i, w in enumerate(words)}
    single = np.full(len(words) + 1, -1)  # the last place stands for all other words
    pair = np.full((len(words) + 1, len(words) + 1), -1)
    for i, t in enumerate(terms):
        at = [place[w] for w in t.split(" ")]
        if len(at) == 1:
            single[at[0]] = i
        else:
            pair[at[0], at[1]] = i

    def counted(known: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Per row the terms among its words `known`, which end at `ends`, and their numbers."""
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        both = pair[known[:-1], known[1:]]
        both[owner[:-1] != owner[1:]] = -1
        found = np.concatenate([single[known], both])
        rows = np.concatenate([owner, owner[:-1]])[found >= 0] * len(terms) + found[found >= 0]
        rows, numbers = np.unique(rows, return_counts=True)
        names = pa.array(terms, pa.string()).take(pa.array(rows % len(terms)))
        begins = np.searchsorted(rows, np.arange(len(ends) + 1) * len(terms)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(begins), pa.StructArray.from_arrays([names, pa.array(numbers, pa.int64())], ["term", "n"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = len(words)
        for batch in batches:
            tokens = batch.column("tokens")
            known = pc.fill_null(pc.index_in(tokens.flatten(), value_set=pa.array(words, pa.string())), other).to_numpy(zero_copy_only=False)
            hits = counted(known, np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False)))
            parts, ends = [], []
            for text in batch.column("raw").to_pylist():
                parts.append(np.array([place.get(w, other) for w in text.decode("utf-8", "replace").split()], np.int32))
                ends.append(len(parts[-1]))
            raw_hits = counted(np.concatenate(parts) if parts else np.zeros(0, np.int32), np.cumsum(ends, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([hits, raw_hits], ["hits", "raw_hits"])

    return run


def keywords_of_words(prepared: DataFrame, top_n: int = 50, max_features: int = 100) -> DataFrame:
    """`extract_keywords` of stored rows with the columns of `keyword_words`."""
    terms = top_terms(prepared.select("tokens"), max_features)
    if not terms:
        return _frequent(prepared.select(T.split_space(F.col("raw")).alias("raw")), top_n, CAPACITY)

    counted = "array<struct<term:string,n:bigint>>"
    hits = checkpointed(
        prepared.select("tokens", F.col("raw").cast("binary").alias("raw")).mapInArrow(_hits(terms), f"hits {counted}, raw_hits {counted}")
    )
    # Documents per term, and under the empty term all documents: at most `max_features` + 1 rows.
    present = F.concat(F.array(F.lit("")), F.col("hits.term"))
    in_documents = {
        r["term"]: r["total"] for r in _count(hits.select(F.explode_outer(present).alias("term"))).collect()
    }
    n = in_documents[""]
    idf = {t: math.log((1 + n) / (1 + in_documents.get(t, 0))) + 1.0 for t in terms}
    idf_of = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(idf[t]))])

    # One row holds one document, so its weights and norm need no shuffle.
    weighted = hits.select(
        F.transform(
            "hits",
            lambda h: F.struct(h["term"].alias("term"), (h["n"] * F.element_at(idf_of, h["term"])).alias("weight")),
        ).alias("weights"),
        "raw_hits",
    )
    norm = F.sqrt(
        F.aggregate("weights", F.lit(0.0), lambda s, w: s + w["weight"] * w["weight"])
    )
    entries = weighted.withColumn("norm", norm).select(
        F.explode_outer(
            F.concat(
                F.transform(
                    "weights",
                    lambda w: F.struct(
                        w["term"].alias("term"),
                        (w["weight"] / F.col("norm")).alias("weight"),
                        F.lit(0).cast("bigint").alias("raw"),
                    ),
                ),
                F.transform(
                    "raw_hits",
                    lambda r: F.struct(r["term"].alias("term"), F.lit(0.0).alias("weight"), r["n"].alias("raw")),
                ),
            )
        ).alias("e")
    )
    scores = (
        entries.where("e IS NOT NULL")
        .groupBy(F.col("e.term").alias("keyword"))
        .agg(F.sum("e.weight").alias("weight"), F.sum("e.raw").alias("raw"))
        .withColumn("mean", F.col("weight") / F.lit(float(n)))
    )
    best = scores.orderBy(F.desc(round_exact("mean", 10)), "keyword").limit(top_n)
    return best.select(
        "keyword",
        F.when(F.contains("keyword", F.lit(" ")), "ngram").otherwise("keyword").alias("keyword_type"),
        F.greatest("raw", F.lit(1)).alias("frequency"),
        round_exact("mean", 4).alias("tfidf_score"),
    )


def frequent_words(texts: DataFrame, top_n: int, capacity: int = CAPACITY) -> DataFrame:
    """Words longer than three characters by frequency, all with the score 0.1."""
    return _frequent(texts.select(T.split_space(F.col("text")).alias("raw")), top_n, capacity)


def _frequent(prepared: DataFrame, top_n: int, capacity: int) -> DataFrame:
    words = prepared.select(F.filter("raw", lambda w: F.length(w) > 3).alias("terms"))
    return (
        _top(leading_terms(words, top_n, capacity), top_n)
        .select(
            F.col("term").alias("keyword"),
            F.lit("keyword").alias("keyword_type"),
            F.col("total").alias("frequency"),
            F.lit(0.1).alias("tfidf_score"),
        )
    )


def hashtag_counts(posts: DataFrame, in_first_half: Column | None = None) -> DataFrame:
    """Posts' hashtags with their total and, given the half, their growth from half to half.

    Growth is (second - first) / first, and 1.0 for a tag new in the second half.
    """
    first = F.lit(False) if in_first_half is None else in_first_half
    tags = posts.select(F.explode("hashtags").alias("hashtag"), first.alias("early"))
    counts = (
        tags.where("hashtag <> ''")
        .groupBy("hashtag")
        .agg(F.count(F.lit(1)).alias("frequency"), F.count_if("early").alias("early"))
    )
    growth = F.when(F.col("early") > 0, round_exact("(frequency - early - early) / early", 4)).when(
        F.col("frequency") > 0, 1.0
    )
    return counts.select(
        "hashtag",
        "frequency",
        (F.lit(None).cast("double") if in_first_half is None else growth).alias("growth_rate"),
    )


def keyword_table(keywords: DataFrame, hashtags: DataFrame) -> DataFrame:
    """Keywords and hashtags in one table."""
    tags = hashtags.select(
        F.col("hashtag").alias("keyword"),
        F.lit("hashtag").alias("keyword_type"),
        "frequency",
        "growth_rate",
    )
    return keywords.unionByName(tags, allowMissingColumns=True)
