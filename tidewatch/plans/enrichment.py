"""Entity, keyword and hashtag listings, and the sentiment summary of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import entities as E
from tidewatch.operators import filters
from tidewatch.operators.ranking import page


def _check(limit: int, most: int) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"A listing has 1 to {most} rows.")


def list_entities(entities: DataFrame, label: str | None = None, limit: int = 50) -> DataFrame:
    """Most frequent entities, of one label or all."""
    _check(limit, 200)
    chosen = entities.where(filters.entity_label(label))
    return page(chosen, [F.desc("frequency"), F.col("normalized_text"), F.col("label")], limit)


def entity_listing(entities: DataFrame, label: str | None = None, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The listed entities, and the totals over all entities whatever the label: frequency by label,
    and the number of entities in every row."""
    totals = E.totals_by_label(entities)
    number = entities.agg(F.count(F.lit(1)).alias("n")).scalar()
    return list_entities(entities, label, limit), totals.withColumn("total_entities", number)


def list_keywords(table: DataFrame, limit: int = 50) -> DataFrame:
    """Keywords and pairs by score."""
    _check(limit, 100)
    chosen = table.where(filters.keyword_kind("keyword", "ngram"))
    return page(chosen, [F.desc("tfidf_score"), F.col("keyword")], limit)


def list_hashtags(table: DataFrame, limit: int = 50) -> DataFrame:
    """Hashtags by frequency."""
    _check(limit, 100)
    chosen = table.where(filters.keyword_kind("hashtag")).select(
        F.col("keyword").alias("hashtag"), "frequency", "growth_rate"
    )
    return page(chosen, [F.desc("frequency"), F.col("hashtag")], limit)


def sentiment_summary(run) -> dict:
    """Sentiment figures stored with a run; zeros when it has none."""
    stored = json.loads(run["stats"] or "{}").get("sentiment", {})
    counts = {f"{s}_count": stored.get(f"{s}_count", 0) for s in ("positive", "neutral", "negative")}
    shares = {f"{s}_pct": stored.get(f"{s}_pct", 0.0) for s in ("positive", "neutral", "negative")}
    return {
        "analysis_run_id": run["analysis_run_id"],
        "total_posts": stored.get("total_posts", 0),
        **counts,
        **shares,
        "evaluation_metrics": stored.get("evaluation_metrics"),
    }
