"""Topic list and topic dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import text as T
from tidewatch.functions.numeric import round_exact, share
from tidewatch.operators import entities as E
from tidewatch.operators import filters, keywords
from tidewatch.operators.buckets import hourly_rollup, timeline
from tidewatch.operators.ranking import page
from tidewatch.plans.trends import POST_COLUMNS, trend_histories
from tidewatch.session import checkpointed

TREND_COLUMNS = ("trend_score", "classification", "volume_current", "window_start")


def list_topics(
    topics: DataFrame,
    ranked: DataFrame,
    label: str | None = None,
    query: str | None = None,
    platform: str | None = None,
) -> DataFrame:
    """Topics with their latest trend, largest first.

    Asking for a class or a platform drops topics without a trend.
    """
    latest = ranked.select("topic_id", *TREND_COLUMNS)
    joined = topics.join(latest, "topic_id", "inner" if label or platform else "left")
    return joined.where(filters.classified(label) & filters.topic_matches(query)).orderBy(
        F.desc("post_count"), "topic_id"
    )


def topic_list_totals(listed: DataFrame, topics: DataFrame) -> DataFrame:
    """Listed topics that are no outliers, and outlier posts whatever the filters."""
    outliers = topics.agg(
        F.coalesce(F.sum(F.when(F.col("is_outlier"), F.col("post_count"))), F.lit(0)).alias("n")
    ).scalar()
    return listed.agg(
        F.count_if(~F.col("is_outlier")).alias("total_topics"),
        F.max(outliers).alias("outlier_count"),
    )


def topic_posts(
    posts: DataFrame, post_topics: DataFrame, sentiment: DataFrame, topic_id, platform: str | None = None
) -> DataFrame:
    """Posts of one topic with strength and sentiment. The platform is compared as given."""
    linked = post_topics.where(F.col("topic_id") == topic_id).select(
        "post_id", "topic_id", "probability"
    )
    chosen = posts if not platform else posts.where(F.col("platform") == platform)
    labels = sentiment.select("post_id", F.col("label").alias("sentiment"))
    return chosen.join(linked, "post_id").join(labels, "post_id", "left")


def sentiment_distribution(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Percent of the scored posts per label, 2 decimals."""
    counted = rows.groupBy(*keys).agg(
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in V.SENTIMENTS]
    )
    total = "(positive + neutral + negative)"
    return counted.select(
        *keys, *[share(f"100 * {s}", total, 2).alias(f"{s}_pct") for s in V.SENTIMENTS]
    )


def average_engagement(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each engagement field over the posts that have it, null when none does."""

    sums = [F.sum(F.col(f).cast("bigint")).alias(f) for f in V.ENGAGEMENT_FIELDS]
    counts = [F.count(f).alias(f"n_{f}") for f in V.ENGAGEMENT_FIELDS]
    means = [
        round_exact(f"{f} / nullif(n_{f}, 0)", 2).alias(f"avg_{f}") for f in V.ENGAGEMENT_FIELDS
    ]
    return rows.groupBy(*keys).agg(*sums, *counts).select(*keys, *means)


def sample_posts(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Strongest posts, newest first among equals."""
    chosen = rows.select(
        "post_id", "original_text", "timestamp", "platform", "sentiment",
        *V.ENGAGEMENT_FIELDS, "probability",
    )
    return page(chosen, [F.desc("probability"), F.desc("timestamp"), F.col("post_id")], limit)


def top_mentions(counts: DataFrame, limit: int) -> DataFrame:
    """Entities by mentions, then text."""
    return page(counts, [F.desc("frequency"), F.col("text"), F.col("label")], limit)


def topic_dossier(
    tables: dict[str, DataFrame],
    topic_id,
    window: str = "daily",
    platform: str | None = None,
    clock: Column | None = None,
) -> dict[str, DataFrame]:
    """Everything about one topic of a run, each part a frame of its own.

    `tables`: posts, post_topics, topics, sentiment, entities, post_entities. The trend rows use
    the platform in lower case, the post figures as given.
    """
    posts, links, sentiment = tables["posts"], tables["post_topics"], tables["sentiment"]
    rows = topic_posts(posts, links, sentiment, topic_id, platform)
    clock = posts.agg(F.max("timestamp").alias("clock")).scalar() if clock is None else clock
    every = topic_posts(posts, links, sentiment, topic_id).select("topic_id", "sentiment", *POST_COLUMNS)
    rollup = hourly_rollup(every)
    here = rollup.where(filters.on_platform(platform))
    # The topic's texts are joined and read once; the trend reads narrow columns, the sample its own few posts.
    text = T.preferred_text(F.col("cleaned_text"), F.col("original_text"))
    shown = checkpointed(rows.select("post_id", "sentiment", "hashtags", *V.ENGAGEMENT_FIELDS, *keywords.keyword_words(text)))
    history = trend_histories(
        rollup.join(
            tables["topics"].where(filters.not_outlier()).select("topic_id"), "topic_id", "left_semi"
        ),
        window, platform, topic_id, clock,
    )
    counts = E.mention_counts(tables["entities"], tables["post_entities"], shown)
    return {
        "topic": tables["topics"].where(F.col("topic_id") == topic_id),
        "post_count": shown.agg(F.count(F.lit(1)).alias("post_count")),
        "sentiment_distribution": sentiment_distribution(shown),
        "avg_engagement": average_engagement(shown),
        "entities": top_mentions(counts, 20),
        "keywords": keywords.keywords_of_words(shown, 15),
        "hashtags": keywords.hashtag_counts(shown).orderBy(F.desc("frequency"), "hashtag"),
        "trend_history": history,
        "timeline": timeline(here, window, clock),
        "sample_posts": sample_posts(rows),
    }
