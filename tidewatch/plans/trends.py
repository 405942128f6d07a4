"""Trend reads of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import filters, trends
from tidewatch.operators.buckets import hourly_rollup, reference_clock

POST_COLUMNS = ("post_id", "timestamp", "platform", "likes", "comments", "shares")


def trend_input(posts: DataFrame, post_topics: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Posts of topics with their sentiment; a post without a score keeps a null."""
    labels = sentiment.select("post_id", F.col("label").alias("sentiment"))
    return (
        post_topics.select("post_id", "topic_id")
        .join(posts.select(*POST_COLUMNS), "post_id")
        .join(labels, "post_id", "left")
    )


def run_rollup(
    posts: DataFrame, post_topics: DataFrame, topics: DataFrame, sentiment: DataFrame
) -> DataFrame:
    """Hourly rollup of the topics that are no outliers."""
    kept = topics.where(filters.not_outlier()).select("topic_id")
    rows = trend_input(posts, post_topics, sentiment)
    return hourly_rollup(rows).join(kept, "topic_id", "left_semi")


def _signals(
    rollup: DataFrame, window: str, platform: str | None, topic_id, clock: Column | None
) -> DataFrame:
    clock = reference_clock(rollup) if clock is None else clock
    chosen = rollup.where(filters.on_platform(platform) & filters.with_topic(topic_id))
    return trends.trajectory(chosen, window, clock)


def trend_histories(
    rollup: DataFrame,
    window: str = "daily",
    platform: str | None = None,
    topic_id=None,
    clock: Column | None = None,
    run_id: str = "",
) -> DataFrame:
    """Snapshots per topic with their trailing activity.

    The clock is the greatest time of the whole dataset; without one, that of the rollup. Filters
    do not move it. Engagement availability is decided per topic among the filtered rows.
    """
    signals = _signals(rollup, window, platform, topic_id, clock)
    snapshots = trends.score(signals, window, keep=("activity",))
    return trends.with_snapshot_id(snapshots, run_id, platform)


def ranked_trends(
    rollup: DataFrame, window: str = "daily", platform: str | None = None,
    clock: Column | None = None, run_id: str = "",
) -> DataFrame:
    """Latest snapshot per topic, best score first."""
    latest = trends.latest_per_topic(_signals(rollup, window, platform, None, clock))
    snapshots = trends.score(latest, window, keep=("activity",))
    return trends.rank_trends(trends.with_snapshot_id(snapshots, run_id, platform))


def list_trends(ranked: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked trends of one class or all, and the counts over all classes."""
    return ranked.where(filters.classified(label)), trends.classification_counts(ranked)
