"""Filtered post search."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import filters
from tidewatch.operators.ranking import page
from tidewatch.plans.analysis import load_run
from tidewatch.sources import post_index
from tidewatch.sources.store import Store


def matching_posts(
    posts: DataFrame,
    sentiment: DataFrame,
    post_topics: DataFrame,
    query: str | None = None,
    label: str | None = None,
    platform: str | None = None,
    topic_id=None,
    date_from: date | datetime | None = None,
    date_to: date | datetime | None = None,
) -> DataFrame:
    """Posts that meet every filter given. Post filters reach the scan, the others semi-join."""
    found = posts.where(
        filters.on_platform(platform)
        & filters.between_dates(date_from, date_to)
        & filters.containing(query)
    )
    if label:
        scored = sentiment.where(F.col("label") == label.lower()).select("post_id")
        found = found.join(scored, "post_id", "left_semi")
    if topic_id is not None:
        linked = post_topics.where(filters.with_topic(topic_id)).select("post_id")
        found = found.join(linked, "post_id", "left_semi")
    return found


def search_posts(
    posts: DataFrame,
    sentiment: DataFrame,
    post_topics: DataFrame,
    topics: DataFrame,
    limit: int = 50,
    offset: int = 0,
    **criteria,
) -> DataFrame:
    """One page, newest first, with sentiment and topic name.

    The page is cut before the look-ups, so those join at most `limit` posts; a post has one
    sentiment and one topic per run.
    """
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("A page has 1 to 200 posts and starts at 0 or later.")
    found = matching_posts(posts, sentiment, post_topics, **criteria)
    chosen = page(found, [F.desc("timestamp"), F.col("post_id")], limit, offset)
    return (
        with_results(chosen, sentiment, post_topics, topics)
        .orderBy(F.desc("timestamp"), "post_id")
    )


def with_results(
    posts: DataFrame, sentiment: DataFrame, post_topics: DataFrame, topics: DataFrame
) -> DataFrame:
    """Posts with the sentiment and topic name of the run, null where it has none."""
    labels = sentiment.select("post_id", F.col("label").alias("sentiment"))
    names = topics.select("topic_id", F.col("display_name").alias("topic_name"))
    return (
        posts.join(labels, "post_id", "left")
        .join(post_topics.select("post_id", "topic_id"), "post_id", "left")
        .join(names, "topic_id", "left")
    )


def search_total(posts: DataFrame, sentiment: DataFrame, post_topics: DataFrame, **criteria) -> DataFrame:
    """Number of posts over all pages."""
    found = matching_posts(posts, sentiment, post_topics, **criteria)
    return found.agg(F.count(F.lit(1)).alias("total"))


def search_run(
    store: Store, run_id: str, dataset_id: str | None = None, limit: int = 50, offset: int = 0, **criteria
) -> DataFrame:
    """`search_posts` over a stored run that reads only the files that can hold the page."""
    tables = load_run(store, run_id, dataset_id)
    plain = not any(criteria.get(c) for c in ("query", "label", "platform")) and criteria.get("topic_id") is None
    dates = {k: criteria.get(k) for k in ("query", "date_from", "date_to")}
    dataset = store.run(run_id, dataset_id)["dataset_id"]
    found = post_index.select_posts(store, dataset, **dates, limit=limit if plain else None, offset=offset)
    return search_posts(
        found.posts, tables["sentiment"], tables["post_topics"], tables["topics"], limit, found.offset, **criteria
    )


def search_total_of_run(store: Store, run_id: str, dataset_id: str | None = None, **criteria) -> DataFrame:
    """`search_total` over a stored run, reading only the files that can hold matches."""
    tables = load_run(store, run_id, dataset_id)
    dates = {k: criteria.get(k) for k in ("query", "date_from", "date_to")}
    found = post_index.select_posts(store, store.run(run_id, dataset_id)["dataset_id"], **dates)
    return search_total(found.posts, tables["sentiment"], tables["post_topics"], **criteria)
