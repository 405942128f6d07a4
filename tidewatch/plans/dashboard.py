"""Dashboard summary and timeline of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import text as T
from tidewatch.operators import entities as E
from tidewatch.operators import filters, keywords
from tidewatch.operators.buckets import hourly_rollup, reference_clock, timeline
from tidewatch.operators.sentiment import shares_of_counts
from tidewatch.operators.trends import classification_counts
from tidewatch.plans.analysis import load_run
from tidewatch.plans.topics import top_mentions
from tidewatch.plans.trends import POST_COLUMNS, ranked_trends
from tidewatch.session import checkpointed
from tidewatch.sources.store import Store


def _number_of_posts(posts_or_rollup: DataFrame) -> Column:
    """Aggregate over posts, or over a rollup of them."""
    if "volume" in posts_or_rollup.columns:
        return F.coalesce(F.sum("volume"), F.lit(0).cast("bigint"))
    return F.count(F.lit(1))


def platform_breakdown(posts_or_rollup: DataFrame) -> DataFrame:
    """Posts per lower-cased platform; none counts as `other`."""
    named = F.lower(T.preferred_text(F.col("platform"), F.lit("other")))
    return posts_or_rollup.groupBy(named.alias("platform")).agg(_number_of_posts(posts_or_rollup).alias("posts"))


def with_dataset_name(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Runs with the name of their dataset, `Unknown Dataset` when it is gone."""
    names = datasets.select("dataset_id", F.col("name").alias("dataset_name"))
    return runs.join(names, "dataset_id", "left").withColumn(
        "dataset_name", F.coalesce("dataset_name", F.lit("Unknown Dataset"))
    )


def run_timeline(
    posts: DataFrame,
    sentiment: DataFrame,
    window: str = "daily",
    platform: str | None = None,
    post_topics: DataFrame | None = None,
    topic_id=None,
) -> DataFrame:
    """Volume and sentiment per bucket for all posts, a platform or a topic."""
    clock = posts.agg(F.max("timestamp").alias("clock")).scalar()
    rows = posts.where(filters.on_platform(platform)).select(*POST_COLUMNS)
    if topic_id is not None:
        linked = post_topics.where(F.col("topic_id") == topic_id).select("post_id")
        rows = rows.join(linked, "post_id", "left_semi")
    labels = sentiment.select("post_id", F.col("label").alias("sentiment"))
    return timeline(hourly_rollup(rows.join(labels, "post_id", "left"), ()), window, clock)


def stored_timeline(
    tables: dict[str, DataFrame], window: str = "daily", platform: str | None = None, topic_id=None
) -> DataFrame:
    """The same timeline from a run's stored rollup alone; no post is read."""
    rollup = tables["posts_rollup"]
    clock = rollup.agg(F.max("latest_time").alias("clock")).scalar()
    return timeline(rollup.where(filters.on_platform(platform) & filters.with_topic(topic_id)), window, clock)


def dashboard_of_run(
    store: Store, run_id: str | None, window: str = "daily", platform: str | None = None, dataset_id: str | None = None
) -> dict[str, DataFrame]:
    """The summary of a run, with its dataset's name, status and model information in `run`.

    Without a run id the record is empty: zeros and empty lists, never another run's figures.
    """
    if run_id is None:
        return no_data(store.spark)
    tables = load_run(store, run_id, dataset_id)
    runs = store.runs().where(F.col("analysis_run_id") == run_id)
    named = with_dataset_name(runs, store.datasets())
    shown = ("analysis_run_id", "dataset_id", "dataset_name", "status", "model_info", "created_at", "completed_at")
    return {"run": named.select(*shown), **dashboard(tables, tables["hourly_rollup"], window, platform, run_id)}


def dashboard(
    tables: dict[str, DataFrame],
    rollup: DataFrame,
    window: str = "daily",
    platform: str | None = None,
    run_id: str = "",
) -> dict[str, DataFrame]:
    """The summary's parts: totals, breakdowns and the top ten of each list.

    The clock, totals, platforms and sentiment come from the rollup of all posts (`posts_rollup`) where
    the run has stored one. The posts shown are read once, cut into words and stored narrow.
    """
    # The one scan of the posts' texts: all parts but the clock and the trends read what it stores.
    text = T.preferred_text(F.col("cleaned_text"), F.col("original_text"))
    posts = checkpointed(
        tables["posts"].where(filters.on_platform(platform)).select("post_id", "platform", "hashtags", *keywords.keyword_words(text))
    )
    stored = tables.get("posts_rollup")
    clock = reference_clock(tables["posts"] if stored is None else stored)
    ranked = ranked_trends(rollup, window, platform, clock, run_id)
    counts = checkpointed(selection_counts(posts, tables["sentiment"] if stored is None else None))
    tags = counts.where("kind = 'hashtag' AND value <> ''").select(
        F.col("value").alias("hashtag"), F.col("n").alias("frequency"), F.lit(None).cast("double").alias("growth_rate")
    )
    if stored is None:
        counted = counts.where("kind = 'platform'").select(F.col("value").alias("platform"), F.col("n").alias("volume"))
        labelled = [F.coalesce(F.sum(F.when(F.col("value") == s, F.col("n"))), F.lit(0)).alias(s) for s in V.SENTIMENTS]
        shares = shares_of_counts(counts.where("kind = 'sentiment'").agg(*labelled))
    else:
        counted = stored.where(filters.on_platform(platform))
        shares = shares_of_counts(counted.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in V.SENTIMENTS]))
    mentions = E.mention_counts(tables["entities"], tables["post_entities"], posts)
    return {
        "totals": dashboard_totals(counted, ranked),
        "platforms": platform_breakdown(counted),
        "sentiment": shares,
        "classifications": classification_counts(ranked),
        "top_trends": ranked.limit(10),
        "top_entities": top_mentions(mentions, 10),
        "top_hashtags": tags.orderBy(F.desc("frequency"), "hashtag").limit(10),
        "top_keywords": keywords.keywords_of_words(posts, 10),
    }


def selection_counts(posts: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """(kind, value, n): posts per platform and per hashtag, and per sentiment label if that table is given.

    Every post becomes a row per value, and one grouping counts them all, summed up before the shuffle.
    """

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    tags = F.transform(F.coalesce("hashtags", F.array().cast("array<string>")), lambda h: entry("hashtag", h))
    rows = posts.select(F.explode_outer(F.concat(F.array(entry("platform", F.col("platform"))), tags)).alias("e"))
    if sentiment is not None:
        shown = sentiment.join(posts.select("post_id"), "post_id", "left_semi")
        rows = rows.union(shown.select(entry("sentiment", F.col("label")).alias("e")))
    return rows.groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n"))


def dashboard_totals(posts_or_rollup: DataFrame, ranked: DataFrame) -> DataFrame:
    """Posts and ranked topics."""
    topics = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    return posts_or_rollup.agg(
        F.lit("completed").alias("status"),
        _number_of_posts(posts_or_rollup).alias("total_posts"),
        F.max(topics).alias("total_topics"),
    )


#: Columns of the lists of a summary.
_EMPTY = {
    "run": "analysis_run_id string, dataset_id string, dataset_name string, status string, model_info string, "
    "created_at timestamp, completed_at timestamp",
    "platforms": "platform string, posts bigint",
    "top_trends": "topic_id string, trend_score double, classification string",
    "top_entities": "entity_id string, text string, label string, frequency bigint",
    "top_hashtags": "hashtag string, frequency bigint, growth_rate double",
    "top_keywords": "keyword string, keyword_type string, frequency bigint, tfidf_score double",
}


def no_data(spark) -> dict[str, DataFrame]:
    """The parts for a workspace without a run: zeros and empty lists."""
    zero: Column = F.lit(0).cast("bigint")
    one = spark.range(1)
    return {
        "totals": one.select(
            F.lit("no_data").alias("status"), zero.alias("total_posts"), zero.alias("total_topics")
        ),
        "sentiment": one.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(s).alias("label"), zero.alias("count"), F.lit(0.0).alias("percentage")
                        )
                        for s in V.SENTIMENTS
                    ]
                )
            )
        ),
        "classifications": one.select(*[zero.alias(f"{c}_count") for c in V.CLASSIFICATIONS]),
        **{part: spark.createDataFrame([], schema) for part, schema in _EMPTY.items()},
    }
