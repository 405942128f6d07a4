"""Hourly rollup of posts, and bucket metrics over it.

Every figure the trend and timeline views need is a sum, a count, a minimum or a maximum, so one
rollup per (topic, platform, hour) answers all bucket kinds and filters exactly. Spark combines it
before the shuffle: a topic that holds a third of all posts ships one row per hour and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions.numeric import share
from tidewatch.functions.timestamps import bucket

SUMS = (
    "volume", "likes_sum", "comments_sum", "shares_sum", "positive", "neutral", "negative",
    "unscored",
)


def hourly_rollup(posts: DataFrame, keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """One row per key, platform and UTC hour.

    `posts` needs the keys, `timestamp`, `platform`, `likes`, `comments`, `shares`, `sentiment`.
    """

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("bigint")), F.lit(0)).alias(f"{name}_sum")

    measured = F.coalesce(*[F.col(c).cast("bigint") for c in V.ENGAGEMENT_FIELDS]).isNotNull()
    return posts.groupBy(*keys, "platform", F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("volume"),
        *[total(c) for c in V.ENGAGEMENT_FIELDS],
        *[F.count_if(F.col("sentiment") == label).alias(label) for label in V.SENTIMENTS],
        F.count_if(F.col("sentiment").isNull()).alias("unscored"),
        F.max(measured).alias("has_engagement"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("latest_time"),
    )


def reference_clock(posts_or_rollup: DataFrame) -> Column:
    """Greatest timestamp, as a scalar subquery. Pass the unfiltered rows: filters do not move it."""
    name = "latest_time" if "latest_time" in posts_or_rollup.columns else "timestamp"
    return posts_or_rollup.agg(F.max(name).alias("clock")).scalar()


def any_engagement(posts_or_rollup: DataFrame) -> Column:
    """Whether any post carries an engagement value, as a scalar subquery."""
    if "has_engagement" in posts_or_rollup.columns:
        found = F.max("has_engagement")
    else:
        found = F.max(F.coalesce(*[F.col(c) for c in V.ENGAGEMENT_FIELDS]).isNotNull())
    return posts_or_rollup.agg(F.coalesce(found, F.lit(False)).alias("found")).scalar()


def bucket_metrics(rollup: DataFrame, window: str, keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """Rollup hours summed into the buckets of `window`."""
    kind = bucket(window)
    return rollup.groupBy(*keys, kind.start(F.col("hour")).alias("window_start")).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.max("has_engagement").alias("has_engagement"),
        F.min("first_time").alias("first_time"),
        F.max("latest_time").alias("latest_time"),
    )


def fill_gaps(metrics: DataFrame, window: str, clock: Column, keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """Add the empty buckets from a key's first bucket through the clock's bucket.

    Each occupied bucket emits itself and the empty ones up to the next, so no calendar is built
    and joined. With a clock before the first bucket only occupied buckets remain. More than
    20,000 steps raise an error.
    """
    kind = bucket(window)
    by_key = ", ".join(keys) if keys else "1"
    over = f"OVER (PARTITION BY {by_key} ORDER BY window_start)"
    # The first bucket of a key is the running minimum, the next one a lead.
    ranked = metrics.withColumns(
        {
            "next_start": F.expr(f"lead(window_start) {over}"),
            "first_start": F.expr(f"min(window_start) {over}"),
            "clock": clock,
        }
    ).withColumn("clock_start", kind.start(F.col("clock")))
    steps = (F.unix_seconds("clock_start") - F.unix_seconds("first_start")) / kind.seconds
    too_many = F.raise_error(
        F.lit("More than 20,000 buckets from the first post to the clock; choose wider buckets or fewer days.")
    )
    stop = F.least("next_start", F.col("clock_start") + kind.step()) - kind.step()
    run = F.sequence("window_start", F.greatest("window_start", stop), kind.step())
    guarded = F.when(steps > V.MAX_BUCKETS, too_many.cast("array<timestamp>")).otherwise(run)
    filled = ranked.select(
        *keys, *SUMS, "has_engagement", "latest_time", "clock", F.posexplode(guarded)
    )
    occupied = F.col("pos") == 0
    return filled.select(
        *keys,
        F.col("col").alias("window_start"),
        *[F.when(occupied, F.col(c)).otherwise(F.lit(0)).alias(c) for c in SUMS],
        "has_engagement",
        F.when(occupied, F.col("latest_time")).alias("latest_time"),
        "clock",
    )


def timeline(rollup: DataFrame, window: str = "daily", clock: Column | None = None) -> DataFrame:
    """Volume, sentiment counts and mean engagement per bucket; no score counts as neutral."""
    clock = reference_clock(rollup) if clock is None else clock
    kind = bucket(window)
    filled = fill_gaps(bucket_metrics(rollup, window, ()), window, clock, ())
    return filled.select(
        "window_start",
        kind.end(F.col("window_start")).alias("window_end"),
        F.col("volume").alias("total_volume"),
        F.col("positive").alias("positive_count"),
        (F.col("neutral") + F.col("unscored")).alias("neutral_count"),
        F.col("negative").alias("negative_count"),
        share("(likes_sum + comments_sum + shares_sum)", "volume", 2).alias("avg_engagement"),
    )
