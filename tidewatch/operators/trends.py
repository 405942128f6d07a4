"""Trend snapshots: growth, velocity, burst and recency per topic and bucket, scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import scoring
from tidewatch.functions.numeric import round_exact, share
from tidewatch.functions.timestamps import bucket
from tidewatch.operators.buckets import bucket_metrics, fill_gaps, reference_clock

SNAPSHOT_COLUMNS = (
    "topic_id", "time_window", "window_start", "window_end", "trend_score", "classification",
    "explanation", "volume_current", "volume_previous", "volume_growth_pct", "engagement_current",
    "engagement_previous", "engagement_growth_pct", "velocity", "burst_score", "recency_score",
    "sentiment_positive_pct", "sentiment_neutral_pct", "sentiment_negative_pct",
)


def _in_order() -> Window:
    return Window.partitionBy("topic_id").orderBy("window_start")


def trajectory(
    rollup: DataFrame,
    window: str = "daily",
    clock: Column | None = None,
    has_engagement: Column | None = None,
    missing_as_neutral: bool = False,
    config: scoring.TrendConfig = scoring.TrendConfig(),
) -> DataFrame:
    """Unrounded signals per topic and bucket, gaps filled.

    Without `has_engagement` every topic decides for itself from the rollup rows given.
    """
    clock = reference_clock(rollup) if clock is None else clock
    filled = fill_gaps(bucket_metrics(rollup, window), window, clock)
    order = _in_order()
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    recent = order.rowsBetween(-(V.ACTIVITY_LENGTH - 1), Window.currentRow)
    neutral = F.col("neutral") + F.col("unscored") if missing_as_neutral else F.col("neutral")
    total = (F.col("likes_sum") + F.col("comments_sum") + F.col("shares_sum")).cast("double")
    base = F.lit(float(config.min_baseline))

    measured = F.max("has_engagement").over(whole) if has_engagement is None else has_engagement
    first = F.col("age") == 1
    # One window operator for what depends on volumes, one for what depends on its results.
    return (
        filled.withColumns(
            {
                "measured": measured,
                "age": F.row_number().over(order),
                "is_latest": F.lead("window_start").over(order).isNull(),
                "volume_previous": F.lag("volume", 1, 0).over(order),
                "mean_before": F.avg("volume").over(earlier),
                "spread_before": F.stddev_pop("volume").over(earlier),
                "latest_post": F.last("latest_time", ignorenulls=True).over(so_far),
                "activity": F.collect_list("volume").over(recent),
            }
        )
        .withColumns(
            {
                "engagement": F.when(
                    F.col("measured") & (F.col("volume") > 0), total / F.col("volume")
                ).otherwise(0.0),
                "volume_growth": (F.col("volume") - F.col("volume_previous"))
                / F.greatest(F.col("volume_previous").cast("double"), base),
                "burst": F.when(first, 0.0).otherwise(
                    (F.col("volume") - F.col("mean_before"))
                    / F.greatest(F.col("spread_before"), F.lit(1.0))
                ),
            }
        )
        .withColumns(
            {
                "engagement_previous": F.lag("engagement", 1, 0.0).over(order),
                "growth_before": F.lag("volume_growth").over(order),
            }
        )
        .select(
            "topic_id", "window_start", "volume", "volume_previous", "volume_growth", "engagement",
            "engagement_previous",
            F.when(first, 0.0)
            .otherwise(
                (F.col("engagement") - F.col("engagement_previous"))
                / F.greatest(F.col("engagement_previous"), F.lit(1.0))
            )
            .alias("engagement_growth"),
            F.when(first, 0.0)
            .otherwise(F.col("volume_growth") - F.col("growth_before"))
            .alias("velocity"),
            "burst", "age", "measured", "latest_post", "positive", neutral.alias("neutral"),
            "negative", "is_latest", "activity", "clock",
        )
    )


def score(
    signals: DataFrame,
    window: str = "daily",
    config: scoring.TrendConfig = scoring.TrendConfig(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Snapshots from a trajectory: score, class, sentence and rounded figures, plus `keep`."""
    kind = bucket(window)
    # Each step only reads columns of the one before, so no expression is written out repeatedly.
    scored = (
        signals.withColumns(
            {
                "recency": scoring.recency("latest_post", "clock", config.decay_per_hour),
                "n_volume": scoring.logistic("volume_growth", config.steepness),
                "n_engagement": scoring.logistic("engagement_growth", config.steepness),
                "n_velocity": scoring.logistic("velocity", config.steepness),
                "n_burst": scoring.logistic("burst", config.burst_steepness),
                "volume_growth_pct": round_exact("volume_growth * 100D", 2),
                "eng_growth_pct": round_exact("engagement_growth * 100D", 2),
                "burst_printed": round_exact("abs(burst)", 1),
            }
        )
        .withColumns(
            {
                "momentum": scoring.momentum(
                    "n_volume", "n_engagement", "n_velocity", "n_burst", "measured", config
                ),
                "volume_printed": round_exact("abs(volume_growth_pct)", 0),
                "engagement_printed": round_exact("abs(eng_growth_pct)", 0),
            }
        )
        .withColumn("score", scoring.trend_score("momentum", "recency"))
    )
    printed = {name: f"{name}_printed" for name in ("volume", "engagement", "burst")}
    level = F.col("measured")
    return scored.select(
        "topic_id",
        F.lit(kind.name).alias("time_window"),
        "window_start",
        kind.end(F.col("window_start")).alias("window_end"),
        round_exact("score", 4).alias("trend_score"),
        scoring.classification("score", "volume", "volume_previous", "age", config).alias(
            "classification"
        ),
        scoring.explanation(
            "volume_growth_pct", "eng_growth_pct", "burst", "velocity", "volume", printed, config
        ).alias("explanation"),
        F.col("volume").alias("volume_current"),
        "volume_previous",
        "volume_growth_pct",
        F.when(level, round_exact("engagement", 2)).alias("engagement_current"),
        F.when(level, round_exact("engagement_previous", 2)).alias("engagement_previous"),
        F.when(level, F.col("eng_growth_pct")).alias("engagement_growth_pct"),
        round_exact("velocity", 4).alias("velocity"),
        round_exact("burst", 4).alias("burst_score"),
        round_exact("recency", 4).alias("recency_score"),
        *[share(s, "volume").alias(f"sentiment_{s}_pct") for s in V.SENTIMENTS],
        *keep,
    )


def trend_snapshots(
    rollup: DataFrame,
    window: str = "daily",
    clock: Column | None = None,
    has_engagement: Column | None = None,
    missing_as_neutral: bool = False,
    config: scoring.TrendConfig = scoring.TrendConfig(),
) -> DataFrame:
    """Scored snapshots for every topic and bucket of the rollup."""
    signals = trajectory(rollup, window, clock, has_engagement, missing_as_neutral, config)
    return score(signals, window, config)


def with_snapshot_id(snapshots: DataFrame, run_id: str, platform: str | None = None) -> DataFrame:
    key = scoring.snapshot_id(
        F.lit(run_id), F.col("topic_id"), F.col("time_window"), F.lit(platform or ""),
        F.col("window_start"),
    )
    return snapshots.withColumn("snapshot_id", key)


def latest_per_topic(signals: DataFrame) -> DataFrame:
    """The last bucket of each topic, before scoring: other buckets need no score."""
    return signals.where("is_latest")


def rank_trends(latest: DataFrame) -> DataFrame:
    """Highest score first, then topic id."""
    return latest.orderBy(F.desc("trend_score"), F.col("topic_id").cast("string"))


def classification_counts(snapshots: DataFrame) -> DataFrame:
    """One row with a count per class, zero where none."""
    return snapshots.agg(
        *[F.count_if(F.col("classification") == c).alias(f"{c}_count") for c in V.CLASSIFICATIONS]
    )
