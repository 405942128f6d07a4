"""Buckets, trends, timelines and the window functions behind them."""

from pyspark.sql import functions as F

from catalogue import views as T
from catalogue.registry import query
from catalogue.sqltext import UNITS, quoted, rounded, timeline_ctes, trend_ctes
from tidewatch.functions import scoring
from tidewatch.functions.numeric import round_exact
from tidewatch.functions.timestamps import bucket
from tidewatch.operators import buckets, ranking, trends
from tidewatch.operators.keywords import hashtag_counts
from tidewatch.plans import trends as plans
from tidewatch.plans.dashboard import run_timeline

_COLUMNS = ", ".join(trends.SNAPSHOT_COLUMNS)
_WITHOUT_OUTLIERS = "topic_id <> 'error'"
_RUN_POSTS = f"{T.EVENT_POSTS}, run_posts AS (SELECT * FROM event_posts WHERE {_WITHOUT_OUTLIERS})"


def _rollup(spark, sf_dir):
    """Rollup of a run over the event posts, outliers left out."""
    return plans.run_rollup(
        T.event_posts(spark, sf_dir),
        T.event_links(spark, sf_dir),
        T.event_topics(spark, sf_dir),
        T.event_sentiment(spark, sf_dir),
    )


def _clock(spark, sf_dir):
    return buckets.reference_clock(T.event_posts(spark, sf_dir))


def _snapshots_sql(window, where="true", latest=False, columns=_COLUMNS, tail=""):
    last = " WHERE is_latest" if latest else ""
    ctes = trend_ctes("run_posts", window, where, clock_source="event_posts")
    return f"WITH {_RUN_POSTS}, {ctes} SELECT {columns} FROM snapshots{last}{tail}"


def _register_rankings():
    cases = [(w, None) for w in UNITS] + [("daily", "twitter"), ("hourly", "Reddit")]
    for window, platform in cases:
        where = f"platform = {quoted(platform.lower())}" if platform else "true"
        name = f"q5_ranked_trends_{window}" + (f"_{platform.lower()}" if platform else "")

        @query(name, _snapshots_sql(window, where, latest=True))
        def ranked(spark, sf_dir, window=window, platform=platform):
            found = plans.ranked_trends(_rollup(spark, sf_dir), window, platform, _clock(spark, sf_dir))
            return found.select(*trends.SNAPSHOT_COLUMNS)


def _register_histories():
    cases = [
        ("f23_q4_trend_snapshots_daily", "daily", None, None),
        ("f23_q4_trend_snapshots_weekly", "weekly", None, None),
        ("q5_trend_history_hourly_platform", "hourly", "instagram", None),
        ("q5_trend_history_one_topic", "daily", None, "purchase"),
    ]
    for name, window, platform, topic in cases:
        where = f"platform = {quoted(platform)}" if platform else "true"
        where += f" AND topic_id = {quoted(topic)}" if topic else ""

        @query(name, _snapshots_sql(window, where))
        def history(spark, sf_dir, window=window, platform=platform, topic=topic):
            found = plans.trend_histories(
                _rollup(spark, sf_dir), window, platform, topic, _clock(spark, sf_dir)
            )
            return found.select(*trends.SNAPSHOT_COLUMNS)


_register_rankings()
_register_histories()


@query(
    "q4_stored_snapshots_daily",
    f"""WITH {_RUN_POSTS}, {trend_ctes("run_posts", "daily", dataset_engagement=True,
        missing_as_neutral=True, clock_source="event_posts")} SELECT {_COLUMNS} FROM snapshots""",
)
def stored_snapshots(spark, sf_dir):
    """As a run stores them: engagement decided for the dataset, missing sentiment neutral."""
    posts = T.event_posts(spark, sf_dir)
    found = trends.trend_snapshots(
        _rollup(spark, sf_dir), "daily", buckets.reference_clock(posts),
        buckets.any_engagement(posts), missing_as_neutral=True,
    )
    return found.select(*trends.SNAPSHOT_COLUMNS)


@query(
    "w11_trailing_activity",
    _snapshots_sql("daily", columns="topic_id, window_start, array_to_string(activity, ',') AS activity"),
)
def activity(spark, sf_dir):
    found = plans.trend_histories(_rollup(spark, sf_dir), "daily", clock=_clock(spark, sf_dir))
    return found.select("topic_id", "window_start", F.concat_ws(",", "activity").alias("activity"))


@query(
    "w12_latest_bucket_per_topic",
    _snapshots_sql("weekly", latest=True, columns="topic_id, window_start, volume_current"),
)
def latest(spark, sf_dir):
    signals = trends.trajectory(_rollup(spark, sf_dir), "weekly", _clock(spark, sf_dir))
    return trends.latest_per_topic(signals).select(
        "topic_id", "window_start", F.col("volume").alias("volume_current")
    )


@query(
    "w4_w5_w6_w7_w8_w9_w10_trajectory_hourly",
    f"""WITH {_RUN_POSTS}, {trend_ctes("run_posts", "hourly", clock_source="event_posts")}
    SELECT topic_id, window_start, volume, volume_previous, {rounded("engagement_previous", 6)} AS engagement_previous,
      {rounded("volume_growth", 6)} AS volume_growth, {rounded("engagement_growth", 6)} AS engagement_growth,
      {rounded("velocity", 6)} AS velocity, {rounded("burst", 6)} AS burst, age, latest_post
    FROM signals""",
)
def trajectory(spark, sf_dir):
    """Previous values, growth, velocity, burst, age and the carried-over latest post."""
    signals = trends.trajectory(_rollup(spark, sf_dir), "hourly", _clock(spark, sf_dir))
    doubles = ("engagement_previous", "volume_growth", "engagement_growth", "velocity", "burst")
    return signals.select(
        "topic_id", "window_start", "volume", "volume_previous",
        *[round_exact(c, 6).alias(c) for c in doubles], F.col("age").cast("bigint").alias("age"),
        "latest_post",
    )


@query(
    "w1_gap_filled_hours",
    f"""WITH {_RUN_POSTS}, {trend_ctes("run_posts", "hourly", "platform = 'twitter'", clock_source="event_posts")}
    SELECT topic_id, window_start, volume FROM filled""",
)
def gap_fill(spark, sf_dir):
    rollup = _rollup(spark, sf_dir).where("platform = 'twitter'")
    filled = buckets.fill_gaps(
        buckets.bucket_metrics(rollup, "hourly"), "hourly", _clock(spark, sf_dir)
    )
    return filled.select("topic_id", "window_start", "volume")


@query(
    "w2_w3_bucket_bounds",
    """SELECT event_id, date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end,
      CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_start, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS day_end,
      CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start, CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL 7 DAY AS week_end
    FROM events""",
)
def bounds(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    kinds = {"hour": bucket("hourly"), "day": bucket("other name"), "week": bucket("weekly")}
    columns = {f"{n}_start": k.start(ts) for n, k in kinds.items()}
    columns |= {f"{n}_end": k.end(k.start(ts)) for n, k in kinds.items()}
    return T.table(spark, sf_dir, "events").select(
        "event_id", *[c.alias(n) for n, c in columns.items()]
    )


@query(
    "g9_bucket_metrics_daily",
    f"""WITH {_RUN_POSTS}, {trend_ctes("run_posts", "daily", clock_source="event_posts")}
    SELECT topic_id, window_start, volume, CAST(total AS BIGINT) AS engagement_total, positive, neutral, negative, latest
    FROM buckets""",
)
def metrics(spark, sf_dir):
    found = buckets.bucket_metrics(_rollup(spark, sf_dir), "daily")
    return found.select(
        "topic_id", "window_start", "volume",
        F.expr("likes_sum + comments_sum + shares_sum").alias("engagement_total"),
        "positive", "neutral", "negative", F.col("latest_time").alias("latest"),
    )


@query(
    "g11_engagement_availability",
    f"""WITH {T.EVENT_POSTS} SELECT topic_id, bool_or(likes IS NOT NULL OR comments IS NOT NULL OR shares IS NOT NULL)
      AS has_engagement FROM event_posts GROUP BY topic_id""",
)
def availability(spark, sf_dir):
    rollup = buckets.hourly_rollup(T.event_posts(spark, sf_dir))
    return rollup.groupBy("topic_id").agg(F.max("has_engagement").alias("has_engagement"))


@query(
    "g12_reference_clock",
    f"""WITH {T.EVENT_POSTS} SELECT platform, max("timestamp") AS latest_here,
      (SELECT max("timestamp") FROM event_posts) AS clock FROM event_posts GROUP BY platform""",
)
def clock(spark, sf_dir):
    posts = T.event_posts(spark, sf_dir)
    here = posts.groupBy("platform").agg(F.max("timestamp").alias("latest_here"))
    return here.withColumn("clock", buckets.reference_clock(posts))


def _register_timelines():
    cases = [("daily", None, None), ("hourly", None, None), ("weekly", "twitter", None), ("hourly", None, "signup")]
    for window, platform, topic in cases:
        where = f"platform = {quoted(platform)}" if platform else "true"
        where += f" AND topic_id = {quoted(topic)}" if topic else ""
        name = "_".join(["g10_q7_timeline", window, *([platform] if platform else []), *([topic] if topic else [])])

        @query(name, f"WITH {T.EVENT_POSTS}, {timeline_ctes('event_posts', window, where)} SELECT * FROM timeline")
        def timeline(spark, sf_dir, window=window, platform=platform, topic=topic):
            return run_timeline(
                T.event_posts(spark, sf_dir), T.event_sentiment(spark, sf_dir), window, platform,
                T.event_links(spark, sf_dir), topic,
            )


_register_timelines()


@query(
    "g22_q12_trend_listing_counts",
    _snapshots_sql(
        "daily", latest=True,
        columns=", ".join(f"count(*) FILTER (classification = '{c}') AS {c}_count"
                          for c in ("emerging", "rising", "stable", "declining")),
    ),
)
def listing_counts(spark, sf_dir):
    ranked = plans.ranked_trends(_rollup(spark, sf_dir), "daily", None, _clock(spark, sf_dir))
    return plans.list_trends(ranked)[1]


@query("p14_q12_trends_of_one_class", _snapshots_sql("hourly", latest=True).replace(
    "WHERE is_latest", "WHERE is_latest AND classification = 'stable'"))
def listing_of_class(spark, sf_dir):
    ranked = plans.ranked_trends(_rollup(spark, sf_dir), "hourly", None, _clock(spark, sf_dir))
    return plans.list_trends(ranked, "stable")[0].select(*trends.SNAPSHOT_COLUMNS)


@query(
    "g21_snapshot_class_counts",
    _snapshots_sql(
        "hourly",
        columns=", ".join(f"count(*) FILTER (classification = '{c}') AS {c}_count"
                          for c in ("emerging", "rising", "stable", "declining")),
    ),
)
def class_counts(spark, sf_dir):
    found = trends.trend_snapshots(_rollup(spark, sf_dir), "hourly", _clock(spark, sf_dir))
    return trends.classification_counts(found)


@query(
    "o1_o2_top_trends",
    _snapshots_sql("hourly", latest=True, columns="topic_id, trend_score",
                   tail=" ORDER BY trend_score DESC, topic_id LIMIT 2"),
)
def top_trends(spark, sf_dir):
    ranked = plans.ranked_trends(_rollup(spark, sf_dir), "hourly", None, _clock(spark, sf_dir))
    return ranked.select("topic_id", "trend_score").limit(2)


@query(
    "f16_f17_f20_score_parts",
    f"""SELECT event_id, {rounded("1.0 / (1.0 + exp(-(value - 250.0) / 50.0))", 9)} AS logistic,
      {rounded('''exp(-0.05 * greatest(0.0, (SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts)) / 3.6e9)''', 9)} AS recency,
      CASE WHEN value < 3 THEN 'stable' WHEN value / 500 >= 0.7 AND user_id % 2 = 0 THEN 'emerging'
        WHEN value / 500 >= 0.6 THEN 'rising' WHEN value / 500 >= 0.4 THEN 'stable' ELSE 'declining' END AS classification
    FROM events""",
)
def score_parts(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = events.withColumn("clock", events.agg(F.max("ts")).scalar()).select(
        "event_id", "value", "user_id",
        scoring.logistic("((value - 250D) / 50D)").alias("logistic"),
        scoring.recency("ts", "clock").alias("recency"),
    )
    return parts.select(
        "event_id",
        round_exact("logistic", 9).alias("logistic"),
        round_exact("recency", 9).alias("recency"),
        scoring.classification("(value / 500)", "value", "(user_id % 2)", "2").alias("classification"),
    )


@query(
    "f18_f19_momentum_and_score",
    f"""SELECT event_id, {rounded("momentum", 9)} AS momentum, {rounded("0.5 + (momentum - 0.5) * r", 9)} AS trend_score
    FROM (SELECT event_id, r, CASE WHEN user_id % 7 = 0 THEN (0.35 * v + 0.20 * r + 0.20 * (1 - v)) / 0.75
        ELSE 0.35 * v + 0.25 * (1 - r) + 0.20 * r + 0.20 * (1 - v) END AS momentum
      FROM (SELECT event_id, user_id, value / 500 AS v, CAST(json_extract_string(props, '$.k') AS INT) / 100 AS r FROM events))""",
)
def momentum(spark, sf_dir):
    parts = T.table(spark, sf_dir, "events").selectExpr(
        "event_id", "value / 500 AS v", "user_id % 7 <> 0 AS measured",
        "CAST(get_json_object(props, '$.k') AS INT) / 100 AS r",
    )
    scored = parts.withColumn("momentum", scoring.momentum("v", "(1 - r)", "r", "(1 - v)", "measured"))
    scored = scored.withColumn("score", scoring.trend_score("momentum", "r"))
    return scored.select(
        "event_id",
        round_exact("momentum", 9).alias("momentum"),
        round_exact("score", 9).alias("trend_score"),
    )


@query(
    "f21_f22_explanations",
    _snapshots_sql("hourly", "platform = 'twitter'", columns="topic_id, window_start, explanation"),
)
def explanations(spark, sf_dir):
    found = plans.trend_histories(_rollup(spark, sf_dir), "hourly", "twitter", None, _clock(spark, sf_dir))
    return found.select("topic_id", "window_start", "explanation")


@query(
    "f25_dominant_sentiment",
    _snapshots_sql(
        "hourly",
        columns="""topic_id, window_start, CASE
          WHEN sentiment_positive_pct >= greatest(sentiment_neutral_pct, sentiment_negative_pct) THEN 'positive'
          WHEN sentiment_neutral_pct >= sentiment_negative_pct THEN 'neutral' ELSE 'negative' END AS dominant,
          volume_current < 3 AS guarded""",
    ),
)
def dominant(spark, sf_dir):
    found = trends.trend_snapshots(_rollup(spark, sf_dir), "hourly", _clock(spark, sf_dir))
    return found.select(
        "topic_id", "window_start",
        scoring.dominant_sentiment(
            "sentiment_positive_pct", "sentiment_neutral_pct", "sentiment_negative_pct"
        ).alias("dominant"),
        (F.col("volume_current") < 3).alias("guarded"),
    )


@query(
    "f27_snapshot_ids",
    _snapshots_sql("daily", columns="""topic_id, sha256('run/' || topic_id || '/daily//' ||
      strftime(window_start, '%Y-%m-%d %H:%M:%S')) AS snapshot_id"""),
)
def snapshot_ids(spark, sf_dir):
    found = plans.trend_histories(
        _rollup(spark, sf_dir), "daily", clock=_clock(spark, sf_dir), run_id="run"
    )
    return found.select("topic_id", "snapshot_id")


@query(
    "w17_position_in_time",
    """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_number_0 FROM events""",
)
def positions(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select("event_id", "ts")
    return ranking.number_rows(events, ["ts", "event_id"]).select("event_id", "row_number_0")


@query(
    "g19_hashtag_growth",
    f"""WITH {T.DOC_POSTS}, halves AS (
      SELECT post_id, event_type, lang, row_number() OVER (ORDER BY "timestamp", post_id) <= (SELECT count(*) // 2 FROM doc_posts) AS early
      FROM doc_posts),
    tags AS (SELECT event_type AS hashtag, early FROM halves UNION ALL SELECT lang, early FROM halves),
    counts AS (SELECT hashtag, count(*) AS frequency, count(*) FILTER (early) AS early, count(*) FILTER (NOT early) AS late FROM tags GROUP BY 1)
    SELECT hashtag, frequency, CASE WHEN early > 0 THEN {rounded("CAST(late - early AS DOUBLE) / early", 4)}
      WHEN late > 0 THEN 1.0 END AS growth_rate FROM counts""",
)
def hashtag_growth(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir).select("post_id", "timestamp", "hashtags")
    return hashtag_counts(posts, ranking.first_half(posts))
