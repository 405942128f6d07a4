import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scoring
from tidewatch.functions.numeric import round_exact
from tidewatch.operators import buckets, ranking, trends
from tidewatch.plans import trends as plans
from tidewatch.plans.dashboard import run_timeline

DAY = datetime(2026, 1, 5)  # a Monday
SCHEMA = "topic_id string, timestamp timestamp, platform string, likes int, comments int, shares int, sentiment string"


def value(spark, column, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(column).first()[0]


def test_logistic_is_centred(spark):
    assert value(spark, scoring.logistic("x"), x=0.0) == 0.5
    for x in (0.3, 2.0, 50.0):
        up, down = (value(spark, scoring.logistic("x"), x=s * x) for s in (1, -1))
        assert up + down == pytest.approx(1.0) and up > 0.5
    assert value(spark, scoring.logistic("x"), x=1e9) == value(spark, scoring.logistic("x"), x=20.0)


def test_neutral_momentum_ignores_recency(spark):
    for r in (0.0, 0.3, 1.0):
        assert value(spark, scoring.trend_score("m", "r"), m=0.5, r=r) == 0.5


def test_engagement_weight_moves_to_the_others(spark):
    parts = ("v", "e", "s", "b")
    levels = {"v": 0.8, "e": 0.5, "s": 0.8, "b": 0.8}
    with_zero = value(spark, scoring.momentum(*parts, "has"), has=True, **levels)
    without = value(spark, scoring.momentum(*parts, "has"), has=False, **levels)
    assert with_zero == pytest.approx(0.725) and without == pytest.approx(0.80)


def test_recency(spark):
    found = value(spark, scoring.recency("a", "b"), a=DAY, b=DAY + timedelta(hours=12))
    assert found == pytest.approx(math.exp(-0.05 * 12))
    assert value(spark, scoring.recency("b", "a"), a=DAY, b=DAY + timedelta(hours=1)) == 1.0


@pytest.mark.parametrize(
    "score, volume, previous, age, expected",
    [(0.9, 2, 0, 1, "stable"), (0.7, 3, 5, 1, "emerging"), (0.7, 3, 0, 9, "emerging"), (0.7, 3, 1, 2, "rising"),
     (0.6, 9, 1, 5, "rising"), (0.4, 9, 1, 5, "stable"), (0.39, 9, 1, 5, "declining")],
)
def test_classification(spark, score, volume, previous, age, expected):
    column = scoring.classification("score", "volume", "previous", "age")
    assert value(spark, column, score=score, volume=volume, previous=previous, age=age) == expected


def test_explanation(spark):
    def said(vg, eg, burst, velocity, volume):
        printed = {"volume": round_exact_name("abs(vg)", 0), "engagement": round_exact_name("abs(eg)", 0),
                   "burst": round_exact_name("abs(burst)", 1)}
        row = spark.range(1).select(
            F.lit(vg).alias("vg"), F.lit(eg).alias("eg"), F.lit(burst).alias("burst"),
            F.lit(velocity).alias("velocity"), F.lit(volume).alias("volume"),
        )
        row = row.withColumns({k: c for k, c in printed.values()})
        names = {k: n for k, (n, _) in printed.items()}
        return row.select(scoring.explanation("vg", "eg", "burst", "velocity", "volume", names)).first()[0]

    def round_exact_name(x, digits):
        return f"p{abs(hash((x, digits)))}", round_exact(x, digits)

    text = said(150.0, 40.0, 2.85, 0.9, 12)
    assert text == (
        "Post volume increased by 150% compared to the previous period. engagement grew by 40%. activity is "
        "2.9 standard deviations above the historical baseline. growth is accelerating."
    )
    assert said(0.0, 0.0, 0.0, 0.0, 9) == "Activity levels and engagement remain consistent with historical norms."
    low = said(-50.0, -20.0, -2.0, -0.6, 2)
    assert low.startswith("Stable — insufficient current volume (2 < 3). Post volume decreased by 50%")
    assert "2.0 standard deviations below" in low and low.endswith("growth is decelerating.")


def test_rounding_matches_python(spark):
    random.seed(2)
    xs = [i / 160 for i in range(800)] + [i / 32 for i in range(200)] + [random.uniform(-9e4, 9e4) for _ in range(800)] + [2.85, 2.25]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    for digits in (0, 1, 2, 4):
        for r in frame.select("x", round_exact("x", digits).alias("r")).collect():
            assert r["r"] == round(r["x"], digits)


def posts_frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def simple(topic, when, likes=None, sentiment=None, platform="x"):
    return (topic, when, platform, likes, None, None, sentiment)


def test_three_growing_days(spark):
    rows = [simple("t", DAY + timedelta(days=d, minutes=i), 1, "positive") for d, n in enumerate((2, 4, 8)) for i in range(n)]
    found = trends.trend_snapshots(buckets.hourly_rollup(posts_frame(spark, rows))).orderBy("window_start").collect()
    assert [r["volume_current"] for r in found] == [2, 4, 8]
    assert [r["volume_growth_pct"] for r in found] == [200.0, 100.0, 100.0]
    assert [r["velocity"] for r in found] == [0.0, -1.0, 0.0]
    assert found[0]["classification"] == "stable" and found[0]["burst_score"] == 0.0


def test_gaps_weeks_and_clock(spark):
    rows = [simple("a", DAY + timedelta(hours=1)), simple("a", DAY + timedelta(days=3)), simple("b", DAY + timedelta(days=9))]
    rollup = buckets.hourly_rollup(posts_frame(spark, rows))
    daily = trends.trend_snapshots(rollup, "daily").collect()
    volumes = sorted((r["topic_id"], r["window_start"], r["volume_current"]) for r in daily)
    assert [v for t, _, v in volumes if t == "a"] == [1, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert [v for t, _, v in volumes if t == "b"] == [1]
    weekly = trends.trend_snapshots(rollup, "weekly").where("topic_id = 'a'").orderBy("window_start").collect()
    assert [(r["window_start"], r["volume_current"]) for r in weekly] == [(DAY, 2), (DAY + timedelta(7), 0)]
    early = buckets.fill_gaps(buckets.bucket_metrics(rollup, "daily"), "daily", F.lit(DAY - timedelta(days=2)))
    assert early.count() == 3  # a clock before the first bucket leaves the occupied ones


def test_too_many_buckets_is_an_error(spark):
    rows = [simple("a", DAY), simple("a", DAY + timedelta(days=3000))]
    rollup = buckets.hourly_rollup(posts_frame(spark, rows))
    with pytest.raises(Exception, match="More than 20,000 buckets"):
        trends.trend_snapshots(rollup, "hourly").collect()
    assert trends.trend_snapshots(rollup, "daily").count() == 3001


def test_missing_is_not_zero(spark):
    rows = [simple("none", DAY + timedelta(minutes=i)) for i in range(4)] + [simple("zero", DAY + timedelta(minutes=i), 0) for i in range(4)]
    found = {r["topic_id"]: r for r in trends.trend_snapshots(buckets.hourly_rollup(posts_frame(spark, rows))).collect()}
    assert found["none"]["engagement_current"] is None and found["zero"]["engagement_current"] == 0.0
    assert found["none"]["sentiment_neutral_pct"] == 0.0
    stored = trends.trend_snapshots(
        buckets.hourly_rollup(posts_frame(spark, rows)), has_engagement=F.lit(True), missing_as_neutral=True
    )
    assert {r["sentiment_neutral_pct"] for r in stored.collect()} == {1.0}


def brute_force(rows, hours, clock):
    """Snapshot figures of one topic in plain Python."""
    step = timedelta(hours=hours)
    floor = lambda t: datetime(1970, 1, 5) + ((t - datetime(1970, 1, 5)) // step) * step
    by_bucket = {}
    for r in rows:
        by_bucket.setdefault(floor(r[1]), []).append(r)
    at, volumes, before, growth_before, last = min(by_bucket), [], (0, 0.0), 0.0, None
    has = any(r[3] is not None for r in rows)
    out = []
    while at <= floor(clock):
        here = by_bucket.get(at, [])
        v = len(here)
        e = sum(r[3] or 0 for r in here) / v if v and has else 0.0
        growth = (v - before[0]) / max(float(before[0]), 1.0)
        eng = 0.0 if not volumes else (e - before[1]) / max(before[1], 1.0)
        velocity = 0.0 if not volumes else growth - growth_before
        burst = 0.0 if not volumes else (v - np.mean(volumes)) / max(np.std(volumes), 1.0)
        last = max([r[1] for r in here], default=last)
        s = lambda x, k: 1 / (1 + math.exp(max(-20.0, min(20.0, -k * x))))
        if has:
            m = 0.35 * s(growth, 1) + 0.25 * s(eng, 1) + 0.2 * s(velocity, 1) + 0.2 * s(burst, 0.5)
        else:
            m = (0.35 * s(growth, 1) + 0.2 * s(velocity, 1) + 0.2 * s(burst, 0.5)) / 0.75
        fresh = math.exp(-0.05 * (clock - last).total_seconds() / 3600)
        out.append((at, v, round(0.5 + (m - 0.5) * fresh, 4), round(velocity, 4), round(burst, 4), round(fresh, 4)))
        volumes.append(v)
        before, growth_before, at = (v, e), growth, at + step
    return out


@pytest.mark.parametrize("window, hours", [("hourly", 1), ("daily", 24), ("weekly", 168)])
def test_snapshots_against_brute_force(spark, window, hours):
    """Random topics, one of them with a third of all posts."""
    random.seed(hours)
    names = ["hot"] * 4 + [f"t{i}" for i in range(8)]
    rows = [
        simple(t := random.choice(names), DAY + timedelta(seconds=random.randint(0, 4 * 86400)),
               random.choice([None, 0, 5, 9]) if t != "t1" else None, random.choice(["positive", "negative", None]))
        for _ in range(900)
    ]
    clock = max(r[1] for r in rows)
    found = trends.trend_snapshots(buckets.hourly_rollup(posts_frame(spark, rows)), window).collect()
    for topic in set(names):
        mine = sorted(
            (r["window_start"], r["volume_current"], r["trend_score"], r["velocity"], r["burst_score"], r["recency_score"])
            for r in found if r["topic_id"] == topic
        )
        expected = brute_force([r for r in rows if r[0] == topic], hours, clock)
        assert [m[:2] for m in mine] == [e[:2] for e in expected]
        assert np.allclose([m[2:] for m in mine], [e[2:] for e in expected], atol=1.01e-4)


def test_platform_ranking_and_activity(spark):
    rows = [simple("a", DAY + timedelta(hours=i), 1, None, "x") for i in range(30)]
    rows += [simple("b", DAY + timedelta(hours=i), 1, None, "y") for i in range(40)]
    rollup = buckets.hourly_rollup(posts_frame(spark, rows))
    ranked = plans.ranked_trends(rollup, "hourly", "X").collect()
    assert [r["topic_id"] for r in ranked] == ["a"]
    assert ranked[0]["window_start"] == DAY + timedelta(hours=39)  # the clock ignores the filter
    assert len(ranked[0]["activity"]) == 21 and list(ranked[0]["activity"][-10:]) == [0] * 9 + [0]
    assert [r["topic_id"] for r in plans.ranked_trends(rollup, "daily").collect()][0] in ("a", "b")


def test_volumes_add_up(spark):
    random.seed(4)
    rows = [simple(f"t{i % 3}", DAY + timedelta(minutes=random.randint(0, 9000))) for i in range(500)]
    rollup = buckets.hourly_rollup(posts_frame(spark, rows))
    for window in ("hourly", "daily", "weekly"):
        totals = trends.trend_snapshots(rollup, window).groupBy("topic_id").agg(F.sum("volume_current").alias("n"))
        assert {r["topic_id"]: r["n"] for r in totals.collect()} == {"t0": 167, "t1": 167, "t2": 166}


def test_timeline_counts_missing_as_neutral(spark):
    posts = spark.createDataFrame(
        [(1, DAY, "x", 3, 1, None), (2, DAY, "x", None, None, None), (3, DAY + timedelta(days=2), "y", 1, None, None)],
        "post_id int, timestamp timestamp, platform string, likes int, comments int, shares int",
    )
    sentiment = spark.createDataFrame([(1, "positive")], "post_id int, label string")
    rows = run_timeline(posts, sentiment).orderBy("window_start").collect()
    assert [r["total_volume"] for r in rows] == [2, 0, 1]
    assert (rows[0]["positive_count"], rows[0]["neutral_count"], rows[0]["avg_engagement"]) == (1, 1, 2.0)
    assert [r["total_volume"] for r in run_timeline(posts, sentiment, "daily", "X").orderBy("window_start").collect()] == [2, 0, 0]


def test_numbering_with_ties(spark):
    """A third of all rows share one time; positions equal a plain sort."""
    random.seed(9)
    rows = [(0 if i % 3 == 0 else random.randint(0, 50), f"id{i:05d}") for i in range(4000)]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "t int, id string")
    found = {r["id"]: r["row_number_0"] for r in ranking.number_rows(frame, ["t", "id"]).collect()}
    assert found == {r[1]: i for i, r in enumerate(sorted(rows))}
    early = frame.withColumnsRenamed({"t": "timestamp", "id": "post_id"})
    half = early.where(ranking.first_half(early)).count()
    assert half == 2000
    assert ranking.first_half(early.limit(1)) is None


@pytest.mark.parametrize("few", [1, 7, 10**6])
def test_value_at_a_rank(spark, few):
    rng = random.Random(few)
    cases = {
        "spread": [rng.randrange(-(10**15), 10**15) for _ in range(3000)],
        "ties": [rng.choice([5, 5, 5, 9, rng.randrange(20)]) for _ in range(3000)],
        "one value": [4] * 500,
        "two values": [-1] * 400 + [8] * 100,
    }
    for values in cases.values():
        frame = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(8)
        ordered = sorted(values)
        for rank in (0, 1, len(values) // 2, len(values) - 1):
            found = ranking.value_at(frame, rank, few)
            assert found == (ordered[rank], ordered.index(ordered[rank]))


@pytest.mark.parametrize("few", [1, 10**6])
def test_first_half_with_ties_and_missing_times(spark, few):
    rng = random.Random(3)
    schema = "timestamp timestamp, post_id string"
    for times in ([None], [DAY], [None, None, DAY], [DAY + timedelta(microseconds=i) for i in range(50)] + [DAY, DAY, None]):
        rows = [(rng.choice(times), f"p{i:03d}") for i in range(201)]
        posts = spark.createDataFrame(rows, schema)
        first = sorted(rows, key=lambda r: (r[0] is not None, r[0] or DAY, r[1]))[:100]
        assert sorted(r["post_id"] for r in posts.where(ranking.first_half(posts, few)).collect()) == sorted(r[1] for r in first)


def test_first_half_numbers_only_posts_of_one_time(spark, monkeypatch):
    posts = spark.range(5000).selectExpr("timestamp_micros(id * 1000) AS timestamp", "CAST(id AS STRING) AS post_id")
    numbered, whole = [], ranking.number_rows
    monkeypatch.setattr(ranking, "number_rows", lambda rows, order: numbered.append(rows.count()) or whole(rows, order))
    assert posts.where(ranking.first_half(posts, 100)).count() == 2500 and numbered == [1]
