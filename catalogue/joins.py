"""Joins of the read views."""

from pyspark.sql import functions as F

from catalogue import views as T
from catalogue.registry import query
from catalogue.sqltext import trend_ctes
from tidewatch.plans import dashboard, search
from tidewatch.plans import topics as topic_plans
from tidewatch.plans import trends as trend_plans

_BASE = f"WITH {T.EVENT_POSTS}, {T.EVENT_SENTIMENT}, {T.EVENT_LINKS}, {T.EVENT_TOPICS}"


def _tables(spark, sf_dir):
    return {
        "posts": T.event_posts(spark, sf_dir).drop("topic_id", "sentiment"),
        "sentiment": T.event_sentiment(spark, sf_dir),
        "post_topics": T.event_links(spark, sf_dir),
        "topics": T.event_topics(spark, sf_dir),
    }


@query("j1_posts_with_sentiment", f"{_BASE} SELECT post_id, platform, label AS sentiment FROM event_posts LEFT JOIN event_sentiment USING (post_id)")
def with_sentiment(spark, sf_dir):
    t = _tables(spark, sf_dir)
    labels = t["sentiment"].select("post_id", F.col("label").alias("sentiment"))
    return t["posts"].join(labels, "post_id", "left").select("post_id", "platform", "sentiment")


@query(
    "j2_j5_posts_of_a_topic",
    f"""{_BASE} SELECT p.post_id, p."timestamp", l.probability, s.label AS sentiment FROM event_posts p JOIN event_links l ON l.post_id = p.post_id
    LEFT JOIN event_sentiment s ON s.post_id = p.post_id WHERE l.topic_id = 'view'""",
)
def of_topic(spark, sf_dir):
    t = _tables(spark, sf_dir)
    rows = topic_plans.topic_posts(t["posts"], t["post_topics"], t["sentiment"], "view")
    return rows.select("post_id", "timestamp", "probability", "sentiment")


@query(
    "j3_search_join",
    f"""{_BASE} SELECT p.post_id, s.label AS sentiment, t.display_name AS topic_name FROM event_posts p
    LEFT JOIN event_sentiment s ON s.post_id = p.post_id LEFT JOIN event_links l ON l.post_id = p.post_id
    LEFT JOIN event_topics t ON t.topic_id = l.topic_id""",
)
def search_join(spark, sf_dir):
    t = _tables(spark, sf_dir)
    rows = search.with_results(t["posts"], t["sentiment"], t["post_topics"], t["topics"])
    return rows.select("post_id", "sentiment", "topic_name")


@query("j4_trend_input", f'{_BASE} SELECT topic_id, post_id, "timestamp", likes, comments, sentiment FROM event_posts')
def trend_input(spark, sf_dir):
    t = _tables(spark, sf_dir)
    rows = trend_plans.trend_input(t["posts"], t["post_topics"], t["sentiment"])
    return rows.select("topic_id", "post_id", "timestamp", "likes", "comments", "sentiment")


@query("j8_topic_key_lookup", f"{_BASE} SELECT l.post_id, t.display_name || '#' || t.post_count AS topic_key FROM event_links l JOIN event_topics t USING (topic_id)")
def topic_keys(spark, sf_dir):
    """Topics are bounded by the minimum topic size, so the optimizer ships them whole."""
    t = _tables(spark, sf_dir)
    keys = t["topics"].select("topic_id", F.concat_ws("#", "display_name", "post_count").alias("topic_key"))
    return t["post_topics"].join(keys, "topic_id").select("post_id", "topic_key")


@query(
    "j9_entity_key_lookup",
    f"""WITH {T.EVENT_MENTIONS}, {T.EVENT_ENTITIES} SELECT m.post_id, e.entity_id, e."text" FROM event_mentions m
    JOIN event_entities e ON e.normalized_text = m.normalized_text AND e.label = m.label""",
)
def entity_keys(spark, sf_dir):
    entities = T.event_entities(spark, sf_dir).select("normalized_text", "label", "entity_id", "text")
    mentions = T.event_mentions(spark, sf_dir).select("post_id", "normalized_text", "label")
    return mentions.join(entities, ["normalized_text", "label"]).select("post_id", "entity_id", "text")


@query("j10_posts_with_predictions", f"WITH {T.DOC_PREDICTIONS} SELECT post_id, truth, label FROM doc_predictions WHERE truth IS NOT NULL")
def predictions(spark, sf_dir):
    """Predictions meet posts by post id, never by position."""
    guessed = T.doc_predictions(spark, sf_dir).select("post_id", F.lower("label").alias("label"))
    return T.doc_truth(spark, sf_dir).join(guessed, "post_id")


@query(
    "j11_q9_topics_with_trends",
    f"""WITH {T.EVENT_POSTS}, {T.EVENT_TOPICS}, run_posts AS (SELECT * FROM event_posts WHERE topic_id <> 'error'),
    {trend_ctes("run_posts", "daily", clock_source="event_posts")}
    SELECT t.topic_id, t.post_count, s.trend_score, s.classification FROM event_topics t
    LEFT JOIN snapshots s ON s.topic_id = t.topic_id AND s.is_latest""",
)
def with_trends(spark, sf_dir):
    t = _tables(spark, sf_dir)
    rollup = trend_plans.run_rollup(t["posts"], t["post_topics"], t["topics"], t["sentiment"])
    clock = t["posts"].agg(F.max("timestamp").alias("clock")).scalar()
    ranked = trend_plans.ranked_trends(rollup, clock=clock)
    listed = topic_plans.list_topics(t["topics"], ranked)
    return listed.select("topic_id", "post_count", "trend_score", "classification")


@query(
    "j13_run_dataset_names",
    """SELECT doc_id, CASE WHEN n_chars > 500 THEN 'Set ' || source ELSE 'Unknown Dataset' END AS dataset_name FROM documents""",
)
def dataset_names(spark, sf_dir):
    """Runs of a dataset that is gone keep a placeholder; here short documents are such runs."""
    documents = T.table(spark, sf_dir, "documents")
    runs = documents.select("doc_id", F.expr("CASE WHEN n_chars > 500 THEN source END").alias("dataset_id"))
    sets = documents.select("source").distinct().selectExpr("source AS dataset_id", "concat('Set ', source) AS name")
    return dashboard.with_dataset_name(runs, sets).select("doc_id", "dataset_name")
