"""Summaries over posts, predictions, topics and entities."""

from pyspark.sql import functions as F

from catalogue import views as T
from catalogue.registry import query
from catalogue.sqltext import rounded
from tidewatch import fixed_values as V
from tidewatch.operators import entities as E
from tidewatch.operators import evaluation, sentiment, topics
from tidewatch.plans import dashboard
from tidewatch.plans import topics as topic_plans

_LABELS = V.SENTIMENTS
_EVENTS = f"WITH {T.EVENT_POSTS}, {T.EVENT_SENTIMENT}"


@query(
    "g6_sentiment_statistics",
    f"""{_EVENTS} SELECT count(*) AS total_posts,
      {', '.join(f"count(*) FILTER (label = '{s}') AS {s}_count" for s in _LABELS)},
      {', '.join(rounded(f"count(*) FILTER (label = '{s}') / count(*)", 4) + f" AS {s}_pct" for s in _LABELS)} FROM event_sentiment""",
)
def statistics(spark, sf_dir):
    return sentiment.sentiment_statistics(T.event_sentiment(spark, sf_dir))


@query(
    "g7_sentiment_breakdown",
    f"""{_EVENTS} SELECT l.label, count(e.post_id) AS count,
      {rounded("count(e.post_id) / (SELECT count(*) FROM event_sentiment) * 100", 1)} AS percentage
    FROM (VALUES ('positive'), ('neutral'), ('negative')) AS l(label) LEFT JOIN event_sentiment e ON e.label = l.label GROUP BY l.label""",
)
def breakdown(spark, sf_dir):
    return sentiment.sentiment_breakdown(T.event_sentiment(spark, sf_dir))


@query("g8_platform_breakdown", f"WITH {T.EVENT_POSTS} SELECT lower(coalesce(platform, 'other')) AS platform, count(*) AS posts FROM event_posts GROUP BY 1")
def platforms(spark, sf_dir):
    return dashboard.platform_breakdown(T.event_posts(spark, sf_dir))


def _topic_rows(spark, sf_dir):
    posts = T.event_posts(spark, sf_dir).drop("topic_id", "sentiment")
    labels = T.event_sentiment(spark, sf_dir).withColumnRenamed("label", "sentiment")
    links = T.event_links(spark, sf_dir).select("post_id", "topic_id")
    return posts.join(links, "post_id").join(labels, "post_id", "left")


def _percent(label):
    return rounded(f"coalesce(count(*) FILTER (sentiment = '{label}') * 100 / nullif(count(sentiment), 0), 0)", 2) + f" AS {label}_pct"


@query(
    "g13_topic_sentiment_distribution",
    f"WITH {T.EVENT_POSTS} SELECT topic_id, {', '.join(_percent(s) for s in _LABELS)} FROM event_posts GROUP BY topic_id",
)
def topic_sentiment(spark, sf_dir):
    return topic_plans.sentiment_distribution(_topic_rows(spark, sf_dir), ("topic_id",))


@query(
    "g14_topic_average_engagement",
    f"""WITH {T.EVENT_POSTS} SELECT topic_id, {', '.join(rounded(f"avg({f})", 2) + f" AS avg_{f}" for f in V.ENGAGEMENT_FIELDS)}
    FROM event_posts GROUP BY topic_id""",
)
def engagement(spark, sf_dir):
    return topic_plans.average_engagement(_topic_rows(spark, sf_dir), ("topic_id",))


_MENTIONS = f"WITH {T.EVENT_MENTIONS}, {T.EVENT_ENTITIES}"


@query("g15_entity_frequencies", f'{_MENTIONS} SELECT normalized_text, label, "text", frequency FROM event_entities')
def entity_frequencies(spark, sf_dir):
    return E.entity_table(T.event_mentions(spark, sf_dir))


@query("g16_entity_totals_by_label", f"{_MENTIONS} SELECT label, CAST(sum(frequency) AS BIGINT) AS frequency FROM event_entities GROUP BY label")
def totals_by_label(spark, sf_dir):
    return E.totals_by_label(T.event_entities(spark, sf_dir))


@query(
    "g17_j6_j7_entities_of_posts",
    f"""{_MENTIONS}, {T.EVENT_POSTS} SELECT entity_id, e."text", e.label, count(*) AS frequency
    FROM event_mentions m JOIN event_entities e USING (entity_id) WHERE m.post_id IN (SELECT post_id FROM event_posts WHERE platform = 'twitter')
    GROUP BY ALL""",
)
def mention_counts(spark, sf_dir):
    posts = T.event_posts(spark, sf_dir).where("platform = 'twitter'")
    return E.mention_counts(T.event_entities(spark, sf_dir), T.event_mentions(spark, sf_dir), posts)


_TOPICS = f"WITH {T.EVENT_TOPICS}"


@query(
    "g20_topic_statistics",
    f"""{_TOPICS} SELECT count(*) FILTER (NOT is_outlier) AS total_topics,
      CAST(coalesce(sum(post_count) FILTER (is_outlier), 0) AS BIGINT) AS outlier_count, count(*) AS discovered_count FROM event_topics""",
)
def topic_statistics(spark, sf_dir):
    return topics.topic_statistics(T.event_topics(spark, sf_dir))


@query("g23_topic_post_counts", f"WITH {T.EVENT_POSTS} SELECT topic_id, count(*) AS post_count FROM event_posts WHERE platform = 'reddit' GROUP BY 1")
def post_counts(spark, sf_dir):
    rows = _topic_rows(spark, sf_dir).where("platform = 'reddit'")
    return rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("post_count"))


_PREDICTIONS = f"WITH {T.DOC_PREDICTIONS}, pairs AS (SELECT truth, label FROM doc_predictions WHERE truth IS NOT NULL)"
_CLASS = """, classes AS (SELECT l.label, count(*) FILTER (p.truth = l.label AND p.label = l.label) AS hits,
  count(*) FILTER (p.label = l.label) AS predicted, count(*) FILTER (p.truth = l.label) AS support
  FROM pairs p, (VALUES ('negative'), ('neutral'), ('positive')) AS l(label) GROUP BY l.label),
scores AS (SELECT label, coalesce(hits / nullif(predicted, 0), 0.0) AS p, coalesce(hits / nullif(support, 0), 0.0) AS r,
  coalesce(2 * hits / nullif(predicted + support, 0), 0.0) AS f1, support FROM classes)"""


@query(
    "g25_evaluation_summary",
    f"""{_PREDICTIONS}{_CLASS} SELECT {rounded("(SELECT count(*) FILTER (truth = label) / count(*) FROM pairs)", 4)} AS accuracy,
      {rounded("avg(f1)", 4)} AS macro_f1, {rounded("sum(f1 * support) / sum(support)", 4)} AS weighted_f1,
      (SELECT count(*) FROM pairs) AS sample_count FROM scores""",
)
def evaluate(spark, sf_dir):
    return evaluation.evaluation_summary(T.doc_predictions(spark, sf_dir))


@query(
    "g25_class_scores",
    f"""{_PREDICTIONS}{_CLASS} SELECT label, {rounded("p", 4)} AS "precision", {rounded("r", 4)} AS recall, {rounded("f1", 4)} AS f1, support FROM scores""",
)
def class_scores(spark, sf_dir):
    return evaluation.class_scores(T.doc_predictions(spark, sf_dir))


@query(
    "g25_confusion_matrix",
    f"""{_PREDICTIONS} SELECT t.label AS truth, q.label AS predicted, (SELECT count(*) FROM pairs p WHERE p.truth = t.label AND p.label = q.label) AS "rows"
    FROM (VALUES ('negative'), ('neutral'), ('positive')) AS t(label), (VALUES ('negative'), ('neutral'), ('positive')) AS q(label)""",
)
def matrix(spark, sf_dir):
    return evaluation.confusion_matrix(T.doc_predictions(spark, sf_dir))


@query(
    "f26_label_choice",
    f"""WITH s AS (SELECT event_id AS post_id, value / 500 AS p, CAST(json_extract_string(props, '$.k') AS INT) / 100 AS n, 0.5 AS u FROM events)
    SELECT post_id, CASE WHEN p >= greatest(n, u) THEN 'positive' WHEN u >= n THEN 'neutral' ELSE 'negative' END AS label,
      {rounded("greatest(p, n, u)", 4)} AS confidence, {rounded("p", 4)} AS score_positive, {rounded("u", 4)} AS score_neutral,
      {rounded("n", 4)} AS score_negative FROM s""",
)
def label_choice(spark, sf_dir):
    scores = T.table(spark, sf_dir, "events").selectExpr(
        "event_id AS post_id", "value / 500 AS positive", "0.5D AS neutral",
        "CAST(get_json_object(props, '$.k') AS INT) / 100 AS negative",
    )
    return sentiment.choose_label(scores)
