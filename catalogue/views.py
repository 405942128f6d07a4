"""Post tables derived from the driver's tables, for Spark and as SQL common table expressions.

`events` serves as posts with topics, sentiment and entities; `documents`, dated by the event of
the same number, as posts with text. All rows and whole texts take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, which comes as one row group, spread over tasks by its first column."""
    rows = table(spark, sf_dir, name)
    return rows.repartition(F.col(rows.columns[0]))


# --- events as posts ---
_K = "CAST(get_json_object(props, '$.k') AS INT)"
_K_SQL = "CAST(json_extract_string(props, '$.k') AS INT)"
_PLATFORM = (
    "CASE WHEN value < 2 THEN NULL WHEN user_id % 3 = 0 THEN 'twitter' "
    "WHEN user_id % 3 = 1 THEN 'reddit' ELSE 'instagram' END"
)
_LIKES = "CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END"


def _sentiment(k: str) -> str:
    return (
        f"CASE WHEN value < 5 THEN NULL WHEN {k} % 3 = 0 THEN 'negative' "
        f"WHEN {k} % 3 = 1 THEN 'neutral' ELSE 'positive' END"
    )


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS post_id",
        "event_type AS topic_id",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        f"{_PLATFORM} AS platform",
        f"{_LIKES} AS likes",
        f"{_K} AS comments",
        "CAST(NULL AS INT) AS shares",
        f"{_sentiment(_K)} AS sentiment",
    )


EVENT_POSTS = f"""event_posts AS (
  SELECT event_id AS post_id, event_type AS topic_id, ts AS "timestamp", {_PLATFORM} AS platform,
    {_LIKES} AS likes, {_K_SQL} AS comments, CAST(NULL AS INT) AS shares,
    {_sentiment(_K_SQL)} AS sentiment
  FROM events)"""


def event_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = event_posts(spark, sf_dir).where("sentiment IS NOT NULL")
    return scored.select("post_id", F.col("sentiment").alias("label"))


EVENT_SENTIMENT = """event_sentiment AS (
  SELECT post_id, sentiment AS label FROM event_posts WHERE sentiment IS NOT NULL)"""


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS post_id", "event_type AS topic_id", "value / 500 AS probability"
    )


EVENT_LINKS = """event_links AS (
  SELECT event_id AS post_id, event_type AS topic_id, value / 500 AS probability FROM events)"""


def event_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic per event type; errors play the outliers."""
    counted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("post_count"))
    return counted.selectExpr(
        "event_type AS topic_id",
        "concat('About ', event_type) AS display_name",
        "array(named_struct('word', event_type, 'score', 0.5D),"
        " named_struct('word', 'Web Page', 'score', 0.25D)) AS keywords",
        "post_count",
        "event_type = 'error' AS is_outlier",
    )


EVENT_TOPICS = """event_topics AS (
  SELECT event_type AS topic_id, 'About ' || event_type AS display_name,
    event_type || ' Web Page' AS words, count(*) AS post_count, event_type = 'error' AS is_outlier
  FROM events GROUP BY event_type)"""


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention per event: its name cycles with the event's number, its label with the user's."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS post_id",
        f"CASE WHEN value > 250 THEN upper(concat(event_type, ' ', {_K} % 4))"
        f" ELSE concat(event_type, ' ', {_K} % 4) END AS text",
        f"concat(event_type, ' ', {_K} % 4) AS normalized_text",
        "CASE WHEN user_id % 2 = 0 THEN 'ORG' ELSE 'GPE' END AS label",
        f"{_K} AS start_char",
        "CAST(ts AS TIMESTAMP) AS timestamp",
    ).withColumn("entity_id", F.concat_ws("/", "label", "normalized_text"))


EVENT_MENTIONS = f"""event_mentions AS (
  SELECT *, label || '/' || normalized_text AS entity_id FROM (
    SELECT event_id AS post_id,
      CASE WHEN value > 250 THEN upper(event_type || ' ' || ({_K_SQL} % 4))
        ELSE event_type || ' ' || ({_K_SQL} % 4) END AS "text",
      event_type || ' ' || ({_K_SQL} % 4) AS normalized_text,
      CASE WHEN user_id % 2 = 0 THEN 'ORG' ELSE 'GPE' END AS label,
      {_K_SQL} AS start_char, ts AS "timestamp"
    FROM events))"""


def event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.entities import entity_table

    entities = entity_table(event_mentions(spark, sf_dir))
    return entities.withColumn("entity_id", F.concat_ws("/", "label", "normalized_text"))


EVENT_ENTITIES = """event_entities AS (
  SELECT entity_id, normalized_text, label, "text", frequency FROM (
    SELECT *, count(*) OVER (PARTITION BY entity_id) AS frequency,
      row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp", post_id, start_char) AS n
    FROM event_mentions) WHERE n = 1)"""


# --- documents as posts ---
#: What stands for the event of a document that has none of its number.
_NO_EVENT = {"event_type": "'view'", "user_id": "0", "ts": "TIMESTAMP '2024-01-01 00:00:00'", "value": "0.0"}
_FILLED = ", ".join(f"coalesce({c}, {v}) AS {c}" for c, v in _NO_EVENT.items())
EVENTED = f'(SELECT documents.*, {_FILLED} FROM documents LEFT JOIN events ON event_id = doc_id) AS documents'


def _with_events(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Every document with the event of its number, or with fixed values where there is none."""
    kinds = dict(events.dtypes)
    filled = {c: F.coalesce(F.col(c), F.expr(v).cast(kinds[c])) for c, v in _NO_EVENT.items()}
    return documents.join(events, F.col("event_id") == F.col("doc_id"), "left").withColumns(filled)


def doc_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with the markers of social posts appended."""
    documents = text_table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts", "value")
    joined = _with_events(documents, events)
    return joined.selectExpr(
        "doc_id AS post_id",
        "concat(text, ' #', upper(event_type), ' #', event_type, ' @user', user_id,"
        " ' https://ex.com/p/', doc_id % 50, ' &amp; !!!!') AS original_text",
        "CAST(ts AS TIMESTAMP) AS timestamp",
        "source AS platform",
        "CAST(floor(value) AS INT) AS likes",
        "CAST(NULL AS INT) AS comments",
        "CAST(NULL AS INT) AS shares",
        "lang",
        "event_type",
        "array(event_type, lang) AS hashtags",
    )


DOC_POSTS = f"""doc_posts AS (
  SELECT doc_id AS post_id,
    concat("text", ' #', upper(event_type), ' #', event_type, ' @user', user_id,
      ' https://ex.com/p/', doc_id % 50, ' &amp; !!!!') AS original_text,
    ts AS "timestamp", source AS platform, CAST(floor(value) AS INT) AS likes, lang, event_type
  FROM {EVENTED})"""


def doc_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id AS post_id",
        "CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END"
        " AS truth",
    )


DOC_TRUTH = """doc_truth AS (
  SELECT doc_id AS post_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
    ELSE 'neutral' END AS truth
  FROM labels)"""


def doc_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language read as a predicted label, against the truth."""
    guessed = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS post_id",
        "CASE lang WHEN 'en' THEN 'Positive' WHEN 'de' THEN 'neutral' ELSE 'negative' END AS label",
    )
    return guessed.join(doc_truth(spark, sf_dir), "post_id", "left")


DOC_PREDICTIONS = (
    DOC_TRUTH
    + """, doc_predictions AS (
  SELECT doc_id AS post_id, truth,
    CASE lang WHEN 'en' THEN 'positive' WHEN 'de' THEN 'neutral' ELSE 'negative' END AS label
  FROM documents LEFT JOIN doc_truth ON post_id = doc_id)"""
)


# --- a staged upload: all strings, with the faults an import meets ---
_BODY = (
    "CASE WHEN event_type = 'error' AND value < 100 THEN '' "
    "WHEN event_type = 'click' AND value < 60 THEN ' ab ' "
    "ELSE concat(text, ' #', upper(event_type), ' #new @user', user_id, ' https://ex.com/a|b') END"
)
_RAW_LIKES = (
    "CASE event_type WHEN 'view' THEN CAST(CAST(floor(value) AS INT) AS {s}) "
    "WHEN 'click' THEN CAST(value AS {s}) WHEN 'signup' THEN '-3' "
    "WHEN 'purchase' THEN concat(CAST(floor(value) AS INT), 'd') ELSE ' 7.0 ' END"
)
_TAGS = (
    "CASE WHEN value < 250 THEN concat('#Alpha, beta|', upper(lang), '; ;#') ELSE '' END"
)


def _when(iso: str, blank: str, seconds: str, slashes: str, day: str) -> str:
    return (
        f"CASE event_type WHEN 'view' THEN {iso} WHEN 'click' THEN {blank} "
        f"WHEN 'signup' THEN {seconds} WHEN 'purchase' THEN {slashes} "
        f"ELSE CASE WHEN value < 200 THEN 'not-a-date' WHEN value < 300 THEN '  ' ELSE {day} END END"
    )


def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = text_table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    joined = _with_events(documents, events)
    when = _when(
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
        "CAST(unix_seconds(ts) AS STRING)",
        "date_format(ts, 'MM/dd/yyyy HH:mm')",
        "date_format(ts, 'dd.MM.yyyy')",
    )
    return joined.selectExpr(
        "'documents' AS source_file",
        "doc_id AS row_index",
        f"{_BODY} AS body",
        f"{when} AS created_at",
        "concat(' ', upper(source), ' ') AS network",
        f"{_RAW_LIKES.format(s='STRING')} AS likes",
        f"{_TAGS} AS tags",
        "lang AS username",
    )


STAGED = f"""staged AS (
  SELECT doc_id AS row_index, {_BODY} AS body,
    {_when("strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", "strftime(ts, '%Y-%m-%d %H:%M:%S')",
           "CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)", "strftime(ts, '%m/%d/%Y %H:%M')",
           "strftime(ts, '%d.%m.%Y')")} AS created_at,
    concat(' ', upper(source), ' ') AS network, {_RAW_LIKES.format(s="VARCHAR")} AS likes,
    {_TAGS} AS tags, lang AS username,
    CASE event_type WHEN 'view' THEN date_trunc('second', ts) WHEN 'click' THEN date_trunc('second', ts)
      WHEN 'signup' THEN date_trunc('second', ts) WHEN 'purchase' THEN date_trunc('minute', ts)
      ELSE CASE WHEN value < 300 THEN NULL ELSE CAST(date_trunc('day', ts) AS TIMESTAMP) END END AS parsed
  FROM {EVENTED}),
checked AS (
  SELECT *, length(trim(body)) < 3 AS bad_text, trim(created_at) = '' AS no_time,
    trim(created_at) <> '' AND parsed IS NULL AS bad_time,
    length(trim(body)) >= 3 AND parsed IS NOT NULL AS is_valid
  FROM staged),
flagged AS (
  SELECT *, is_valid AND row_number() OVER (PARTITION BY is_valid, md5(trim(body, E' \\n')) ORDER BY row_index) > 1
    AS is_duplicate
  FROM checked)"""

MAPPING = {
    "text": "body",
    "timestamp": "created_at",
    "platform": "network",
    "hashtags": "tags",
    "likes": "likes",
    "author_id": "username",
}
