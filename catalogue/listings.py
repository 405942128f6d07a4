"""Filters, orders, pages and listings."""

from datetime import date, datetime

from pyspark.sql import functions as F

from catalogue import views as T
from catalogue.joins import _tables
from catalogue.registry import query
from catalogue.sqltext import cleaned, keyword_sql, trend_ctes
from tidewatch.functions import text as X
from tidewatch.operators import filters, keywords, topics
from tidewatch.operators import entities as E
from tidewatch.operators.ranking import page
from tidewatch.plans import enrichment, search
from tidewatch.plans import topics as topic_plans
from tidewatch.plans import trends as trend_plans
from tidewatch.session import checkpointed, scratch_path
from tidewatch.sources import post_index
from tidewatch.sources.store import Store

_BASE = f"WITH {T.EVENT_POSTS}, {T.EVENT_SENTIMENT}, {T.EVENT_LINKS}, {T.EVENT_TOPICS}"


def _posts_where(name, condition, build):
    @query(name, f'{_BASE} SELECT post_id, topic_id, "timestamp", sentiment FROM event_posts WHERE {condition}')
    def chosen(spark, sf_dir):
        rows = T.event_posts(spark, sf_dir).where(build())
        return rows.select("post_id", "topic_id", "timestamp", "sentiment")


_posts_where("p8_platform_filter", "platform = 'reddit'", lambda: filters.on_platform("Reddit"))
_posts_where("p9_sentiment_filter", "sentiment = 'positive'", lambda: filters.with_sentiment("Positive"))
_posts_where("p10_topic_filter", "topic_id = 'click'", lambda: filters.with_topic("click"))
_posts_where(
    "p11_date_range",
    "\"timestamp\" >= TIMESTAMP '2024-01-05' AND \"timestamp\" < TIMESTAMP '2024-01-08'",
    lambda: filters.between_dates(date(2024, 1, 5), date(2024, 1, 7)),
)
_posts_where(
    "p11_instant_range",
    "\"timestamp\" BETWEEN TIMESTAMP '2024-01-05 06:30:00' AND TIMESTAMP '2024-01-09 18:00:00'",
    lambda: filters.between_dates(datetime(2024, 1, 5, 6, 30), datetime(2024, 1, 9, 18)),
)


@query("p12_keyword_match", """SELECT doc_id FROM documents WHERE contains(lower("text"), 'ing% of') OR contains(lower("text"), 'the and')""")
def keyword_match(spark, sf_dir):
    """A percent sign is a character like any other."""
    documents = T.text_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("original_text"), F.lit(None).cast("string").alias("cleaned_text")
    )
    found = filters.containing("ING% of ") | filters.containing(" The and ")
    return documents.where(found).select("doc_id")


@query("p13_topic_text_filter", f"{_BASE} SELECT topic_id FROM event_topics WHERE contains(lower(display_name || ' ' || words), 'se web p')")
def topic_text(spark, sf_dir):
    return T.event_topics(spark, sf_dir).where(filters.topic_matches("SE Web P")).select("topic_id")


@query("p15_non_outlier_links", f"{_BASE} SELECT post_id, topic_id FROM event_links JOIN event_topics USING (topic_id) WHERE NOT is_outlier")
def non_outliers(spark, sf_dir):
    t = _tables(spark, sf_dir)
    kept = t["topics"].where(filters.not_outlier()).select("topic_id")
    return t["post_topics"].join(kept, "topic_id", "left_semi").select("post_id", "topic_id")


@query(
    "p16_completed_runs",
    """SELECT source || '/' || lang AS analysis_run_id, count(*) AS posts FROM documents WHERE source || '/' || lang = 'src1/en' GROUP BY 1""",
)
def completed_run(spark, sf_dir):
    from catalogue.ingestion import _runs

    runs = _runs(spark, sf_dir)
    run = filters.resolve_run(runs, "src1/en", "src1")
    return runs.where(F.col("analysis_run_id") == run["analysis_run_id"]).select("analysis_run_id", "posts")


_MENTIONS = f"WITH {T.EVENT_MENTIONS}, {T.EVENT_ENTITIES}"


@query(
    "p17_o3_q11_entities_of_a_label",
    f"""{_MENTIONS} SELECT entity_id, "text", label, frequency FROM event_entities WHERE label = 'ORG' ORDER BY frequency DESC, normalized_text LIMIT 7""",
)
def entities_of_label(spark, sf_dir):
    listed = enrichment.list_entities(T.event_entities(spark, sf_dir), "org", 7)
    return listed.select("entity_id", "text", "label", "frequency")


@query("o8_top_mentions", f"""{_MENTIONS} SELECT "text", label, count(*) AS frequency FROM (SELECT e."text", e.label FROM event_mentions m
  JOIN event_entities e USING (entity_id)) GROUP BY ALL ORDER BY frequency DESC, "text", label LIMIT 20""")
def top_mentions(spark, sf_dir):
    posts = T.event_posts(spark, sf_dir)
    counts = E.mention_counts(T.event_entities(spark, sf_dir), T.event_mentions(spark, sf_dir), posts)
    return topic_plans.top_mentions(counts, 20).select("text", "label", "frequency")


_DECODED = "replace(original_text, '&amp;', '&')"
_TERMS = f"""WITH {T.DOC_POSTS}, texts AS (SELECT post_id AS id, {cleaned(_DECODED)} AS "text" FROM doc_posts), {keyword_sql("texts")},
tags AS (SELECT hashtag, count(*) AS frequency FROM (SELECT event_type AS hashtag FROM doc_posts UNION ALL SELECT lang FROM doc_posts) GROUP BY 1),
terms AS (SELECT keyword, keyword_type, frequency, tfidf_score FROM keywords UNION ALL SELECT hashtag, 'hashtag', frequency, NULL FROM tags)"""


def _terms(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir)
    texts = posts.select(X.cleaned(X.decode_entities(F.col("original_text"))).alias("text"))
    found = keywords.extract_keywords(checkpointed(texts))
    return keywords.keyword_table(found, keywords.hashtag_counts(posts))


@query("u1_keyword_table", f"{_TERMS} SELECT * FROM terms")
def keyword_table(spark, sf_dir):
    return _terms(spark, sf_dir).select("keyword", "keyword_type", "frequency", "tfidf_score")


@query(
    "p18_o4_q11_keyword_listing",
    f"{_TERMS} SELECT keyword, frequency, tfidf_score FROM terms WHERE keyword_type IN ('keyword', 'ngram') ORDER BY tfidf_score DESC, keyword LIMIT 12",
)
def keyword_listing(spark, sf_dir):
    return enrichment.list_keywords(_terms(spark, sf_dir), 12).select("keyword", "frequency", "tfidf_score")


@query(
    "p18_o4_q11_hashtag_listing",
    f"{_TERMS} SELECT keyword AS hashtag, frequency FROM terms WHERE keyword_type = 'hashtag' ORDER BY frequency DESC, keyword LIMIT 5",
)
def hashtag_listing(spark, sf_dir):
    return enrichment.list_hashtags(_terms(spark, sf_dir), 5).select("hashtag", "frequency")


_SEARCH = f"WITH {T.DOC_POSTS}, {T.DOC_TRUTH}, texts AS (SELECT *, {cleaned(_DECODED)} AS cleaned_text FROM doc_posts)"
_MATCH = """platform IN ('src1') AND "timestamp" >= TIMESTAMP '2024-01-01 02:00:00'
  AND (contains(lower(original_text), 'the ') OR contains(cleaned_text, 'the '))"""


def _search_tables(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir)
    return {
        "posts": posts.withColumn("cleaned_text", X.cleaned(X.decode_entities(F.col("original_text")))),
        "sentiment": T.doc_truth(spark, sf_dir).withColumnRenamed("truth", "label"),
        "post_topics": posts.select("post_id", F.col("lang").alias("topic_id")),
    }


_CRITERIA = {"query": "The ", "platform": "SRC1", "date_from": datetime(2024, 1, 1, 2)}


@query(
    "q8_o5_search_page",
    f"""{_SEARCH} SELECT p.post_id, p."timestamp", md5(original_text) AS text_md5, truth AS sentiment, 'Language ' || lang AS topic_name
    FROM texts p LEFT JOIN doc_truth t ON t.post_id = p.post_id WHERE {_MATCH.replace("'the '", "'the'")} ORDER BY p."timestamp" DESC, p.post_id LIMIT 20 OFFSET 5""",
)
def search_page(spark, sf_dir):
    t = _search_tables(spark, sf_dir)
    names = t["post_topics"].select("topic_id").distinct().select(
        "topic_id", F.concat(F.lit("Language "), F.col("topic_id")).alias("display_name")
    )
    found = search.search_posts(
        t["posts"], t["sentiment"], t["post_topics"], names, 20, 5, **_CRITERIA
    )
    return found.select(
        "post_id", "timestamp", F.md5("original_text").alias("text_md5"), "sentiment", "topic_name"
    )


@query(
    "q8_g26_search_total",
    f"""{_SEARCH} SELECT count(*) AS total FROM texts p JOIN doc_truth t ON t.post_id = p.post_id
    WHERE {_MATCH.replace("'the '", "'the'")} AND truth = 'positive' AND lang = 'en'""",
)
def search_total(spark, sf_dir):
    t = _search_tables(spark, sf_dir)
    return search.search_total(
        t["posts"], t["sentiment"], t["post_topics"], label="Positive", topic_id="en", **_CRITERIA
    )


def _indexed_posts(spark, sf_dir):
    """Document posts in a new store, their files cut by time and indexed."""
    workspace = Store(spark, scratch_path(spark, "indexed"))
    posts = T.doc_posts(spark, sf_dir).withColumn("cleaned_text", F.lit(None).cast("string"))
    workspace.replace(post_index.POSTS, posts.repartitionByRange("timestamp", "post_id"), "documents")
    post_index.build(workspace, "documents")
    return workspace


@query(
    "p12_q8_indexed_search",
    f"""WITH {T.DOC_POSTS} SELECT post_id, md5(original_text) AS text_md5 FROM doc_posts
    WHERE contains(lower(original_text), 'the and') OR contains(lower(original_text), 'https://ex.com/p/17 ')""",
)
def indexed_search(spark, sf_dir):
    """Two searches that read only files with all trigrams of the query."""
    workspace = _indexed_posts(spark, sf_dir)
    found = None
    for text in ("The and", "HTTPS://ex.com/p/17 &amp"):
        posts = post_index.select_posts(workspace, "documents", text).posts.where(filters.containing(text))
        found = posts if found is None else found.unionByName(posts)
    return found.select("post_id", F.md5("original_text").alias("text_md5")).distinct()


@query(
    "o5_deep_page",
    f"""WITH {T.DOC_POSTS} SELECT post_id, "timestamp", md5(original_text) AS text_md5 FROM doc_posts
    ORDER BY "timestamp" DESC, post_id LIMIT 60 OFFSET 130""",
)
def deep_page(spark, sf_dir):
    """A page far from the start, from the files that can overlap it."""
    found = post_index.select_posts(_indexed_posts(spark, sf_dir), "documents", limit=60, offset=130)
    chosen = page(found.posts, [F.desc("timestamp"), F.col("post_id")], 60, found.offset)
    return chosen.select("post_id", "timestamp", F.md5("original_text").alias("text_md5"))


def _ranked(spark, sf_dir, window="hourly", platform=None):
    t = _tables(spark, sf_dir)
    rollup = trend_plans.run_rollup(t["posts"], t["post_topics"], t["topics"], t["sentiment"])
    clock = t["posts"].agg(F.max("timestamp").alias("clock")).scalar()
    return t["topics"], trend_plans.ranked_trends(rollup, window, platform, clock)


_RANKED = f"""WITH {T.EVENT_POSTS}, {T.EVENT_TOPICS}, run_posts AS (SELECT * FROM event_posts WHERE topic_id <> 'error'),
{{ctes}}, listed AS (SELECT t.*, s.trend_score, s.classification FROM event_topics t {{how}} JOIN snapshots s ON s.topic_id = t.topic_id AND s.is_latest)"""


@query(
    "q9_p14_topics_of_a_class",
    _RANKED.format(ctes=trend_ctes("run_posts", "hourly", clock_source="event_posts"), how="")
    + " SELECT topic_id, post_count, trend_score FROM listed WHERE classification = 'stable'",
)
def topics_of_class(spark, sf_dir):
    found, ranked = _ranked(spark, sf_dir)
    return topic_plans.list_topics(found, ranked, "stable").select("topic_id", "post_count", "trend_score")


@query(
    "q9_topics_on_a_platform",
    _RANKED.format(ctes=trend_ctes("run_posts", "daily", "platform = 'twitter'", clock_source="event_posts"), how="")
    + " SELECT topic_id, post_count, trend_score, classification FROM listed WHERE contains(lower(display_name || ' ' || words), 'i')",
)
def topics_on_platform(spark, sf_dir):
    found, ranked = _ranked(spark, sf_dir, "daily", "twitter")
    listed = topic_plans.list_topics(found, ranked, None, "I", "twitter")
    return listed.select("topic_id", "post_count", "trend_score", "classification")


@query(
    "q9_g24_topic_list_totals",
    _RANKED.format(ctes=trend_ctes("run_posts", "daily", clock_source="event_posts"), how="LEFT")
    + """ SELECT count(*) FILTER (NOT is_outlier) AS total_topics,
      (SELECT CAST(sum(post_count) AS BIGINT) FROM event_topics WHERE is_outlier) AS outlier_count FROM listed""",
)
def topic_totals(spark, sf_dir):
    found, ranked = _ranked(spark, sf_dir, "daily")
    return topic_plans.topic_list_totals(topic_plans.list_topics(found, ranked), found)


@query("o6_topics_by_size", f"{_BASE} SELECT topic_id, post_count FROM event_topics ORDER BY post_count DESC, topic_id LIMIT 3")
def topics_by_size(spark, sf_dir):
    found = T.event_topics(spark, sf_dir).select("topic_id", "post_count")
    return page(found, [F.desc("post_count"), F.col("topic_id")], 3)


@query(
    "o7_topic_sample",
    f"""{_BASE} SELECT p.post_id, p."timestamp", l.probability FROM event_posts p JOIN event_links l USING (post_id)
    WHERE l.topic_id = 'signup' ORDER BY probability DESC, "timestamp" DESC, post_id LIMIT 10""",
)
def topic_sample(spark, sf_dir):
    t = _tables(spark, sf_dir)
    posts = t["posts"].withColumn("original_text", F.lit(""))
    rows = topic_plans.topic_posts(posts, t["post_topics"], t["sentiment"], "signup")
    return topic_plans.sample_posts(rows).select("post_id", "timestamp", "probability")


@query(
    "o9_topic_keywords",
    f"""WITH {T.DOC_POSTS}, texts AS (SELECT post_id AS id, original_text AS "text" FROM doc_posts WHERE lang = 'en'),
    {keyword_sql("texts", 15)} SELECT * FROM keywords""",
)
def topic_keywords(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir).where("lang = 'en'")
    return keywords.extract_keywords(posts.select(F.col("original_text").alias("text")), 15)


@query(
    "w15_representative_posts",
    f"""{_BASE} SELECT topic_id AS topic_index, n AS rank, post_id FROM (SELECT l.topic_id, l.post_id,
      row_number() OVER (PARTITION BY l.topic_id ORDER BY probability DESC, "timestamp", l.post_id) AS n
      FROM event_links l JOIN event_posts p USING (post_id)) WHERE n <= 5""",
)
def representatives(spark, sf_dir):
    t = _tables(spark, sf_dir)
    rows = t["post_topics"].join(t["posts"].select("post_id", "timestamp"), "post_id")
    found = topics.representatives(rows.withColumnRenamed("topic_id", "topic_index"))
    return found.select("topic_index", F.col("rank").cast("bigint").alias("rank"), "post_id")


@query(
    "w16_distinct_names",
    f"""{_BASE}, named AS (SELECT topic_id, CASE WHEN topic_id IN ('view', 'click') THEN 'Web' ELSE 'Shop ' || is_outlier END AS name FROM event_topics)
    SELECT topic_id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' · ' || upper(topic_id[1]) || topic_id[2:] ELSE name END
      AS display_name FROM named""",
)
def names(spark, sf_dir):
    """Topics that share a name get their first keyword appended."""
    shared = F.expr(
        "CASE WHEN topic_id IN ('view', 'click') THEN 'Web' ELSE concat('Shop ', is_outlier) END"
    )
    found = T.event_topics(spark, sf_dir).withColumn("display_name", shared)
    return topics.distinct_names(found).select("topic_id", "display_name")
