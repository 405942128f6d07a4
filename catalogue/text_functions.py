"""Text columns over whole documents, pages and conversations."""

from pyspark.sql import functions as F

from catalogue import sqltext as S
from catalogue import views as T
from catalogue.registry import query
from tidewatch import fixed_values as V
from tidewatch.functions import naming
from tidewatch.functions import text as X
from tidewatch.operators import entities, keywords
from tidewatch.operators.duplicates import flag_canonical_duplicates
from tidewatch.plans.preprocess import preprocess, preprocessing_summary
from tidewatch.session import checkpointed


def _joined(column):
    return F.array_join(column, "|")


@query("f3_extract_urls", f"SELECT page_id, {S.distinct_in_order(f'regexp_extract_all(html, {S.quoted(S.URL)})')} AS urls FROM pages")
def urls(spark, sf_dir):
    pages = T.text_table(spark, sf_dir, "pages")
    return pages.select("page_id", _joined(X.extract_urls(F.col("html"))).alias("urls"))


_POSTS = f"WITH {T.DOC_POSTS}"


@query("f4_extract_mentions", f"{_POSTS} SELECT post_id, {S.first_casing(S.mentions('original_text'))} AS mentions FROM doc_posts")
def mentions(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir)
    return posts.select("post_id", _joined(X.extract_mentions(F.col("original_text"))).alias("mentions"))


@query("f5_extract_hashtags", f"{_POSTS} SELECT post_id, {S.first_casing(S.hashtags('original_text'))} AS hashtags FROM doc_posts")
def hashtags(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir)
    return posts.select("post_id", _joined(X.extract_hashtags(F.col("original_text"))).alias("hashtags"))


@query(
    "f6_import_extraction",
    f"""{_POSTS} SELECT post_id,
      array_to_string([lower(x) FOR x IN regexp_extract_all(original_text, {S.quoted(f"#({V.WORD}+)")}, 1)], '|') AS hashtags,
      array_to_string(regexp_extract_all(original_text, {S.quoted(f"@({V.WORD}+)")}, 1), '|') AS mentions,
      array_to_string(regexp_extract_all(original_text, {S.quoted(V.IMPORT_URL)}), '|') AS urls FROM doc_posts""",
)
def import_extraction(spark, sf_dir):
    text = F.col("original_text")
    return T.doc_posts(spark, sf_dir).select(
        "post_id", _joined(X.import_hashtags(text)).alias("hashtags"),
        _joined(X.import_mentions(text)).alias("mentions"), _joined(X.import_urls(text)).alias("urls"),
    )


@query(
    "f8_decode_entities",
    """WITH d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM pages)
    SELECT page_id, md5(t) AS html_md5, length(t) AS n FROM d""",
)
def decode(spark, sf_dir):
    """HTML entities of whole pages, which hold but a few kinds."""
    pages = T.text_table(spark, sf_dir, "pages")
    decoded = X.decode_entities(F.col("html"))
    return pages.select("page_id", F.md5(decoded).alias("html_md5"), F.length(decoded).alias("n"))


@query("f9_collapse_space", f"SELECT conv_id, turn, md5({S.collapse_space('\"text\"')}) AS text_md5 FROM conversations")
def collapse_space(spark, sf_dir):
    talks = T.text_table(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", F.md5(X.collapse_space(F.col("text"))).alias("text_md5"))


@query("f10_collapse_punctuation", f"{_POSTS} SELECT post_id, md5({S.collapse_punctuation('original_text')}) AS text_md5 FROM doc_posts")
def collapse_punctuation(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir)
    return posts.select("post_id", F.md5(X.collapse_punctuation(F.col("original_text"))).alias("text_md5"))


@query("f11_text_hash", f"SELECT doc_id, {S.text_hash('\"text\"')} AS text_hash FROM documents")
def text_hash(spark, sf_dir):
    documents = T.text_table(spark, sf_dir, "documents")
    return documents.select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))


_DECODED = "replace(original_text, '&amp;', '&')"  # the only entity in these texts


@query("f12_sentiment_ready", f"{_POSTS} SELECT post_id, md5({S.sentiment_ready(_DECODED)}) AS text_md5 FROM doc_posts")
def sentiment_ready(spark, sf_dir):
    ready = X.sentiment_ready(X.decode_entities(F.col("original_text")))
    return T.doc_posts(spark, sf_dir).select("post_id", F.md5(ready).alias("text_md5"))


@query("f13_cleaned_text", f"{_POSTS} SELECT post_id, md5({S.cleaned(_DECODED)}) AS text_md5 FROM doc_posts")
def cleaned(spark, sf_dir):
    clean = X.cleaned(X.decode_entities(F.col("original_text")))
    return T.doc_posts(spark, sf_dir).select("post_id", F.md5(clean).alias("text_md5"))


@query("f14_ner_text", f"{_POSTS} SELECT post_id, md5({S.ner_text(_DECODED)}) AS text_md5 FROM doc_posts")
def ner_text(spark, sf_dir):
    text = X.ner_text(X.decode_entities(F.col("original_text")))
    return T.doc_posts(spark, sf_dir).select("post_id", F.md5(text).alias("text_md5"))


_NO_TAGS = S.replace_all("original_text", f"#{V.WORD}+", " ")


@query("m13_text_for_entities", f"""{_POSTS} SELECT post_id, md5({S.ner_text(f"replace({_NO_TAGS}, '&amp;', '&')")}) AS text_md5 FROM doc_posts""")
def tagged_text(spark, sf_dir):
    texts = entities.tagged_text(T.doc_posts(spark, sf_dir))
    return texts.select("post_id", F.md5("text").alias("text_md5"))


@query(
    "f15_preprocessing_meta",
    f"""{_POSTS} SELECT post_id, '1.0.0' AS version, length(original_text) AS char_length_original,
      length({S.cleaned(_DECODED)}) AS char_length_cleaned, {S.text_hash("original_text")} AS text_hash, 'kept' AS origin,
      len(string_split({S.first_casing(S.hashtags("original_text"))}, '|')) AS hashtag_count FROM doc_posts""",
)
def meta(spark, sf_dir):
    """The meta struct merged over an existing map, whose other keys stay."""
    posts = preprocess(T.doc_posts(spark, sf_dir))
    existing = F.create_map(F.lit("origin"), F.lit("kept"), F.lit("version"), F.lit("old"))
    merged = X.merge_meta(existing, F.col("preprocessing_meta"))
    numbers = ("char_length_original", "char_length_cleaned", "hashtag_count")
    return posts.select("post_id", merged.alias("m")).select(
        "post_id", *[F.col(f"m.{n}").cast("bigint").alias(n) for n in numbers],
        F.col("m.version").alias("version"), F.col("m.text_hash").alias("text_hash"),
        F.col("m.origin").alias("origin"),
    )


@query(
    "f28_preferred_text",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN md5("text") WHEN 'user' THEN md5("text") ELSE md5(lower("text")) END AS text_md5
    FROM conversations""",
)
def preferred(spark, sf_dir):
    canonical = F.expr("CASE role WHEN 'system' THEN NULL WHEN 'user' THEN '' ELSE lower(text) END")
    talks = T.text_table(spark, sf_dir, "conversations")
    return talks.select("conv_id", "turn", F.md5(X.preferred_text(canonical, F.col("text"))).alias("text_md5"))


@query(
    "w14_canonical_duplicates",
    f"""SELECT doc_id AS post_id, row_number() OVER (PARTITION BY {S.text_hash('"text"')} ORDER BY ts, doc_id) > 1 AS is_duplicate
    FROM documents JOIN events ON event_id = doc_id""",
)
def duplicates(spark, sf_dir):
    events = T.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"))
    documents = T.text_table(spark, sf_dir, "documents")
    posts = documents.join(events, F.col("event_id") == F.col("doc_id")).select(
        F.col("doc_id").alias("post_id"), F.col("text").alias("original_text"), "timestamp"
    )
    return flag_canonical_duplicates(posts).select("post_id", "is_duplicate")


@query(
    "u2_hashtag_union",
    f"""{_POSTS} SELECT post_id, {S.distinct_in_order(f'list_concat([event_type, lang], string_split({S.first_casing(S.hashtags("original_text"))}, chr(124)))')}
      AS hashtags FROM doc_posts""",
)
def hashtag_union(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir)
    both = X.union_in_order(F.col("hashtags"), X.extract_hashtags(F.col("original_text")))
    return posts.select("post_id", _joined(both).alias("hashtags"))


@query(
    "g5_q2_preprocessing_summary",
    f"""{_POSTS}, tagged AS (SELECT post_id, "timestamp", {S.text_hash("original_text")} AS h,
        len(string_split({S.distinct_in_order(f"regexp_extract_all(original_text, {S.quoted(S.URL)})")}, '|')) AS urls,
        len(string_split({S.first_casing(S.hashtags("original_text"))}, '|')) AS tags,
        len(string_split({S.first_casing(S.mentions("original_text"))}, '|')) AS names FROM doc_posts)
    SELECT count(*) AS posts_processed, count(*) - count(DISTINCT h) AS duplicates_count, CAST(sum(urls) AS BIGINT) AS total_urls,
      CAST(sum(tags) AS BIGINT) AS total_hashtags, CAST(sum(names) AS BIGINT) AS total_mentions, '1.0.0' AS preprocessing_version FROM tagged""",
)
def preprocessing(spark, sf_dir):
    return preprocessing_summary(preprocess(T.doc_posts(spark, sf_dir)))


@query(
    "q2_preprocessed_posts",
    f"""{_POSTS}, dated AS (SELECT *, row_number() OVER (PARTITION BY {S.text_hash("original_text")} ORDER BY "timestamp", post_id) > 1 AS is_duplicate FROM doc_posts)
    SELECT post_id, md5({S.cleaned(_DECODED)}) AS cleaned, md5({S.sentiment_ready(_DECODED)}) AS ready,
      {S.first_casing(S.mentions("original_text"))} AS mentions, is_duplicate FROM dated""",
)
def preprocessed(spark, sf_dir):
    posts = preprocess(T.doc_posts(spark, sf_dir))
    return posts.select(
        "post_id", F.md5("cleaned_text").alias("cleaned"), F.md5("sentiment_ready_text").alias("ready"),
        _joined("mentions").alias("mentions"), "is_duplicate",
    )


@query(
    "f24_topic_names",
    r"""WITH words AS (SELECT item_id, [x FOR x IN string_split_regex(lower("text"), '[^a-z]+') IF x <> ''] AS w FROM benchmark)
    SELECT item_id, 'Topic Of ' || upper(w[1][1]) || w[1][2:] || coalesce(' · ' || (SELECT upper(x[1]) || x[2:] FROM
      (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS i)
      WHERE regexp_replace(x, '(ing|ed|s)$', '') NOT IN ('topic', 'of', regexp_replace(w[1], '(ing|ed|s)$', '')) ORDER BY i LIMIT 1), '') AS topic_name
    FROM words""",
)
def topic_names(spark, sf_dir):
    """Names from the words of whole texts, the first with a prefix of its own."""
    items = T.text_table(spark, sf_dir, "benchmark")
    found = items.select("item_id", F.expr("filter(split(lower(text), '[^a-z]+'), x -> x <> '')").alias("w"))
    phrases = F.concat(F.array(F.concat(F.lit("topic_of "), F.col("w")[0])), F.slice("w", F.lit(2), F.size("w")))
    return found.select("item_id", naming.topic_name(phrases, F.lit(1)).alias("topic_name"))


@query(
    "m1_m2_keywords",
    f"""WITH texts AS (SELECT doc_id AS id, "text" FROM documents), {S.keyword_sql("texts")} SELECT * FROM keywords""",
)
def corpus_keywords(spark, sf_dir):
    return keywords.extract_keywords(T.text_table(spark, sf_dir, "documents").select("text"))


@query(
    "m1_m2_keywords_of_cleaned_posts",
    f"""{_POSTS}, texts AS (SELECT post_id AS id, {S.cleaned(_DECODED)} AS "text" FROM doc_posts),
    {S.keyword_sql("texts", 15, 40)} SELECT * FROM keywords""",
)
def cleaned_keywords(spark, sf_dir):
    clean = X.cleaned(X.decode_entities(F.col("original_text")))
    texts = T.doc_posts(spark, sf_dir).select(clean.alias("text"))
    return keywords.extract_keywords(checkpointed(texts), 15, 40)


def _frequent_sql(table, n):
    return f"""SELECT w AS keyword, 'keyword' AS keyword_type, count(*) AS frequency, CAST(0.1 AS DOUBLE) AS tfidf_score FROM
      (SELECT unnest(string_split_regex("text", {S.quoted(V.SPACE + "+")})) AS w FROM {table}) WHERE length(w) > 3
    GROUP BY w ORDER BY count(*) DESC, w LIMIT {n}"""


@query("m3_frequent_words", _frequent_sql("conversations", 50))
def frequent_words(spark, sf_dir):
    talks = T.text_table(spark, sf_dir, "conversations").select("text")
    return keywords.frequent_words(talks, 50)


@query("m3_frequent_words_counted_twice", _frequent_sql("documents", 20))
def frequent_words_by_small_summaries(spark, sf_dir):
    """So few counters a task that the leaders must be counted a second time."""
    return keywords.frequent_words(T.text_table(spark, sf_dir, "documents").select("text"), 20, 200)


@query(
    "g18_hashtag_totals",
    f"""{_POSTS} SELECT hashtag, count(*) AS frequency FROM
      (SELECT event_type AS hashtag FROM doc_posts UNION ALL SELECT lang FROM doc_posts) GROUP BY hashtag""",
)
def hashtag_totals(spark, sf_dir):
    return keywords.hashtag_counts(T.doc_posts(spark, sf_dir)).select("hashtag", "frequency")
