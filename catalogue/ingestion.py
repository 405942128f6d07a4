"""Scans, sinks, listings of stored tables, mapping, validation and normalisation."""

from pyspark.sql import functions as F

from catalogue import views as T
from catalogue.registry import query
from catalogue.sqltext import quoted, strip
from tidewatch import fixed_values as V
from tidewatch.functions import text as X
from tidewatch.functions import timestamps as TS
from tidewatch.operators import columns, normalize, validation
from tidewatch.plans import ingest
from tidewatch.plans.preprocess import preprocess
from tidewatch.session import scratch_path
from tidewatch.sources import csv_scan, store

_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "quoteAll": True,
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _documents_as_csv(spark, sf_dir, encoding, **scan):
    path = f"{scratch_path(spark, 'upload')}/documents.csv"
    documents = T.text_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    documents.write.options(**_CSV, encoding=encoding).csv(path)
    return csv_scan.scan_csv(spark, path, **scan)


_DOCUMENT_ROWS = """SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5("text") AS text_md5, length("text") AS n,
  lang, source FROM documents"""


def _document_rows(staged, *more):
    return staged.select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"), "lang", "source", *more
    )


@query("s1_s3_csv_scan", _DOCUMENT_ROWS)
def csv_round_trip(spark, sf_dir):
    """The documents written as CSV by Spark and scanned back, newlines and quotes included."""
    return _document_rows(_documents_as_csv(spark, sf_dir, "UTF-8"))


@query("s2_encoding_fallback", _DOCUMENT_ROWS)
def csv_latin(spark, sf_dir):
    """The same through a file that is not UTF-8."""
    return _document_rows(_documents_as_csv(spark, sf_dir, "ISO-8859-1"))


@query(
    "s1_s3_csv_in_blocks",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5("text") AS text_md5, length("text") AS n, lang, source, true AS gapless FROM documents""",
)
def csv_in_blocks(spark, sf_dir):
    """The same with every file read in blocks; row numbers must have no gaps within a file."""
    staged = _documents_as_csv(spark, sf_dir, "UTF-8", split_bytes=0)
    counted = staged.groupBy("source_file").agg(
        ((F.count(F.lit(1)) == F.count_distinct("row_index")) & (F.min("row_index") == 0) & (F.max("row_index") == F.count(F.lit(1)) - 1)).alias("gapless")
    )
    return _document_rows(staged.join(counted, "source_file"), "gapless")


@query("s4_raw_preview", 'SELECT CAST(doc_id AS VARCHAR) AS doc_id, "text", lang, source FROM documents ORDER BY documents.doc_id LIMIT 20')
def raw_preview(spark, sf_dir):
    """The first rows of the scanned upload, in the order of their ids."""
    staged = _documents_as_csv(spark, sf_dir, "UTF-8").select("doc_id", "text", "lang", "source")
    return csv_scan.preview(staged.orderBy(F.col("doc_id").cast("bigint")), 20)


@query(
    "s5_posts_preview",
    f"""WITH {T.DOC_POSTS} SELECT post_id, original_text, "timestamp", platform, event_type || '|' || lang AS hashtags, likes,
      (SELECT count(*) FROM doc_posts) AS total_rows FROM doc_posts ORDER BY "timestamp", post_id LIMIT 20""",
)
def posts_preview(spark, sf_dir):
    posts = T.doc_posts(spark, sf_dir).withColumn("is_duplicate", F.lit(False))
    shown = store.posts_preview(posts, 20)
    return shown.select(
        "post_id", "original_text", "timestamp", "platform", F.concat_ws("|", "hashtags").alias("hashtags"),
        "likes", F.lit(posts.count()).cast("bigint").alias("total_rows"),
    )


def _event_store(spark, sf_dir):
    """Event posts in a new store, one dataset per platform."""
    workspace = store.Store(spark, scratch_path(spark, "store"))
    posts = T.event_posts(spark, sf_dir).withColumn(
        "dataset_id", F.coalesce("platform", F.lit("none"))
    )
    for _ in range(2):  # the second import changes nothing
        workspace.write("posts", posts, store.DATASET_KEYS)
    return workspace


@query(
    "s6_s7_partitioned_sinks",
    f"""WITH {T.EVENT_POSTS} SELECT coalesce(platform, 'none') AS dataset_id, count(*) AS posts,
      CAST(sum(likes) AS BIGINT) AS likes, count(shares) AS shares FROM event_posts GROUP BY 1""",
)
def sinks(spark, sf_dir):
    stored = spark.read.parquet(_event_store(spark, sf_dir).path("posts"))
    return stored.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("likes").alias("likes"), F.count("shares").alias("shares")
    )


@query(
    "s9_posts_of_a_dataset",
    f"""WITH {T.EVENT_POSTS} SELECT post_id, "timestamp", likes FROM event_posts WHERE platform = 'reddit'""",
)
def posts_scan(spark, sf_dir):
    found = _event_store(spark, sf_dir).posts("reddit")
    return found.select("post_id", "timestamp", "likes").orderBy("timestamp", "post_id")


_RUNS_SQL = """runs AS (SELECT source || '/' || lang AS analysis_run_id, source AS dataset_id,
    CASE WHEN lang = 'de' THEN 'failed' ELSE 'completed' END AS status, count(*) AS posts,
    max(n_chars) AS newest FROM documents GROUP BY source, lang)"""


def _runs(spark, sf_dir):
    """One run per source and language; its longest document stands for the creation time."""
    documents = T.table(spark, sf_dir, "documents")
    grouped = documents.groupBy("source", "lang").agg(
        F.count("*").alias("posts"), F.max("n_chars").alias("newest")
    )
    return grouped.selectExpr(
        "concat(source, '/', lang) AS analysis_run_id", "source AS dataset_id",
        "CASE WHEN lang = 'de' THEN 'failed' ELSE 'completed' END AS status", "posts",
        "newest", "timestamp_seconds(newest) AS created_at",
    )


@query(
    "s10_dataset_listing",
    """SELECT source AS dataset_id, count(*) AS posts, CAST(max(n_chars) AS BIGINT) AS newest, count(*) OVER () AS total FROM documents GROUP BY source
    ORDER BY newest DESC, dataset_id LIMIT 10 OFFSET 5""",
)
def dataset_listing(spark, sf_dir):
    documents = T.table(spark, sf_dir, "documents")
    datasets = documents.groupBy(F.col("source").alias("dataset_id")).agg(
        F.count("*").alias("posts"), F.max("n_chars").alias("newest")
    )
    listed, total = store.dataset_listing(datasets.withColumn("created_at", F.timestamp_seconds("newest")), 10, 5)
    return listed.select("dataset_id", "posts", "newest", F.lit(total).cast("bigint").alias("total"))


@query("s11_run_listing", f"WITH {_RUNS_SQL} SELECT analysis_run_id, status, posts FROM runs WHERE dataset_id = 'src3'")
def run_listing(spark, sf_dir):
    return store.list_runs(_runs(spark, sf_dir), "src3").select("analysis_run_id", "status", "posts")


@query(
    "s12_dataset_delete",
    "SELECT doc_id, source AS dataset_id FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING max(n_chars) < 20000)",
)
def dataset_delete(spark, sf_dir):
    """Every row of the deleted datasets goes; here those without a long document."""
    rows = T.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dataset_id"), "n_chars")
    workspace = store.Store(spark, scratch_path(spark, "delete"))
    workspace.write("posts", rows, store.DATASET_KEYS)
    deleted = rows.groupBy("dataset_id").agg(F.max("n_chars").alias("longest")).where("longest < 20000")
    for row in deleted.collect():  # one row a dataset
        workspace.delete_dataset(row["dataset_id"])
    kept = spark.read.schema("doc_id long, n_chars long, dataset_id string").parquet(workspace.path("posts"))
    return kept.select("doc_id", "dataset_id")


@query("s13_canonical_reuse", "SELECT lang, true AS reusable, count(*) AS posts FROM documents GROUP BY lang")
def canonical_reuse(spark, sf_dir):
    posts = preprocess(T.doc_posts(spark, sf_dir))
    return posts.groupBy("lang").agg(
        store.canonical_flag(V.PREPROCESSING_VERSION).alias("reusable"), F.count(F.lit(1)).alias("posts")
    )


@query(
    "p1_column_detection",
    """SELECT * FROM (VALUES ('text', 'text', 1.0::DOUBLE, false, (SELECT count("text") FROM documents)), ('timestamp', NULL, 0.0::DOUBLE, false, 0),
      ('platform', 'source', 0.95::DOUBLE, false, (SELECT count(source) FROM documents)), ('hashtags', NULL, 0.0::DOUBLE, false, 0),
      ('likes', NULL, 0.0::DOUBLE, false, 0), ('comments', NULL, 0.0::DOUBLE, false, 0), ('shares', NULL, 0.0::DOUBLE, false, 0),
      ('author_id', NULL, 0.0::DOUBLE, false, 0), ('external_id', NULL, 0.0::DOUBLE, false, 0))
      AS t(field, source_column, confidence, ambiguous, filled_rows)""",
)
def detection(spark, sf_dir):
    return columns.detection_table(T.table(spark, sf_dir, "documents"))


def _mapped(spark, sf_dir):
    staged = T.staged_rows(spark, sf_dir)
    return columns.apply_mapping(staged, T.MAPPING, validation.ROW_KEY)


def _checked(spark, sf_dir):
    return validation.check_rows(_mapped(spark, sf_dir))


def _flagged(spark, sf_dir):
    """Checked and flagged rows as an import makes them."""
    return ingest.validate(T.staged_rows(spark, sf_dir), T.MAPPING).rows


@query(
    "p2_p3_apply_mapping",
    f"""WITH {T.STAGED} SELECT row_index, md5(body) AS text_md5, created_at AS "timestamp", network AS platform, tags AS hashtags, likes,
      username AS author_id FROM staged""",
)
def mapping(spark, sf_dir):
    staged = T.staged_rows(spark, sf_dir)
    columns.check_mapping(T.MAPPING, staged.columns)
    mapped = columns.apply_mapping(staged, T.MAPPING, ("row_index",))
    return mapped.select(
        "row_index", F.md5("text").alias("text_md5"), "timestamp", "platform", "hashtags", "likes", "author_id"
    )


@query(
    "p4_row_validity",
    f"WITH {T.STAGED} SELECT row_index, bad_text, no_time, bad_time, is_valid FROM checked",
)
def validity(spark, sf_dir):
    return _checked(spark, sf_dir).select("row_index", "bad_text", "no_time", "bad_time", "is_valid")


_ISSUES = f"""WITH {T.STAGED}, issues AS (
  SELECT 0 AS phase, row_index, 0 AS place, 'missing_text' AS issue_type,
    CASE WHEN trim(body) = '' THEN 'Text field is empty' ELSE 'Text too short (' || length(trim(body)) || ' chars, min 3)' END AS detail
  FROM checked WHERE bad_text
  UNION ALL SELECT 0, row_index, 1, 'missing_timestamp', 'Timestamp is empty' FROM checked WHERE no_time
  UNION ALL SELECT 0, row_index, 2, 'invalid_timestamp', 'Cannot parse timestamp: ''' || created_at || '''' FROM checked WHERE bad_time
  UNION ALL SELECT 1, row_index, 3, 'duplicate', 'Repeated text; retained and flagged' FROM flagged WHERE is_duplicate)"""


@query("p5_row_issues", f"{_ISSUES} SELECT row_index, issue_type, detail FROM issues ORDER BY phase, row_index, place LIMIT 200")
def issues(spark, sf_dir):
    return validation.row_issues(_flagged(spark, sf_dir)).select("row_index", "issue_type", "detail")


@query("p5_all_row_issues", f"{_ISSUES} SELECT row_index, issue_type, detail FROM issues")
def all_issues(spark, sf_dir):
    found = validation.row_issues(_flagged(spark, sf_dir), limit=None)
    return found.select("row_index", "issue_type", "detail")


@query("w13_import_duplicates", f"WITH {T.STAGED} SELECT row_index, is_duplicate FROM flagged")
def import_duplicates(spark, sf_dir):
    return _flagged(spark, sf_dir).select("row_index", "is_duplicate")


_ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"


@query(
    "g1_g2_validation_summary",
    f"""WITH {T.STAGED} SELECT count(*) AS total_rows, count(*) FILTER (is_valid) AS valid_rows,
      count(*) FILTER (NOT is_valid) AS invalid_rows, count(*) FILTER (bad_text) AS missing_text,
      count(*) FILTER (no_time) AS missing_timestamp, count(*) FILTER (bad_time) AS invalid_timestamp,
      count(*) FILTER (is_duplicate) AS duplicate_posts,
      strftime(min(parsed) FILTER (is_valid), {_ISO}) AS earliest, strftime(max(parsed) FILTER (is_valid), {_ISO}) AS latest,
      count(*) FILTER (bad_text) + count(*) FILTER (no_time) + count(*) FILTER (bad_time) + count(*) FILTER (is_duplicate) > 200
        AS issues_truncated FROM flagged""",
)
def summary(spark, sf_dir):
    return validation.validation_summary(_flagged(spark, sf_dir))


@query("g3_platform_distribution", f'WITH {T.STAGED} SELECT network AS platform, count(*) AS "rows" FROM checked WHERE is_valid GROUP BY 1')
def distribution(spark, sf_dir):
    return validation.platform_distribution(_checked(spark, sf_dir))


@query(
    "g4_missing_fields",
    """SELECT * FROM (VALUES ('comments', (SELECT count(*) FROM documents)), ('shares', (SELECT count(*) FROM documents)),
      ('external_id', (SELECT count(*) FROM documents))) AS t(field, missing)""",
)
def missing(spark, sf_dir):
    return validation.missing_fields(_mapped(spark, sf_dir))


_SAFE = r"""CASE WHEN regexp_full_match(trim(likes), '[0-9]+([.][0-9]*)?') AND CAST(trim(likes) AS DOUBLE) <= 2147483647
  AND floor(CAST(trim(likes) AS DOUBLE)) = CAST(trim(likes) AS DOUBLE) THEN CAST(CAST(trim(likes) AS DOUBLE) AS BIGINT) END"""
_TEXT_TAGS = f"""[lower(x) FOR x IN regexp_extract_all(body, {quoted(f"#({V.WORD}+)")}, 1)]"""
_FIELD_TAGS = r"""[lower(regexp_replace(trim(x), '^#+', '')) FOR x IN string_split_regex(tags, '[,|;]') IF trim(x) <> '']"""


@query("p7_safe_integers", f"WITH {T.STAGED} SELECT row_index, {_SAFE} AS likes FROM staged")
def safe_integers(spark, sf_dir):
    return T.staged_rows(spark, sf_dir).select(
        "row_index", normalize.safe_int(F.col("likes")).cast("bigint").alias("likes")
    )


@query(
    "p6_f7_u3_normalized_posts",
    f"""WITH {T.STAGED}, tagged AS (SELECT *, {_FIELD_TAGS} AS a, {_TEXT_TAGS} AS b FROM flagged WHERE is_valid)
    SELECT row_index, md5(body) AS text_md5, parsed AS "timestamp", nullif(lower(trim(network)), '') AS platform,
      array_to_string(a, '|') || '+' || (SELECT coalesce(string_agg(w, '|' ORDER BY i), '') FROM
        (SELECT w, min(i) AS i FROM (SELECT unnest(b) AS w, generate_subscripts(b, 1) AS i) WHERE NOT list_contains(a, w) GROUP BY w)) AS hashtags,
      {_SAFE} AS likes, CAST(NULL AS BIGINT) AS comments, username AS author_id,
      array_to_string(regexp_extract_all(body, {quoted(f"@({V.WORD}+)")}, 1), '|') AS mentions,
      array_to_string(regexp_extract_all(body, {quoted(V.IMPORT_URL)}), '|') AS urls, is_duplicate
    FROM tagged""",
)
def normalized(spark, sf_dir):
    """Normalised posts; mapped hashtags and those the text adds are told apart by a plus."""
    rows = _flagged(spark, sf_dir).where("is_valid")
    posts = normalize.normalize_rows(rows, "d", F.col("row_index"))
    mapped = rows.select(
        F.col("row_index").alias("post_id"), F.size(X.split_hashtag_field(F.col("hashtags"))).alias("n")
    )
    tags = F.coalesce("hashtags", F.array().cast("array<string>"))
    return posts.join(mapped, "post_id").select(
        F.col("post_id").alias("row_index"), F.md5("original_text").alias("text_md5"), "timestamp", "platform",
        F.concat_ws(
            "+", F.array_join(F.slice(tags, F.lit(1), F.col("n")), "|"),
            F.array_join(F.slice(tags, F.col("n") + 1, F.size(tags)), "|"),
        ).alias("hashtags"),
        F.col("likes").cast("bigint").alias("likes"), F.col("comments").cast("bigint").alias("comments"),
        "author_id", F.array_join(F.coalesce("mentions", F.array().cast("array<string>")), "|").alias("mentions"),
        F.array_join(F.coalesce("urls", F.array().cast("array<string>")), "|").alias("urls"), "is_duplicate",
    )


@query("j12_valid_rows", f"WITH {T.STAGED} SELECT row_index FROM checked WHERE is_valid")
def valid_rows(spark, sf_dir):
    rows = _checked(spark, sf_dir)
    invalid = rows.where(~F.col("is_valid")).select(*validation.ROW_KEY)
    return rows.join(invalid, list(validation.ROW_KEY), "left_anti").select("row_index")


@query("f1_parse_timestamps", f"WITH {T.STAGED} SELECT row_index, parsed FROM staged")
def parse(spark, sf_dir):
    return T.staged_rows(spark, sf_dir).select(
        "row_index", TS.parse_standard(F.col("created_at")).alias("parsed")
    )


@query("f2_free_form_timestamps", "SELECT event_id, date_trunc('minute', ts) AS parsed FROM events")
def free_form(spark, sf_dir):
    """A form no listed format fits."""
    events = T.table(spark, sf_dir, "events")
    written = F.date_format(F.col("ts").cast("timestamp"), "MMMM d, yyyy h:mm a")
    return events.select("event_id", TS.parse_timestamp(written).alias("parsed"))


@query(
    "q1_ingest",
    f"""WITH {T.STAGED} SELECT nullif(lower(trim(network)), '') AS platform, count(*) AS posts,
      count(*) FILTER (is_duplicate) AS duplicates, CAST(sum({_SAFE}) AS BIGINT) AS likes, min(parsed) AS earliest, max(parsed) AS latest,
      count(*) FILTER ({strip('body')} <> body) AS padded FROM flagged WHERE is_valid GROUP BY 1""",
)
def ingest_all(spark, sf_dir):
    """Staged rows mapped, validated, normalised, written and read back."""
    workspace = store.Store(spark, scratch_path(spark, "ingest"))
    done = ingest.import_dataset(workspace, T.staged_rows(spark, sf_dir), T.MAPPING, "d1", "Documents")
    again = ingest.import_dataset(workspace, T.staged_rows(spark, sf_dir), T.MAPPING, "d1", "Documents")
    assert done["imported"] and not again["imported"]
    return workspace.posts("d1").groupBy("platform").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if("is_duplicate").alias("duplicates"),
        F.sum("likes").alias("likes"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"),
        F.count_if(X.strip(F.col("original_text")) != F.col("original_text")).alias("padded"),
    )
