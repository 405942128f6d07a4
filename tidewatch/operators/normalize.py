"""Valid mapped rows as posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import fixed_values as V
from tidewatch.functions import text as T

_NUMBER = r"\A[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?\z"


def safe_int(raw: Column) -> Column:
    """Whole number from 0 to 2^31-1, else null. Spark alone would also read `1d`."""
    text = T.strip(raw)
    number = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit(""))).try_cast("double")
    whole = (number >= 0) & (number <= V.MAX_INT) & (F.floor(number) == number)
    return F.when(whole, number.cast("int"))


def _blank_to_null(raw: Column) -> Column:
    return F.nullif(T.strip(raw), F.lit(""))


def _empty_to_null(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def normalize_rows(valid: DataFrame, dataset_id: str, post_id: Column | None = None) -> DataFrame:
    """Posts from checked, duplicate-flagged rows; a column not mapped stays null."""

    def given(name: str) -> Column:
        return F.col(name) if name in valid.columns else F.lit(None).cast("string")

    text = F.col("text")
    mapped_tags = F.when(given("hashtags").isNotNull(), T.split_hashtag_field(given("hashtags")))
    tags = T.append_missing(
        F.coalesce(mapped_tags, F.array().cast("array<string>")), T.import_hashtags(text)
    )
    if post_id is None:
        post_id = F.sha2(
            F.concat_ws("/", F.lit(dataset_id), F.col("source_file"), F.col("row_index")), 256
        )
    return valid.select(
        post_id.alias("post_id"),
        F.lit(dataset_id).alias("dataset_id"),
        _blank_to_null(given("external_id")).alias("external_id"),
        text.alias("original_text"),
        F.lit(None).cast("string").alias("cleaned_text"),
        F.lit(None).cast("string").alias("sentiment_ready_text"),
        F.col("parsed_time").alias("timestamp"),
        F.lower(_blank_to_null(given("platform"))).alias("platform"),
        _empty_to_null(tags).alias("hashtags"),
        *[safe_int(given(f)).alias(f) for f in V.ENGAGEMENT_FIELDS],
        _blank_to_null(given("author_id")).alias("author_id"),
        _empty_to_null(T.import_mentions(text)).alias("mentions"),
        _empty_to_null(T.import_urls(text)).alias("urls"),
        "is_duplicate",
    )
