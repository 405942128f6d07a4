"""Predicates of the read views."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_platform(platform: str | None) -> Column:
    return F.lit(True) if not platform else F.col("platform") == platform.lower()


def with_sentiment(label: str | None) -> Column:
    return F.lit(True) if not label else F.col("sentiment") == label.lower()


def with_topic(topic_id) -> Column:
    return F.lit(True) if topic_id is None else F.col("topic_id") == topic_id


def utc(value: datetime) -> datetime:
    """Naive values are UTC."""
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def between_dates(start: date | datetime | None, end: date | datetime | None, column: str = "timestamp") -> Column:
    """Inclusive range of a time column. A date-only end covers its whole day."""
    day_only = end is not None and not isinstance(end, datetime)

    def instant(value) -> datetime:
        if not isinstance(value, datetime):
            value = datetime(value.year, value.month, value.day)
        return utc(value)

    low = None if start is None else instant(start)
    high = None if end is None else instant(end) + (timedelta(days=1) if day_only else timedelta())
    last = high - timedelta(microseconds=1) if day_only else high
    if low is not None and last is not None and low > last:
        raise ValueError(f"The range is empty: it starts {low} and ends {high}.")
    condition = F.lit(True)
    if low is not None:
        condition = condition & (F.col(column) >= F.lit(low))
    if high is not None:
        bound = F.lit(high)
        condition = condition & (
            F.col(column) < bound if day_only else F.col(column) <= bound
        )
    return condition


def containing(query: str | None) -> Column:
    """Literal, case-insensitive match in the original or the cleaned text."""
    needle = (query or "").strip().lower()
    if not needle:
        return F.lit(True)
    original = F.contains(F.lower("original_text"), F.lit(needle))
    canonical = F.contains(F.lower("cleaned_text"), F.lit(needle))
    return F.coalesce(original, F.lit(False)) | F.coalesce(canonical, F.lit(False))


def topic_matches(query: str | None) -> Column:
    """Case-folded substring of the display name followed by the keyword words."""
    if not query:
        return F.lit(True)
    words = F.transform("keywords", lambda k: F.coalesce(k["word"], F.lit("")))
    text = F.concat_ws(" ", F.col("display_name"), F.array_join(words, " "))
    return F.contains(F.lower(text), F.lit(query.lower()))


def classified(label: str | None) -> Column:
    return F.lit(True) if not label else F.col("classification") == label


def not_outlier() -> Column:
    return ~F.col("is_outlier")


def entity_label(label: str | None) -> Column:
    return F.lit(True) if not label else F.col("label") == label.upper()


def keyword_kind(*kinds: str) -> Column:
    return F.col("keyword_type").isin(list(kinds))


def resolve_run(
    runs: DataFrame, run_id: str | None, dataset_id: str | None = None, completed: bool = True
):
    """The run row after its checks, or None without a run id; never a default run."""
    if run_id is None:
        return None
    run = runs.where(F.col("analysis_run_id") == run_id).limit(1).first()
    if run is None:
        raise LookupError(f"There is no run {run_id}.")
    if dataset_id is not None and run["dataset_id"] != dataset_id:
        raise ValueError(f"Run {run_id} is one of dataset {run['dataset_id']}, not of {dataset_id}.")
    if completed and run["status"] != "completed":
        raise RuntimeError(f"Run {run_id} is {run['status']}; only completed runs can be read.")
    return run


def require_posts(posts: DataFrame, status: str) -> None:
    """A run needs an imported dataset with at least one post."""
    if status not in ("imported", "preprocessed"):
        raise RuntimeError(f"A dataset that is {status} cannot be analysed; import it first.")
    if posts.isEmpty():
        raise ValueError("The dataset has no posts to analyse.")
