"""Timestamps from text, and UTC calendar buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.bound import bound
from tidewatch.functions.text import collapse_space

# Shapes a timestamp may have and the patterns tried on each, in order (fixed values): ISO with T
# or blank, date only, US before European slashes, the weekday form, dots. Naive means UTC.
# Each text meets only the patterns of its own shape.
_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_ZONE = r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)"
_SLASHES = r"\d{1,2}/\d{1,2}/\d{4}"
_DOTS = r"\d{1,2}\.\d{1,2}\.\d{4}"
SHAPES = [
    (
        rf"{_DATE}T{_CLOCK}(?:\.\d{{1,6}})?{_ZONE}?",
        ["yyyy-M-d'T'H:m:s[.SSSSSS][XXXXX][XXXX]"],
    ),
    (
        rf"{_DATE} +{_CLOCK}(?:\.\d{{1,6}})?{_ZONE}?",
        ["yyyy-M-d H:m:s[.SSSSSS][XXXXX][XXXX]"],
    ),
    (rf"{_DATE} +\d{{1,2}}:\d{{1,2}}", ["yyyy-M-d H:m"]),
    (_DATE, ["yyyy-M-d"]),
    (rf"{_SLASHES} +{_CLOCK}", ["M/d/yyyy H:m:s", "d/M/yyyy H:m:s"]),
    (rf"{_SLASHES} +\d{{1,2}}:\d{{1,2}}", ["M/d/yyyy H:m"]),
    (_SLASHES, ["M/d/yyyy", "d/M/yyyy"]),
    (rf"{_DOTS} +{_CLOCK}", ["d.M.yyyy H:m:s"]),
    (_DOTS, ["d.M.yyyy"]),
]
# "Mon Jul 15 14:30:00 +0000 2026"; the weekday is dropped, since Spark does not parse it.
_WEEKDAY_FORM = (
    rf"(?i)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) +([a-z]{{3}} +\d{{1,2}} +{_CLOCK} +{_ZONE} +\d{{4}})"
)
_EPOCH = r"\A\d{10,13}\z"
_YEAR_10000 = 253402300800


def parse_standard(raw: Column) -> Column:
    """Epoch seconds or milliseconds and the listed formats; null for anything else."""
    return bound(collapse_space(raw), _standard)


def _standard(text: Column) -> Column:
    number = F.when(text.rlike(_EPOCH), text).try_cast("bigint")
    seconds = F.when(number > 10**12, F.floor(number / 1000)).otherwise(number)
    in_range = F.when(seconds < _YEAR_10000, seconds)
    result = F.when(text.rlike(_EPOCH), F.timestamp_seconds(in_range))
    for shape, formats in SHAPES:
        parsed = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
        result = result.when(text.rlike(rf"\A{shape}\z"), F.coalesce(*parsed))
    without_day = F.initcap(F.lower(F.regexp_extract(text, _WEEKDAY_FORM, 1)))
    return result.when(
        text.rlike(rf"\A{_WEEKDAY_FORM}\z"),
        F.try_to_timestamp(without_day, F.lit("MMM d H:m:s [XXXXX][XXXX] yyyy")),
    )


# Dates of free forms and their patterns, after commas, weekday and the dot of a short month are gone.
# Months of three letters are short names, longer ones whole names: each date meets one pattern of its own.
_FREE_DATES = [
    (_DATE, ["yyyy-M-d"]),
    (r"\d{8}", ["yyyyMMdd"]),
    (r"\d{4}/\d{1,2}/\d{1,2}", ["yyyy/M/d"]),
    (_SLASHES, ["M/d/yyyy", "d/M/yyyy"]),
    (_DOTS, ["d.M.yyyy"]),
    (r"\p{Alpha}{3} \d{1,2} \d{4}", ["MMM d yyyy"]),
    (r"\p{Alpha}{4,9} \d{1,2} \d{4}", ["MMMM d yyyy"]),
    (r"\d{1,2}[ -]\p{Alpha}{3}[ -]\d{4}", ["d MMM yyyy"]),
    (r"\d{1,2}[ -]\p{Alpha}{4,9}[ -]\d{4}", ["d MMMM yyyy"]),
]
_FREE_DATE = "|".join(shape for shape, _ in _FREE_DATES)
_FREE_TIME = r"(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?(?: ?([AaPp])\.?[Mm]\.?)?(?: ?(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?)?"
_FREE_FORM = rf"\A({_FREE_DATE})[ T]*{_FREE_TIME}\z"


def parse_free_form(raw: Column) -> Column:
    """A date in one of several ways to write it, a time of 12 or 24 hours behind it if any, and a
    zone if any; naive means UTC, anything else is null. Hand it the rest of `parse_standard`."""
    text = F.regexp_replace(collapse_space(raw), r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?[.,]? ", "")
    text = collapse_space(F.regexp_replace(F.regexp_replace(text, ",", " "), r"(\p{Alpha}{3})\.(?= )", "$1"))
    return bound(text, lambda t: F.when(t.rlike(_FREE_FORM), _free_form(t)))


def _free_form(text: Column) -> Column:
    date = F.regexp_replace(F.initcap(F.lower(F.regexp_extract(text, _FREE_FORM, 1))), r"(?<=\p{Alpha})-|-(?=\p{Alpha})", " ")

    def part(n: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _FREE_FORM, n), F.lit("")).cast("int"), F.lit(0))

    # Each piece is read once, however often what follows names it.
    pieces = F.struct(
        bound(F.initcap(date), _free_day).alias("day"),
        *[part(n).alias(name) for n, name in ((2, "hour"), (3, "minute"), (4, "second"))],
        F.upper(F.regexp_extract(text, _FREE_FORM, 5)).alias("half"),
        bound(F.regexp_extract(text, _FREE_FORM, 6), _offset).alias("offset"),
    )
    return bound(pieces, _instant)


def _free_day(date: Column) -> Column:
    day = F.lit(None).cast("timestamp")
    for shape, formats in reversed(_FREE_DATES):
        parsed = F.coalesce(*[F.try_to_timestamp(date, F.lit(f)) for f in formats])
        day = F.when(date.rlike(rf"\A(?:{shape})\z"), parsed).otherwise(day)
    return day


def _offset(zone: Column) -> Column:
    """Seconds of a zone's digits, 0 for a name or none."""
    numbers = F.regexp_replace(zone, "[^0-9]", "")
    return F.when(
        F.length(numbers) == 4,
        (F.substring(numbers, 1, 2).cast("int") * 60 + F.substring(numbers, 3, 2).cast("int"))
        * F.when(F.startswith(zone, F.lit("-")), -60).otherwise(60),
    ).otherwise(0)


def _instant(p: Column) -> Column:
    half = p["half"]
    hour = F.when(half == "", p["hour"]).otherwise(p["hour"] % 12 + F.when(half == "P", 12).otherwise(0))
    in_day = F.when(half == "", p["hour"] < 24).otherwise(p["hour"].between(1, 12))
    seconds = F.unix_seconds(p["day"]) + hour * 3600 + p["minute"] * 60 + p["second"] - p["offset"]
    return F.when((p["minute"] < 60) & (p["second"] < 60) & in_day, F.timestamp_seconds(seconds))


def parse_timestamp(raw: Column) -> Column:
    """Timestamp of a text in any accepted form, else null."""
    read = F.struct(raw.alias("raw"), parse_standard(raw).alias("standard"))
    return bound(read, lambda r: F.coalesce(r["standard"], parse_free_form(F.when(r["standard"].isNull(), r["raw"]))))


@dataclass(frozen=True)
class Bucket:
    """A tumbling UTC calendar bucket."""

    name: str
    unit: str
    interval: str
    seconds: int

    def start(self, ts: Column) -> Column:
        return F.date_trunc(self.unit, ts)

    def end(self, start: Column) -> Column:
        return start + self.step()

    def step(self) -> Column:
        return F.expr(f"INTERVAL {self.interval}")


BUCKETS = {
    "hourly": Bucket("hourly", "hour", "1 HOUR", 3600),
    "daily": Bucket("daily", "day", "1 DAY", 86400),
    "weekly": Bucket("weekly", "week", "7 DAY", 7 * 86400),  # weeks start on Monday
}


def bucket(name: str) -> Bucket:
    """The named bucket; any other name means daily."""
    return BUCKETS.get(name, BUCKETS["daily"])
