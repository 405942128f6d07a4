"""SQL texts shared by the twins: rounding, text rules and the trend query."""

from __future__ import annotations

from tidewatch import fixed_values as V
from tidewatch.functions.scoring import TrendConfig


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(x: str, digits: int) -> str:
    """Correct decimal rounding of the binary value, by printing it."""
    return f"(CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0)"


def replace_all(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def strip(x: str) -> str:
    return replace_all(x, rf"^{V.SPACE}+|{V.SPACE}+\z", "")


def collapse_space(x: str) -> str:
    return f"trim({replace_all(x, V.SPACE + '+', ' ')})"


def collapse_punctuation(x: str) -> str:
    for mark in V.REPEATED_PUNCTUATION:
        x = replace_all(x, f"[{mark}]{{3,}}", mark)
    return x


URL = (
    f"(?i){V.URL_START}(?:{V.URL_CHAR}+|{V.URL_PARENS})+(?:{V.URL_PARENS}|{V.URL_LAST_CHAR})"
)
_HIDDEN = "\x01"


def _hide(x: str, mark: str) -> str:
    """Marks behind a word character start no tag; put a sign in their place."""
    return replace_all(x, rf"({V.WORD}){mark}", rf"\1{_HIDDEN}")


def _tags(x: str, mark: str, body: str) -> str:
    return f"regexp_extract_all({_hide(x, mark)}, {quoted(f'{mark}({body})(?:{V.NOT_WORD}|$)')}, 1)"


def mentions(x: str) -> str:
    return _tags(x, "@", V.MENTION_BODY)


def hashtags(x: str) -> str:
    return _tags(x, "#", V.HASHTAG_BODY)


def _replace_tags(x: str, mark: str, body: str, by: str) -> str:
    out = replace_all(_hide(x, mark), rf"{mark}({body})({V.NOT_WORD}|$)", rf"{by}\2")
    return f"replace({out}, {quoted(_HIDDEN)}, {quoted(mark)})"


def first_casing(found: str) -> str:
    """Distinct regardless of case, first spelling kept, joined by a bar."""
    return (
        f"(SELECT coalesce(string_agg(w, '|' ORDER BY i), '') FROM (SELECT w, i, row_number() OVER "
        f"(PARTITION BY lower(w) ORDER BY i) AS n FROM (SELECT unnest(l) AS w, "
        f"generate_subscripts(l, 1) AS i FROM (SELECT {found} AS l))) WHERE n = 1)"
    )


def distinct_in_order(found: str) -> str:
    """Distinct, first occurrence kept, joined by a bar."""
    return (
        f"(SELECT coalesce(string_agg(w, '|' ORDER BY i), '') FROM (SELECT w, min(i) AS i FROM "
        f"(SELECT unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT {found} AS l)) GROUP BY w))"
    )


def cleaned(decoded: str) -> str:
    x = replace_all(decoded, URL, " ")
    x = _replace_tags(x, "@", V.MENTION_BODY, " ")
    x = _replace_tags(x, "#", V.HASHTAG_BODY, r"\1")
    return f"lower({collapse_space(collapse_punctuation(x))})"


def sentiment_ready(decoded: str) -> str:
    x = _replace_tags(decoded, "@", V.MENTION_BODY, "@user")
    return collapse_space(collapse_punctuation(replace_all(x, URL, "http")))


def ner_text(decoded: str) -> str:
    x = replace_all(decoded, URL, " ")
    x = _replace_tags(x, "#", V.HASHTAG_BODY, r"\1")
    return collapse_space(collapse_punctuation(x))


def text_hash(x: str) -> str:
    return f"sha256({replace_all(f'lower({strip(x)})', V.SPACE + '+', ' ')})"


def stop_words() -> str:
    return "(" + ", ".join(quoted(w) for w in V.STOP_WORDS) + ")"


def keyword_sql(source: str, top_n: int = 50, max_features: int = 100) -> str:
    """Keywords of the rows (id, text) of `source`: common table expressions ending in `keywords`."""
    return f"""
words AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (
    SELECT id, string_split_regex(lower("text"), {quoted(V.NOT_WORD + '+')}) AS l FROM {source})),
tokens AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY i) AS i FROM words
    WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {stop_words()}),
grams AS (SELECT id, w AS term FROM tokens UNION ALL
    SELECT a.id, a.w || ' ' || b.w FROM tokens a JOIN tokens b ON a.id = b.id AND b.i = a.i + 1),
vocabulary AS (SELECT term FROM grams GROUP BY term ORDER BY count(*) DESC, term LIMIT {max_features}),
tf AS (SELECT id, term, count(*) AS tf FROM grams JOIN vocabulary USING (term) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
weights AS (SELECT id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY id),
scores AS (SELECT term, sum(w / norm) / (SELECT count(*) FROM {source}) AS score
    FROM weights JOIN norms USING (id) GROUP BY term),
plain AS (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY i) AS i FROM (
    SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (
      SELECT id, string_split_regex("text", {quoted(V.SPACE + '+')}) AS l FROM {source})) WHERE w <> ''),
raw AS (SELECT term, count(*) AS frequency FROM (
    SELECT w AS term FROM plain UNION ALL
    SELECT a.w || ' ' || b.w FROM plain a JOIN plain b ON a.id = b.id AND b.i = a.i + 1) GROUP BY term),
keywords AS (SELECT term AS keyword, CASE WHEN contains(term, ' ') THEN 'ngram' ELSE 'keyword' END AS keyword_type,
    coalesce(frequency, 1) AS frequency, {rounded('score', 4)} AS tfidf_score
  FROM scores LEFT JOIN raw USING (term) ORDER BY {rounded('score', 10)} DESC, term LIMIT {top_n})"""


UNITS = {"hourly": ("hour", "1 HOUR"), "daily": ("day", "1 DAY"), "weekly": ("week", "7 DAY")}


def trend_ctes(
    source: str, window: str, where: str = "true", dataset_engagement: bool = False,
    missing_as_neutral: bool = False, clock_source: str | None = None,
) -> str:
    """Expressions up to `signals` (unrounded) and `snapshots` for the posts of `source`."""
    unit, step = UNITS[window]
    c = TrendConfig()
    rest = c.weight_volume + c.weight_velocity + c.weight_burst
    has = "likes IS NOT NULL OR comments IS NOT NULL OR shares IS NOT NULL"
    measured = (
        f"(SELECT bool_or({has}) FROM {clock_source or source})" if dataset_engagement else f"bool_or({has})"
    )
    sentiment = "coalesce(sentiment, 'neutral')" if missing_as_neutral else "sentiment"
    over = "OVER (PARTITION BY topic_id ORDER BY window_start)"

    def logistic(x: str, k: float) -> str:
        return f"(1.0 / (1.0 + exp(greatest(-20.0, least(20.0, CAST(-{k} AS DOUBLE) * {x})))))"

    def percent(x: str) -> str:
        return rounded(f"100.0 * {x}", 2)

    return f"""
clock AS (SELECT max("timestamp") AS clock FROM {clock_source or source}),
chosen AS (SELECT * FROM {source} WHERE {where}),
buckets AS (SELECT topic_id, CAST(date_trunc('{unit}', "timestamp") AS TIMESTAMP) AS window_start, count(*) AS volume,
    CAST(sum(coalesce(likes, 0)) + sum(coalesce(comments, 0)) + sum(coalesce(shares, 0)) AS DOUBLE) AS total,
    count(*) FILTER ({sentiment} = 'positive') AS positive,
    count(*) FILTER ({sentiment} = 'neutral') AS neutral,
    count(*) FILTER ({sentiment} = 'negative') AS negative, max("timestamp") AS latest
  FROM chosen GROUP BY 1, 2),
availability AS (SELECT topic_id, {measured} AS measured FROM chosen GROUP BY topic_id),
calendar AS (SELECT topic_id, unnest(generate_series(min(window_start),
    (SELECT CAST(date_trunc('{unit}', clock) AS TIMESTAMP) FROM clock), INTERVAL {step})) AS window_start
  FROM buckets GROUP BY topic_id),
filled AS (SELECT topic_id, window_start, measured, coalesce(volume, 0) AS volume,
    CASE WHEN measured AND volume > 0 THEN total / volume ELSE 0.0 END AS engagement,
    coalesce(positive, 0) AS positive, coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative, latest
  FROM calendar LEFT JOIN buckets USING (topic_id, window_start) JOIN availability USING (topic_id)),
history AS (SELECT *, row_number() {over} AS age, lag(volume, 1, 0) {over} AS volume_previous,
    lag(engagement, 1, 0.0) {over} AS engagement_previous,
    avg(volume) OVER (PARTITION BY topic_id ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_before,
    stddev_pop(volume) OVER (PARTITION BY topic_id ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spread_before,
    max(latest) OVER (PARTITION BY topic_id ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest_post,
    list(volume) OVER (PARTITION BY topic_id ORDER BY window_start ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS activity,
    lead(window_start) {over} IS NULL AS is_latest
  FROM filled),
growth AS (SELECT *, (volume - volume_previous) / greatest(volume_previous, 1.0) AS volume_growth,
    CASE WHEN age = 1 THEN 0.0 ELSE (engagement - engagement_previous) / greatest(engagement_previous, 1.0) END AS engagement_growth,
    CASE WHEN age = 1 THEN 0.0 ELSE (volume - mean_before) / greatest(spread_before, 1.0) END AS burst
  FROM history),
signals AS (SELECT *, CASE WHEN age = 1 THEN 0.0 ELSE volume_growth - lag(volume_growth) {over} END AS velocity FROM growth),
scored AS (SELECT *, {percent('volume_growth')} AS volume_growth_pct, {percent('engagement_growth')} AS eng_pct,
    exp(-{c.decay_per_hour} * greatest(0.0, epoch_us((SELECT clock FROM clock)) - epoch_us(latest_post)) / 3.6e9) AS recency,
    CASE WHEN measured THEN {c.weight_volume} * {logistic('volume_growth', c.steepness)}
        + {c.weight_engagement} * {logistic('engagement_growth', c.steepness)}
        + {c.weight_velocity} * {logistic('velocity', c.steepness)} + {c.weight_burst} * {logistic('burst', c.burst_steepness)}
      ELSE ({c.weight_volume} * {logistic('volume_growth', c.steepness)} + {c.weight_velocity} * {logistic('velocity', c.steepness)}
        + {c.weight_burst} * {logistic('burst', c.burst_steepness)}) / {rest} END AS momentum
  FROM signals),
finished AS (SELECT *, 0.5 + (momentum - 0.5) * recency AS score,
    concat_ws('. ',
      CASE WHEN volume_growth_pct > 15 THEN 'Post volume increased by ' || format('{{:.0f}}', volume_growth_pct) || '% compared to the previous period'
        WHEN volume_growth_pct < -15 THEN 'Post volume decreased by ' || format('{{:.0f}}', -volume_growth_pct) || '% compared to the previous period' END,
      CASE WHEN eng_pct > 15 THEN 'engagement grew by ' || format('{{:.0f}}', eng_pct) || '%'
        WHEN eng_pct < -15 THEN 'engagement dropped by ' || format('{{:.0f}}', -eng_pct) || '%' END,
      CASE WHEN burst >= 2 THEN 'activity is ' || format('{{:.1f}}', burst) || ' standard deviations above the historical baseline'
        WHEN burst <= -2 THEN 'activity is ' || format('{{:.1f}}', -burst) || ' standard deviations below the historical baseline' END,
      CASE WHEN velocity > 0.5 THEN 'growth is accelerating' WHEN velocity < -0.5 THEN 'growth is decelerating' END) AS said
  FROM scored),
snapshots AS (SELECT topic_id, '{window}' AS time_window, window_start, window_start + INTERVAL {step} AS window_end,
    {rounded('score', 4)} AS trend_score,
    CASE WHEN volume < {c.min_posts} THEN 'stable'
      WHEN score >= {c.emerging} AND (age < 2 OR volume_previous = 0) THEN 'emerging'
      WHEN score >= {c.rising} THEN 'rising' WHEN score >= {c.stable} THEN 'stable' ELSE 'declining' END AS classification,
    CASE WHEN volume < {c.min_posts} THEN 'Stable — insufficient current volume (' || volume || ' < {c.min_posts}). ' ELSE '' END
      || CASE WHEN said = '' THEN 'Activity levels and engagement remain consistent with historical norms.' ELSE said || '.' END AS explanation,
    volume AS volume_current, volume_previous, volume_growth_pct,
    CASE WHEN measured THEN {rounded('engagement', 2)} END AS engagement_current,
    CASE WHEN measured THEN {rounded('engagement_previous', 2)} END AS engagement_previous,
    CASE WHEN measured THEN eng_pct END AS engagement_growth_pct,
    {rounded('velocity', 4)} AS velocity, {rounded('burst', 4)} AS burst_score, {rounded('recency', 4)} AS recency_score,
    {', '.join(f"CASE WHEN volume > 0 THEN {rounded(f'{s} / volume', 4)} ELSE 0.0 END AS sentiment_{s}_pct" for s in V.SENTIMENTS)},
    activity, is_latest
  FROM finished)"""


def timeline_ctes(source: str, window: str, where: str = "true") -> str:
    """Expressions ending in `timeline`; the clock ignores the filter."""
    unit, step = UNITS[window]
    return f"""
chosen AS (SELECT * FROM {source} WHERE {where}),
buckets AS (SELECT CAST(date_trunc('{unit}', "timestamp") AS TIMESTAMP) AS window_start, count(*) AS volume,
    sum(coalesce(likes, 0) + coalesce(comments, 0) + coalesce(shares, 0)) AS total,
    count(*) FILTER (sentiment = 'positive') AS positive,
    count(*) FILTER (coalesce(sentiment, 'neutral') = 'neutral') AS neutral,
    count(*) FILTER (sentiment = 'negative') AS negative
  FROM chosen GROUP BY 1),
calendar AS (SELECT unnest(generate_series((SELECT min(window_start) FROM buckets),
    (SELECT CAST(date_trunc('{unit}', max("timestamp")) AS TIMESTAMP) FROM {source}), INTERVAL {step})) AS window_start),
timeline AS (SELECT window_start, window_start + INTERVAL {step} AS window_end, coalesce(volume, 0) AS total_volume,
    coalesce(positive, 0) AS positive_count, coalesce(neutral, 0) AS neutral_count, coalesce(negative, 0) AS negative_count,
    coalesce({rounded('total / volume', 2)}, 0.0) AS avg_engagement
  FROM calendar LEFT JOIN buckets USING (window_start))"""
