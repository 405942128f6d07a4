"""Trend score, classification and explanation as column expressions.

Arguments are column names or SQL expressions as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch import fixed_values as V


@dataclass(frozen=True)
class TrendConfig:
    """Weights, steepness and thresholds of the trend model (fixed values by default)."""

    weight_volume: float = 0.35
    weight_engagement: float = 0.25
    weight_velocity: float = 0.20
    weight_burst: float = 0.20
    steepness: float = 1.0
    burst_steepness: float = 0.5
    decay_per_hour: float = 0.05
    min_baseline: float = 1.0
    emerging: float = 0.70
    rising: float = 0.60
    stable: float = 0.40
    min_posts: int = 3

    def weights(self) -> dict[str, float]:
        return {
            "volume": self.weight_volume,
            "engagement": self.weight_engagement,
            "velocity": self.weight_velocity,
            "burstiness": self.weight_burst,
        }


def logistic(x: str, steepness: float = 1.0) -> Column:
    """Centred logistic; the exponent is clamped to +-20."""
    return F.expr(f"1D / (1D + exp(greatest(-20D, least(20D, {x} * {-steepness}D))))")


def recency(latest: str, clock: str, decay_per_hour: float = 0.05) -> Column:
    """Exponential decay over the hours since the latest post."""
    hours = f"(unix_micros({clock}) - unix_micros({latest})) / 3.6e9D"
    return F.expr(f"exp(greatest(0D, {hours}) * {-decay_per_hour}D)")


def momentum(
    volume: str,
    engagement: str,
    velocity: str,
    burst: str,
    has_engagement: str,
    config: TrendConfig = TrendConfig(),
) -> Column:
    """Weighted sum of the four signals; without engagement its weight goes to the others."""
    w = config
    rest = w.weight_volume + w.weight_velocity + w.weight_burst
    if rest > 0:
        others = [x / rest for x in (w.weight_volume, w.weight_velocity, w.weight_burst)]
    else:
        others = list(V.EQUAL_SHARES)
    full = (
        f"{w.weight_volume}D * {volume} + {w.weight_engagement}D * {engagement} "
        f"+ {w.weight_velocity}D * {velocity} + {w.weight_burst}D * {burst}"
    )
    partial = f"{others[0]}D * {volume} + {others[1]}D * {velocity} + {others[2]}D * {burst}"
    return F.expr(
        f"greatest(0D, least(1D, CASE WHEN {has_engagement} THEN {full} ELSE {partial} END))"
    )


def trend_score(momentum: str, recency: str) -> Column:
    """Momentum pulled towards 0.5 as the latest post ages."""
    fresh = f"greatest(0D, least(1D, {recency}))"
    return F.expr(f"greatest(0D, least(1D, 0.5D + ({momentum} - 0.5D) * {fresh}))")


def classification(
    score: str, volume: str, previous: str, age: str, config: TrendConfig = TrendConfig()
) -> Column:
    """Too few posts are stable; otherwise the first threshold met, on the unrounded score."""
    return F.expr(
        f"""CASE WHEN {volume} < {config.min_posts} THEN 'stable'
        WHEN {score} >= {config.emerging}D AND ({age} < 2 OR {previous} = 0) THEN 'emerging'
        WHEN {score} >= {config.rising}D THEN 'rising'
        WHEN {score} >= {config.stable}D THEN 'stable'
        ELSE 'declining' END"""
    )


def explanation(
    volume_growth_pct: str,
    engagement_growth_pct: str,
    burst: str,
    velocity: str,
    volume: str,
    printed: dict[str, str],
    config: TrendConfig = TrendConfig(),
) -> Column:
    """Plain sentence from growth above 15 %, burst beyond 2 sigma and velocity beyond 0.5.

    `printed` names the absolute volume and engagement growth to 0 decimals and the burst to 1, as
    the sentence shows them.
    """

    def either(x: str, above: str, below: str, up: str, down: str) -> str:
        return f"CASE WHEN {x} {above} THEN '{up}' WHEN {x} {below} THEN '{down}' END"

    grew = either(volume_growth_pct, "> 15", "< -15", *V.VOLUME_VERBS)
    engaged = either(engagement_growth_pct, "> 15", "< -15", *V.ENGAGEMENT_VERBS)
    side = either(burst, ">= 2", "<= -2", *V.BURST_SIDES)
    pace = either(velocity, "> 0.5", "< -0.5", *V.PACE_SENTENCES)
    v, e, b = V.VOLUME_SENTENCE, V.ENGAGEMENT_SENTENCE, V.BURST_SENTENCE
    # A part without its verb is null, which concat_ws leaves out.
    joined = f"""concat_ws('. ',
        concat('{v[0]}', {grew}, '{v[1]}', format_string('%.0f', {printed["volume"]}), '{v[2]}'),
        concat('{e[0]}', {engaged}, '{e[1]}', format_string('%.0f', {printed["engagement"]}), '{e[2]}'),
        concat('{b[0]}', format_string('%.1f', {printed["burst"]}), '{b[1]}', {side}, '{b[2]}'),
        {pace})"""
    usual, few = V.USUAL_SENTENCE, V.FEW_POSTS_SENTENCE
    guard = f"concat('{few[0]}', {volume}, '{few[1]}{config.min_posts}{few[2]}')"
    return F.expr(
        f"concat(CASE WHEN {volume} < {config.min_posts} THEN {guard} ELSE '' END, "
        f"coalesce(concat(nullif({joined}, ''), '.'), '{usual}'))"
    )


def dominant_sentiment(positive: str, neutral: str, negative: str) -> Column:
    """Label of the greatest share; ties go to positive, then neutral."""
    return F.expr(
        f"""CASE WHEN {positive} >= {neutral} AND {positive} >= {negative} THEN 'positive'
        WHEN {neutral} >= {negative} THEN 'neutral' ELSE 'negative' END"""
    )


def snapshot_id(*parts: Column) -> Column:
    """Deterministic key of run, topic, bucket kind, platform and bucket start."""
    return F.sha2(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
