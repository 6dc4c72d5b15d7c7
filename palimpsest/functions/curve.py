"""Forgetting, reinforcement, review intervals and confidence as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.lexicon import AROUSED, DECAY_RATE


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 3.6e9


def hours_idle(now: Column) -> Column:
    return F.greatest(F.lit(0.0), hours_between(F.coalesce("last_access_at", "created_at"), now))


def decay_rate(rate: float = DECAY_RATE) -> Column:
    """Aroused memories fade more slowly until three successful reviews have worked them through."""
    return F.when(F.col("affect").isin(*AROUSED) & (F.col("review_streak") < 3), F.lit(rate * 0.6)).otherwise(F.lit(rate))


def retrievability(now: Column, rate: float = DECAY_RATE) -> Column:
    return F.col("strength") * F.col("storage_strength") * F.exp(-decay_rate(rate) * hours_idle(now))


def reinforced(delta: Column) -> dict[str, Column]:
    return {"strength": F.least(F.lit(1.0), F.col("strength") + delta), "storage_strength": F.least(F.lit(2.0), F.col("storage_strength") + 0.3 * delta), "access_count": F.col("access_count") + 1}


def review_delta(delta: Column, gap_hours: Column, effort: Column) -> Column:
    return delta * (1 + 0.45 * F.least(F.lit(1.0), gap_hours / 168)) * (1 + 0.5 * clamp(effort))


def interval_hours(streak: Column, base: float = 24.0) -> Column:
    up = F.least(streak - 1, F.lit(8.0))
    return base * F.pow(F.lit(2.0), F.when(streak < 1, F.greatest(F.lit(-2.0), streak - 1)).otherwise(up))


def add_hours(at: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + F.round(hours * 3_600_000_000).cast("long"))


def next_review_at(now: Column) -> Column:
    return add_hours(F.coalesce("last_review_at", now), interval_hours(F.col("review_streak")))


def attempts() -> Column:
    return F.col("retrieval_successes") + F.col("retrieval_failures")


def adaptive_interval(r: Column) -> Column:
    n = attempts()
    accuracy = F.col("retrieval_successes") / F.when(n > 0, n)
    by_accuracy = F.when(n >= 3, F.when(accuracy >= 0.8, 1.2).when(accuracy < 0.5, 0.5).otherwise(1.0)).otherwise(1.0)
    by_recall = F.when(r >= 0.7, 1.3).when(r < 0.3, 0.6).otherwise(1.0)
    streak = F.least(F.lit(4.0), F.pow(F.lit(1.5), F.least(F.col("review_streak").cast("double"), F.lit(12.0))))
    return 24.0 * streak * by_accuracy * F.when(F.col("importance") >= 0.7, 0.8).otherwise(1.0) * by_recall


def confidence(r: Column) -> Column:
    r = F.least(F.lit(1.0), r)
    return (
        F.col("confidence")
        * (0.45 + 0.55 * r)
        * (0.8 + 0.2 * F.least(F.col("access_count"), F.lit(3)) / 3)
        * (0.95 + 0.05 * F.least(F.col("evidence_count"), F.lit(5)) / 5)
    )


def calibrated(own: Column) -> Column:
    """Own confidence blended with the success rate, the more the more attempts there are."""
    n = attempts()
    w = 0.5 * F.least(F.lit(1.0), n / 5.0)
    return F.when(n >= 2, (1 - w) * own + w * (F.col("retrieval_successes") + 1) / (n + 2)).otherwise(own)
