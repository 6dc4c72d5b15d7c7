"""Review scheduling: what is due, when to review next, and how memories will fade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import curve
from palimpsest.functions.lexicon import AROUSED


def topic() -> Column:
    return F.coalesce(F.get("cues", 0), F.substring("content", 1, 10))


def with_r(mem: DataFrame, now: Column) -> DataFrame:
    return mem.withColumn("r", curve.retrievability(now))


def due(mem: DataFrame, now: Column, by: str = "importance", limit: int = 20) -> DataFrame:
    """The memories to review first: important ones that are fading, or those of the most useful difficulty."""
    rows = with_r(mem, now).where("r < 0.5")
    order = [F.desc("importance"), F.asc(F.round("r", 9))] if by == "importance" else [F.asc(F.round(F.abs(F.col("r") - 0.45), 9))]
    return rows.orderBy(*order, F.desc("seq")).limit(limit).select("id", "importance", F.round("r", 6).alias("retrievability"))


def due_rows(mem: DataFrame, now: Column) -> DataFrame:
    return with_r(mem, now).where("r < 0.5").select("id", "importance", F.round("r", 6).alias("retrievability"), F.round(F.abs(F.col("r") - 0.45), 6).alias("difficulty"))


def next_reviews(mem: DataFrame, now: Column) -> DataFrame:
    at = curve.next_review_at(now)
    return mem.select("id", "review_streak", F.round(curve.interval_hours(F.col("review_streak")), 6).alias("interval_hours"), F.unix_seconds(at).alias("next_review_s"), (at < now).alias("overdue"))


def next_intervals(mem: DataFrame, now: Column) -> DataFrame:
    rows = with_r(mem, now)
    return rows.select("id", F.round("r", 6).alias("retrievability"), F.round(curve.adaptive_interval(F.col("r")), 6).alias("next_interval_hours"))


def curve_fit(mem: DataFrame, now: Column, horizon: int = 30, threshold: float = 0.4) -> DataFrame:
    rows = with_r(mem, now).withColumn("attempts", curve.attempts())
    success = F.col("retrieval_successes") / F.when(F.col("attempts") > 0, F.col("attempts"))
    rate = curve.decay_rate() / F.coalesce(F.least(F.lit(2.0), 0.5 + success), F.lit(1.0))
    days = F.when(F.col("r") > threshold, F.log(F.col("r") / threshold) / rate / 24.0).otherwise(0.0)
    return rows.select("id", "attempts", F.round(success, 6).alias("success_rate"), F.round(rate, 8).alias("rate_per_hour"), F.round(F.least(F.lit(float(horizon)), days), 6).alias("days_to_threshold"))


def calibrate(mem: DataFrame, now: Column) -> DataFrame:
    """The decay rate at which the median accessed memory halves over its life; the default below five of them."""
    span = curve.hours_between(F.col("created_at"), F.col("last_access_at"))
    rows = mem.where("access_count > 0").select(span.alias("span")).where("span >= 1")
    rate = curve.clamp(F.log(F.lit(2.0)) / F.percentile("span", 0.5), 0.0005, 0.02)
    return rows.agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 5, rate).otherwise(0.002), 8).alias("rate"))


def affect_decay(mem: DataFrame) -> DataFrame:
    charge = F.greatest(F.lit(0.0), 1.0 - F.col("review_streak") / 3.0)
    rows = mem.where(F.col("affect").isin(*AROUSED, "mixed")).withColumn("charge", F.round(charge, 6))
    state = F.when(F.col("charge") == 0, "processed").when(F.col("charge") <= 0.5, "fading").otherwise("persistent")
    return rows.select("id", "affect", "charge", F.round(F.col("charge") * 30.0, 6).alias("persistence_days"), state.alias("state"))


def spacing_plan(mem: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The day to review each memory on (weak ones first), and its turn that day: topics alternate."""
    rows = with_r(mem, now)
    day = F.least(F.lit(days - 1), F.bround(F.least(F.lit(1.0), F.col("r")) * (days - 1)).cast("int"))
    rows = rows.select("id", "seq", "importance", topic().alias("topic"), day.alias("day"))
    turn = F.row_number().over(Window.partitionBy("day", "topic").orderBy(F.desc("importance"), F.desc("seq")))
    return rows.select("id", "topic", "day", turn.alias("turn"))


def load(mem: DataFrame, now: Column, days: int = 7) -> DataFrame:
    rows = with_r(mem, now).withColumn("at", curve.next_review_at(now))
    horizon = curve.add_hours(now, F.lit(24.0 * days))
    soon, over = F.count_if(F.col("at") <= horizon), F.count_if(F.col("at") < now)
    return rows.agg(F.count_if(F.col("r") < 0.5).alias("due_now"), over.alias("overdue"), (soon - over).alias("due_within_days"), F.count_if(F.col("r") < 0.3).alias("weak"), (soon + over).alias("load_index"))


def consistency(mem: DataFrame, now: Column) -> DataFrame:
    """Of reviewed memories, how many are on time, and how late the others are."""
    at = curve.next_review_at(now)
    late = curve.hours_between(at, now) / 24.0
    rows = mem.where("last_review_at is not null").select(late.alias("late"))
    n = F.count("*")
    on_time = F.count_if(F.col("late") <= 0)
    return rows.agg(n.alias("reviewed"), on_time.alias("on_time"), (n - on_time).alias("overdue"), F.round(on_time / F.nullif(n, F.lit(0)), 6).alias("adherence"), F.round(F.avg(F.when(F.col("late") > 0, F.col("late"))), 6).alias("avg_days_late"))


def curve_points(mem: DataFrame, now: Column, days: int = 30, step: int = 10) -> DataFrame:
    rows = mem.select("*", F.explode(F.sequence(F.lit(0), F.lit(days), F.lit(step))).alias("day"))
    r = F.col("strength") * F.col("storage_strength") * F.exp(-curve.decay_rate() * (curve.hours_idle(now) + F.col("day") * 24))
    return rows.select("id", "day", F.round(r, 6).alias("retrievability"))


def cramming(mem: DataFrame, now: Column, hours: float = 72.0, sessions: int = 3, limit: int = 12) -> DataFrame:
    r = F.col("strength") * F.col("storage_strength") * F.exp(-curve.decay_rate() * (curve.hours_idle(now) + hours))
    need = F.round(F.col("importance") * (1 - F.least(F.lit(1.0), r)), 6)
    top = mem.select("id", "seq", need.alias("need")).orderBy(F.desc("need"), F.desc("seq")).limit(limit)
    return top.select("id", "need", F.ntile(sessions).over(Window.partitionBy(F.lit(0)).orderBy(F.desc("need"), F.desc("seq"))).alias("session"))


def working_set(mem: DataFrame, limit: int = 7) -> DataFrame:
    return mem.where("last_access_at is not null").orderBy(F.desc("last_access_at"), F.desc("seq")).limit(limit).select("id", F.unix_micros("last_access_at").alias("accessed_us"))


def reviewed(mem: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Rows of mem after one review each (outcomes: id, success): strengths, streak, counts and times."""
    rows = with_r(mem, now).join(outcomes.select("id", "success"), "id")
    gap = F.greatest(F.lit(0.0), curve.hours_between(F.coalesce("last_access_at", "created_at"), now))
    grown = curve.review_delta(F.lit(0.1), gap, 1 - F.least(F.lit(1.0), F.col("r")))
    sure = curve.calibrated(curve.confidence(F.col("r"))) >= 0.7
    ok = F.col("success")
    return rows.select(
        "id",
        F.round(F.when(ok, F.least(F.lit(1.0), F.col("strength") + grown)).otherwise(F.greatest(F.lit(0.3), F.col("strength") - 0.05)), 6).alias("strength"),
        F.round(F.when(ok, F.least(F.lit(2.0), F.col("storage_strength") + 0.3 * grown)).otherwise(F.col("storage_strength")), 6).alias("storage_strength"),
        F.when(ok, F.col("review_streak") + 1 - F.when(sure, 0.0).otherwise(0.5)).otherwise(0.0).alias("review_streak"),
        (F.col("retrieval_successes") + ok.cast("long")).alias("retrieval_successes"),
        (F.col("retrieval_failures") + (~ok).cast("long")).alias("retrieval_failures"),
    )
