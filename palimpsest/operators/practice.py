"""Practice: what to practise, answers scored, rivals weakened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import curve
from palimpsest.functions.lexicon import AROUSED
from palimpsest.operators import review

# Hours of steps by what they mention, the first that fits.
STEP_HOURS = {"需求": 4.0, "设计": 6.0, "架构": 6.0, "开发": 8.0, "实现": 8.0, "测试": 5.0, "功能": 8.0, "部署": 3.0, "上线": 3.0, "文档": 3.0, "复盘": 2.0, "总结": 2.0}


def answered(mem: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """id, success, generated, strength, review_streak after one answer each (answers: id, attempt). Right is what
    contains the memory or is contained in it, without white space, or shares 60 % of its own characters with it."""
    squeeze = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", "")
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    rows = review.with_r(mem, now).join(answers.select("id", "attempt"), "id").withColumns({"a": squeeze(F.col("attempt")), "c": squeeze(F.col("content"))})
    own = letters(F.col("a"))
    shared = F.size(F.array_intersect(own, letters(F.col("c"))))
    right = (F.length("a") > 0) & (F.col("c").contains(F.col("a")) | F.col("a").contains(F.col("c")) | ((F.length("a") >= 2) & (shared >= 2) & (shared / F.greatest(F.size(own), F.lit(1)) >= 0.6)))
    rows = rows.withColumn("success", right).withColumn("generated", right & (F.col("a") != F.col("c")))
    gap = F.greatest(F.lit(0.0), curve.hours_between(F.coalesce("last_access_at", "created_at"), now))
    grown = curve.review_delta(F.when(F.col("generated"), 0.12 * 1.15).otherwise(0.12), gap, 1 - F.least(F.lit(1.0), F.col("r")))
    return rows.select("id", "success", "generated", F.round(F.least(F.lit(1.0), F.col("strength") + F.when(F.col("success"), grown).otherwise(0.05)), 6).alias("strength"), F.when(F.col("success"), F.col("review_streak") + 1).otherwise(0.0).alias("review_streak"))


def suppressed(mem: DataFrame, practised: DataFrame, factor: float = 0.97) -> DataFrame:
    """id, strength of the rivals of practised memories (id): others under their first cue, once for each."""
    n = practised.join(mem, "id").groupBy(F.get("cues", 0).alias("cue")).agg(F.count("*").alias("n"))
    mine = practised.select("id", F.lit(1).alias("own"))
    rows = mem.select("id", "strength", F.get("cues", 0).alias("first"), F.explode("cues").alias("cue")).join(n, "cue").join(mine, "id", "left")
    times = F.sum(F.col("n") - F.when((F.col("own") == 1) & (F.col("first") == F.col("cue")), 1).otherwise(0))
    return rows.groupBy("id", "strength").agg(times.alias("t")).where("t > 0").select("id", F.round(F.greatest(F.lit(0.05), F.col("strength") * F.pow(F.lit(factor), F.col("t"))), 6).alias("strength"))


def tests(mem: DataFrame) -> DataFrame:
    """id, kind, prompt: by turns a cue to answer from, and the text with its tail left out."""
    turn = F.row_number().over(Window.partitionBy(review.topic()).orderBy(F.desc("importance"), F.desc("seq"))) % 2
    n = F.length("content")
    return mem.select("id", F.when(turn == 1, "cue").otherwise("cloze").alias("kind"), F.when(turn == 1, F.get("cues", 0)).otherwise(F.concat(F.substring(F.col("content"), F.lit(1), n - F.floor(n / 3).cast("int")), F.lit("____"))).alias("prompt"))


def success_rate() -> Column:
    return F.when(curve.attempts() > 0, F.col("retrieval_successes") / F.nullif(curve.attempts(), F.lit(0))).otherwise(0.5)


def due(mem: DataFrame, now: Column, limit: int = 5, kind: str | None = None, gap_hours: float = 24.0) -> DataFrame:
    """id, cue, turn: memories to practise, shown by two of their cues only, which change with each attempt.

    Of those due (retrievability under 0.5) the 2 * limit (12 at least) of the most useful difficulty, and of aroused ones
    under 0.65 half the limit more; none that was seen within the gap (shorter for struggling memories, longer for known
    ones). The kind asked for and aroused ones come first; then turns alternate between topics.
    """
    pool = max(2 * limit, 12)
    rows = review.with_r(mem, now).withColumn("hard", F.round(F.abs(F.col("r") - 0.45), 9))
    felt = F.coalesce(F.col("affect").isin(*AROUSED), F.lit(False))
    first = rows.where("r < 0.5").orderBy("hard", F.desc("seq")).limit(pool)
    wider = rows.where("r < 0.65").orderBy("hard", F.desc("seq")).limit(pool).where(felt)
    extra = wider.join(first.select("id"), "id", "left_anti").orderBy("hard", F.desc("seq")).limit(max(1, limit // 2))
    columns = first.columns
    rows = first.withColumn("late", F.lit(0)).unionByName(extra.select(columns).withColumn("late", F.lit(1)))
    rate, tried = success_rate(), curve.attempts() > 0
    gap = gap_hours * F.when(tried & (rate < 0.5), 0.6).when(tried & (rate >= 0.9), 1.3).otherwise(1.0)
    rows = rows.where(curve.hours_idle(now) >= gap)
    other = [] if kind is None else [F.col("kind") != kind]
    order = [*other, (~felt).cast("int"), F.col("late"), F.col("hard"), F.desc("seq")]
    rows = rows.orderBy(*order).limit(limit).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # `limit` rows
    turn = F.row_number().over(Window.partitionBy(review.topic()).orderBy("k"))
    rows = rows.withColumn("lap", turn)
    n = F.size("cues")
    start = (curve.attempts() % F.greatest(n, F.lit(1))).cast("int")
    two = F.when(n >= 3, F.array(F.get("cues", start), F.get("cues", (start + 1) % n))).when(n > 0, F.slice("cues", 1, 2)).otherwise(F.array(F.substring("content", 1, 12)))
    return rows.select("id", F.array_join(two, " / ").alias("cue"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lap", "k")).alias("turn"))


def plan(cards: DataFrame, mem: DataFrame, now: Column) -> DataFrame:
    """id, cue, kind, next_review_s, overdue, retrievability, success_rate of the cards of a session."""
    rows = review.with_r(mem, now).join(cards.select("id", "cue"), "id")
    at = curve.next_review_at(now)
    return rows.select("id", "cue", "kind", F.unix_seconds(at).alias("next_review_s"), (at < now).alias("overdue"), F.round("r", 6).alias("retrievability"), F.round(success_rate(), 6).alias("success_rate"))


def forecast(mem: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """id, due_s, overdue, retrievability of the memories whose review falls within so many days (365 at most)."""
    at = curve.next_review_at(now)
    rows = review.with_r(mem, now).withColumn("at", at).where(F.col("at") <= curve.add_hours(now, F.lit(24.0 * min(max(1, days), 365))))
    return rows.select("id", F.unix_seconds("at").alias("due_s"), (F.col("at") < now).alias("overdue"), F.round("r", 6).alias("retrievability"))


def report(mem: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """One row on a round of answers (id, attempt): how many, how many right, and how hard they were."""
    scored = answered(mem, answers, now).select("id", "success")
    rows = review.with_r(mem, now).join(scored, "id")
    n = F.count("*")
    return rows.agg(
        n.alias("n"), F.count_if("success").alias("successes"), (n - F.count_if("success")).alias("failures"), F.round(F.count_if("success") / F.nullif(n, F.lit(0)), 3).alias("success_rate"),
        F.round(F.avg("r"), 3).alias("mean_retrievability"), F.round(F.min("r"), 3).alias("min_retrievability"), F.round(F.max("r"), 3).alias("max_retrievability"),
    )


def review_batch(mem: DataFrame, answers: DataFrame) -> DataFrame:
    """id, reviews, retrieval_successes, retrieval_failures, review_streak after answers (id, pos, success) one after the
    other: the streak is what follows the last failure, or all of them on top of the old one."""
    order = Window.partitionBy("id").orderBy("pos")
    back = Window.partitionBy("id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = answers.withColumn("__fails", F.sum((~F.col("success")).cast("int")).over(back)).withColumn("__n", F.row_number().over(order))
    sums = rows.groupBy("id").agg(F.count("*").alias("reviews"), F.count_if("success").alias("good"), F.count_if(~F.col("success")).alias("bad"), F.count_if(F.col("__fails") == 0).alias("tail"))
    streak = F.when(F.col("bad") == 0, F.col("review_streak") + F.col("good")).otherwise(F.col("tail").cast("double"))
    return mem.join(sums, "id").select("id", "reviews", (F.col("retrieval_successes") + F.col("good")).alias("retrieval_successes"), (F.col("retrieval_failures") + F.col("bad")).alias("retrieval_failures"), streak.alias("review_streak"))


def learning_loop(mem: DataFrame, now: Column) -> DataFrame:
    """One row: the topic to practise (the least mastered), how many reviews are overdue, and the figures to compare with
    afterwards."""
    from palimpsest.operators import insights, reports

    focus = reports.mastery(mem, now).agg(F.min_by("topic", F.struct("mastery", "topic")).alias("focus"))
    late = review.consistency(mem, now).select(F.col("overdue").alias("overdue"), "adherence")
    return focus.crossJoin(F.broadcast(late)).crossJoin(F.broadcast(insights.snapshot(mem, now)))  # rows of one each


def measures(one: DataFrame, part: str) -> DataFrame:
    """A row of figures as rows: part, id (null), detail (the figure's name), value."""
    figures = [F.struct(F.lit(c).alias("detail"), F.col(c).cast("double").alias("value")) for c in one.columns]
    return one.select(F.explode(F.array(*figures)).alias("f")).select(F.lit(part).alias("part"), F.lit(None).cast("string").alias("id"), "f.detail", "f.value")


def session(mem: DataFrame, answers: DataFrame, now: Column, limit: int = 5) -> DataFrame:
    """part, id, detail, value: the coming session's cards (`plan`: cue and retrievability) and the report on the answers of
    the one that ends (`report`: figures)."""
    cards = plan(due(mem, now, limit), mem, now).select(F.lit("plan").alias("part"), "id", F.col("cue").alias("detail"), F.col("retrievability").alias("value"))
    return cards.unionByName(measures(report(mem, answers, now), "report"))


def night_and_plan(mem: DataFrame, slept: DataFrame, phases: DataFrame, now: Column, days: int = 7, limit: int = 10) -> DataFrame:
    """part, id, detail, value: what each phase of the night touched (`sleep`, of mem), and on the memories as it left them
    (slept) the cards to practise (`plan`) and the coming reviews (`forecast`: hours until each)."""
    cards = plan(due(slept, now, limit), slept, now).select(F.lit("plan").alias("part"), "id", F.col("cue").alias("detail"), F.col("retrievability").alias("value"))
    ahead = forecast(slept, now, days).select(F.lit("forecast").alias("part"), "id", F.when(F.col("overdue"), "overdue").otherwise("due").alias("detail"), F.round((F.col("due_s") - F.unix_seconds(now)) / 3600, 3).alias("value"))
    return measures(phases, "sleep").unionByName(cards).unionByName(ahead)


def learning_session(mem: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """part, id, detail, value: figures before (`before`), each answer (`answer`: right or wrong, and the strength it leaves),
    figures on the memories after them (`after`), and what they changed by (`change`)."""
    from palimpsest.operators import insights

    scored = answered(mem, answers, now)
    told = scored.select(F.lit("answer").alias("part"), "id", F.when(F.col("success"), "right").otherwise("wrong").alias("detail"), F.col("strength").alias("value"))
    new = scored.select("id", F.col("strength").alias("__s"), F.col("success").alias("__ok"))
    rows = mem.join(new, "id", "left")
    tried = F.col("__ok").isNotNull()
    rows = rows.withColumns({
        "strength": F.coalesce("__s", "strength"),
        "retrieval_successes": F.col("retrieval_successes") + F.coalesce(F.col("__ok").cast("long"), F.lit(0)),
        "retrieval_failures": F.col("retrieval_failures") + F.when(tried & ~F.col("__ok"), 1).otherwise(0),
    }).drop("__s", "__ok")
    before, after = measures(insights.snapshot(mem, now), "before"), measures(insights.snapshot(rows, now), "after")
    change = before.withColumnRenamed("value", "old").join(after.select("detail", F.col("value").alias("new")), "detail").select(F.lit("change").alias("part"), "id", "detail", F.round(F.col("new") - F.col("old"), 6).alias("value"))
    return before.unionByName(told).unionByName(after).unionByName(change)
