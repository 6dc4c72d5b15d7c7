"""Intents, plans and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.curve import hours_between
from palimpsest.sources.shared import written


def due_intents(intents: DataFrame, now: Column) -> DataFrame:
    return intents.where("status = 'active'").where(F.col("due_at") <= now).select("id", F.unix_seconds(F.col("due_at").cast("timestamp")).alias("due_s"))


def intent_report(intents: DataFrame, now: Column) -> DataFrame:
    on = F.col("status") == "active"
    return intents.agg(
        F.count_if(on).alias("active"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.count_if(on & (F.col("due_at") < now)).alias("overdue"), F.min_by(F.when(on, F.col("id")), F.when(on & (F.col("due_at") >= now), F.struct("due_at", "id"))).alias("next_id"),
    )


def set_intent(intents: DataFrame, ids: list, status: str) -> DataFrame:
    """Only active intents change."""
    hit = F.col("id").isin(*ids) & (F.col("status") == "active")
    return intents.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def remembered_intents(intents: DataFrame, new: DataFrame) -> DataFrame:
    """Intents and new ones (id, due_at, context_cue); new ones are active, and an id that is known keeps its row."""
    rows = new.join(intents.select("id"), "id", "left_anti").withColumn("status", F.lit("active"))
    return intents.unionByName(rows.select(intents.columns))


def intent_conflicts(intents: DataFrame, minutes: int = 60) -> DataFrame:
    """id_a, id_b, kind of active intents that clash: `time` where they are due within `minutes` of each other, else
    `context` where their cue is the same. Buckets of the window's width meet their own and the next ones, so no pair is
    compared that is further apart than two widths."""
    width = minutes * 60
    t = F.unix_seconds(F.col("due_at").cast("timestamp"))
    rows = intents.where("status = 'active'").select("id", "context_cue", t.alias("t"), F.floor(t / width).alias("b"))
    a = rows.select(F.col("id").alias("id_a"), F.col("t").alias("ta"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    b = rows.select(F.col("id").alias("id_b"), F.col("t").alias("tb"), "b")
    near = a.join(b, "b").where((F.col("id_a") < F.col("id_b")) & (F.abs(F.col("ta") - F.col("tb")) < width)).select("id_a", "id_b", F.lit("time").alias("kind"))
    # A pair of one cue is told by its own times whether it is among the near ones, so no pair is shuffled.
    cue = rows.where("context_cue <> ''")
    a = cue.select(F.col("id").alias("id_a"), F.col("t").alias("ta"), "context_cue")
    b = cue.select(F.col("id").alias("id_b"), F.col("t").alias("tb"), "context_cue")
    apart = ~F.coalesce(F.abs(F.col("ta") - F.col("tb")) < width, F.lit(False))
    same = a.join(b, "context_cue").where((F.col("id_a") < F.col("id_b")) & apart).select("id_a", "id_b", F.lit("context").alias("kind"))
    return near.unionByName(same)


def _at(intents: DataFrame) -> DataFrame:
    """id, context_cue, t (seconds) of the active intents."""
    return intents.where("status = 'active'").select("id", F.coalesce("context_cue", F.lit("")).alias("context_cue"), F.unix_seconds(F.col("due_at").cast("timestamp")).alias("t"))


def clash_count(intents: DataFrame, minutes: int = 60) -> DataFrame:
    """One row, clashes: how many pairs intent_conflicts() would list, without listing them. Intents with the same cue and
    time are one row with a count; a cue's pairs follow from counts, near times are met in buckets of the window's width."""
    width = minutes * 60

    def near_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
        """Pairs less than the width apart: those at one time, and those of times in this bucket or the next."""
        one = rows if by else rows.groupBy("t").agg(F.sum("n").alias("n"))  # rows are one for each cue and time
        one = one.withColumn("b", F.floor(F.col("t") / width))
        same = one.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("x"))
        later = one.select(*by, F.col("t").alias("t2"), F.col("n").alias("n2"), F.explode(F.array("b", F.col("b") - 1)).alias("b"))
        apart = one.join(later, [*by, "b"]).where((F.col("t2") > F.col("t")) & (F.col("t2") - F.col("t") < width)).agg(F.sum(F.col("n") * F.col("n2")).alias("x"))
        return same.unionByName(apart).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("x"))

    rows = written(_at(intents).groupBy("context_cue", "t").agg(F.count("*").alias("n")), "intents")
    named = rows.where("context_cue <> ''")
    cues = named.groupBy("context_cue").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("x"))
    parts = near_pairs(rows, []).unionByName(cues).unionByName(near_pairs(named, ["context_cue"]).select((-F.col("x")).alias("x")))
    return parts.agg(F.sum("x").cast("long").alias("clashes"))


def action_queue(intents: DataFrame, now: Column, limit: int = 20, minutes: int = 60) -> DataFrame:
    """id, overdue, urgent, hours, clash of the active intents, overdue ones first, then by time. Whether one of the `limit`
    rows clashes is told from counts by cue and by time."""
    width = minutes * 60
    rows = intents.where("status = 'active'").withColumn("hours", hours_between(now, F.col("due_at")))
    rows = rows.select("id", (F.col("hours") <= 0).alias("overdue"), (F.col("hours") <= 1).alias("urgent"), F.round("hours", 6).alias("hours"))
    top = rows.orderBy(F.desc("overdue"), "hours", "id").limit(limit)
    every = _at(intents)
    asked = F.broadcast(every.join(F.broadcast(top.select("id")), "id", "left_semi"))  # limit rows
    same = every.where("context_cue <> ''").join(asked.select("context_cue").distinct(), "context_cue", "left_semi").groupBy("context_cue").agg((F.count("*") > 1).alias("cue_clash"))
    times = every.groupBy("t").agg(F.count("*").alias("n")).withColumnRenamed("t", "t2")
    near = asked.join(times, F.abs(F.col("t") - F.col("t2")) < width).groupBy("id").agg((F.sum("n") > 1).alias("time_clash"))
    told = asked.join(same, "context_cue", "left").join(near, "id", "left").select("id", (F.coalesce("cue_clash", F.lit(False)) | F.coalesce("time_clash", F.lit(False))).alias("clash"))
    return top.join(told, "id", "left").withColumn("clash", F.coalesce("clash", F.lit(False)))


def outcome_rates(outcomes: DataFrame, by: str = "step") -> DataFrame:
    """step, trials, rate, confidence of the prediction that it works again."""
    rows = outcomes.groupBy(by).agg(F.count("*").alias("trials"), F.avg(F.col("ok").cast("double")).alias("p"))
    return rows.select(by, "trials", F.round("p", 6).alias("rate"), F.round(2 * F.abs(F.col("p") - 0.5), 6).alias("confidence"))


def outcome_deltas(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """plan_id, step, delta: what past outcomes of a step move it in a plan."""
    signed = outcomes.groupBy("step").agg(F.sum(F.when(F.col("ok"), 1).otherwise(-1)).alias("x"))
    return plan.join(signed, "step", "left").select("plan_id", "step", F.greatest(F.lit(-0.15), F.least(F.lit(0.15), 0.08 * F.coalesce("x", F.lit(0)))).alias("delta"))


def nearest_events(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, side, k, event_id: the two nearest events of the same person before and after each anchor's time.

    Events and anchors of a person are one sorted run; an anchor takes the last two times of events before it and the
    first two after it, so no anchor meets all of a person's events. Events at the same time come in order of their ids.
    """
    times = events.groupBy("person", "event_at").agg(F.slice(F.array_sort(F.collect_list("event_id")), 1, 2).alias("ids"))
    both = times.select("person", F.col("event_at").alias("at"), "ids", F.lit(None).cast(anchors.schema["anchor_id"].dataType).alias("anchor_id")).unionByName(
        anchors.select("person", F.col("anchor_at").alias("at"), F.lit(None).cast(times.schema["ids"].dataType).alias("ids"), "anchor_id")
    )
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    both = both.withColumns({"us": micros, "event": F.when(F.col("ids").isNotNull(), F.struct(micros.alias("us"), "ids"))})
    run = Window.partitionBy("person").orderBy("us")
    before, after = run.rangeBetween(Window.unboundedPreceding, -1), run.rangeBetween(1, Window.unboundedFollowing)
    nearest = {
        "p1": F.last("event", True).over(before), "n1": F.first("event", True).over(after),
    }
    rows = both.withColumns(nearest)
    # The second nearest time is the nearest one's own neighbour.
    own = rows.where("event is not null").select(F.col("person").alias("whose"), F.col("us").alias("u"), F.col("p1").alias("p2"), F.col("n1").alias("n2"))
    asked = rows.where("anchor_id is not null").select("person", "anchor_id", F.col("us").alias("at"), "p1", "n1")
    sides = []
    for side, one, two in (("before", "p1", "p2"), ("after", "n1", "n2")):
        found = asked.where(f"{one} is not null").join(own, (F.col("person") == F.col("whose")) & (F.col(f"{one}.us") == F.col("u")))
        near = F.flatten(F.transform(F.array_compact(F.array(one, two)), lambda e: F.transform(e["ids"], lambda i: F.struct(e["us"].alias("us"), i.alias("event_id")))))
        sides.append(found.select("anchor_id", "at", F.lit(side).alias("side"), F.explode(F.slice(near, 1, 2)).alias("e")))
    out = sides[0].unionByName(sides[1]).select("anchor_id", "side", "e.event_id", F.abs(F.col("e.us") - F.col("at")).alias("gap"))
    # An anchor id that stands for several times takes the nearest of all.
    return out.withColumn("k", F.row_number().over(Window.partitionBy("anchor_id", "side").orderBy("gap", "event_id"))).where("k <= 2").select("anchor_id", "side", "k", "event_id")
