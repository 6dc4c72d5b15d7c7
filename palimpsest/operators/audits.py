"""Audits: the state of a store, what recall did stage by stage, and what is known about an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import curve
from palimpsest.operators import graph, recall, reports, review
from palimpsest.operators.recall import COMMON_TERM, LARGE_STORE

NO_TOPIC = "（无标签）"


def memory_audit(mem: DataFrame, conflicts: DataFrame, now: Column) -> DataFrame:
    """One row: active, recycled, semantic, episodic, revised and emotional memories, conflicts, what is due now, mean
    retrievability and importance."""
    on = F.col("status") == "active"
    r = curve.retrievability(now)
    one = mem.agg(
        F.count_if(on).alias("active"), F.count_if(F.col("status") == "recycled").alias("recycled"), F.count_if(on & (F.col("kind") == "semantic")).alias("semantic"),
        F.count_if(on & (F.col("kind") == "episodic")).alias("episodic"), F.count_if(on & (F.col("revision_count") > 0)).alias("revised"), F.count_if(on & F.col("affect").isNotNull()).alias("emotional"),
        F.count_if(on & (r < 0.5)).alias("due_now"), F.round(F.coalesce(F.avg(F.when(on, r)), F.lit(0.0)), 3).alias("avg_retrievability"), F.round(F.avg(F.when(on, F.col("importance"))), 6).alias("avg_importance"),
    )
    return one.crossJoin(F.broadcast(conflicts.agg(F.count("*").alias("conflicts"))))  # rows of one each


def check(queries: DataFrame, found: DataFrame, mem: DataFrame, terms: DataFrame, cues: DataFrame, conflicts: DataFrame, now: Column) -> DataFrame:
    """query_id, part, name, label: what is known about each answer. `item`: a result and how sure it is (label); `gap`: a
    word that no memory has; `blocked`: a memory that shares a cue with the query, but was not recalled; `conflict`: how
    many contradictions the store holds (label), for every query."""
    none = F.lit(None).cast("string")
    sure = reports.confidences(mem, now).select("id", "label")
    items = found.select("query_id", "id").join(sure, "id").select("query_id", F.lit("item").alias("part"), F.col("id").alias("name"), "label")
    gaps = recall.gaps(queries, terms).select("query_id", F.lit("gap").alias("part"), F.explode("gaps").alias("name"), none.alias("label"))
    blocked = recall.blocked(queries, found, cues).select("query_id", F.lit("blocked").alias("part"), F.col("id").alias("name"), none.alias("label"))
    number = conflicts.agg(F.count("*").cast("string").alias("label"))
    clash = queries.select("query_id").crossJoin(F.broadcast(number)).select("query_id", F.lit("conflict").alias("part"), none.alias("name"), "label")  # number is one row
    return items.unionByName(gaps).unionByName(blocked).unionByName(clash)


def recall_trace(queries: DataFrame, mem: DataFrame, items: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, stage, n: how many memories each stage of a recall left. `store`, `terms` (share a term with the query),
    `brought` (by a term that is not too common), `scored` (the best of them), `returned`."""
    hits = recall.known_terms(queries, items).join(recall.weighted_terms(queries, items), "term")
    brings = (F.col("df") <= COMMON_TERM) | (F.col("n") < LARGE_STORE)
    per = hits.groupBy("query_id", "id").agg(F.count_if(brings).alias("brought"))
    counts = per.groupBy("query_id").agg(F.count("*").alias("terms"), F.count_if(F.col("brought") > 0).alias("brought"))
    back = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("returned"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = queries.select("query_id").join(counts, "query_id", "left").join(back, "query_id", "left").crossJoin(F.broadcast(mem.agg(F.count("*").alias("store"))))  # one row
    stages = {"store": F.col("store"), "terms": zero("terms"), "brought": zero("brought"), "scored": F.least(zero("brought"), F.lit(recall.CANDIDATES).cast("long")), "returned": zero("returned")}
    return rows.select("query_id", F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), c.cast("long").alias("n")) for s, c in stages.items()))).alias("s")).select("query_id", "s.stage", "s.n")


def _firsts(rows: DataFrame, by: list[str], order: Column, k: int, what: Column) -> DataFrame:
    """Of each group the k rows that come first, as an array: groups are cut to k in every task before they meet, so a group
    of any size is no more than k rows a task."""
    bucket = rows.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(64))).withColumns({"__o": order, "__w": what})
    cut = bucket.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__o"))).where(F.col("__k") <= k)
    return cut.groupBy(*by).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("__o", "__w"))), 1, k), lambda x: x["__w"]).alias("firsts"))


def schema_samples(mem: DataFrame, k: int = 3, letters: int = 24) -> DataFrame:
    """topic, n, avg_importance, facts, episodes, samples: groups by first cue, with the beginnings of their first k
    memories."""
    rows = mem.withColumn("topic", F.coalesce(F.get("cues", 0), F.lit(NO_TOPIC)))
    sums = rows.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("avg_importance"), F.count_if(F.col("kind") == "semantic").alias("facts"), F.count_if(F.col("kind") == "episodic").alias("episodes"))
    return sums.join(_firsts(rows, ["topic"], F.struct("seq", "id"), k, F.substring("content", 1, letters)).withColumnRenamed("firsts", "samples"), "topic")


def life_highlights(mem: DataFrame, days: int = 14, epoch: str = "2023-01-01", k: int = 3) -> DataFrame:
    """period, start, stop, events, avg_importance, highlights (ids, the most important first) of each life period."""
    day = F.datediff(F.to_date("created_at"), F.lit(epoch).cast("date"))
    rows = mem.withColumn("period", F.floor(day / days).cast("int"))
    sums = rows.groupBy("period").agg(F.count("*").alias("events"), F.round(F.avg("importance"), 6).alias("avg_importance"))
    top = _firsts(rows, ["period"], F.struct(-F.col("importance"), -F.col("seq"), F.col("id")), k, F.col("id")).withColumnRenamed("firsts", "highlights")
    start = F.date_add(F.lit(epoch).cast("date"), F.col("period") * days)
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    return sums.join(top, "period").select("period", text(start).alias("start"), text(F.date_add(start, days - 1)).alias("stop"), "events", "avg_importance", "highlights")


def timeline_items(mem: DataFrame, start: Column | None = None, end: Column | None = None, limit: int = 100) -> DataFrame:
    """day, id, importance of the earliest episodes in a range of time, in order."""
    rows = mem.where("kind = 'episodic'")
    rows = rows.where(F.col("created_at") >= start) if start is not None else rows
    rows = rows.where(F.col("created_at") < end) if end is not None else rows
    top = rows.orderBy("created_at", "seq").limit(limit)
    return top.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "id", F.round("importance", 3).alias("importance"))


def learner_scale(mem: DataFrame, now: Column) -> DataFrame:
    """One row: memories, reviews, their success rate, mean retrievability and importance, the pace of learning and by what
    review intervals should be scaled."""
    s, n = F.sum("retrieval_successes"), F.sum(curve.attempts())
    rate = s / F.nullif(n, F.lit(0))
    one = mem.agg(F.count("*").alias("memories"), n.alias("reviews"), F.round(rate, 3).alias("success_rate"), F.round(F.avg(curve.retrievability(now)), 3).alias("avg_retrievability"), F.round(F.avg("importance"), 3).alias("avg_importance"), rate.alias("__rate"))
    pace = F.when(F.col("__rate").isNull(), "unknown").when(F.col("__rate") >= 0.8, "fast").when(F.col("__rate") >= 0.6, "steady").otherwise("struggling")
    return one.withColumn("pace", pace).withColumn("scale", F.when(F.col("pace") == "fast", 1.2).when(F.col("pace") == "struggling", 0.8).otherwise(1.0)).drop("__rate")


def rumination_verdict(mem: DataFrame, least: int = 5) -> DataFrame:
    """One row: negative memories, those that are called up too often, the most of one topic, and the risk: high from three
    such memories or two of a topic on, medium from one."""
    negative = mem.where(F.col("affect").isin("negative", "arousing"))
    risky = F.col("access_count") >= least
    per = negative.groupBy(review.topic().alias("topic")).agg(F.count("*").alias("n"), F.count_if(risky).alias("risky"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("negative"), F.coalesce(F.sum("risky"), F.lit(0)).alias("risky"), F.coalesce(F.max("risky"), F.lit(0)).alias("most_of_topic"))
    return one.withColumn("risk", F.when((F.col("risky") >= 3) | (F.col("most_of_topic") >= 2), "high").when(F.col("risky") > 0, "medium").otherwise("low"))


def context_packs(found: DataFrame, mem: DataFrame, budget: int = 1200) -> DataFrame:
    """pack, place, id, score, used: of the results of a pack's questions (pack, id, score, overlap; those that words found)
    each memory once by its best score, as many in order as fit the number of characters. What doesn't fit is passed over;
    the first always fits. A pack holds its questions' few results, so it is packed in one row."""
    best = found.where("overlap > 0").groupBy("pack", "id").agg(F.max("score").alias("score"))
    rows = best.join(mem.select("id", "seq", F.length("content").alias("letters")), "id")
    rows = rows.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("seq")).alias("q"), "id", "letters"))).alias("rows"))
    kept = F.array().cast("array<struct<id:string,score:double,used:int>>")
    start = F.struct(F.lit(0).alias("used"), kept.alias("kept"))

    def step(a: Column, x: Column) -> Column:
        used = a["used"] + x["letters"]
        took = F.struct(used.alias("used"), F.concat(a["kept"], F.array(F.struct(x["id"].alias("id"), (-x["s"]).alias("score"), used.alias("used")))).alias("kept"))
        return F.when((F.size(a["kept"]) == 0) | (used <= budget), took).otherwise(a)

    return rows.select("pack", F.posexplode(F.aggregate("rows", start, step)["kept"]).alias("place", "k")).select("pack", "place", "k.id", F.round("k.score", 6).alias("score"), "k.used")


def attention(found: DataFrame, mem: DataFrame, k: int = 5) -> DataFrame:
    """query_id, part, place, id, all: what belongs to a task and what would only distract. `relevant` are its results (rank
    up to k, at most 500); `suppressed` the first k other memories that are strong (0.7) and important (0.6), the strongest
    first; `all` says how many the part has in the whole store. Of the strong ones only the first 2k can come into any
    task's k, so no task meets the store."""
    strong = mem.where("strength >= 0.7 and importance >= 0.6")
    order = [F.desc("strength"), F.desc("importance"), F.desc("seq")]
    top = strong.orderBy(*order).limit(2 * k).select("id", "strength", "importance", "seq")
    number = strong.agg(F.count("*").alias("strong"))
    hits = found.where(F.col("rank") <= k).select("query_id", "id", "rank")
    per = hits.join(strong.select("id", F.lit(1).alias("s")), "id", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("s").alias("own"))
    relevant = hits.join(per, "query_id").select("query_id", F.lit("relevant").alias("part"), F.col("rank").cast("long").alias("place"), "id", F.col("n").alias("all"))
    rest = per.crossJoin(F.broadcast(number)).crossJoin(F.broadcast(top))  # one row, and 2k rows at most
    rest = rest.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")
    rest = rest.select("query_id", F.lit("suppressed").alias("part"), place.alias("place"), "id", (F.col("strong") - F.col("own")).alias("all"))
    return relevant.unionByName(rest.where(F.col("place") <= k))


def retrieval_quality(queries: DataFrame, found: DataFrame) -> DataFrame:
    """One row: questions, share of them whose first result shares a word (hits) and of the others, mean score and
    retrievability of first results, and the verdict: good from 0.8 hits, fair from 0.5, else poor."""
    top = found.where("rank = 1").select("query_id", "score", "retrievability", (F.col("overlap") > 0).cast("int").alias("hit"))
    rate = F.coalesce(F.round(F.try_divide(F.coalesce(F.sum("hit"), F.lit(0)), F.count("*")), 3), F.lit(0.0))
    mean = lambda c: F.coalesce(F.round(F.avg(c), 3), F.lit(0.0))
    weak = F.coalesce(F.round(F.try_divide(F.count("*") - F.coalesce(F.sum("hit"), F.lit(0)), F.count("*")), 3), F.lit(0.0))
    one = queries.select("query_id").join(top, "query_id", "left").agg(F.count("*").alias("evaluated"), rate.alias("hit_rate"), weak.alias("weak_rate"), mean("score").alias("avg_top_score"), mean("retrievability").alias("avg_top_retrievability"))
    return one.withColumn("verdict", F.when(F.col("hit_rate") >= 0.8, "good").when(F.col("hit_rate") >= 0.5, "fair").otherwise("poor"))


def explained(mem: DataFrame, links: DataFrame, suppressed: DataFrame, now: Column) -> DataFrame:
    """The state of each memory in plain fields: how reachable it is, what it rests on, its links (each counts from both
    sides), and whether it is suppressed (id)."""
    degree = graph.degrees(links).select("id", (2 * F.col("degree")).alias("linked_count"))
    rows = review.with_r(mem, now).join(degree, "id", "left").join(suppressed.select("id", F.lit(True).alias("suppressed")).distinct(), "id", "left")
    three = lambda c: F.round(c, 3).alias(c)
    return rows.select(
        "id", "kind", "cues", F.round("r", 3).alias("retrievability"), three("importance"), three("strength"), three("confidence"), "evidence_count", F.coalesce("linked_count", F.lit(0)).alias("linked_count"),
        F.coalesce("suppressed", F.lit(False)).alias("suppressed"), "access_count", "last_access_at", "review_streak", "last_review_at",
    )


def emotion_advice(mem: DataFrame, k: int = 3) -> DataFrame:
    """One row: memories by affect, the share of negative ones, the k topics that hold most of these (most first, then by
    name), and what to do: `reappraise` from 0.4, `rewrite` from 0.2, else `keep`."""
    n = lambda a: F.count_if(F.col("affect") == a).alias(a)
    ratio = F.coalesce(F.round(F.try_divide(F.count_if(F.col("affect") == "negative"), F.count("*")), 3), F.lit(0.0))
    neutral = F.count_if(F.col("affect").isNull() | (F.col("affect") == "neutral"))
    one = mem.agg(F.count("*").alias("memories"), n("positive"), n("negative"), n("arousing"), neutral.alias("neutral"), ratio.alias("negative_ratio"))
    topics = mem.where("affect = 'negative' and size(cues) > 0").groupBy(F.get("cues", 0).alias("topic")).agg(F.count("*").alias("n"))
    top = topics.orderBy(F.desc("n"), "topic").limit(k)
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "topic"))), lambda x: F.concat(x["topic"], F.lit(":"), (-x["o"]).cast("string"))), ",").alias("topics"))  # k rows
    advice = F.when(F.col("negative_ratio") >= 0.4, "reappraise").when(F.col("negative_ratio") >= 0.2, "rewrite").otherwise("keep")
    return one.crossJoin(F.broadcast(top)).withColumn("advice", advice)  # rows of one each
