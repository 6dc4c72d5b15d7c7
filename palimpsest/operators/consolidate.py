"""Consolidation: the phases of the nightly batch job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import curve, text
from palimpsest.functions.lexicon import AROUSED
from palimpsest.operators import graph, index
from palimpsest.sources.shared import written

#: The rule of a night: so many links of shared cues at most, the heaviest ones. The links themselves have no bound.
REM_BUDGET = 200_000
#: Cues of more episodes than that link none in a night.
REM_COMMON = 500


def replay_recent(mem: DataFrame, now: Column, newest: int = 64) -> DataFrame:
    """id, strength, storage_strength of recent important episodes after replay."""
    top = mem.where("kind = 'episodic'").orderBy(F.desc("seq")).limit(newest)
    age = curve.hours_between(F.col("created_at"), now) / 24.0
    rows = top.withColumn("age", age).where("age <= 7 and importance >= 0.4")
    gain = 0.02 * (1 - 0.5 * F.col("age") / 7.0) * (0.5 + F.col("importance"))
    return rows.select("id", F.round(F.least(F.lit(1.0), F.col("strength") + gain), 6).alias("strength"), F.round(F.least(F.lit(2.0), F.col("storage_strength") + gain), 6).alias("storage_strength"))


def merge_duplicates(mem: DataFrame) -> DataFrame:
    """Episodes of one hash: the first stays with the evidence of all; survivor and what it becomes."""
    rows = mem.where("kind = 'episodic'").groupBy("content_hash").agg(
        F.count("*").alias("n"), F.min_by("id", F.struct("seq", "id")).alias("id"), F.min_by("evidence_count", F.struct("seq", "id")).alias("own"),
        F.sum("evidence_count").alias("all_evidence"), F.max("importance").alias("importance"), F.min_by("confidence", F.struct("seq", "id")).alias("confidence"),
    )
    return rows.where("n > 1").select("id", "n", F.greatest("own", "all_evidence").alias("evidence_count"), "importance", F.round(F.least(F.lit(1.0), F.col("confidence") + 0.05 * (F.col("n") - 1)), 6).alias("confidence"))


def promote(mem: DataFrame, now: Column) -> DataFrame:
    """Episodes that become facts: often used, old enough, and important."""
    moved = F.col("affect").isin(*AROUSED)
    moved = F.coalesce(moved, F.lit(False))
    age = curve.hours_between(F.col("created_at"), now)
    rows = mem.where("kind = 'episodic'").where((F.col("access_count") >= F.when(moved, 1).otherwise(2)) & (age >= F.when(moved, 12).otherwise(24)) & ((F.col("importance") >= 0.6) | (F.col("access_count") >= 3)))
    known = mem.where("kind = 'semantic'").groupBy("content_hash").agg(F.min("id").alias("fact"))
    rows = rows.join(known, "content_hash", "left")
    sure = F.least(F.lit(1.0), 0.6 + 0.08 * F.col("evidence_count") + F.when(moved, 0.05).otherwise(0.0))
    return rows.select("id", F.col("fact").isNotNull().alias("known"), F.size("cues").alias("n_cues"), F.round(sure, 6).alias("confidence"))


def prunable(mem: DataFrame, now: Column) -> DataFrame:
    return mem.where("importance < 0.2 and access_count = 0").where(curve.hours_between(F.col("created_at"), now) >= 720).select("id", "importance")


def weak_replay(mem: DataFrame, now: Column, most: int = 100) -> DataFrame:
    rows = mem.withColumn("r", curve.retrievability(now)).where("kind = 'semantic' and importance >= 0.6 and r < 0.35").orderBy(F.desc("importance"), F.desc("seq")).limit(most)
    gain = 0.03 * (0.5 + F.col("importance"))
    return rows.select("id", F.round(F.least(F.lit(1.0), F.col("strength") + gain), 6).alias("strength"), F.round(F.least(F.lit(2.0), F.col("storage_strength") + gain), 6).alias("storage_strength"))


def conflicts(mem: DataFrame, per_cue: int = 120, pairs_per_cue: int = 1000) -> DataFrame:
    """id_a, id_b, cue: sure facts under one cue that differ and share a word that is not the cue's. Words come to the facts of a
    cue once each, before they are paired, so no pair carries words through a shuffle."""
    facts = mem.where("kind = 'semantic' and confidence >= 0.6")
    facts = written(facts.select("id", "seq", "content_hash", "confidence", "importance", "cues", F.array_distinct(text.tokenize(F.col("content"))).alias("words")), "facts")
    rows = facts.select(F.explode("cues").alias("cue"), "id", "seq", "content_hash", "confidence", "importance")
    best = Window.partitionBy("cue").orderBy(F.desc("confidence"), F.desc("importance"), F.desc("seq"))
    rows = rows.withColumn("k", F.row_number().over(best)).where(F.col("k") <= per_cue)
    rows = rows.select("cue", "id", "k", F.col("content_hash").alias("h"))
    several = rows.groupBy("cue").agg(F.count("*").alias("n")).where("n > 1").select("cue")
    rows = rows.join(several, "cue", "left_semi").join(facts.select("id", "words"), "id")
    rows = rows.select("cue", "id", "k", "h", F.array_except("words", text.tokenize(F.col("cue"))).alias("w"))
    side = lambda of: rows.select("cue", *(F.col(c).alias(f"{c}_{of}") for c in ("id", "k", "h", "w")))
    pairs = side("a").join(side("b"), "cue").where("k_a < k_b and h_a <> h_b and arrays_overlap(w_a, w_b)").select("cue", "id_a", "id_b", "k_a", "k_b")
    pairs = pairs.withColumn("p", F.row_number().over(Window.partitionBy("cue").orderBy("k_a", "k_b"))).where(F.col("p") <= pairs_per_cue)
    return pairs.groupBy(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).agg(F.min("cue").alias("cue"))


def emotion_growth(mem: DataFrame) -> DataFrame:
    rows = mem.where(F.col("affect").isin(*AROUSED) & (F.col("evidence_count") >= 2))
    e = F.col("evidence_count") - 1
    return rows.select(
        "id",
        F.round(F.least(F.lit(1.0), F.col("confidence") + 0.03 * e), 6).alias("confidence"),
        F.round(F.least(F.lit(2.0), F.col("storage_strength") + 0.05 * e), 6).alias("storage_strength"),
        F.round(F.least(F.lit(1.0), F.col("strength") + 0.03), 6).alias("strength"),
    )


def emotion_links(mem: DataFrame, most: int = 500) -> DataFrame:
    felt = mem.where(F.col("affect").isin(*AROUSED))
    rows = graph.cue_rows(felt, most).join(felt.select("id", "content_hash"), "id")
    a = rows.select("cue", F.col("id").alias("src"), F.col("content_hash").alias("ha"))
    b = rows.select("cue", F.col("id").alias("dst"), F.col("content_hash").alias("hb"))
    return a.join(b, "cue").where("src < dst and ha <> hb").select("src", "dst").distinct().withColumn("weight", F.lit(1.2))


def accommodated(mem: DataFrame) -> DataFrame:
    """Facts that a fact of the same cue outweighs three times in evidence with no less trust."""
    sure = mem.where("kind = 'semantic' and confidence >= 0.5")
    rows = sure.select(F.explode("cues").alias("cue"), "id", "evidence_count", "trust")
    # For each cue and trust, the most evidence is all that can outweigh: it meets before the join.
    best = rows.groupBy("cue", F.col("trust").alias("t")).agg(F.max("evidence_count").alias("e"))
    return rows.join(best, "cue").where("e >= 3 * evidence_count and t >= trust").select("id").distinct()


def advice(mem: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """For each conflict, which side to prefer, or `clarify` where they are close."""
    age = curve.hours_between(F.col("created_at"), now)
    score = 2 * F.col("evidence_count") + F.col("confidence") + F.col("importance") + 0.2 * F.least(F.col("access_count"), F.lit(5)) + F.col("trust") + 1 / (1 + age / 168)
    s = mem.select("id", F.round(score, 6).alias("s"))
    rows = pairs.join(s.select(F.col("id").alias("id_a"), F.col("s").alias("score_a")), "id_a").join(s.select(F.col("id").alias("id_b"), F.col("s").alias("score_b")), "id_b")
    gap = F.col("score_a") - F.col("score_b")
    return rows.select("id_a", "id_b", "score_a", "score_b", F.when(F.abs(gap) < 0.08, "clarify").when(gap > 0, F.col("id_a")).otherwise(F.col("id_b")).alias("prefer"))


def sleep_report(mem: DataFrame, now: Column) -> DataFrame:
    """One row of how many memories each phase touches."""
    counts = {
        "replayed": replay_recent(mem, now), "merged": merge_duplicates(mem), "promoted": promote(mem, now), "pruned": prunable(mem, now),
        "strengthened": weak_replay(mem, now), "conflicts": conflicts(mem), "rem_links": rem_of(mem), "accommodated": accommodated(mem),
    }
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # rows of one each
    return out


def rem_of(mem: DataFrame) -> DataFrame:
    return graph.rem_links(mem, REM_COMMON, REM_BUDGET)


def sleep(mem: DataFrame, links: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The memories and links after a night: each phase works on what the one before left, checkpointed between."""
    on = lambda m: m.where("status = 'active'")

    def put(m: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
        side = new.select("id", *(F.col(c).alias(f"__{c}") for c in columns))
        return m.join(side, "id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns)).checkpoint()

    mem = put(mem, replay_recent(on(mem), now), ["strength", "storage_strength"])
    merged = merge_duplicates(on(mem))
    losers = on(mem).where("kind = 'episodic'").join(merged.join(mem.select("id", "content_hash"), "id").select("content_hash", F.col("id").alias("keeper")), "content_hash").where("id <> keeper").select("id")
    mem = put(mem, merged, ["evidence_count", "importance", "confidence"])
    mem = mem.join(losers.withColumn("__x", F.lit(1)), "id", "left").withColumn("status", F.when(F.col("__x") == 1, "recycled").otherwise(F.col("status"))).drop("__x").checkpoint()
    up = promote(on(mem), now).where("not known").select("id", F.col("confidence").alias("__c"))
    facts = mem.join(up, "id").withColumns({"id": F.concat(F.lit("s-"), "id"), "kind": F.lit("semantic"), "confidence": F.col("__c"), "cues": F.array_distinct(F.concat("cues", F.array(F.lit("consolidated"))))}).drop("__c")
    facts = facts.groupBy("content_hash").agg(F.min_by(F.struct(*mem.columns), "seq").alias("row")).select("row.*").select(mem.columns)
    mem = mem.unionByName(facts).checkpoint()
    links = links.unionByName(facts.select(F.expr("least(substring(id, 3), id)").alias("src"), F.expr("greatest(substring(id, 3), id)").alias("dst"), F.lit(1.0).alias("weight")))
    gone = prunable(on(mem), now).select("id").unionByName(accommodated(on(mem))).distinct()
    mem = put(mem, weak_replay(on(mem), now), ["strength", "storage_strength"])
    mem = put(mem, emotion_growth(on(mem)), ["confidence", "storage_strength", "strength"])
    mem = mem.join(gone.withColumn("__x", F.lit(1)), "id", "left").withColumn("status", F.when(F.col("__x") == 1, "recycled").otherwise(F.col("status"))).drop("__x").checkpoint()
    links = graph.canonical(links.unionByName(rem_of(on(mem))).unionByName(emotion_links(on(mem)))).checkpoint()
    return mem, links


def upsert_facts(mem: DataFrame, new: DataFrame) -> DataFrame:
    """Facts of new merged into those of mem by text."""
    return index.merge_rows(mem.where("kind = 'semantic'").unionByName(new))


def rem_resolved(mem: DataFrame, pairs: DataFrame, loss: float = 0.1, floor: float = 0.4) -> DataFrame:
    """id, confidence of the facts in conflicts (id_a, id_b) where both are sure beyond a half: each conflict costs a tenth,
    down to 0.4. A partner counts by what it was before the night."""
    sure = mem.where("confidence > 0.5").select("id")
    both = pairs.join(sure.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(sure.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
    n = both.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return mem.join(n, "id").select("id", F.round(F.greatest(F.lit(floor), F.col("confidence") - loss * F.col("n")), 6).alias("confidence"))


def reflections(mem: DataFrame, links: DataFrame, most: int = 20, least: int = 2) -> DataFrame:
    """id, n, contents: facts of two pieces of evidence or more with the texts, in order of time, of the episodes linked to
    them (two at least, the first `most` by seq): what a summary of them is made from."""
    facts = mem.where("kind = 'semantic' and evidence_count >= 2").select(F.col("id").alias("fact"))
    episodes = mem.where("kind = 'episodic'")
    near = facts.join(graph.symmetric(links), F.col("fact") == F.col("src")).join(episodes.select("id", "seq", "created_at"), F.col("dst") == F.col("id"))
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("fact").orderBy("seq"))).where(F.col("k") <= most)
    lists = near.groupBy("fact").agg(F.array_sort(F.collect_list(F.struct("created_at", "seq", "id"))).alias("c")).where(F.size("c") >= least)
    lists = written(lists.select("fact", F.transform("c", lambda x: x["id"]).alias("of")), "reflected")
    # Texts come last, and once for each list: facts of the same cues have the same episodes.
    asked = lists.select("of").distinct().withColumn("list", F.sha2(F.to_json("of"), 256))
    told = asked.select("list", F.posexplode("of").alias("place", "id")).join(episodes.select("id", "content"), "id")
    told = told.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("c"))
    rows = lists.withColumn("list", F.sha2(F.to_json("of"), 256)).join(told, "list")
    return rows.select(F.col("fact").alias("id"), F.size("of").cast("long").alias("n"), F.transform("c", lambda x: x["content"]).alias("contents"))


def reflected(mem: DataFrame, links: DataFrame, summarize: Callable[[list[str]], str]) -> DataFrame:
    """id, content: facts rewritten by a user's summary of their episodes; those for which it raises stay."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        def one(texts):
            try:
                return summarize(list(texts))
            except Exception:  # the user's own function
                return None

        return lists.map(one)

    return reflections(mem, links).select("id", run("contents").alias("content")).where("content is not null")


def resolved(mem: DataFrame) -> DataFrame:
    """One row: facts outweighed, conflicts eased, and conflicts left without those facts."""
    losers = accommodated(mem)
    rest = mem.join(losers, "id", "left_anti")
    pairs = conflicts(rest)
    one = losers.agg(F.count("*").alias("accommodated"))
    for df, name in ((rem_resolved(rest, pairs), "eased"), (pairs, "left")):
        one = one.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # rows of one each
    return one
