"""Chains: comparisons that follow from others, events of a topic in order, and orders that keep topics apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import review
from palimpsest.operators.index import numbered
from palimpsest.sources import shared

#: The two ends of what is compared; the first means more.
SCALES = (("高", "低"), ("大", "小"), ("晚", "早"), ("贵", "便宜"), ("昂贵", "廉价"), ("多", "少"), ("快", "慢"), ("长", "短"), ("远", "近"), ("higher", "lower"), ("larger", "smaller"), ("later", "earlier"), ("faster", "slower"), ("longer", "shorter"))
_NAME = "([\\w\\u4e00-\\u9fff·-]{1,40}?)"
_ENDS = "|".join(sorted((w for pair in SCALES for w in pair), key=len, reverse=True))
COMPARES = f"{_NAME}比{_NAME}(?:更|还)?({_ENDS})|{_NAME} is ({_ENDS}) than ([\\w-]{{1,40}})"


def comparisons(mem: DataFrame) -> DataFrame:
    """id, greater, less, scale (the word for more) of every comparison that a record states: "A比B高", "A is higher than
    B"."""
    one = lambda k: F.regexp_extract_all(F.col("content"), F.lit(COMPARES), F.lit(k)).alias(f"g{k}")
    each = mem.select("id", F.explode(F.arrays_zip(*(one(k) for k in range(1, 7)))).alias("m"))
    zh = F.col("m.g3") != ""
    a, b = F.when(zh, F.col("m.g1")).otherwise(F.col("m.g4")), F.when(zh, F.col("m.g2")).otherwise(F.col("m.g6"))
    word = F.when(zh, F.col("m.g3")).otherwise(F.col("m.g5"))
    more = F.create_map(*(F.lit(x) for high, low in SCALES for x in (high, high, low, high)))
    up = word.isin(*(high for high, _ in SCALES))
    rows = each.select("id", F.when(up, a).otherwise(b).alias("greater"), F.when(up, b).otherwise(a).alias("less"), more[word].alias("scale"))
    return rows.where("greater <> less")


def transitive_premises(queries: DataFrame, facts: DataFrame, hops: int = 4) -> DataFrame:
    """query_id, hops, premises (the records in order) of the questions whether `greater` stands above `less` on a scale
    (query_id, greater, less, scale) that records answer, by one or by up to `hops` of them in a row.

    The search goes out from each question's subject, a join a step. Of the ways to a name the one with the fewest records
    is kept, of those the first in order of ids, so a step has a row for each question and name at most."""
    edges = shared.written(facts.groupBy("scale", "greater", "less").agg(F.min("id").alias("id")), "edges")
    goal = queries.select("query_id", "scale", F.col("less").alias("goal"))
    at = queries.select("query_id", "scale", F.col("greater").alias("name"), F.array().cast("array<string>").alias("way"))
    visited = at.select("query_id", "name")
    done = None
    for k in range(1, hops + 1):
        step = at.join(edges.select("scale", F.col("greater").alias("name"), "less", "id"), ["scale", "name"])
        step = step.groupBy("query_id", "scale", F.col("less").alias("name")).agg(F.min(F.concat("way", F.array("id"))).alias("way"))
        new = shared.written(step.join(visited, ["query_id", "name"], "left_anti"), "step")
        hit = new.join(goal, ["query_id", "scale"]).where("name = goal").select("query_id", F.lit(k).alias("hops"), F.col("way").alias("premises"))
        done = hit if done is None else done.unionByName(hit)
        # A question that is answered goes no further.
        at = new.join(hit.select("query_id"), "query_id", "left_anti").select("query_id", "scale", "name", "way")
        visited = visited.unionByName(new.select("query_id", "name"))
    return done


def extremes(facts: DataFrame) -> DataFrame:
    """scale, name, top of the names that nothing stands above (top) or below: what "who is highest" asks for, where records
    leave one only."""
    f = facts.select("scale", "greater", "less").distinct()
    top = f.select("scale", F.col("greater").alias("name")).distinct().join(f.select("scale", F.col("less").alias("name")), ["scale", "name"], "left_anti").withColumn("top", F.lit(True))
    low = f.select("scale", F.col("less").alias("name")).distinct().join(f.select("scale", F.col("greater").alias("name")), ["scale", "name"], "left_anti").withColumn("top", F.lit(False))
    return top.unionByName(low)


def premise_boosts(queries: DataFrame, mem: DataFrame, facts: DataFrame, boost: float = 0.35, hops: int = 4) -> DataFrame:
    """query_id, id, boost for composed recall: the records along the way of questions that compare two names."""
    q = queries.select("query_id", F.regexp_extract("query", COMPARES, 1).alias("a"), F.regexp_extract("query", COMPARES, 2).alias("b"), F.regexp_extract("query", COMPARES, 3).alias("w")).where("w <> ''")
    more = F.create_map(*(F.lit(x) for high, low in SCALES for x in (high, high, low, high)))
    up = F.col("w").isin(*(high for high, _ in SCALES))
    asks = q.select("query_id", F.when(up, F.col("a")).otherwise(F.col("b")).alias("greater"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("less"), more[F.col("w")].alias("scale"))
    found = transitive_premises(asks, facts, hops)
    rows = found.select("query_id", F.explode("premises").alias("id"), F.lit(boost).alias("boost"))
    return rows.join(mem.select("id"), "id", "left_semi").select("query_id", "id", "boost")


def event_chains(mem: DataFrame, days: float = 14.0) -> DataFrame:
    """topic, events, span_days of the topics whose dated episodes, two or more, all lie within so many days."""
    rows = mem.where("kind = 'episodic' and occurred_at is not null").select(review.topic().alias("topic"), F.unix_micros("occurred_at").alias("us"))
    per = rows.groupBy("topic").agg(F.count("*").alias("events"), (F.max("us") - F.min("us")).alias("span"))
    span = F.round(F.col("span") / 8.64e10, 1)
    return per.where("events >= 2").select("topic", "events", span.alias("span_days")).where(F.col("span_days") <= days)


def chain_runs(mem: DataFrame, days: float = 14.0) -> DataFrame:
    """topic, chain, pos, id: the dated episodes of a topic in order of date (then seq), a new chain wherever more than so
    many days pass; chains of one are left out. All topics are one sorted sequence that is cut in ranges, so a topic of any
    size is spread over tasks; only the neighbours of a row are looked at."""
    rows = mem.where("kind = 'episodic' and occurred_at is not null").select("id", review.topic().alias("topic"), F.unix_micros("occurred_at").alias("us"), "seq")
    line = shared.written(numbered(rows, ["topic", "us", "seq"], "n"), "line")
    before = line.select((F.col("n") + 1).alias("n"), F.col("topic").alias("t0"), F.col("us").alias("us0"))
    cut = line.join(before, "n", "left").withColumn("start", F.coalesce((F.col("topic") != F.col("t0")) | (F.col("us") - F.col("us0") > days * 8.64e10), F.lit(True)))
    cut = shared.written(cut.select("n", "id", "topic", "start"), "cut")
    # Chains are numbered where they start; every row takes the last start at or before it, by ranges of starts.
    starts = shared.written(numbered(cut.where("start").select("n", "topic"), ["n"], "k"), "starts")
    ends = starts.select((F.col("k") - 1).alias("k"), F.col("n").alias("stop"))
    spans = starts.join(ends, "k", "left").select("topic", F.col("n").alias("first"), F.coalesce("stop", F.lit(None).cast("long")).alias("stop"))
    total = line.agg(F.coalesce(F.max("n") + 1, F.lit(0)).alias("total"))
    spans = spans.crossJoin(F.broadcast(total)).withColumn("stop", F.coalesce("stop", "total")).where(F.col("stop") - F.col("first") >= 2)  # total is one row
    first_of = spans.groupBy("topic").agg(F.min("first").alias("t_first"))
    each = spans.join(first_of, "topic").select("topic", "first", F.explode(F.sequence("first", F.col("stop") - 1)).alias("n"))
    order = Window.partitionBy("topic").orderBy("first")
    chains = spans.select("topic", "first").withColumn("chain", F.row_number().over(order))
    return each.join(cut.select("n", "id"), "n").join(chains, ["topic", "first"]).select("topic", F.col("chain").cast("int").alias("chain"), (F.col("n") - F.col("first")).alias("pos"), "id")


def interleaved(rows: DataFrame, category: Column, order: list[Column]) -> DataFrame:
    """rows with `place`, from 0: an order in which neighbours have different categories wherever that is possible.

    The rows are lined up by category, the most frequent first, and fill every other place, first the even ones, then the
    odd ones. A category of at most half the rows then never meets itself; of a larger one, what is too much follows at the
    end, so that as few neighbours as possible are equal. Lining up goes by ranges, places by arithmetic."""
    named = rows.withColumn("__c", category)
    size = named.groupBy("__c").agg(F.count("*").alias("__size"))
    sized = named.join(size.withColumnRenamed("__c", "__of"), F.col("__c").eqNullSafe(F.col("__of"))).drop("__of")
    keyed = sized.withColumns({f"__o{k}": c for k, c in enumerate(order)}).withColumn("__neg", -F.col("__size"))
    line = shared.written(numbered(keyed, ["__neg", "__c", *(f"__o{k}" for k in range(len(order)))], "__n"), "line")
    totals = line.agg(F.count("*").alias("__all"), F.coalesce(F.max("__size"), F.lit(0)).alias("__most"))
    # Of a category beyond half the places, `pairs` rows alternate with all others; the rest of it stands behind them.
    n, total, most = F.col("__n"), F.col("__all"), F.col("__most")
    rest = total - most
    crowded = most > rest + 1
    half = F.expr("(__all + 1) div 2")
    usual = F.when(n < half, 2 * n).otherwise(2 * (n - half) + 1)
    of_most = F.when(n <= rest, 2 * n).otherwise(rest + n)
    tight = F.when(n < most, of_most).otherwise(2 * (n - most) + 1)
    placed = line.crossJoin(F.broadcast(totals)).withColumn("place", F.when(crowded, tight).otherwise(usual).cast("long"))  # totals is one row
    return placed.drop("__c", "__size", "__neg", "__n", "__all", "__most", *(f"__o{k}" for k in range(len(order))))


def interleaved_plan(mem: DataFrame, limit: int | None = None) -> DataFrame:
    """place, id, category: memories to practise, important ones first within their category, no two of a category in a row
    where that is possible. A memory without cues is a category of its own. With limit, of the most important ones."""
    rows = mem.orderBy(F.desc("importance"), F.desc("seq")).limit(limit) if limit else mem
    rows = rows.select("id", "seq", "importance", F.coalesce(F.get("cues", 0), F.col("id")).alias("category"))
    return interleaved(rows, F.col("category"), [-F.col("importance"), -F.col("seq")]).select("place", "id", "category")


def semantic_gaps(queries: DataFrame, terms: DataFrame, mem: DataFrame, least: float = 0.35, dim: int = 256, most: int = 8) -> DataFrame:
    """query_id, gaps: words of the query that no memory has or comes near to (cosine of n-gram vectors above `least`), the
    first `most` in order. Nearness is decided for each word once, in blocks over all memories."""
    from palimpsest.operators import vector

    asked = queries.select("query_id", F.explode(F.array_distinct(text.tokenize(F.col("query")))).alias("term"))
    missing = shared.written(asked.join(terms.select("term").distinct(), "term", "left_anti"), "missing")
    words = vector.embeddings(missing.select("term").distinct(), "term", dim)
    near = vector.near_any(words.select(F.col("term").alias("key"), F.col("embedding").alias("vector")), vector.embeddings(mem.select("content"), "content", dim).select(F.col("embedding").alias("vector")), least)
    left = missing.join(near.withColumnRenamed("key", "term"), "term", "left_anti")
    return left.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("term")), 1, most).alias("gaps"))
