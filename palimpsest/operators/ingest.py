"""Ingest: records become memories with cues, context, hashes, terms and links."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import graph, index
from palimpsest.sources.memories import SCHEMA

#: Links of a new memory when one is remembered, and the bounds and budget of many at once.
LINKS_EACH, LINKS_LEAST, LINKS_MOST, LINKS_BUDGET = 64, 8, 32, 1_000_000
#: What a record gets where it gives nothing.
DEFAULTS = {"kind": "episodic", "origin": "user", "trust": 0.8, "confidence": 0.7, "strength": 1.0, "storage_strength": 1.0, "evidence_count": 1, "affect": None, "context": None}


def scored_by(scorer: Callable[[list[str]], list[float | None]]) -> Callable[[Column], Column]:
    """The user's scorer of importance as a column: each batch of texts at once, from 0 to 1; null where it raises, gives
    something else than a number, or not as many as it got."""

    @F.pandas_udf("double")
    def run(contents: pd.Series) -> pd.Series:
        try:
            got = [float(x) if x is not None else None for x in scorer(list(contents))]
        except Exception:  # noqa: BLE001  whatever a user's function raises
            got = []
        if len(got) != len(contents):
            return pd.Series([None] * len(contents), dtype="float64")
        return pd.Series(got, dtype="float64").clip(0.0, 1.0)

    return run


def prepared(records: DataFrame, now: Column, top_seq: int, auto_cues: bool = True, auto_context: bool = True, scorer: Callable[[list[str]], list[float | None]] | None = None) -> DataFrame:
    """Records (content; any of the columns of a memory; input_pos) as memories numbered after top_seq in order of
    input_pos. Cues are normalised and up to six words of the text follow them; the context is the place that the text
    names; importance follows the rule where it is not given. A scorer (a function of a list of texts) is asked for it
    first; where it fails or gives no number, the rule holds. Records without content are left out."""
    given = set(records.columns)
    rows = records.where("trim(coalesce(content, '')) <> ''")
    kinds = {f.name: f.dataType for f in SCHEMA}
    col = lambda c: F.coalesce(F.col(c), F.lit(DEFAULTS.get(c)).cast(kinds[c])) if c in given else F.lit(DEFAULTS.get(c)).cast(kinds[c])
    cues = text.normalize_cues(F.coalesce("cues", F.array().cast("array<string>"))) if "cues" in given else F.array().cast("array<string>")
    if auto_cues:
        cues = F.array_distinct(F.concat(cues, text.extract_cues(text.tokenize(F.col("content")), 6)))
    made = {
        "content_hash": text.content_hash(F.col("content")),
        "cues": cues,
        "created_at": F.coalesce("created_at", now) if "created_at" in given else now,
        "status": F.lit("active"),
        "review_streak": F.lit(0.0),
        **{c: F.lit(0).cast("long") for c in ("access_count", "retrieval_successes", "retrieval_failures", "revision_count")},
    }
    rows = index.assign_seq(rows, top_seq, "input_pos")
    rows = rows.withColumns({c: col(c) for c in ("kind", "origin", "trust", "confidence", "strength", "storage_strength", "evidence_count", "affect", "context", "ref", "occurred_at")})
    rows = rows.withColumns(made)
    rule = text.importance(F.col("content"), F.col("trust"), F.lit(0))
    if scorer is not None:
        rule = F.coalesce(scored_by(scorer)(F.col("content")), rule)
    rows = rows.withColumn("importance", F.coalesce("importance", rule) if "importance" in given else rule)
    if auto_context:
        rows = rows.withColumn("context", F.coalesce("context", text.place_of(F.col("content"))))
    rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lit("m"), F.col("seq"))) if "id" in given else F.concat(F.lit("m"), F.col("seq")))
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA))


def remembered(mem: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that a store gains or changes, and (new_id, id): which memory each new row became. Episodes are added;
    facts merge with the fact of the same text, whatever its status."""
    facts = new.where("kind = 'semantic'")
    known = mem.where("kind = 'semantic'").join(facts.select("content_hash").distinct(), "content_hash", "left_semi")
    both = known.select(new.columns).unionByName(facts)
    merged = index.merge_rows(both)
    first = Window.partitionBy("kind", "content_hash").orderBy("seq")
    base = both.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    fold = [c for c in merged.columns if c not in ("kind", "content_hash", "id")]
    facts_now = base.drop(*fold).join(merged.select("id", *fold), "id").select(new.columns)
    became = facts.select(F.col("id").alias("new_id"), "kind", "content_hash").join(merged.select("kind", "content_hash", "id"), ["kind", "content_hash"]).select("new_id", "id")
    episodes = new.where("kind <> 'semantic'")
    return episodes.unionByName(facts_now), became.unionByName(episodes.select(F.col("id").alias("new_id"), "id"))


def link_budget(n: int) -> int:
    """Links of each of n memories that are remembered together."""
    return LINKS_EACH if n <= 1 else min(LINKS_MOST, max(LINKS_LEAST, LINKS_BUDGET // n))


def new_links(mem: DataFrame, new: DataFrame, per_item: int = LINKS_EACH) -> DataFrame:
    """src < dst, weight 1: each new memory and the `per_item` newest memories that share a cue with it."""
    cues = mem.select(F.explode("cues").alias("cue"), "id", "seq")
    mine = new.select(F.explode("cues").alias("cue"), F.col("id").alias("a"))
    newest = cues.withColumn("k", F.row_number().over(Window.partitionBy("cue").orderBy(F.desc("seq")))).where(F.col("k") <= per_item + 1)
    pairs = mine.join(newest, "cue").where(F.col("a") != F.col("id")).select("a", F.col("id").alias("b"), "seq").distinct()
    near = pairs.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("seq"), "b"))).where(F.col("k") <= per_item)
    return graph.canonical(near.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")))


def with_links(links: DataFrame, more: DataFrame) -> DataFrame:
    """Links and further ones: the heavier weight of each pair holds."""
    return graph.canonical(links.select("src", "dst", "weight").unionByName(more.select("src", "dst", "weight")))


def suppress(suppressed: DataFrame, ids: DataFrame, mem: DataFrame) -> DataFrame:
    """The set of suppressed ids with further ones that exist."""
    return suppressed.select("id").unionByName(ids.select("id").join(mem.select("id"), "id", "left_semi")).distinct()


def unsuppress(suppressed: DataFrame, ids: DataFrame) -> DataFrame:
    return suppressed.join(ids.select("id"), "id", "left_anti")


def suppressed_report(suppressed: DataFrame, mem: DataFrame) -> DataFrame:
    return mem.join(suppressed.select("id"), "id", "left_semi").select("id", "kind", F.substring("content", 1, 40).alias("preview"))


def deleted(tables: dict[str, DataFrame], ids: DataFrame, only_recycled: bool = False) -> dict[str, DataFrame]:
    """The tables memories, cues, terms and links (those given) without some memories (id). With only_recycled, active
    memories stay."""
    if only_recycled:
        ids = tables["memories"].where("status = 'recycled'").join(ids.select("id"), "id", "left_semi")
    gone = ids.select("id").distinct()
    out = {name: df.join(gone, "id", "left_anti") for name, df in tables.items() if name != "links"}
    if "links" in tables:
        out["links"] = tables["links"].join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return out


def by_hash(mem: DataFrame, kind: str, contents: DataFrame) -> DataFrame:
    """The first memory of a kind with each text (content)."""
    asked = contents.select(text.content_hash(F.col("content")).alias("content_hash")).distinct()
    rows = mem.where(F.col("kind") == kind).join(asked, "content_hash", "left_semi")
    return rows.groupBy("content_hash").agg(F.min_by("id", "seq").alias("id"))


def get(mem: DataFrame, ids: list[str], any_status: bool = False) -> DataFrame:
    """Memories of given ids, active ones only, the newest first; with any_status whatever their status."""
    rows = mem.where(F.col("id").isin(*ids))
    return (rows if any_status else rows.where("status = 'active'")).orderBy(F.desc("seq"))


def recycled_page(mem: DataFrame, after: int, limit: int) -> DataFrame:
    """id, seq of the next recycled memories after a seq."""
    return mem.where((F.col("status") == "recycled") & (F.col("seq") > after)).orderBy("seq").limit(limit).select("id", "seq")


def link_weight(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and the weight of their link, 0 where there is none."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return pairs.select("a", "b", low.alias("src"), high.alias("dst")).join(links, ["src", "dst"], "left").select("a", "b", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def refused(mem: DataFrame, changes: DataFrame) -> DataFrame:
    """id of the changes (id, content) that would make a fact equal to another one."""
    new = changes.select("id", text.content_hash(F.col("content")).alias("content_hash"))
    facts = mem.where("kind = 'semantic'")
    new = new.join(facts.select("id", F.col("content_hash").alias("old")), "id").where("content_hash <> old").drop("old")
    return new.join(facts.select(F.col("id").alias("other"), "content_hash"), "content_hash").where("id <> other").select("id").distinct()
