"""Index tables, keyed writes and statistics of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.sources.shared import shared_dir, written


def item_terms(mem: DataFrame, cjk: bool = False) -> DataFrame:
    """id, terms: distinct tokens of content and cues; with `cjk` those of Chinese too."""
    return mem.select("id", F.array_distinct(F.concat(text.tokenize(F.col("content"), cjk), F.flatten(F.transform("cues", lambda c: text.tokenize(c, cjk))))).alias("terms"))


def stored_terms(mem: DataFrame, cjk: bool = False) -> DataFrame:
    """item_terms, computed once and kept for all that reads them."""
    return written(item_terms(mem, cjk), "terms")


def term_index(mem: DataFrame) -> DataFrame:
    return exploded(item_terms(mem))


def exploded(items: DataFrame) -> DataFrame:
    # A plain explode would have Spark test whether there are terms, and compute them twice for it.
    return items.select(F.explode_outer("terms").alias("term"), "id").where("term is not null")


def inverted(mem: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """term, part, ids: the memories of each term, a frequent term's in several parts of about `part_rows`, by the digest of
    the id."""
    terms = term_index(mem)
    parts = terms.groupBy("term").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
    dealt = terms.join(parts, "term").withColumn("part", (F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % F.col("parts")).cast("int"))
    return dealt.groupBy("term", "part").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def without_terms(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """A term index without the rows of some memories (id)."""
    return terms.join(ids.select("id").distinct(), "id", "left_anti")


def cue_index(mem: DataFrame) -> DataFrame:
    return mem.select(F.posexplode("cues").alias("pos", "cue"), "id", "seq")


def term_df(mem: DataFrame) -> DataFrame:
    return term_index(mem).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    df = F.least(df, n)
    return F.least(F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5))), F.lit(4.0))


def term_idf(mem: DataFrame) -> DataFrame:
    n = mem.agg(F.count("*").alias("n"))
    return term_df(mem).crossJoin(F.broadcast(n)).select("term", "df", F.round(idf(F.col("df"), F.col("n")), 6).alias("idf"))  # n is one row


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least n from which on at most `most` rows of counts have that n or more. No task sorts them: the driver sees how
    many rows have each n."""
    left = 0
    for n, many in sorted((tuple(r) for r in counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        left += many
        if left > most:
            return n + 1
    return 0


def find_by_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    return index.where(F.col("term").isin(*terms)).select("id").distinct()


def find_by_cue(mem: DataFrame, cue: str) -> DataFrame:
    return mem.where(F.array_contains("cues", F.lower(F.trim(F.lit(cue))))).orderBy("seq", "content")


def merge_rows(rows: DataFrame, keys: tuple[str, ...] = ("kind", "content_hash")) -> DataFrame:
    """One row for each key: counts add up, strengths take the highest, the source is the most trusted one's, cues are
    joined in order of seq."""
    cues = F.transform(F.array_sort(F.collect_list(F.struct("seq", "cues"))), lambda s: s["cues"])
    highest = [F.max(c).alias(c) for c in ("importance", "confidence", "strength", "storage_strength", "revision_count", "evidence_count", "last_access_at")]
    return rows.groupBy(*keys).agg(
        F.min_by("id", "seq").alias("id"),
        F.min("seq").alias("seq"),
        *highest,
        F.sum("access_count").alias("access_count"),
        F.max_by("origin", F.struct("trust", -F.col("seq"))).alias("origin"),
        F.max("trust").alias("trust"),
        F.array_distinct(F.flatten(cues)).alias("cues"),
    )


def assign_seq(new: DataFrame, top: int, position: str = "input_pos") -> DataFrame:
    """Insert numbers after `top`, by the rows' own position."""
    return numbered(new, [position], "seq").withColumn("seq", F.col("seq") + F.lit(top + 1))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the number of each row from 0 in an order. Ranges of the order are numbered side by side; only their sizes
    are gathered."""
    shared_dir(df.sparkSession)  # for checkpoint()
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    starts, at = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(k, 0)
    start = F.get(F.array(*map(F.lit, starts)) if starts else F.array(F.lit(0)), F.col("__part"))
    return ranged.withColumn(name, (F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + start).cast("long")).drop("__part")


def stats(mem: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row; with links also their number."""
    on = F.col("status") == "active"
    cues = mem.select(F.explode("cues").alias("cue")).agg(F.count_distinct("cue").alias("cues"))
    one = mem.agg(
        F.count("*").alias("total"),
        F.count_if(on).alias("active"),
        F.count_if(on & (F.col("kind") == "episodic")).alias("episodic"),
        F.count_if(on & (F.col("kind") == "semantic")).alias("semantic"),
        F.round(F.avg(F.when(on, F.col("importance"))), 6).alias("avg_importance"),
        F.round(F.avg(F.when(on, F.col("strength"))), 6).alias("avg_strength"),
    ).crossJoin(F.broadcast(cues))  # both sides are one row
    return one if links is None else one.crossJoin(F.broadcast(links.agg(F.count("*").alias("links"))))


def scan(mem: DataFrame, kind: str | None = None, status: str = "active", limit: int | None = None) -> DataFrame:
    rows = mem.where(F.col("status") == status)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.orderBy(F.desc("seq")).limit(limit) if limit else rows.orderBy(F.desc("seq"))


def strongest(mem: DataFrame, limit: int) -> DataFrame:
    return mem.where("status = 'active'").orderBy(F.desc("importance"), F.desc("seq")).limit(limit)


def turn_segments(turns: DataFrame) -> DataFrame:
    """Up to four parts of each turn, as facts where short and as episodes where long."""
    parts = F.slice(F.filter(F.transform(F.split("text", "[。！？!?；;\\n]+"), F.trim), lambda p: p != ""), 1, 4)
    return turns.select("conv_id", "turn", "role", F.posexplode(parts).alias("part", "content")).withColumn(
        "kind", F.when(F.length("content") <= 60, "semantic").otherwise("episodic")
    )


def update_content(mem: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Rows of changes (id, content) rewritten: a new hash and revision, and some confidence and strength lost."""
    new = F.col("__new")
    rows = mem.join(changes.select("id", F.col("content").alias("__new")), "id", "left")
    changed = new.isNotNull() & (new != F.col("content"))
    put = lambda value, old: F.when(changed, value).otherwise(F.col(old))
    return rows.withColumns(
        {
            "content_hash": put(text.content_hash(new), "content_hash"),
            "revision_count": put(F.col("revision_count") + 1, "revision_count"),
            "updated_at": put(now, "updated_at"),
            "confidence": put((F.col("confidence") + 0.4) / 2, "confidence"),
            "strength": put(F.greatest(F.lit(0.3), 0.8 * F.col("strength")), "strength"),
            "content": put(new, "content"),
        }
    ).drop("__new")


def set_status(mem: DataFrame, ids: list[str], status: str) -> DataFrame:
    return mem.withColumn("status", F.when(F.col("id").isin(*ids), F.lit(status)).otherwise(F.col("status")))


def tag(mem: DataFrame, ids: list[str], add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """Cues taken away and added: those that stay keep their order, new ones follow sorted."""
    words = lambda w: text.normalize_cues(F.array(*map(F.lit, w))) if w else F.array().cast("array<string>")
    kept = F.array_except("cues", words(remove))
    return mem.withColumn("cues", F.when(F.col("id").isin(*ids), F.concat(kept, F.array_sort(F.array_except(words(add), kept)))).otherwise(F.col("cues")))


def purge(mem: DataFrame, before: Column | None = None) -> DataFrame:
    gone = F.col("status") == "recycled"
    return mem.where(~(gone & (F.col("created_at") < before)) if before is not None else ~gone)
