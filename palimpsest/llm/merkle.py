"""A Merkle manifest of a table: every row is a leaf, eight neighbours make a node, one root stands for all.

Leaves are sorted by ranges and numbered within their group, so every node has a coordinate: group, level, place. The
node store is a folder with one Parquet partition a level that holds the runs of up to eight nodes, by their place on the
level above. A level is made from one pass over the level below. Proofs go the other way: runs are merged with the paths
of their parents by coordinate, so a path is carried once a run, not once a leaf. Nothing but the number of levels, the
size of the largest group and the root comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A path: for each level upwards the node's place in its run and the digests of the others in it, one after another.
PATH = "array<struct<at: int, others: binary>>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_text(digests: Column) -> Column:
    """Lowercase hex of one digest or of several in a row."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""

    def up(below: Column, step: Column) -> Column:
        left, rest = step["at"] * 32, step["others"]
        return digest(F.concat(as_text(rest.substr(F.lit(1), left)), as_text(below), as_text(rest.substr(left + 1, F.length(rest)))))

    return F.aggregate(path, start, up)


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: as_text(step["others"])), ""), 256)


def numbered(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves with pos, a row's place in its group by `order`, and n, the group's rows. Rows that are equal in all of it
    are told apart by a number that they got when they were written, so no range has to take them all."""
    told = common.written(leaves.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())), "leaves")
    ranges = told.repartitionByRange(group, *order, "__salt").sortWithinPartitions(group, *order, "__salt")
    runs = common.written(ranges.drop("__salt").withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)), "runs")
    # Rows of a group in each range, summed over the ranges before: as many rows a group as there are ranges.
    counts = runs.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("__count"), F.min("__row").alias("__first"))
    before = "sum(__count) over (partition by __g order by __p rows between unbounded preceding and 1 preceding)"
    counts = counts.selectExpr("__g", "__p", "__first", f"coalesce({before}, 0) as __before", "sum(__count) over (partition by __g) as n")
    placed = runs.join(counts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("pos", F.col("__before") + F.col("__row") - F.col("__first")).drop("__g", "__p", "__first", "__before", "__row", "__part")


@dataclass
class Tree:
    """Runs of each level, from the leaves up, and the tops: one node a group."""

    group: str
    runs: list[DataFrame]
    tops: DataFrame

    @staticmethod
    def build(leaves: DataFrame, group: str, order: list[str], store: str) -> Tree:
        """leaves: group, the columns of order, digest, row (a struct that goes with the leaf)."""
        spark = leaves.sparkSession
        nodes = common.written(numbered(leaves, group, order).select(group, "pos", "n", "digest", "row"), "placed")
        most = nodes.agg(F.max("n")).first()[0] or 0
        keep, runs, tops = ["pos", "digest", "row"], [], []
        while True:
            tops.append(nodes.where("n = 1").select(group, "digest", F.lit(len(runs)).alias("level"), *(["row"] if not runs else [F.lit(None).cast(leaves.schema["row"].dataType).alias("row")])))
            if most <= 1:
                break
            path = f"{store}/level={len(runs)}"
            up = nodes.where("n > 1").groupBy(group, F.expr(f"pos div {FAN}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct(*keep))).alias("run"), F.expr(f"(max(n) + {FAN - 1}) div {FAN}").alias("n"))
            up = up.withColumn("digest", digest(as_text_of(F.col("run"))))
            up.sortWithinPartitions(group, "parent").write.parquet(path)
            runs.append(spark.read.schema(up.schema).parquet(path))
            nodes = runs[-1].select(group, F.col("parent").alias("pos"), "n", "digest")
            keep, most = ["pos", "digest"], -(-most // FAN)
        every = tops[0]
        for more in tops[1:]:
            every = every.unionByName(more)
        return Tree(group, runs, common.written(every, "tops"))

    def paths(self, above: DataFrame) -> DataFrame:
        """group, pos, digest, row, path, top of every leaf. above: __g, up (the path of the group's top)."""
        g = self.group
        tops = common.written(self.tops.join(above, F.col(g).eqNullSafe(F.col("__g"))).select(g, F.lit(0).cast("long").alias("pos"), "level", "digest", "row", F.col("up").alias("path"), F.col("digest").alias("top")), "paths")
        found = tops.where(F.col("level") == len(self.runs)).drop("level")
        for k in range(len(self.runs) - 1, -1, -1):
            parents = found.select(F.col(g).alias("__g"), F.col("pos").alias("__pos"), F.col("path").alias("__path"), "top")
            both = self.runs[k].select(g, "parent", "run").join(parents.hint("merge"), F.col(g).eqNullSafe(F.col("__g")) & (F.col("parent") == F.col("__pos")))
            each = both.select(g, "run", "__path", "top", F.posexplode("run").alias("at", "node"))
            step = F.struct("at", others(F.col("run"), F.col("at")).alias("others"))
            row = F.col("node.row") if k == 0 else F.lit(None).cast(self.tops.schema["row"].dataType)
            below = each.select(g, F.col("node.pos").alias("pos"), F.col("node.digest").alias("digest"), row.alias("row"), F.concat(F.array(step), F.col("__path")).cast(PATH).alias("path"), "top")
            found = below.unionByName(tops.where(F.col("level") == k).drop("level"))
            if k:
                found = common.written(found, "paths")
        return found


def as_text_of(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda x: as_text(x["digest"])), "")


def others(run: Column, at: Column) -> Column:
    """Digests of a run but for the one at a place, in one binary."""
    rest = F.filter(run, lambda x, i: i != at)
    return F.unhex(as_text_of(rest))


def manifest(rows: DataFrame, group: str, key: str, leaf_of: Column, keep: dict[str, Column]) -> tuple[DataFrame, bytes | None]:
    """The leaves of a table with their proofs, and the root (None for an empty table). `leaf_of` is the digest of a row;
    leaves of a group ascend by key (null first, ties by digest); subroots ascend by group (null first, by bytes). `keep`
    are columns to carry along. Returns digest, path (as PATH, through the subroot), top (the subroot) and the columns."""
    spark = rows.sparkSession
    store = common.shared_path(spark, "nodes")
    leaves = rows.select(F.col(group).alias("__group"), F.col(key).alias("__key"), leaf_of.alias("digest"), F.struct(*[c.alias(k) for k, c in keep.items()]).alias("row"))
    tree = Tree.build(leaves, "__group", ["__key", "digest"], f"{store}/groups")
    all_one = F.lit(0).alias("__all")
    upper = Tree.build(tree.tops.select(all_one, F.col("__group").alias("__sub"), "digest", F.struct(F.col("__group").alias("sub")).alias("row")), "__all", ["__sub"], f"{store}/root")
    root = upper.tops.select("digest").first()  # one row at most
    none = spark.range(1).select(F.lit(0).alias("__g"), F.array().cast(PATH).alias("up"))
    over = common.written(upper.paths(none).select(F.col("row.sub").alias("__g"), F.col("path").alias("up")), "over")
    return tree.paths(over).select("digest", "path", "top", "row.*"), bytes(root[0]) if root else None


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every row of documents; the root that the tampered leaf folds to, and whether it
    is the root. Null ids stand first in their language and are never tampered with; rows that are equal in all columns
    take neighbouring places, in any order. An empty table gives no rows and has no root."""
    docs = common.load(spark, sf_dir, "documents").select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    plain = [F.col(c) for c in FIELDS]
    changed = F.when(hit, leaf(*plain[:-1], F.translate("text", UPPER, LOWER)))
    rows, root = manifest(docs, "lang", "doc_id", leaf(*plain), {"doc_id": F.col("doc_id"), "changed": changed})
    rooted = F.lit(root.hex() if root else None).cast("string")
    folded = as_text(fold(F.coalesce("changed", "digest"), F.col("path")))
    out = rows.select("doc_id", as_text(F.col("digest")).alias("leaf"), as_text(F.col("top")).alias("subroot"), rooted.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL goes up: enough for 8^6 rows a language and as many languages.
_SQL_LEVELS = 6


def oracle() -> str:
    """The same in SQL, one step a level; crc32 by its table."""

    def value(c: str, text: str | None = None) -> str:
        s = text or f"CAST({c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode({s})) AS VARCHAR) || ':' || {s} END"

    low = f"translate(text, '{UPPER}', '{LOWER}')"
    plain = " || ".join(value(c) for c in FIELDS)
    tampered = " || ".join([*(value(c) for c in FIELDS[:-1]), value("text", low)])
    out = [
        "WITH RECURSIVE bits(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8)",
        "crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)",
        "crc AS (SELECT doc_id AS crc_id, xor(list_reduce(list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT)), lambda acc, x: xor(acc // 256, t[xor(acc % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 3 = 0 AS hit"
        " FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)",
        f"d0 AS (SELECT doc_id, lang, sha256({plain}) AS leaf, CASE WHEN hit THEN sha256({tampered}) ELSE sha256({plain}) END AS folded FROM documents LEFT JOIN crc ON doc_id = crc_id)",
        "d AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d0)",
        "l0 AS (SELECT lang AS g, pos, n, leaf AS h FROM d)",
    ]
    # Going up: runs of eight; a group of one node stays as it is.
    for tree, group in (("l", "g"), ("u", "g")):
        if tree == "u":
            out.append(f"u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, g AS lang FROM l{_SQL_LEVELS})")
        for k in range(_SQL_LEVELS):
            out.append(f"{tree}{k + 1} AS (SELECT g, pos // {FAN} AS pos, CASE WHEN max(n) = 1 THEN 1 ELSE (max(n) + {FAN - 1}) // {FAN} END AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {tree}{k} GROUP BY g, pos // {FAN})")
    # A leaf's others on each level and its own fold, level by level; then those of its language.
    out.append("p0 AS (SELECT d.*, d.pos AS at, CAST(u0.pos AS BIGINT) AS upos, CAST('' AS VARCHAR) AS proof FROM d JOIN u0 ON d.lang IS NOT DISTINCT FROM u0.lang)")
    step = 0
    for tree in ("l", "u"):
        at = "at" if tree == "l" else "upos"
        key = "x.g IS NOT DISTINCT FROM p.lang" if tree == "l" else "TRUE"
        for k in range(_SQL_LEVELS):
            out.append(
                f"p{step + 1} AS (SELECT p.r, any_value(p.doc_id) AS doc_id, any_value(p.lang) AS lang, any_value(p.leaf) AS leaf, any_value(p.{'upos' if tree == 'l' else 'at'}) AS {'upos' if tree == 'l' else 'at'}, any_value(p.{at}) // {FAN} AS {at},"
                f" CASE WHEN max(x.n) = 1 THEN any_value(p.folded) ELSE sha256(string_agg(CASE WHEN x.pos = p.{at} THEN p.folded ELSE x.h END, '' ORDER BY x.pos)) END AS folded,"
                f" any_value(p.proof) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> p.{at}), '') AS proof FROM p{step} p JOIN {tree}{k} x ON {key} AND x.pos // {FAN} = p.{at} // {FAN} GROUP BY p.r)"
            )
            step += 1
    top = _SQL_LEVELS
    out.append(f"done AS (SELECT doc_id, leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.h AS verified FROM p{step} p JOIN l{top} s ON s.g IS NOT DISTINCT FROM p.lang, u{top} u)")
    return ",\n".join(out) + "\nSELECT * FROM done"
