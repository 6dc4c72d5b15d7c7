"""Indexes that are kept: terms and vectors, with additions, replacements, removals and compaction.

An index is a few tables of a ledger. Additions are parts of their own and removals are rows too; what has come since the
last compaction says which older rows no longer hold, and only that is read to tell. Reading by term or by bucket opens the
folders of those alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import index, vector
from palimpsest.sources import shared
from palimpsest.sources.ledger import Ledger, Transaction

#: Folders of postings, and of documents.
BUCKETS = 16
#: The leading bits of a code that name a folder.
LEADING = 4


class Index:
    """What both kinds share: which rows hold. MAIN is the table with a row an id."""

    MAIN = ""

    def __init__(self, ledger: Ledger, name: str) -> None:
        self.ledger, self.name, self.spark = ledger, name, ledger.spark

    def table(self, kind: str) -> str:
        return f"{self.name}.{kind}"

    def parts(self, kind: str, t: Transaction | None = None) -> list[dict]:
        if t is not None:
            return t.parts(self.table(kind)) or []
        return self.ledger.state()["tables"].get(self.table(kind), [])

    def _changes(self, id_type: T.DataType, t: Transaction | None = None) -> DataFrame:
        """id, newest, gone: of the ids that have come or gone since the oldest part, the last commit that brought and the
        last that removed them. Its size is that of the additions, not of the index."""
        schema = T.StructType([T.StructField("id", id_type)])
        came = self.ledger.frame(self._numbered(self.parts(self.MAIN, t)[1:]), schema).select("id", F.col("commit").alias("newest"), F.lit(None).cast("long").alias("gone"))
        went = self.ledger.frame(self._numbered(self.parts("removed", t)), schema).select("id", F.lit(None).cast("long").alias("newest"), F.col("commit").alias("gone"))
        return came.unionByName(went).groupBy("id").agg(F.max("newest").alias("newest"), F.max("gone").alias("gone"))

    @staticmethod
    def _numbered(parts: list[dict]) -> list[dict]:
        """Parts of the running transaction count as newer than all others."""
        return [p if p["commit"] else {**p, "commit": 1 << 60} for p in parts]

    def _holding(self, kind: str, schema: T.StructType, t: Transaction | None = None, where: Column | None = None) -> DataFrame:
        """The rows of a table that hold, with `commit`."""
        rows = self.ledger.frame(self._numbered(self.parts(kind, t)), schema)
        rows = rows.where(where) if where is not None else rows
        changes = self._changes(schema["id"].dataType, t).withColumnRenamed("id", "__id")
        kept = rows.join(changes, F.col("id") == F.col("__id"), "left")
        return kept.where("commit >= coalesce(newest, commit) and commit >= coalesce(gone, commit)").drop("__id", "newest", "gone")

    def _forget(self, t: Transaction, ids: DataFrame) -> None:
        t.append(self.table("removed"), ids.select("id").distinct())


class TermIndex(Index):
    """Postings in folders by term, document frequencies as sums of additions and removals, and each id's terms."""

    MAIN = "docs"
    DOCS = T.StructType([T.StructField("id", T.StringType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("folder", T.IntegerType())])
    POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", T.StringType()), T.StructField("folder", T.IntegerType())])
    COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("folder", T.IntegerType())])

    @staticmethod
    def folder(term: Column) -> Column:
        return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")

    @staticmethod
    def folders(terms: list[str]) -> list[int]:
        return sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})

    def _write(self, t: Transaction, kind: str, rows: DataFrame, replace: bool = False) -> None:
        key = "id" if kind == "docs" else "term"
        rows = rows.withColumn("folder", self.folder(F.col(key)))
        # A folder's rows go to several tasks, so one with a very frequent term is no one task's work.
        rows = rows.repartition("folder", F.pmod(F.xxhash64(*[c for c in rows.columns if c in ("id", "term")]), F.lit(4))).sortWithinPartitions("folder", key)
        (t.write if replace else t.append)(self.table(kind), rows, ["folder"])

    def put(self, mem: DataFrame) -> None:
        """Takes in memories (id, content, cues); of ids that are there already the old terms go."""
        items = shared.written(index.item_terms(mem), "terms")
        postings = shared.written(index.exploded(items).select("term", "id"), "postings")
        counts = postings.groupBy("term").agg(F.count("*").alias("n"))

        def change(t: Transaction) -> None:
            old = self._old(t, items)
            gone = index.exploded(old).groupBy("term").agg((-F.count("*")).alias("n"))
            both = counts.unionByName(gone).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
            self._write(t, "counts", both)
            self._write(t, "docs", items)
            self._write(t, "postings", postings)

        self.ledger.update(change)

    def _old(self, t: Transaction, ids: DataFrame) -> DataFrame:
        held = self._holding("docs", self.DOCS, t)
        return shared.written(held.select("id", "terms").join(ids.select("id").distinct(), "id", "left_semi"), "old")

    def remove(self, ids: DataFrame) -> None:
        def change(t: Transaction) -> None:
            old = self._old(t, ids)
            self._write(t, "counts", index.exploded(old).groupBy("term").agg((-F.count("*")).alias("n")))
            self._forget(t, old)

        self.ledger.update(change)

    def terms(self) -> DataFrame:
        """term, id of all postings that hold."""
        return self._holding("postings", self.POSTINGS).select("term", "id")

    def find(self, terms: list[str]) -> DataFrame:
        """term, id of some terms' postings; only their folders are read."""
        hit = F.col("folder").isin(self.folders(terms)) & F.col("term").isin(terms)
        return self._holding("postings", self.POSTINGS, where=hit).select("term", "id")

    def df(self, terms: list[str] | None = None) -> DataFrame:
        """term, df."""
        rows = self.ledger.frame(self.parts("counts"), self.COUNTS)
        if terms is not None:
            rows = rows.where(F.col("folder").isin(self.folders(terms)) & F.col("term").isin(terms))
        return rows.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def size(self) -> int:
        return self._holding("docs", self.DOCS).count()

    def compact(self) -> None:
        """One part a table again, without what no longer holds."""

        def change(t: Transaction) -> None:
            docs = self._holding("docs", self.DOCS, t).select("id", "terms")
            postings = self._holding("postings", self.POSTINGS, t).select("term", "id")
            counts = t.read(self.table("counts"), self.COUNTS).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
            for kind, rows in (("docs", docs), ("postings", postings), ("counts", counts)):
                self._write(t, kind, rows, replace=True)
            t.drop(self.table("removed"))

        self.ledger.update(change)


def cosines(a: Column, b: Column) -> Column:
    """Cosine of two vectors a row, by blocks; 0 where one has no length."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            if not len(x):
                yield pd.Series([], dtype=float)
                continue
            p, q = np.stack(x.to_numpy()).astype(float), np.stack(y.to_numpy()).astype(float)
            size = np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))
            yield pd.Series(np.divide((p * q).sum(axis=1), size, out=np.zeros(len(p)), where=size > 0))

    return run(a, b)


class VectorIndex(Index):
    """Vectors and their buckets: signs against random planes in several tables. Its dimension, planes and number of bits
    are kept with it; what has another dimension is refused."""

    MAIN = "vectors"

    @staticmethod
    def create(ledger: Ledger, name: str, dim: int, expected_rows: int, tables: int = vector.TABLES, seed: int = vector.SEED, id_type: str = "bigint") -> VectorIndex:
        ledger.update(lambda t: t.put(f"vectors:{name}", {"dim": dim, "bits": vector.bits_for(expected_rows), "tables": tables, "seed": seed, "id": id_type}))
        return VectorIndex(ledger, name)

    @property
    def about(self) -> dict:
        """dim, bits, tables, seed and the ids' type."""
        return self.ledger.state()["properties"][f"vectors:{self.name}"]

    def _schemas(self) -> tuple[T.StructType, T.StructType]:
        id_type = T._parse_datatype_string(self.about["id"])
        vectors = T.StructType([T.StructField("id", id_type), T.StructField("vector", T.ArrayType(T.FloatType()))])
        buckets = T.StructType([T.StructField("id", id_type), T.StructField("code", T.LongType()), T.StructField("tab", T.IntegerType()), T.StructField("lead", T.IntegerType())])
        return vectors, buckets

    @staticmethod
    def _coded(rows: DataFrame, about: dict, probe: bool = False) -> DataFrame:
        """The rows' buckets: tab, lead (leading bits) and code."""
        bits, tables = about["bits"], about["tables"]
        normals = vector.planes(about["dim"], bits * tables, about["seed"])

        @F.pandas_udf("array<struct<tab: int, code: long>>")
        def codes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            near = [0, *(1 << k for k in range(bits))] if probe else [0]
            for x in parts:
                on = (np.stack(x.to_numpy()).astype(float) @ normals.T >= 0) if len(x) else np.zeros((0, bits * tables), bool)
                code = on.reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.Series([[{"tab": t, "code": int(c) ^ m} for t, c in enumerate(row) for m in near] for row in code])

        each = rows.select("*", F.explode(codes("vector")).alias("__b")).select(*[c for c in rows.columns if c != "vector"], "__b.tab", "__b.code")
        return each.withColumn("lead", F.shiftright("code", max(0, bits - LEADING)).cast("int"))

    def _write(self, t: Transaction, rows: DataFrame, about: dict, replace: bool = False) -> None:
        put = t.write if replace else t.append
        put(self.table("vectors"), rows.select("id", "vector").repartition("id"))
        buckets = self._coded(rows, about).select("id", "code", "tab", "lead")
        put(self.table("buckets"), buckets.repartition("tab", "lead").sortWithinPartitions("tab", "lead", "code"), ["tab", "lead"])

    def add(self, rows: DataFrame) -> None:
        """Takes in id, vector; an id that is there already gets the new vector. Rows without a vector are left out; of several
        rows of an id the greatest vector counts."""
        about = self.about
        good = rows.where("id is not null and vector is not null").groupBy("id").agg(F.max(F.col("vector").cast("array<float>")).alias("vector"))
        good = shared.written(good, "added")
        other = good.where(F.size("vector") != about["dim"]).first()
        if other is not None:
            raise ValueError(f"{len(other['vector'])} dimensions instead of {about['dim']}")
        self.ledger.update(lambda t: self._write(t, good, about))

    def remove(self, ids: DataFrame) -> None:
        """Ids that are not there change nothing."""
        gone = shared.written(ids.select("id").distinct(), "gone")
        self.ledger.update(lambda t: self._forget(t, gone))

    def clear(self) -> None:
        def change(t: Transaction) -> None:
            for kind in ("vectors", "buckets", "removed"):
                t.drop(self.table(kind))

        self.ledger.update(change)

    def vectors(self) -> DataFrame:
        """id, vector of all that is there."""
        return self._holding("vectors", self._schemas()[0]).select("id", "vector")

    def has(self, ids: DataFrame) -> DataFrame:
        """id, present of each id asked for."""
        there = self._holding("vectors", self._schemas()[0]).select("id", F.lit(True).alias("present"))
        return ids.select("id").distinct().join(there, "id", "left").select("id", F.coalesce("present", F.lit(False)).alias("present"))

    def size(self) -> int:
        return self._holding("vectors", self._schemas()[0]).count()

    def compact(self) -> None:
        """One part a table again, in buckets for the present number of rows."""

        def change(t: Transaction) -> None:
            rows = shared.written(self._holding("vectors", self._schemas()[0], t).select("id", "vector"), "live")
            about = {**self.about, "bits": vector.bits_for(rows.count())}
            t.put(f"vectors:{self.name}", about)
            self._write(t, rows, about, replace=True)
            t.drop(self.table("removed"))

        self.ledger.update(change)

    def candidates(self, queries: DataFrame) -> DataFrame:
        """query, id, commit: what shares a bucket with a query (query, vector) or one that is one sign away."""
        asked = self._coded(queries, self.about, probe=True).select("query", F.col("tab").alias("__tab"), F.col("lead").alias("__lead"), F.col("code").alias("__code"))
        asked = shared.written(asked, "asked")  # computed once; of few queries it is broadcast and prunes the folders
        rows = self.ledger.frame(self.parts("buckets"), self._schemas()[1])
        same = (F.col("tab") == F.col("__tab")) & (F.col("lead") == F.col("__lead")) & (F.col("code") == F.col("__code"))
        return rows.join(asked, same).select("query", "id", "commit").distinct()

    def search(self, queries: DataFrame, k: int = 10, least: float | None = None, rounded: int = 6) -> DataFrame:
        """query, id, similarity, rank: the k most similar of the candidates (with `least`, those from that cosine on). A query
        whose own id is in the index does not find itself."""
        held = self._holding("vectors", self._schemas()[0]).select("id", "commit", "vector")
        near = self.candidates(queries).join(held, ["id", "commit"]).join(queries.select("query", F.col("vector").alias("__q")), "query")
        if queries.schema["query"].dataType == near.schema["id"].dataType:
            near = near.where("query <> id")
        near = near.select("query", "id", F.round(cosines(F.col("vector"), F.col("__q")), rounded).alias("similarity"))
        near = near.where(F.col("similarity") >= least) if least is not None else near
        return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


def open_ledger(spark: SparkSession, path: str | None = None) -> Ledger:
    """The ledger of a folder, or a new one in the shared folder that goes with the application."""
    return Ledger(spark, path or shared.shared_path(spark, "ledger"))
