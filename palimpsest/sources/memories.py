"""The memory table: its schema, the mapping from documents, and a store of snapshots."""

from __future__ import annotations

import os
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import curve, text
from palimpsest.functions.lexicon import ORIGINS
from palimpsest.sources import shared
from palimpsest.sources.ledger import ConcurrentWrite, Ledger

#: The instant that reports are made for, where none is given.
NOW = "2024-02-01 00:00:00"

#: Tables of so many rows at most are dealt out evenly: their file may be one row group, which one task would read.
SMALL = 100_000

_TYPES = {
    T.StringType(): "id kind content content_hash origin ref status context affect",
    T.LongType(): "seq access_count retrieval_successes retrieval_failures evidence_count revision_count",
    T.DoubleType(): "trust importance strength storage_strength confidence review_streak",
    T.TimestampType(): "occurred_at created_at last_access_at updated_at last_review_at",
    T.ArrayType(T.StringType()): "cues",
}
_ORDER = "id seq kind content content_hash origin ref occurred_at trust cues created_at last_access_at updated_at last_review_at access_count retrieval_successes retrieval_failures importance strength storage_strength confidence status context affect evidence_count review_streak revision_count"
SCHEMA = T.StructType([T.StructField(c, next(t for t, names in _TYPES.items() if c in names.split())) for c in _ORDER.split()])


INTENTS = "id string, due_at timestamp, context_cue string, status string, content string"


def now(at: str = NOW) -> Column:
    return F.lit(at).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: usage from events, importance and affect from labels, the rest from the id."""
    docs, labels, events = (table(spark, sf_dir, t) for t in ("documents", "labels", "events"))
    n = docs.count()  # from the files' footers
    usage = (
        events.groupBy(F.pmod("event_id", F.lit(n)).alias("doc_id"))
        .agg(
            F.max("ts").alias("last_access_at"),
            F.count("*").alias("access_count"),
            F.count_if(F.col("event_type").isin("purchase", "signup")).alias("retrieval_successes"),
            F.count_if(F.col("event_type") == "error").alias("retrieval_failures"),
        )
    )
    d = F.col("doc_id")
    if n <= SMALL:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    rows = docs.join(labels, "doc_id", "left").join(usage, "doc_id", "left")
    tokens = text.tokenize(F.col("text"))
    zero = F.lit(0).cast("long")
    return rows.select(
        F.concat(F.lit("d"), d.cast("string")).alias("id"),
        (d + 1).alias("seq"),
        F.when(d % 4 == 0, "semantic").otherwise("episodic").alias("kind"),
        F.col("text").alias("content"),
        text.content_hash(F.col("text")).alias("content_hash"),
        F.get(F.array(*map(F.lit, ORIGINS)), (d % 5).cast("int")).alias("origin"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
        (0.5 + 0.02 * F.substring("source", 4, 9).cast("int")).alias("trust"),
        F.array_distinct(F.concat(F.array("source", "lang"), text.extract_cues(tokens, 3))).alias("cues"),
        (now() - F.make_dt_interval((d % 60).cast("int"), (d % 24).cast("int"))).alias("created_at"),
        F.col("last_access_at").cast("timestamp"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.when(d % 3 == 0, now() - F.make_dt_interval((d % 60 - 1).cast("int"), (d % 24).cast("int"))).alias("last_review_at"),
        F.coalesce("access_count", zero).alias("access_count"),
        F.coalesce("retrieval_successes", zero).alias("retrieval_successes"),
        F.coalesce("retrieval_failures", zero).alias("retrieval_failures"),
        curve.clamp(F.round(0.2 + 0.6 * F.coalesce("quality", F.lit(0)) + 0.01 * (d % 20), 2)).alias("importance"),
        (0.5 + 0.05 * (d % 10)).alias("strength"),
        (0.8 + 0.1 * (d % 8)).alias("storage_strength"),
        (0.4 + 0.06 * (d % 11)).alias("confidence"),
        F.when(d % 19 == 0, "recycled").otherwise("active").alias("status"),
        F.lit(None).cast("string").alias("context"),
        F.when(F.col("toxic") == 1, "negative").when(d % 17 == 0, "positive").alias("affect"),
        (1 + d % 5).alias("evidence_count"),
        (d % 4).cast("double").alias("review_streak"),
        F.when(d % 13 == 0, 1).otherwise(0).cast("long").alias("revision_count"),
    )


def active(mem: DataFrame, kind: str | None = None) -> DataFrame:
    rows = mem.where("status = 'active'")
    return rows.where(F.col("kind") == kind) if kind else rows


class Store:
    """Tables of a folder under one log. A write makes a new part and commits it, so readers never see half of it, and of
    two writers who began from the same version one wins."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.ledger = Ledger(spark, self.path)

    def version(self, name: str) -> str | None:
        """What identifies the table's present rows."""
        parts = self.ledger.state()["tables"].get(name)
        return None if parts is None else "|".join(p["at"] for p in parts)

    def read(self, name: str) -> DataFrame:
        parts = self.ledger.state()["tables"].get(name)
        if parts is None:
            if name == "memories":
                return self.spark.createDataFrame([], SCHEMA)
            raise FileNotFoundError(name)
        return self.ledger.frame(parts).drop("commit")

    def write(self, name: str, df: DataFrame, by: list[str] | None = None, expected: str | None = None) -> DataFrame:
        """A new snapshot. With expected, the version that df was made from: another one meanwhile raises ConcurrentWrite,
        and the store stays as it is."""
        self.write_all({name: df}, {} if expected is None else {name: expected}, {name: by} if by else {})
        return self.read(name)

    def write_all(self, tables: dict[str, DataFrame], expected: dict[str, str | None] | None = None, by: dict[str, list[str]] | None = None) -> None:
        """New snapshots of several tables in one commit; expected as for write()."""
        for _ in range(100):
            t = self.ledger.transaction()
            for name, version in (expected or {}).items():
                parts = t.parts(name)
                if (None if parts is None else "|".join(p["at"] for p in parts)) != version:
                    raise ConcurrentWrite(name)
            for name, df in tables.items():
                t.write(name, df, (by or {}).get(name))
            try:
                t.commit()
                return
            except ConcurrentWrite:
                if expected:
                    raise
        raise ConcurrentWrite(", ".join(tables))

    def vacuum(self, name: str | None = None) -> int:
        """Deletes all but the last commit, and parts that it doesn't name; how many. Readers of older ones must have ended."""
        return self.ledger.vacuum(kept=1)

    def merge(self, name: str, changes: DataFrame, key: str = "id") -> DataFrame:
        """Rows of changes in place of the rows with the same key."""
        version = self.version(name)
        old = self.read(name)
        return self.write(name, old.join(changes.select(key), key, "left_anti").unionByName(changes.select(old.columns)), expected=version)

    def delete(self, name: str, keys: DataFrame, key: str = "id") -> DataFrame:
        version = self.version(name)
        return self.write(name, self.read(name).join(keys.select(key).distinct(), key, "left_anti"), expected=version)

    def delete_memories(self, ids: DataFrame) -> None:
        """Memories with all that hangs on them (links, vectors, suppressed ids, recorded terms and cues), in one commit."""
        gone = ids.select("id").distinct()
        for _ in range(20):
            versions = {n: self.version(n) for n in ("memories", "links", "vectors", "suppressed", "terms", "cues") if self.version(n) is not None}
            new = {}
            for name in versions:
                rows = self.read(name)
                for column in ("src", "dst") if name == "links" else ("id",):
                    if column in rows.columns:
                        rows = rows.join(gone.withColumnRenamed("id", column), column, "left_anti").select(rows.columns)
                new[name] = rows
            try:
                return self.write_all(new, versions)
            except ConcurrentWrite:
                continue
        raise ConcurrentWrite("memories")

    def get_setting(self, key: str) -> str | None:
        return self.ledger.state()["properties"].get(key)

    def put_setting(self, key: str, value: str) -> None:
        self.ledger.update(lambda t: t.put(key, value))

    def read_or(self, name: str, schema: str) -> DataFrame:
        """A table, or an empty one where it was never written. Columns that it lacks are filled: schemas may grow."""
        if self.version(name) is None:
            return self.spark.createDataFrame([], schema)
        return migrated(self.read(name), self.spark.createDataFrame([], schema).schema)

    def export_json(self, path: str) -> None:
        """Active memories, intents and suppressed ids, as JSON lines in a folder each."""
        active(self.read("memories")).write.mode("overwrite").json(f"{path}/memories")
        self.read_or("intents", INTENTS).write.mode("overwrite").json(f"{path}/intents")
        self.read_or("suppressed", "id string").write.mode("overwrite").json(f"{path}/suppressed")

    def import_json(self, path: str) -> DataFrame:
        """Rows of an export under their own ids; ids already present keep the stored row. Intents and the suppressed ids that
        exist come along, all in one commit."""
        def rows(name: str, schema) -> DataFrame:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
            return self.spark.read.schema(schema).json(f"{path}/{name}") if there else self.spark.createDataFrame([], schema)

        versions = {n: self.version(n) for n in ("memories", "intents", "suppressed")}
        new = rows("memories", SCHEMA)
        old = self.read("memories")
        mem = old.unionByName(new.join(old.select("id"), "id", "left_anti").select(old.columns))
        intents = self.read_or("intents", INTENTS)
        intents = intents.unionByName(rows("intents", INTENTS).join(intents.select("id"), "id", "left_anti").select(intents.columns))
        ids = self.read_or("suppressed", "id string").unionByName(rows("suppressed", "id string")).distinct()
        self.write_all({"memories": mem, "intents": intents, "suppressed": ids.join(mem.select("id"), "id", "left_semi")}, versions)
        return self.read("memories")


#: What columns hold in rows from before they existed; others are null.
DEFAULTS = {
    "trust": 0.5, "importance": 0.5, "strength": 0.5, "storage_strength": 1.0, "confidence": 0.6, "review_streak": 0.0, "access_count": 0, "retrieval_successes": 0, "retrieval_failures": 0,
    "evidence_count": 1, "revision_count": 0, "status": "active", "kind": "episodic", "origin": "user",
}


def migrated(rows: DataFrame, schema: T.StructType = SCHEMA) -> DataFrame:
    """Rows in the present schema: columns they lack get their defaults, nulls in stored rows stay."""
    def column(f: T.StructField) -> Column:
        if f.name in rows.columns:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        return (F.array() if f.name == "cues" else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)

    return rows.select(*(column(f) for f in schema))


class MemoryStore(Store):
    """A store without files of its own: tables live as long as the session does."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.tables, self.settings, self.lock = spark, "", {}, {}, threading.Lock()

    def version(self, name: str) -> str | None:
        return self.tables[name][0] if name in self.tables else None

    def read(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name][1]
        if name == "memories":
            return self.spark.createDataFrame([], SCHEMA)
        raise FileNotFoundError(name)

    def write_all(self, tables: dict[str, DataFrame], expected: dict[str, str | None] | None = None, by: dict[str, list[str]] | None = None) -> None:
        new = {name: (uuid.uuid4().hex, shared.written(df, name)) for name, df in tables.items()}
        with self.lock:
            for name, version in (expected or {}).items():
                if self.version(name) != version:
                    raise ConcurrentWrite(name)
            self.tables |= new

    def get_setting(self, key: str) -> str | None:
        return self.settings.get(key)

    def put_setting(self, key: str, value: str) -> None:
        self.settings[key] = value

    def vacuum(self, name: str | None = None) -> int:
        return 0


def open_store(spark: SparkSession, path: str | None = None) -> Store:
    """The store in a folder, or one in memory without a path."""
    return MemoryStore(spark) if path is None else Store(spark, os.fspath(path))
