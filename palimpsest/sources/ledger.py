"""Tables under one log: a commit names a version of every table, so several tables change in one step or not at all.

A table is a list of parts, folders of Parquet files; a part is never changed. The log has a file for each commit, which
holds the whole state: the parts of each table, properties (small settings) and, for each stream that writes, the last
batch that has been taken in. Writers put the next file only if it is absent; who comes second looks at what the other has
changed, and goes on behind it or, if both touched the same table, starts anew from there. Parts that no commit names are
what a crash has left: readers never see them, vacuum() deletes them.
"""

from __future__ import annotations

import copy
import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Commits that are kept for readers that have begun before the newest.
KEPT = 10


class ConcurrentWrite(RuntimeError):
    """Another commit changed a table that this one has read or written."""


class Files:
    """The few file operations that the log needs, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def names(self, path: str) -> list[str]:
        system, where = self.at(path)
        return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []

    def delete(self, path: str) -> bool:
        system, where = self.at(path)
        return bool(system.delete(where, True))

    def read(self, path: str) -> str:
        system, where = self.at(path)
        stream = system.open(where)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_if_absent(self, path: str, content: str) -> bool:
        """Writes a file whole, unless it is there already. Of several writers one wins: a rename does not replace on a
        distributed file system, and a link does not on a local one."""
        jvm = self.spark._jvm
        system, where = self.at(f"{path}.{uuid.uuid4().hex}.new")
        out = system.create(where, True)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if system.getUri().getScheme() == "file":
                of = lambda p: jvm.java.io.File(jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(of(path), of(where.toString()))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(where, jvm.org.apache.hadoop.fs.Path(path), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:  # noqa: BLE001
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            system.delete(where, False)


class Ledger:
    """Tables of a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def head(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json")), default=0)

    def state(self, version: int | None = None) -> dict:
        """tables: the parts of each, newest last; properties; batches."""
        version = self.head() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "properties": {}, "batches": {}}
        return json.loads(self.files.read(f"{self.path}/log/{version:020d}.json"))

    def frame(self, parts: list[dict], schema: T.StructType | None = None) -> DataFrame:
        """The rows of some parts, with `commit`, the number of the commit that added them. Columns may be added over time:
        parts that lack one have null there."""
        out = None
        for part in parts:
            rows = self.spark.read.schema(T.StructType.fromJson(part["schema"])).parquet(f"{self.path}/{part['at']}").withColumn("commit", F.lit(part["commit"]).cast("long"))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            return self.spark.createDataFrame([], T.StructType([*(schema or T.StructType()), T.StructField("commit", T.LongType())]))
        return out

    def read(self, name: str, version: int | None = None) -> DataFrame:
        parts = self.state(version)["tables"].get(name)
        if parts is None:
            raise FileNotFoundError(name)
        return self.frame(parts).drop("commit")

    def transaction(self) -> Transaction:
        return Transaction(self)

    def update(self, change: Callable[[Transaction], object], tries: int = 20) -> object:
        """Runs change(transaction) and commits; where another commit got in between, anew on the state it has left."""
        for k in range(tries):
            t = self.transaction()
            out = change(t)
            try:
                t.commit()
                return out
            except ConcurrentWrite:
                if k == tries - 1:
                    raise
                time.sleep(random.uniform(0, 0.05 * 2 ** min(k, 5)))

    def vacuum(self, kept: int = KEPT) -> int:
        """Deletes older commits than the last `kept` and parts that none of those names; how many parts. Writers that have not
        committed yet must have ended."""
        head = self.head()
        versions = sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json"))
        old = [v for v in versions if v <= head - kept]
        live = {part["at"] for v in versions if v not in old for parts in self.state(v)["tables"].values() for part in parts}
        gone = 0
        for name in self.files.names(self.path):
            if name != "log":
                for part in self.files.names(f"{self.path}/{name}"):
                    if part.startswith("p-") and f"{name}/{part}" not in live:
                        gone += self.files.delete(f"{self.path}/{name}/{part}")
        for v in old:
            self.files.delete(f"{self.path}/log/{v:020d}.json")
        return gone


class Transaction:
    """Changes on top of one state, unseen until commit()."""

    def __init__(self, ledger: Ledger) -> None:
        self.ledger, self.base = ledger, ledger.state()
        self.next = copy.deepcopy(self.base)
        self.used: set[str] = set()
        self.appended: dict[str, list[dict]] = {}
        self.replaced: dict[str, list[dict]] = {}
        self.properties: dict[str, object] = {}
        self.batches: dict[str, int] = {}

    def parts(self, name: str) -> list[dict] | None:
        self.used.add(name)
        return self.next["tables"].get(name)

    def exists(self, name: str) -> bool:
        return self.parts(name) is not None

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """A table as this transaction sees it."""
        parts = self.parts(name)
        if parts is None and schema is None:
            raise FileNotFoundError(name)
        return self.ledger.frame(parts or [], schema).drop("commit")

    def _part(self, name: str, df: DataFrame, by: list[str] | None) -> dict:
        at = f"{name}/p-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.ledger.path}/{at}")
        return {"at": at, "schema": json.loads(df.schema.json()), "commit": None}

    def write(self, name: str, df: DataFrame, by: list[str] | None = None) -> None:
        """df in place of the table."""
        self.replaced[name] = [self._part(name, df, by)]
        self.appended.pop(name, None)
        self.next["tables"][name] = self.replaced[name]

    def append(self, name: str, df: DataFrame, by: list[str] | None = None) -> None:
        """df beside what the table has. Two commits that only append to a table do not disturb each other."""
        part = self._part(name, df, by)
        self.appended.setdefault(name, []).append(part)
        self.next["tables"][name] = [*self.next["tables"].get(name, []), part]

    def drop(self, name: str) -> None:
        self.replaced[name] = []
        self.appended.pop(name, None)
        self.next["tables"].pop(name, None)

    def get(self, key: str, default: object = None) -> object:
        self.used.add(f"property:{key}")
        return self.next["properties"].get(key, default)

    def put(self, key: str, value: object) -> None:
        self.properties[key] = value
        self.next["properties"][key] = value

    def taken(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch has been taken in before; if not, this commit marks it."""
        if batch <= self.base["batches"].get(stream, -1):
            return True
        self.used.add(f"batch:{stream}")
        self.batches[stream] = batch
        return False

    def _changed(self, other: dict) -> bool:
        """Whether what was read or replaced here is another in a later state."""
        for name in self.used | set(self.replaced):
            kind, _, key = name.partition(":")
            if kind in ("property", "batch") and key:
                where = "properties" if kind == "property" else "batches"
                if self.base[where].get(key) != other[where].get(key):
                    return True
            elif self.base["tables"].get(name) != other["tables"].get(name):
                return True
        return False

    def commit(self) -> int:
        """The commit's number. Raises ConcurrentWrite, with nothing changed, if a table that was read or replaced here is no
        longer what it was."""
        state = self.base
        while True:
            new = copy.deepcopy(state)
            new["version"] = state["version"] + 1
            for name, parts in self.replaced.items():
                new["tables"][name] = copy.deepcopy(parts)
                if not parts:
                    del new["tables"][name]
            for name, parts in self.appended.items():
                new["tables"][name] = [*new["tables"].get(name, []), *copy.deepcopy(parts)]
            for parts in new["tables"].values():
                for part in parts:
                    part["commit"] = part["commit"] or new["version"]
            new["properties"] |= self.properties
            new["batches"] |= self.batches
            if self.ledger.files.put_if_absent(f"{self.ledger.path}/log/{new['version']:020d}.json", json.dumps(new)):
                return new["version"]
            state = self.ledger.state(new["version"])
            if self._changed(state):
                raise ConcurrentWrite(", ".join(sorted(self.used | set(self.replaced))))
