"""Streams of accesses and of conversation turns."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.sources import shared
from palimpsest.sources.ledger import Files, Ledger, Transaction


def stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A file stream of the events table (a folder of parquet files or one file)."""
    schema = spark.read.parquet(path).schema
    source, pattern = (path, "*.parquet") if _is_folder(spark, path) else path.rsplit("/", 1)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern).parquet(source)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


STATE = "n long, successes long, failures long, streak long, strength double, last long"


def clamped_sum(start: float, step: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """start after x -> min(high, max(low, x + step)) for each row in turn. Two such moves make one of the same kind, so
    neighbours are joined until one is left."""
    step, low, high = step.astype(float), low.astype(float), high.astype(float)
    while len(step) > 1:
        if len(step) % 2:
            step, low, high = np.append(step, 0.0), np.append(low, -np.inf), np.append(high, np.inf)
        s, l, h = step[1::2], low[1::2], high[1::2]  # noqa: E741
        low, high = np.clip(low[0::2] + s, l, h), np.clip(high[0::2] + s, l, h)
        step = step[0::2] + s
    return float(min(high[0], max(low[0], start + step[0]))) if len(step) else start


def fold_one(state: tuple | None, rows: pd.DataFrame) -> tuple:
    """Access state after the rows, in order of time: successes strengthen and lengthen the streak, errors end it."""
    n, good, bad, streak, strength, last = state or (0, 0, 0, 0, 0.5, 0)
    rows = rows.sort_values(["ts", "event_id"])
    won = rows["event_type"].isin(["purchase", "signup"]).to_numpy()
    lost = (rows["event_type"] == "error").to_numpy()
    # A success adds up to 1, an error takes away down to 0.3, and neither bounds the other way.
    step = np.where(won, 0.05, np.where(lost, -0.05, 0.0))
    strength = clamped_sum(strength, step, np.where(lost, 0.3, -np.inf), np.where(won, 1.0, np.inf))
    ends = np.nonzero(lost)[0]
    streak = int(won[ends[-1] + 1 :].sum()) if len(ends) else streak + int(won.sum())
    last = max([last, *(rows["ts"].max().value // 1000 for _ in rows.index[:1])])
    return n + len(rows), good + int(won.sum()), bad + int(lost.sum()), streak, strength, int(last)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames))
    new = fold_one(state.get if state.exists else None, rows)
    state.update(new)
    yield pd.DataFrame([[key[0], *new[:5]]], columns=["user_id", "n", "successes", "failures", "streak", "strength"])


def fold(events: DataFrame) -> DataFrame:
    """Stateful fold by user: a row of the state after each batch that has events of the user."""
    return events.groupBy("user_id").applyInPandasWithState(
        _update, "user_id long, n long, successes long, failures long, streak long, strength double", STATE, "update", GroupStateTimeout.NoTimeout
    )


def run_to_table(df: DataFrame, name: str, mode: str = "append", options: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over what is there now into files of the shared folder, and reads them: all batches of an append or
    update stream (with `batch`, its number), the last of a complete one."""
    into = shared.shared_path(df.sparkSession, name)
    return run_into(df, into, mode, options)


def run_into(df: DataFrame, into: str, mode: str = "append", options: dict[str, str] | None = None) -> DataFrame:
    """The same into a given folder, where it goes on from the checkpoint that an earlier run has left. A batch has a
    folder of its own that a replay overwrites, so it counts once. State is kept in as many partitions as the cluster has
    cores, or fewer where the session says so: each is a store that every batch opens."""
    spark, seen = df.sparkSession, []
    cores, shuffle = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    options = {"spark.sql.shuffle.partitions": str(min(cores, shuffle)), **(options or {})}

    def keep(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{into}/rows/batch={k}")
        seen.append(k)

    with settings(spark, options):
        query = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{into}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    schema = T.StructType([*df.schema, T.StructField("batch", T.LongType())])
    if not seen and not Files(spark).names(f"{into}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{into}/rows")
    return rows.where(F.col("batch") == seen[-1]).drop("batch") if mode == "complete" else rows


@contextlib.contextmanager
def settings(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a stream starts and runs; afterwards they are as before."""
    old = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replayed(rows: DataFrame, slice_of: Column, slices: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table as a stream in so many arrivals: the rows of slice 0 come first, and so on. run(stream) is called after each
    arrival and must go on where it was; returns what the last call returns."""
    spark = rows.sparkSession
    folder = shared.shared_path(spark, "arrivals")
    dealt = shared.written(rows.withColumn("__slice", slice_of), "slices")
    schema = rows.schema
    out = None
    for k in range(slices):
        dealt.where(F.col("__slice") == k).drop("__slice").write.mode("append").parquet(folder)
        out = run(spark.readStream.schema(schema).parquet(folder))
    return out


def folded(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each user."""
    rows = run_to_table(fold(stream(spark, path)), "access_fold", "update")
    state = F.struct("n", "successes", "failures", "streak", F.round("strength", 6).alias("strength"))
    return rows.groupBy("user_id").agg(F.max_by(state, "n").alias("s")).select("user_id", "s.*")


def tumbling(spark: SparkSession, path: str, width: str = "1 day") -> DataFrame:
    rows = stream(spark, path).withWatermark("ts", "1 hour").groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return run_to_table(rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("v", 4).alias("value")), "tumbling", "complete")


def sessions(spark: SparkSession, path: str, gap: str = "2 hours") -> DataFrame:
    rows = stream(spark, path).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return run_to_table(rows.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n"), "sessions", "complete")


def windows(events: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums by window and type, each window once, when the watermark has passed its end. Events that come again
    within the delay count once, those that come after the watermark has passed them not at all."""
    rows = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    rows = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("value", 4).alias("value"))


def turns(spark: SparkSession, path: str, without: DataFrame | None = None) -> DataFrame:
    """Conversation turns as memories, as they come; of conversations in `without` (conv_id, a table) none."""
    from palimpsest.operators.index import turn_segments

    schema = spark.read.parquet(path).schema
    source, pattern = (path, "*.parquet") if _is_folder(spark, path) else path.rsplit("/", 1)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    if without is not None:
        rows = rows.join(without.select("conv_id").distinct(), "conv_id", "left_anti")
    return run_to_table(turn_segments(rows), "turn_memories").drop("batch")


#: What accesses add to memories before they are folded in.
ACCESSES = "memory_id string, n long, last timestamp"


def take_accesses(ledger: Ledger, batch: DataFrame, k: int, stream: str = "accesses") -> bool:
    """Adds a batch of accesses (memory_id, ts) as counts, in the commit that marks the batch as taken; False where it was
    taken before, so a batch that is replayed counts once."""
    used = batch.groupBy("memory_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))

    def change(t: Transaction) -> bool:
        if t.taken(stream, k):
            return False
        t.append("accesses", used)
        return True

    return ledger.update(change)


def merge_accesses(accesses: DataFrame, ledger: Ledger, checkpoint: str, stream: str = "accesses") -> None:
    """Runs a stream of accesses into the ledger, up to what is there now."""
    query = accesses.writeStream.foreachBatch(lambda rows, k: take_accesses(ledger, rows, k, stream) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def with_accesses(mem: DataFrame, added: DataFrame) -> DataFrame:
    """Memories with the counts that have come since; accesses of memories that are gone count for nothing."""
    sums = added.groupBy(F.col("memory_id").alias("id")).agg(F.sum("n").alias("__n"), F.max("last").alias("__t"))
    rows = mem.join(sums, "id", "left")
    return rows.withColumns({"access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)), "last_access_at": F.greatest("last_access_at", "__t")}).drop("__n", "__t")


def fold_accesses(ledger: Ledger, name: str = "memories") -> int:
    """Folds what has come into the memories and empties it, in one commit; how many deltas that were."""

    def change(t: Transaction) -> int:
        parts = t.parts("accesses") or []
        if parts:
            t.write(name, with_accesses(t.read(name), t.read("accesses")))
            t.drop("accesses")
        return len(parts)

    return ledger.update(change)
