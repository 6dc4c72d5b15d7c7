"""Sharding by a Feistel permutation of global row numbers.

A row's place in the shuffled order is a keyed permutation of its row number
in the order of ids, so shard and slot of any row number can be computed, and
computed back, without the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import common

SHARDS = 8
KEY = 20240611
ROUNDS = 6
#: Ranges of ids that are numbered side by side; a range holds about its share of the rows however ids are spread.
RANGES = 1024


class Feistel:
    """A permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walking cycles
    until a value is below n."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS) -> None:
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = common.mix(np.arange(rounds, dtype=np.uint64) + np.uint64(key % (1 << 64)))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (common.mix(left + k) & self.mask), left
            else:
                left, right = right, left ^ (common.mix(right + k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while len(far := np.nonzero(out >= self.n)[0]):
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def place(self, row: np.ndarray) -> np.ndarray:
        """Places of row numbers in the shuffled order."""
        return self._walk(row, False)

    def row(self, place: np.ndarray) -> np.ndarray:
        """Row numbers of places: place() backwards."""
        return self._walk(place, True)


def row_numbers(df: DataFrame, key: str, ties: list[Column], name: str = "row") -> DataFrame:
    """Adds the number of each row from 0, by key and then by ties, nulls first.

    Ranges of the key are numbered side by side; the counts of the ranges (RANGES at most) give each one's start.
    Rows equal in key and ties get their numbers among themselves in any order.
    """
    spread = [(i + 1) / RANGES for i in range(RANGES - 1)]
    found = df.agg(F.percentile_approx(key, spread, 20 * RANGES).alias("b")).first()["b"] if RANGES > 1 else []
    bounds = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(bounds, keys.to_numpy(), "right") + 1).astype(np.int32))

    # Nulls stay out of the batches, which would turn to floats and blur ids beyond 2**53.
    parted = df.withColumn("__range", F.when(F.col(key).isNull(), 0).otherwise(range_of(F.coalesce(key, F.lit(0)))))
    counts = {r["__range"]: r["count"] for r in parted.groupBy("__range").count().collect()}  # RANGES + 1 at most
    starts, at = [], 0
    for k in range(len(bounds) + 2):
        starts.append(at)
        at += counts.get(k, 0)
    order = Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first(), *ties)
    first = F.element_at(F.lit(starts).cast("array<long>"), F.col("__range") + 1)
    return parted.withColumn(name, F.row_number().over(order) - 1 + first).drop("__range")


def shard(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", seed: int = KEY) -> DataFrame:
    """key, size, text_crc32, row, shard, slot for every row.

    Law `rows`: place p of the permuted row number goes to shard p mod shards, slot p div shards, so counts differ by
    one at most and slots have no gaps. Null text: size 1, crc32 of nothing. Null keys are numbered first; rows with
    the same key are ordered by crc32 and size, and rows equal in these are alike. An empty table gives no rows.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = common.written(df.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")), "sizes")
    rows = slim.count()
    numbered = row_numbers(slim, "doc_id", [F.col("text_crc32"), F.col("size")])
    network = Feistel(rows, seed)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(network.place(numbers.to_numpy()))

    placed = numbered.withColumn("place", place("row"))
    return placed.select("doc_id", "size", "text_crc32", "row", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
