"""Connected components of a graph of long ids: forests of parts, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common

#: So many edges at most are one task's work (16 MB); larger graphs go by steps. Results are the same.
ONE_TASK = 500_000


def _forests(edges: DataFrame) -> DataFrame:
    """A star forest for the edges of each partition, at the smallest id of each star: fewer edges with the same
    components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (y := up.setdefault(top, top)) != top:
                top = y
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ra, rb = root(a), root(b)
                if ra != rb:
                    up[max(ra, rb)] = min(ra, rb)
        found = np.array([(x, root(x)) for x in list(up) if root(x) != x], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """id, root for every id in edges (columns u and v, neither null): root is the smallest id of its component.

    A hub's edges are met by partial aggregation and joins that can be split; each step's edges are written to the
    shared folder. Once a bounded number of edges is left, one task finds their forest.
    """
    now = common.written(_forests(edges.where("u <> v")).distinct(), "edges")
    seen = None
    for _ in range(most):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        if state["n"] <= one_task:
            now = common.written(_forests(now.coalesce(1)), "edges")
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        now = common.written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
