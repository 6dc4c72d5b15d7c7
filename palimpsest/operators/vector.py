"""Vectors: exact and hashed nearest neighbours, and n-gram embeddings."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TABLES, SEED = 12, 42
#: Queries that are sent to all tasks at once; more are met in blocks of so many.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _chosen(vectors: DataFrame, queries: list[int] | DataFrame, key: str) -> DataFrame:
    """The rows of the queries, given as a list or as a table with their ids."""
    if isinstance(queries, DataFrame):
        return vectors.join(queries.select(key).distinct(), key, "left_semi")
    return vectors.where(F.col(key).isin(*queries))


def _few(queries: list[int] | DataFrame) -> bool:
    return (queries.count() if isinstance(queries, DataFrame) else len(queries)) <= BLOCK


#: Numbers of a block of similarities that a task holds at once.
CELLS = 1 << 22


def _query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """key and vectors of the queries (key, vector), `block` at a time: no more of them is on the driver at once."""
    rows = queries.select("key", "vector").where("vector is not null").toLocalIterator()
    while part := list(itertools.islice(rows, block)):
        yield [r["key"] for r in part], np.array([r["vector"] for r in part], float)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; those without length stay zero."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def block_top_k(rows: DataFrame, queries: DataFrame, k: int, itself: bool = False, digits: int = 6, block: int | None = None) -> DataFrame:
    """query, id, similarity, rank: each query (key, vector) against all rows (id, vector) by exact cosine; ties by id. With
    `itself`, a row may be a query's neighbour although it has its id.

    Tasks multiply blocks of rows with a block of queries and keep the k best a query, so what is shuffled is k rows a query
    and task, however many rows there are."""
    spark, kind = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    of = queries.schema["key"].dataType.simpleString()
    schema = f"query {of}, id {kind}, similarity double"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    found = None
    for keys, vectors in _query_blocks(queries, block or BLOCK):
        units = _units(vectors)

        def run(batches: Iterator[pa.RecordBatch], keys: list = keys, units: np.ndarray = units) -> Iterator[pa.RecordBatch]:
            names = np.array(keys, object)
            best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # of each query: its number, ids, similarities
            step = max(1, CELLS // max(1, len(keys)))
            for whole in batches:
                for start in range(0, whole.num_rows, step):
                    part = whole.slice(start, step)
                    ids = np.array(part.column(0).to_pylist(), object)
                    sims = np.round(_units(np.array(part.column(1).to_pylist(), float)) @ units.T, digits) + 0.0
                    if not itself:
                        sims[ids[:, None] == names[None, :]] = -np.inf
                    keep = min(k, len(ids))
                    least = np.partition(sims, len(ids) - keep, axis=0)[len(ids) - keep]
                    r, q = np.nonzero((sims >= least) & (sims > -np.inf))
                    new = (q, ids[r], sims[r, q])
                    best = new if best is None else tuple(np.concatenate(x) for x in zip(best, new))
                    order = np.lexsort((best[1], -best[2], best[0]))
                    q, i, s = (x[order] for x in best)
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    best = tuple(x[place < k] for x in (q, i, s))
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_pydict({"query": [keys[x] for x in best[0]], "id": best[1].tolist(), "similarity": best[2]}, schema=arrow)

        part = rows.select("id", "vector").where("vector is not null").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


def near_any(queries: DataFrame, rows: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """The keys of the queries (key, vector) that come nearer than `least` to some row (vector)."""
    spark, schema = rows.sparkSession, f"key {queries.schema['key'].dataType.simpleString()}"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    found = None
    for keys, vectors in _query_blocks(queries, block or BLOCK):
        units = _units(vectors)

        def run(batches: Iterator[pa.RecordBatch], keys: list = keys, units: np.ndarray = units) -> Iterator[pa.RecordBatch]:
            on = np.zeros(len(keys), bool)
            for batch in batches:
                on |= (_units(np.array(batch.column(0).to_pylist(), float)) @ units.T > least).any(axis=0) if batch.num_rows else False
            yield pa.RecordBatch.from_pydict({"key": [k for k, x in zip(keys, on) if x]}, schema=arrow)

        part = rows.select("vector").where("vector is not null").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found.distinct()


def top_k(vectors: DataFrame, query_ids: list[int] | DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query, id, similarity, rank: each query against all rows, by exact cosine."""
    queries = _chosen(vectors, query_ids, key).select(F.col(key).alias("key"), F.col(column).alias("vector"))
    return block_top_k(vectors.select(F.col(key).alias("id"), F.col(column).alias("vector")), queries, k)


def knn_vote(vectors: DataFrame, query_ids: list[int] | DataFrame, k: int = 9) -> DataFrame:
    """query, label, votes: the label most of the nearest rows have (ties: the lower)."""
    near = top_k(vectors, query_ids, k).join(vectors.select(F.col("vec_id").alias("id"), "label"), "id")
    votes = near.groupBy("query", "label").agg(F.count("*").alias("votes"))
    return votes.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("votes"), "label"))).where("k = 1").drop("k")


def planes(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim))


def bits_for(rows: int) -> int:
    """Planes of a table, so that a bucket holds about 64 rows."""
    return int(np.clip(np.round(np.log2(max(rows, 1) / 64)), 3, 24))


def buckets(vectors: DataFrame, dim: int, bits: int, probe: bool = False, key: str = "vec_id", column: str = "embedding", tables: int = TABLES) -> DataFrame:
    """key, bucket: in each table the signs against random planes; with `probe` also the buckets one sign away."""
    normals = planes(dim, bits * tables)

    @F.pandas_udf("array<long>")
    def signs(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        near = [0, *(1 << k for k in range(bits))] if probe else [0]
        for x in parts:
            on = (np.stack(x.to_numpy()).astype(float) @ normals.T >= 0) if len(x) else np.zeros((0, bits * tables), bool)
            code = on.reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            yield pd.Series([[t << bits | int(c) ^ m for t, c in enumerate(row) for m in near] for row in code])

    return vectors.select(key, F.explode(signs(column)).alias("bucket"))


def lsh_top_k(vectors: DataFrame, query_ids: list[int] | DataFrame, dim: int, k: int = 10) -> DataFrame:
    """Like top_k, among rows that share a bucket with the query or with a bucket one sign away."""
    bits = bits_for(vectors.count())
    chosen = _chosen(vectors, query_ids, "vec_id")
    asked = buckets(chosen, dim, bits, probe=True).withColumnRenamed("vec_id", "query")
    q = chosen.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    if _few(query_ids):
        asked, q = F.broadcast(asked), F.broadcast(q)
    pairs = buckets(vectors, dim, bits).join(asked, "bucket").where("vec_id <> query").select("query", "vec_id").distinct()
    scored = pairs.join(vectors, "vec_id").join(q, "query").select("query", F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)


def search(vectors: DataFrame, query_ids: list[int] | DataFrame, dim: int, k: int = 10, exact: bool = True) -> DataFrame:
    """Exact, or where asked for through the buckets, which miss some neighbours."""
    return top_k(vectors, query_ids, k) if exact else lsh_top_k(vectors, query_ids, dim, k)


def dense_pass(queries: DataFrame, mem: DataFrame, vectors: DataFrame, k: int = 24) -> DataFrame:
    """query_id, id, similarity, rank: the memories nearest to each query's vector (query_id, vector). vectors: id, vector;
    only memories of mem take part, which are picked before the neighbours are."""
    rows = vectors.join(mem.select("id"), "id", "left_semi")
    found = block_top_k(rows, queries.select(F.col("query_id").alias("key"), "vector"), k, itself=True)
    return found.withColumnRenamed("query", "query_id").select("query_id", "id", "similarity", "rank")


def embedder(kind: str | None, function: Callable[[list[str]], list[list[float]]] | None = None, dim: int = 256) -> Callable[[DataFrame, str], DataFrame] | None:
    """A function that adds `embedding` to a table's text column: `none`, `ngram`, or `callable` with a function of a list of
    texts, which must return as many vectors."""
    if kind in (None, "none"):
        return None
    if kind == "ngram":
        return lambda rows, text="content": embeddings(rows, text, dim)
    if kind != "callable" or function is None:
        raise ValueError(f"no embedder {kind!r}")

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = function([t or "" for t in x])
        if len(out) != len(x):
            raise ValueError(f"{len(out)} vectors for {len(x)} texts")
        return pd.Series([[float(v) for v in row] for row in out])

    return lambda rows, text="content": rows.withColumn("embedding", run(F.col(text)))


def cached(mem: DataFrame, cache: DataFrame, embed_rows: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The cache (content_hash, embedding) with the texts of mem that it lacks, each distinct text embedded once."""
    new = missing(mem, cache).groupBy("content_hash").agg(F.min("content").alias("content"))
    return cache.unionByName(embed_rows(new, "content").select("content_hash", "embedding"))


def without(vectors: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Vectors without those of some ids, as after memories are purged."""
    return vectors.join(ids.select(key).distinct(), key, "left_anti")


def ngram_features(text: str) -> dict[str, int]:
    """Words of two letters or more and their 2- to 4-grams; Chinese characters and pairs."""
    import re

    out: dict[str, int] = {}
    low = text.lower()

    def add(f: str) -> None:
        out[f] = out.get(f, 0) + 1

    for w in re.findall(r"[a-z0-9]{2,}", low):
        add(w)
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                add(w[i : i + n])
    chars = re.findall(r"[一-鿿]", low)
    for c in chars:
        add(c)
    for a, b in zip(chars, chars[1:]):
        add(a + b)
    return out


def embed(text: str, dim: int = 256) -> list[float]:
    """Signed feature hashing: place by the digest's first four bytes, sign by the fifth, weight 1 + ln(count), unit length."""
    v = np.zeros(dim)
    for f, n in ngram_features(text).items():
        d = hashlib.blake2b(f.encode(), digest_size=8).digest()
        v[int.from_bytes(d[:4], "little") % dim] += (1 if d[4] & 1 else -1) * (1 + np.log(n))
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm else v).tolist()


#: Characters of the texts that are embedded at once; a longer text is alone.
CHARS = 1 << 19


def _embedded(texts: list[str], dim: int) -> np.ndarray:
    """A row for each text: each distinct feature is hashed once, and sums over all texts are one operation."""
    counted = [ngram_features(t) for t in texts]
    features = list({f for c in counted for f in c})
    place = {f: k for k, f in enumerate(features)}
    digests = np.frombuffer(b"".join(hashlib.blake2b(f.encode(), digest_size=8).digest() for f in features), np.uint8).reshape(-1, 8)
    slot = digests[:, :4].copy().view("<u4").ravel() % dim
    sign = np.where(digests[:, 4] & 1, 1.0, -1.0)
    owner = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
    which = np.fromiter((place[f] for c in counted for f in c), np.int64, len(owner))
    n = np.fromiter((v for c in counted for v in c.values()), np.float64, len(owner))
    sums = np.bincount(owner * dim + slot[which], sign[which] * (1 + np.log(n)), len(counted) * dim).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)


def text_blocks(texts: Sequence[str], chars: int | None = None) -> Iterator[list[str]]:
    """Texts in order, of about so many characters (CHARS) at once, so that a batch of long texts takes no more memory."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > (chars or CHARS):
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def embeddings(rows: DataFrame, text: str = "content", dim: int = 256) -> DataFrame:
    """Adds `embedding`. Each distinct text of a batch is embedded once, blocks of texts at a time."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(x.fillna(""))
        sums = np.concatenate([np.zeros((0, dim)), *(_embedded(block, dim) for block in text_blocks(texts))])
        return pd.Series(list(sums[codes]), index=x.index)

    return rows.withColumn("embedding", run(F.col(text)))


def missing(mem: DataFrame, cache: DataFrame) -> DataFrame:
    """Memories whose text has no vector yet."""
    return mem.join(cache.select("content_hash"), "content_hash", "left_anti")
