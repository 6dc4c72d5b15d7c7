"""Shared pieces: bounded Arrow blocks, vectorised word hashing, shared-folder tables."""

from __future__ import annotations

import contextlib
import contextvars
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20


#: Rows of a batch that goes to Python. Texts may be long, and the buffers of both sides are kept for later batches.
BATCH_ROWS = 2000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; from now on the session sends BATCH_ROWS rows at most to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one beside the warehouse, on a local master
    only: what executors of a cluster share can't be guessed."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "palimpsest-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found


class _Open:
    """Paths handed out within each scratch() that is open in this thread or task, the innermost last. A copy that
    travels to a worker starts anew."""

    def __init__(self) -> None:
        self.paths: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open", default=())

    def __reduce__(self):
        return _Open, ()


_OPEN = _Open()


def _on(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop knows them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str, hold: bool = False) -> str:
    """A new path in the shared folder. It is deleted at the end of the innermost scratch() (with hold, of the next one
    outside), otherwise with the application: only the caller knows when a result that reads it has been written."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    where, system = _on(spark, path)
    system.deleteOnExit(where)
    around = _OPEN.paths.get()
    if len(around) > hold:
        around[-1 - hold].append(path)
    return path


def written(df: DataFrame, name: str, hold: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs nothing. With hold
    the table outlives the innermost scratch()."""
    path = shared_path(df.sparkSession, name, hold)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, but for those on hold, are deleted at the end; what is returned must not read them. A
    caller who puts a query and the writing of its result inside leaves nothing behind."""
    mine: list[str] = []
    token = _OPEN.paths.set((*_OPEN.paths.get(), mine))
    try:
        yield
    finally:
        _OPEN.paths.reset(token)
        for path in mine:
            where, system = _on(spark, path)
            system.delete(where, True)
            system.cancelDeleteOnExit(where)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 3, is 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of at most `limit` bytes of text (a longer text is a slice by itself)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Python workers are kept for later tasks; memory that a task no longer needs goes back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def released(run):
    """A function over batches, after which what it held goes back: only when it has ended are its own tables free."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and the offsets of each (null: empty)."""
    col = pa.compute.fill_null(col, "")
    if not isinstance(col, pa.Array):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + _MIX1
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * _MIX3
    return x ^ (x >> np.uint64(31))


#: Spans of so many bytes at most are hashed side by side, eight bytes a step; longer ones one by one.
_SIDE_BY_SIDE = 48
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of any spans of a byte array. Every step mixes the bits anew, so no regular texts collide by rule."""
    size = ends - starts
    out = mix(size.astype(np.uint64))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words_at = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    at = np.nonzero(size <= _SIDE_BY_SIDE)[0]
    place, left = starts[at], size[at]
    while len(at):
        more = left > 0
        if not more.all():
            at, place, left = at[more], place[more], left[more]
            continue
        out[at] = mix(out[at] ^ (words_at[place] & _MASKS[np.minimum(left, 8)]))
        place, left = place + 8, left - 8
    for k in np.nonzero(size > _SIDE_BY_SIDE)[0].tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs without bytes 0x20, 0x09-0x0D."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.nonzero(inside & (~before | edge[:-1]))[0]
    ends = np.nonzero(inside & (~after | edge[1:]))[0] + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(col: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its word shingles; with fewer words, of the whole
    sequence; without words, none. A-Z are lower-cased first."""
    data, offs = utf8(col)
    data = _LOWER[data]
    starts, ends, text = words(data, offs)
    h = span_hashes(data, starts, ends)
    first = np.searchsorted(text, np.arange(len(offs)))
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            s = mix(s + h[k : len(h) - size + 1 + k])
    else:
        s = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        else:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x + h[k : k + 1])
            out.append(x if b > a else x[:0])
    return out


#: Bits of a filter for each member, and the least and the most bits (as powers of two; the largest has 32 MB).
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 16, 16, 28
_PIECE = 15


class Filter:
    """A Bloom filter of 64-bit numbers, sized by their count up to a bound. It may hold more than its members, never
    less; beyond the bound (some 16 million members) it holds off less and less, and what it lets through is told
    apart by the join that follows."""

    def __init__(self, bits: np.ndarray) -> None:
        self.packed = zlib.compress(bits.tobytes(), 1)

    @staticmethod
    def places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two places of each number among so many bits (a power of two)."""
        h = mix(np.asarray(x).astype(np.int64).view(np.uint64))
        mask = np.uint64(bits - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)

    def open(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.packed), np.uint8)

    @staticmethod
    def among(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for p in Filter.places(x, 8 * len(bits)):
            out &= ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
        return out

    @staticmethod
    def of(df: DataFrame, column: str) -> Filter:
        """Of a column of longs (nulls are left out) of a written table, which is read twice: its rows are counted
        first. Tasks set bits; the pieces of the bit map are joined in Spark."""
        power = min(max((FILTER_SHARE * df.count()).bit_length(), FILTER_LEAST), FILTER_MOST)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (power - 3), np.uint8)
            for batch in batches:
                for p in Filter.places(np.asarray(batch.column(0)), 1 << power):
                    np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
            rows = bits.reshape(-1, 1 << (_PIECE - 3))
            some = np.nonzero(rows.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[k].tobytes() for k in some], pa.binary())], names=["piece", "bits"])

        def join(pdf):
            merged = np.zeros(1 << (_PIECE - 3), np.uint8)
            for b in pdf["bits"]:
                merged |= np.frombuffer(b, np.uint8)
            return pdf.head(1).assign(bits=merged.tobytes())

        parts = df.select(F.col(column).cast("long").alias("x")).where("x is not null").mapInArrow(run, "piece int, bits binary")
        bits = np.zeros((1 << (power - _PIECE), 1 << (_PIECE - 3)), np.uint8)
        for row in parts.groupBy("piece").applyInPandas(join, "piece int, bits binary").collect():  # 32 MB at most
            bits[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
        return Filter(bits)

    def column(self, of):
        """A column: whether the filter holds a column of longs."""

        @F.pandas_udf("boolean")
        def among(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bits = self.open()
            for x in parts:
                yield pd.Series(Filter.among(bits, x.to_numpy()))

        return among(of)
