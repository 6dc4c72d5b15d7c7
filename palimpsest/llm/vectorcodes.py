"""Vector code compression: vectors cut in parts of integers, a codebook a part position, a byte a part.

Equal parts of a position are one weighted row. Lloyd's rounds run over those distinct rows: tasks assign them to the
codebook's entries and add up what falls to each, so a round brings at most one row an entry to the driver. Codes and
errors of distinct parts are then joined back to the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A part that holds more than one in so many vectors is hot; no position has more such parts than that.
HOT = 1000
#: Distinct parts that are compared with a codebook at once.
BLOCK = 1 << 14


@dataclass
class Codebooks:
    """entries[p]: integers of each entry of position p, entries by components."""

    entries: list[np.ndarray]

    def nearest(self, p: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (ties: the lower one) and the squared distance, in integers."""
        book = self.entries[p]
        best, least = np.zeros(len(rows), np.int64), None
        for k, entry in enumerate(book):
            apart = ((rows - entry) ** 2).sum(axis=1)
            if least is None:
                least = apart
                continue
            closer = apart < least
            best[closer], least[closer] = k, apart[closer]
        return best, least if least is not None else np.zeros(len(rows), np.int64)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for x in book.ravel()).encode()).hexdigest()

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries replaced by the floor of the mean of what fell to them; unused ones stay."""
        out = [b.copy() for b in self.entries]
        for (p, k), (n, total) in sums.items():
            out[p][k] = [x // n for x in total]
        return Codebooks(out)


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows whose vector and components are neither null nor other than finite, with `ints`: floor(scale * x)."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).withColumn("ints", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def parted(rows: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """A row for each part of a vector: p and part; shorter vectors count as filled up with zeros."""
    full = F.concat("ints", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("ints")))
    each = width // parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(full, p * each + 1, F.lit(each)))
    return rows.select("__rid", *[c for c in rows.columns if c not in ("ints", "__rid")], F.posexplode(cut).alias("p", "part"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), width)


def _by_position(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """batch, position, its rows in the batch and their parts."""
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            at = np.asarray(batch.column(0))
            rows = _matrix(batch.column(1), width)
            for p in np.unique(at).tolist():
                mine = np.nonzero(at == p)[0]
                yield batch, p, mine, rows[mine]


def lloyd_round(distinct: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """distinct: p, part, weight. One round over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch, p, mine, rows in _by_position(batches, width):
            weight = np.asarray(batch.column(2))[mine]
            best, _ = books.nearest(p, rows)
            for k in np.unique(best).tolist():
                on = best == k
                n, total = sums.get((p, k), (0, np.zeros(width, np.int64)))
                sums[p, k] = (n + int(weight[on].sum()), total + (rows[on] * weight[on, None]).sum(axis=0))
        if sums:
            keys = list(sums)
            flat = np.concatenate([sums[x][1] for x in keys]) if width else np.zeros(0, np.int64)
            offsets = np.arange(0, width * len(keys) + 1, width) if width else np.zeros(len(keys) + 1, int)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in keys], pa.int32()), pa.array([k for _, k in keys], pa.int32()), pa.array([sums[x][0] for x in keys], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["p", "k", "n", "total"],
            )

    part = distinct.select("p", "part", "weight").mapInArrow(run, "p int, k int, n long, total array<long>")
    added = part.groupBy("p", "k").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)])
    rows = added.collect()  # a row an entry
    return books.moved({(r["p"], r["k"]): (r["n"], [r[f"t{i}"] for i in range(width)]) for r in rows})


def assigned(distinct: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """p, part, weight, k (the nearest entry), apart (its squared distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p, mine, rows in _by_position(batches, width):
            best, least = books.nearest(p, rows)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(mine)).columns, pa.array(best.astype(np.int32)), pa.array(least)], names=["p", "part", "weight", "k", "apart"])

    return distinct.select("p", "part", "weight").mapInArrow(run, "p int, part array<long>, weight long, k int, apart long")


def joined_evenly(rows: DataFrame, told: DataFrame, on: list[str], weight: str, total: int, salt: str, values: list[str]) -> DataFrame:
    """rows with the values that told has for their keys (told: a row a key, weight: how many rows have it; no null keys).
    Keys with more than total / HOT rows, fewer than HOT for each value of a leading key of few values, are broadcast; rows that
    they serve get keys of their own, so the exchange deals them out evenly."""
    hot = told.where(F.col(weight) * HOT > total).select(*[F.col(c).alias(f"__h_{c}") for c in on], *[F.col(v).alias(f"__h_{v}") for v in values])
    rest = told.where(F.col(weight) * HOT <= total).select(*[F.col(c).alias(f"__k_{c}") for c in on], F.lit(0).cast("long").alias("__k_spread"), *[F.col(v).alias(f"__r_{v}") for v in values])
    some = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), [F.col(c) == F.col(f"__h_{c}") for c in on], "left")
    spread = F.when(F.col("__hot"), -1 - F.pmod(F.col(salt), F.lit(1 << 20))).otherwise(F.lit(0)).cast("long")
    some = some.withColumn("__spread", spread)
    full = some.join(rest, [*[F.col(c) == F.col(f"__k_{c}") for c in on], F.col("__spread") == F.col("__k_spread")], "left")
    return full.select(*rows.columns, *[F.when(F.col("__hot"), F.col(f"__h_{v}")).otherwise(F.col(f"__r_{v}")).alias(v) for v in values])


def first_codebooks(rows: DataFrame, key: str, width: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the smallest keys (null last; ties by the integers)."""
    first = rows.orderBy(F.col(key).asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    grid = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        grid[i, : len(r["ints"])] = r["ints"]
    each = width // parts
    return Codebooks([grid[:, p * each : (p + 1) * each].copy() for p in range(parts)])


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ("label",), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """key, the kept columns, code (an array of entry numbers by part) and error of each vector that integers() lets
    through, and the codebooks (None without any vector). Rows with equal keys are vectors of their own. Vectors of other
    lengths count as filled up with zeros to the longest, and that to a multiple of parts. Integers times 2 must fit into
    26 bits or so: components beyond 2^17 overflow."""
    named = vectors.select(F.col(key).alias("__key"), F.col(vector).alias("__vector"), *[F.col(c).alias(f"__c_{c}") for c in keep])
    rows = common.written(integers(named, "__vector").drop("__vector").withColumn("__rid", F.monotonically_increasing_id()), "vectors")
    total, longest = rows.agg(F.count("*"), F.max(F.size("ints"))).first()
    back = [F.col("__key").alias(key), *[F.col(f"__c_{c}").alias(c) for c in keep]]
    if not total:
        return rows.select(*back, F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), None
    width = -(-longest // parts) * parts
    each = width // parts
    books = first_codebooks(rows, "__key", width, parts, entries)
    pieces = parted(rows, width, parts)
    distinct = common.written(pieces.groupBy("p", "part").agg(F.count("*").alias("weight")), "distinct")
    for _ in range(rounds):
        books = lloyd_round(distinct, books, each)
    told = common.written(assigned(distinct, books, each), "assigned")
    coded = joined_evenly(pieces, told, ["p", "part"], "weight", total, "__rid", ["k", "apart"])
    whole = coded.groupBy("__rid", "__key", *[f"__c_{c}" for c in keep]).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "k"))), lambda x: x["k"]).alias("code"), F.sum("apart").alias("error"))
    return whole.select(*back, "code", "error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and the error summed over its label of every usable vector, and the digest of the final codebooks.
    Null ids come last among the first entries; an empty table gives no rows."""
    rows, books = compress(common.load(spark, sf_dir, "embeddings"))
    coded = common.written(rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())), "coded")
    # Null labels are one label.
    tag = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label"))
    sums = common.written(coded.groupBy(tag.alias("tag")).agg(F.count("*").alias("weight"), F.sum("error").alias("label_error")), "labels")
    total = sums.agg(F.sum("weight")).first()[0] or 0
    both = joined_evenly(coded.withColumn("tag", tag), sums, ["tag"], "weight", total, "__salt", ["label_error"])
    hexed = F.array_join(F.transform("code", lambda k: F.lpad(F.lower(F.hex(k)), 2, "0")), "")
    return both.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def oracle() -> str:
    """The same in SQL, by the definition: every part is compared with every entry."""
    nearest = "(SELECT v.vec_id, v.p, c.k, sum((v.x - c.x) * (v.x - c.x)) AS apart FROM parts v JOIN {book} c ON v.p = c.p AND v.j = c.j GROUP BY v.vec_id, v.p, c.k)"
    best = f"SELECT vec_id, p, k, apart FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY apart, k) AS r FROM {nearest}) WHERE r = 1"
    out = [
        "WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS ints FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding))",
        f"wide AS (SELECT *, len(ints) // {PARTS} AS each FROM kept)",
        "parts AS (SELECT vec_id, (i - 1) // each AS p, (i - 1) % each AS j, ints[i] AS x FROM (SELECT *, unnest(range(1, len(ints) + 1)) AS i FROM wide))",
        f"b0 AS (SELECT p, j, row_number() OVER (PARTITION BY p, j ORDER BY vec_id) - 1 AS k, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for r in range(ROUNDS):
        out.append(f"a{r} AS ({best.format(book=f'b{r}')})")
        down = "(CAST(sum(x) AS BIGINT) - ((CAST(sum(x) AS BIGINT) % count(*)) + count(*)) % count(*)) // count(*)"
        out.append(f"m{r} AS (SELECT a.p, a.k, v.j, {down} AS x FROM a{r} a JOIN parts v ON a.vec_id = v.vec_id AND a.p = v.p GROUP BY a.p, a.k, v.j)")
        out.append(f"b{r + 1} AS (SELECT b.p, b.j, b.k, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.j = m.j AND b.k = m.k)")
    out.append(f"last AS ({best.format(book=f'b{ROUNDS}')})")
    out.append("coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(apart) AS BIGINT) AS error FROM last GROUP BY vec_id)")
    out.append(f"books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM b{ROUNDS})")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"
