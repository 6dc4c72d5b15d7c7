"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines has its local minima at
places that depend on nearby content only, so chunk ends shift with the text.
Chunks that occur more than once anywhere are compared byte by byte; the first
occurrence stays and the others are removed.

Chunk ends may fall anywhere in a short passage, so runs of lines are looked for
besides. Any repeated run of MIN_WORDS words or more is the union of the shortest
runs of so many words that start or end at its lines: a run that starts at a line
and would pass the end of the passage has less words left, so the one that ends
with the passage holds that line. These shortest runs are compared everywhere, by
128-bit digests of their bytes, and all but the first of equal ones are removed.
Lines of MIN_WORDS words or more are chunks of their own; runs may pass them, but
their words do not count, so a shorter rest beside a repeated long line stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

#: Lines that the rolling hash covers.
WINDOW = 2
#: A chunk counts if it has so many lines, or so many words; a line of so many words is a chunk of its own.
MIN_LINES, MIN_WORDS = 2, 50
#: Bytes of text that a worker takes at once.
BLOCK = 1 << 19


class Chunks:
    """The chunks of a block of texts: owner, first and last byte (end), lines and words of each."""

    def __init__(self, col: pa.Array, window: int = WINDOW, min_words: int = MIN_WORDS) -> None:
        data, offs = common.utf8(col)
        n = len(offs) - 1
        # Every text has at least one line; a line's bytes exclude its line end.
        breaks = np.nonzero(data == 10)[0]
        text_of_break = np.searchsorted(offs, breaks, "right") - 1
        starts = np.concatenate([offs[:-1], breaks + 1])
        owner = np.concatenate([np.arange(n), text_of_break])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        last = np.ones(len(starts), bool)
        last[:-1] = owner[1:] != owner[:-1]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        ends[last] = offs[1:][owner[last]]
        w_start, _, _ = common.words(data, offs)
        words = np.searchsorted(w_start, ends) - np.searchsorted(w_start, starts)
        h = common.span_hashes(data, starts, ends)
        rolled = h.copy()
        for k in range(1, window):
            same = owner[k:] == owner[:-k]
            rolled[k:] = np.where(same, common.mix(rolled[k:] * np.uint64(31) + h[:-k]), rolled[k:])
        least = np.uint64(0xFFFFFFFFFFFFFFFF)
        first = np.concatenate([[True], last[:-1]])
        before = np.where(first, least, np.concatenate([[least], rolled[:-1]]))
        after = np.where(last, least, np.concatenate([rolled[1:], [least]]))
        long = words >= min_words
        cut = last | long | ((rolled < before) & (rolled <= after) & ~first)
        cut[:-1] |= long[1:]
        stop = np.nonzero(cut)[0]
        begin = np.concatenate([[0], stop[:-1] + 1]).astype(np.int64)
        self.data, self.offs = data, offs
        self.line_owner, self.line_start, self.line_end, self.line_words, self.long = owner, starts, ends, words, long
        self.begin, self.stop = begin, stop
        self.line = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]
        self.owner = owner[begin]
        self.start, self.end = starts[begin], ends[stop]
        self.lines = stop - begin + 1
        total = np.concatenate([[0], np.cumsum(words)])
        self.words = total[stop + 1] - total[begin]
        self.hash = common.span_hashes(data, self.start, self.end)
        firsts = np.searchsorted(self.owner, np.arange(n))
        self.seq = np.arange(len(self.owner)) - firsts[self.owner]

    def counting(self, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> np.ndarray:
        """Which chunks are long enough to be removed where they repeat."""
        return ((self.lines >= min_lines) & (self.words > 0)) | (self.words >= min_words)

    def runs(self, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """First and last line of the shortest runs of `min_words` words, those of long lines not counted, that start or
        end at each line of a text."""
        m = len(self.line_owner)
        total = np.concatenate([[0], np.cumsum(np.where(self.long, 0, self.line_words))])
        at = np.arange(m)
        last = np.searchsorted(total, total[:-1] + min_words) - 1
        on = at[last < m]
        on = on[self.line_owner[last[on]] == self.line_owner[on]]
        first = np.searchsorted(total, total[1:] - min_words, "right") - 1
        back = at[first >= 0]
        back = back[self.line_owner[first[back]] == self.line_owner[back]]
        both = np.unique(np.concatenate([on << 32 | last[on], first[back] << 32 | back]))
        return both >> 32, both & 0xFFFFFFFF


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("__id"), F.xxhash64(F.col(text)).alias("__th"), F.col(text).alias("__text"))


def _hashes(rows: DataFrame) -> DataFrame:
    """h of each chunk that counts and of each run; those of runs are mixed once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__text", BLOCK):
            c = Chunks(block.column(2))
            first, last = c.runs()
            runs = common.mix(common.span_hashes(c.data, c.line_start[first], c.line_end[last]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c.hash[c.counting()], runs]).astype(np.int64))], names=["h"])

    return rows.mapInArrow(run, "h long")


def _listed(df: DataFrame) -> DataFrame:
    """A row for each document with the sorted numbers of its chunks in df, and its runs (first line << 32 | last line)."""
    chunk = F.when(F.col("stop") < 0, F.col("seq"))
    run = F.when(F.col("stop") >= 0, F.shiftleft(F.col("seq").cast("long"), 32).bitwiseOR(F.col("stop").cast("long")))
    return df.groupBy("__id", "__th").agg(F.sort_array(F.collect_set(chunk)).alias("seqs"), F.collect_set(run).alias("runs"))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__id, __th, seq, stop of the chunks (number, -1) and runs (first line, last line) to remove: all occurrences but
    the first, by id, then place, of chunks with equal bytes and of equal runs. Runs that overlap the first within its
    text stay. Rows that are equal in id and text are one document."""
    rows = _identified(docs, key, text)
    # A filter of the hashes that occur twice keeps the texts where they are; what it lets through too many is told
    # apart with the rest, byte by byte.
    often = _hashes(rows).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    twice = common.Filter.of(common.written(often, "twice"), "h")
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.open()
        for block in common.blocks(batches, "__text", BLOCK):
            c = Chunks(block.column(2))
            some = np.nonzero(c.counting())[0]
            some = some[common.Filter.among(bits, c.hash[some].astype(np.int64))]
            first, last = c.runs()
            here = common.Filter.among(bits, common.mix(common.span_hashes(c.data, c.line_start[first], c.line_end[last])).astype(np.int64))
            first, last = first[here], last[here]
            raw = c.data.tobytes()
            owner = pa.array(np.concatenate([c.owner[some], c.line_owner[first]]))
            seq = np.concatenate([c.seq[some], c.line[first]]).astype(np.int32)
            stop = np.concatenate([np.full(len(some), -1), c.line[last]]).astype(np.int32)
            # No text holds the byte FF, so no chunk equals a digest.
            spans = [raw[c.start[p] : c.end[p]] for p in some]
            spans += [b"\xff" + hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(c.line_start[first], c.line_end[last])]
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(owner), block.column(1).take(owner), pa.array(seq), pa.array(stop), pa.array(spans, pa.binary())],
                names=["__id", "__th", "seq", "stop", "chunk"],
            )

    chunks = rows.mapInArrow(run, f"__id {kind}, __th long, seq int, stop int, chunk binary")
    # Grouping by the bytes themselves compares them; partial aggregation meets a frequent chunk in each task first.
    place = F.struct("__id", "__th", "seq", "stop")
    digest = F.unhex(F.sha2("chunk", 256)).alias("digest")
    spots = common.written(chunks.select(place.alias("place"), digest, "chunk"), "spots")
    first = spots.groupBy("chunk").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(digest, "first")
    first = common.written(first, "firsts")
    apart = (F.col("place.stop") < 0) | ~F.col("place.__id").eqNullSafe(F.col("first.__id")) | (F.col("place.__th") != F.col("first.__th")) | (F.col("place.seq") > F.col("first.stop"))
    doomed = spots.select("place", "digest").join(first, "digest").where((F.col("place") != F.col("first")) & apart)
    return doomed.select("place.*").distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", removed: str = "removed_chunks") -> DataFrame:
    """All columns of docs, with repeated chunks and runs cut from the text, and `removed`, the number of chunks cut and
    of stretches of further lines cut in runs.

    A removed chunk or line goes with its line end. Null text stays null, without chunks; empty text and documents without a
    repeated chunk stay as they are; a document all of whose chunks repeat elsewhere becomes empty. The first occurrence
    is that with the lowest id (nulls first), then text hash, then place. An empty table gives no rows. Columns of docs
    may have any other names; one named like `removed` is replaced.
    """
    columns = [c for c in docs.columns if c != removed]
    gone = common.written(_listed(repeated(docs, key, text)).select(F.col("__id").alias("__i"), F.col("__th").alias("__t"), F.col("seqs").alias("__seqs"), F.col("runs").alias("__runs")), "doomed")
    # Only documents that may lose a chunk are dealt out by id.
    marked = docs.select(*(F.col(f"`{c}`") for c in columns), F.xxhash64(F.col(text)).alias("__th"))
    marked = marked.withColumn("__some", common.Filter.of(gone, "__t").column(F.col("__th")))
    plain = marked.where("not __some").select(*(F.col(f"`{c}`") for c in columns), F.lit(0).alias(removed))
    whole = marked.where("__some").drop("__some")
    joined = whole.join(gone, whole[key].eqNullSafe(gone["__i"]) & (whole["__th"] == gone["__t"]), "left").drop("__i", "__t", "__th")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + f", `{removed}` int"
    where = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, text, BLOCK):
            lists, spans = (block.column(len(columns) + k).to_pylist() for k in range(2))
            some = [k for k in range(len(lists)) if lists[k] or spans[k]]
            cut = [0] * len(lists)
            texts = block.column(where)
            if some:
                rows = texts.to_pylist()
                c = Chunks(texts.take(pa.array(some)))
                raw = c.data.tobytes()
                ends = np.searchsorted(c.owner, np.arange(len(some) + 1))
                line_ends = np.searchsorted(c.line_owner, np.arange(len(some) + 1))
                for r, k in enumerate(some):
                    low = line_ends[r]
                    gone = np.zeros(line_ends[r + 1] - low, bool)
                    for s in lists[k] or ():
                        gone[c.begin[ends[r] + s] - low : c.stop[ends[r] + s] + 1 - low] = True
                    more = np.zeros(len(gone), bool)
                    for s in spans[k] or ():
                        more[s >> 32 : (s & 0xFFFFFFFF) + 1] = True
                    more &= ~gone
                    cut[k] = len(lists[k] or ()) + int(more[0]) + int((more[1:] & ~more[:-1]).sum())
                    rows[k] = b"\n".join([raw[c.line_start[p] : c.line_end[p]] for p in np.nonzero(~gone & ~more)[0] + low]).decode()
                texts = pa.array(rows, texts.type)
            made = [texts if k == where else block.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*made, pa.array(cut, pa.int32())], names=[*columns, removed])

    return plain.unionByName(joined.mapInArrow(run, fields))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs)
