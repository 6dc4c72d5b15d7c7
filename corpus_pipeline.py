"""From raw documents to token ids: quality, line dedup, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, common, linededup, mixing, ngramjoin, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that rank above the threshold of a model learned from the labelled documents of sf_dir that are not
    held out. Null text ranks as empty. Without labels all stay."""
    known = common.load(spark, sf_dir, "documents").where(~common.held_out())
    labels = common.load(spark, sf_dir, "labels").where(~common.held_out())
    return quality.score(docs.select(*COLUMNS), quality.train(known, labels), name="__score").where("__score >= 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that occur earlier. Those of which nothing is left go; n_chars follows."""
    cut = linededup.dedup(docs.select(*COLUMNS), removed="__removed")
    return cut.where("__removed = 0 or text <> ''").withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents; of repeated rows, one. Rows with null ids
    stay."""
    docs = docs.select(*COLUMNS)
    found = common.written(ngramjoin.join(docs), "groups")
    rows = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = common.written(rows.where("not stays").select(F.col("doc_id").alias("__gone"), F.xxhash64("doc_id").alias("__h")), "gone")
    # A filter keeps the texts where they are; only rows that it names are dealt out and told apart.
    some = common.Filter.of(gone, "__h").column(F.xxhash64("doc_id"))
    marked = docs.withColumn("__some", F.col("doc_id").isNotNull() & some)
    told = marked.where("__some").join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    out = marked.where("not __some").unionByName(told).select(*COLUMNS)
    several = common.written(rows.where("n > 1").select(F.col("doc_id").alias("__several")), "several")
    if several.isEmpty():
        return out
    once = out.join(several, F.col("doc_id") == F.col("__several"), "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(several, F.col("doc_id") == F.col("__several"), "left_anti").unionByName(once)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target weights."""
    return mixing.sample(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and decoded_sha256 of the text that the ids decode to. The ids are written
    between: encoding and decoding in one stage would keep two Python workers a core."""
    vocabulary = bpe.default_vocabulary()
    ids = common.written(bpe.encode(docs, vocabulary, keep=["doc_id", "lang", "source"]), "ids")
    rows = bpe.decode(ids, vocabulary)
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", judge_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL expresses the trained stages; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), name, hold=True)
    return docs
