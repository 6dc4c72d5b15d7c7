"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

Topics are learned from the documents: TOPICS words that are frequent, yet in no more than a tenth of the documents,
stand for one each; a document's topic is the one whose count there, weighted by rarity, is greatest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

DIMENSIONS = ("source", "lang", "topic")
#: A dimension's target share of a value is proportional to its tokens to this power, unless targets are given.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Tokens to keep, as a share of all.
BUDGET = 0.6
ITERATIONS = 25
#: Up to so many cells the fit runs on the driver and its result is broadcast; beyond, as DataFrame steps and a join.
CELLS_ON_DRIVER = 100_000
SEED = 97
#: Number of topics, and the letters (a to z and all beyond ASCII) that a topic's word has in a row at least.
TOPICS, LETTERS = 48, 5
#: A topic's word is in one of so many documents at most.
RARITY = 10
BLOCK = 1 << 20


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of LETTERS or more letters a to z and characters beyond ASCII."""
    inside = (data >= 97) & (data <= 122) | (data >= 128)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.nonzero(inside & (~before | edge[:-1]))[0]
    ends = np.nonzero(inside & (~after | edge[1:]))[0] + 1
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = characters[ends] - characters[starts] >= LETTERS
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def topic_words(docs: DataFrame, text: str = "text", topics: int = TOPICS) -> list[tuple[str, float]]:
    """The words of the topics and their weights, ln(documents / documents with the word). Counts are over all
    documents; of words with equal counts the first in the alphabet is taken. The list has `topics` entries at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "__text", BLOCK):
            data, offs = common.utf8(block.column(0))
            starts, ends, owner = _runs(data, offs)
            h = common.span_hashes(data, starts, ends)
            order = np.lexsort((owner, h))
            h, owner, starts, ends = h[order], owner[order], starts[order], ends[order]
            word = np.ones(len(h), bool)
            word[1:] = h[1:] != h[:-1]
            first = word.copy()
            first[1:] |= owner[1:] != owner[:-1]
            n = np.bincount(np.cumsum(word)[first] - 1) if len(h) else h
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw[a:b].decode() for a, b in zip(starts[word].tolist(), ends[word].tolist())], pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"]
            )

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"))
    total = docs.count()
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = found.where((F.col("n") >= 2) & (F.col("n") * RARITY <= total)).orderBy(F.desc("n"), "word").limit(topics).collect()
    return [(r["word"], float(np.log(total / r["n"]))) for r in top]


def annotated(df: DataFrame, words: list[tuple[str, float]], text: str, topic: str, tokens: str) -> DataFrame:
    """df with two columns added: each text's topic (`other` where no topic's word occurs) and its number of tokens, runs
    without bytes 0x20, 0x09-0x0D. Rows stay where they are, and only texts go to Python."""
    names = sorted(w for w, _ in words)
    weight = np.array([dict(words)[w] for w in names])
    raw = [np.frombuffer(w.encode(), np.uint8) for w in names]
    keys = np.array([common.span_hashes(w, np.array([0]), np.array([len(w)]))[0] for w in raw], np.uint64)
    place = np.argsort(keys)
    sorted_keys = keys[place]
    labels = np.array([*names, "other"], object)

    def of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = common.utf8(col)
        n = len(offs) - 1
        count = np.bincount(common.words(data, offs)[2], minlength=n)
        best = np.full(n, len(names))
        if len(names):
            starts, ends, owner = _runs(data, offs)
            h = common.span_hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(sorted_keys, h), len(names) - 1)
            hit = sorted_keys[at] == h
            score = np.bincount(owner[hit] * len(names) + place[at[hit]], minlength=n * len(names)).reshape(n, -1) * weight
            best = np.where(score.any(axis=1), np.argmax(np.round(score, 9), axis=1), len(names))
        return labels[best], count.astype(np.int64)

    @F.arrow_udf("struct<topic: string, tokens: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            batch = pa.RecordBatch.from_arrays([col], names=["t"])
            made = [of(part.column(0)) for part in common.blocks([batch], "t", BLOCK)]
            topics = pa.array([t for m in made for t in m[0]], pa.string())
            counts = pa.array(np.concatenate([np.zeros(0, np.int64), *(m[1] for m in made)]))
            yield pa.StructArray.from_arrays([topics, counts], names=["topic", "tokens"])

    found = df.withColumn("__found", run(F.col(f"`{text}`")))
    return found.withColumns({topic: F.col("__found.topic"), tokens: F.col("__found.tokens")}).drop("__found")


def draw(key: Column, seed: int = SEED) -> Column:
    """A reproducible number from 0 to 1 for each key."""
    raw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(raw, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def power_targets(cells: DataFrame, dims: tuple[str, ...], powers: dict[str, float]) -> dict[str, DataFrame]:
    """For each dimension, value and target share."""
    out = {}
    for d in dims:
        sums = cells.where("tokens > 0").groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(powers.get(d, 1.0))).alias("w"))
        total = sums.agg(F.sum("w").alias("t"))
        out[d] = sums.crossJoin(F.broadcast(total)).select(d, (F.col("w") / F.col("t")).alias("share"))  # total is one row
    return out


def fit_on_driver(keys: list[tuple], tokens: np.ndarray, targets: list[dict], iterations: int) -> np.ndarray:
    """Fitted share of each cell: the cells' token shares, scaled to each dimension's targets in turn."""
    share = tokens / tokens.sum()
    for _ in range(iterations):
        for d, target in enumerate(targets):
            values = {v: k for k, v in enumerate(dict.fromkeys(key[d] for key in keys))}
            of = np.array([values[key[d]] for key in keys])
            now = np.bincount(of, share, len(values))
            aim = np.array([target.get(v, 0.0) for v in values])
            share = share * np.where(now > 0, aim / np.where(now > 0, now, 1), 0)[of]
    return share / share.sum() if share.any() else share


def probabilities(share: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Chances in proportion to share/tokens, at most 1, that keep `budget` tokens on average (all with a share, if those are
    fewer). Cells without a share have no chance."""
    some = share > 0
    if not some.all():
        out = np.zeros(len(share))
        out[some] = probabilities(share[some], tokens[some], budget) if some.any() else 0
        return out
    ratio = share / tokens
    order = np.argsort(-ratio, kind="stable")
    full = np.concatenate([[0], np.cumsum(tokens[order])])[:-1]
    left = share[order][::-1].cumsum()[::-1]
    scale = (budget - full) / np.maximum(left, 1e-300)
    fits = np.nonzero((scale * ratio[order] <= 1) | (left <= 0))[0]
    return np.minimum(1, max(0.0, scale[fits[0]]) * ratio) if len(fits) else np.ones(len(share))


def fit_as_frames(cells: DataFrame, targets: dict[str, DataFrame], iterations: int, budget: float) -> DataFrame:
    """The same on DataFrames: dims, tokens, share, probability. A value without target has share and chance 0."""
    now = cells.where("tokens > 0").withColumn("share", F.col("tokens").cast("double"))
    for _ in range(iterations):
        for d, target in targets.items():
            sums = now.groupBy(d).agg(F.sum("share").alias("__now"))
            factor = sums.join(target.withColumnRenamed("share", "__aim"), d, "left").select(d, F.coalesce(F.try_divide(F.coalesce("__aim", F.lit(0.0)), F.col("__now")), F.lit(0.0)).alias("__f"))
            now = now.join(factor, d).withColumn("share", F.col("share") * F.col("__f")).drop("__f")
        now = common.written(now, "fit")
    # Which cells are kept whole is found by halving; the scale of the others follows in closed form.
    most = now.agg(F.max(F.try_divide(F.col("tokens"), F.col("share")))).first()[0]
    if most is None:  # no target can be met
        return now.withColumn("probability", F.lit(0.0))
    low, high = 0.0, float(most)
    for _ in range(60):
        middle = (low + high) / 2
        got = now.agg(F.sum(F.least(F.col("tokens").cast("double"), middle * F.col("share")))).first()[0]
        low, high = (middle, high) if got < budget else (low, middle)
    whole = F.col("share") * high >= F.col("tokens")
    sums = now.agg(F.sum("share").alias("all"), F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(~whole, F.col("share"))).alias("left")).first()
    scale = (budget - sums["full"]) / sums["left"] if sums["left"] else high
    return now.withColumn("probability", F.least(F.lit(1.0), scale * F.col("share") / F.col("tokens"))).withColumn("share", F.col("share") / sums["all"])


def _fitted(cells: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float, powers: dict[str, float] | None, iterations: int, on_driver: int) -> tuple[DataFrame, bool]:
    """Dims, share and probability of each cell, and whether the cells are few enough to broadcast."""
    spark = cells.sparkSession
    aims = power_targets(cells, DIMENSIONS, powers or POWERS)
    for d, given in (targets or {}).items():
        total = sum(given.values())
        aims[d] = spark.createDataFrame([(v, s / total) for v, s in given.items()], f"{d} string, share double")
    sums = cells.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    small = sums["n"] <= on_driver
    if not sums["t"]:
        return cells.select(*DIMENSIONS, F.lit(0.0).alias("share"), F.lit(1.0).alias("probability")), small
    if not small:
        return fit_as_frames(cells, aims, iterations, budget * float(sums["t"])).select(*DIMENSIONS, "share", "probability"), small
    rows = sorted((tuple(r[d] for d in DIMENSIONS), r["tokens"]) for r in cells.where("tokens > 0").collect())  # CELLS_ON_DRIVER at most
    keys, tokens = [k for k, _ in rows], np.array([t for _, t in rows], float)
    by = [{r[d]: r["share"] for r in aims[d].collect()} for d in DIMENSIONS]
    share = fit_on_driver(keys, tokens, by, iterations)
    chance = probabilities(share, tokens, budget * float(sums["t"]))
    return spark.createDataFrame([(*k, float(s), float(p)) for k, s, p in zip(keys, share, chance)], "source string, lang string, topic string, share double, probability double"), small


def with_chances(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, powers: dict[str, float] | None = None,
                 key: str = "doc_id", text: str = "text", seed: int = SEED, iterations: int = ITERATIONS, on_driver: int = CELLS_ON_DRIVER,
                 topics: int = TOPICS) -> DataFrame:
    """docs with __source, __lang, __topic, __tokens, __share, __probability and __keep added. Texts are read three
    times (words, cells, chances) and dealt out nowhere, as long as the cells are few enough to broadcast."""
    words = topic_words(docs, text, topics)
    named = {"__source": F.coalesce("source", F.lit("unknown")), "__lang": F.coalesce("lang", F.lit("unknown"))}
    slim = annotated(docs.select(*(c.alias(n) for n, c in named.items()), F.col(text).alias("__text")), words, "__text", "__topic", "__tokens")
    dims = [f"__{d}" for d in DIMENSIONS]
    cells = slim.groupBy(*dims).agg(F.sum("__tokens").alias("tokens")).withColumnsRenamed(dict(zip(dims, DIMENSIONS)))
    fitted, small = _fitted(common.written(cells, "cells"), targets, budget, powers, iterations, on_driver)
    fitted = fitted.withColumnsRenamed({**dict(zip(DIMENSIONS, dims)), "share": "__share", "probability": "__probability"})
    rows = annotated(docs.withColumns(named), words, text, "__topic", "__tokens")
    rows = rows.join(F.broadcast(fitted) if small else fitted, dims, "left").fillna({"__share": 0.0, "__probability": 1.0})
    return rows.withColumn("__keep", draw(F.col(key), seed) < F.col("__probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, share (of its cell), probability and keep for every row.

    targets: shares of values by dimension; a dimension that is left out gets power targets. Values without a target are
    not sampled. Null values count as `unknown`; null text has no tokens. Cells without tokens are kept whole, as they
    weigh nothing. Rows with equal keys share their draw. An empty table gives no rows. Columns of docs may have any
    names that don't begin with two underscores.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), "source", "lang", F.col(text).alias("text"))
    rows = with_chances(narrow, targets, **how)
    return rows.select("doc_id", *(F.col(f"__{d}").alias(d) for d in DIMENSIONS), F.col("__tokens").alias("n_tokens"), F.col("__share").alias("share"), F.col("__probability").alias("probability"), F.col("__keep").alias("keep"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, **how) -> DataFrame:
    """The rows of docs that mix() keeps, with their own columns."""
    return with_chances(docs, targets, **how).where("__keep").select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).withColumns({c: F.round(c, 6) for c in ("share", "probability")})


def oracle(iterations: int = ITERATIONS) -> str:
    """The same in SQL, the steps of the fit written out."""
    steps, last = [], "fit0"
    for k in range(iterations):
        for d in DIMENSIONS:
            name = f"fit{k}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT f.* REPLACE (f.share * a.share / sum(f.share) OVER (PARTITION BY f.{d}) AS share) FROM {last} f JOIN aim_{d} a USING ({d}))")
            last = name
    aims = [
        f"aim_{d} AS MATERIALIZED (SELECT {d}, w / sum(w) OVER () AS share FROM (SELECT {d}, pow(sum(tokens)::DOUBLE, {POWERS[d]}) AS w FROM cells WHERE tokens > 0 GROUP BY {d}))"
        for d in DIMENSIONS
    ]
    return f"""WITH texts AS MATERIALIZED (SELECT *, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
occurs AS MATERIALIZED (SELECT rid, unnest(regexp_extract_all(t, '[a-z\\x{{80}}-\\x{{10FFFF}}]{{{LETTERS},}}')) AS w FROM texts),
vocabulary AS MATERIALIZED (SELECT w, ln((SELECT count(*) FROM texts) / count(DISTINCT rid)) AS weight FROM occurs GROUP BY w
  HAVING count(DISTINCT rid) >= 2 AND count(DISTINCT rid) * {RARITY} <= (SELECT count(*) FROM texts) ORDER BY count(DISTINCT rid) DESC, w LIMIT {TOPICS}),
topics AS MATERIALIZED (SELECT rid, w AS topic FROM (SELECT rid, w, row_number() OVER (PARTITION BY rid ORDER BY round(count(*) * any_value(weight), 9) DESC, w) AS k
  FROM occurs JOIN vocabulary USING (w) GROUP BY rid, w) WHERE k = 1),
docs AS MATERIALIZED (
  SELECT rid, doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(topic, 'other') AS topic,
    len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM texts LEFT JOIN topics USING (rid)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
{", ".join(aims)},
fit0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS share FROM cells WHERE tokens > 0),
{", ".join(steps)},
shares AS MATERIALIZED (SELECT source, lang, topic, tokens, share / sum(share) OVER () AS share FROM {last}),
ranked AS (SELECT *, share / tokens AS ratio, sum(tokens) OVER o - tokens AS whole, sum(share) OVER (ORDER BY share / tokens, source DESC, lang DESC, topic DESC) AS rest
  FROM shares WINDOW o AS (ORDER BY share / tokens DESC, source, lang, topic)),
scale AS (SELECT max_by(s, ratio) AS s FROM (SELECT ({BUDGET} * (SELECT sum(tokens) FROM cells) - whole) / rest AS s, ratio FROM ranked) WHERE s * ratio <= 1),
fitted AS (SELECT source, lang, topic, share, least(1.0, greatest(0.0, s) * ratio) AS probability FROM ranked, scale)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(share, 0.0), 6) AS share, round(coalesce(probability, 1.0), 6) AS probability,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(2, 52) < coalesce(probability, 1.0) AS keep
FROM docs LEFT JOIN fitted USING (source, lang, topic)"""
