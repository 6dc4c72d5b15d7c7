"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import common

DIMS = 4096
SCALE = 40.0
#: The training sample: distinct texts of a language, and in all.
PER_LANGUAGE, ALL_ROWS = 500, 4000
#: Losses that lie closer than this to each other leave a text ambiguous.
AMBIGUOUS = 0.08
BLOCK_ROWS = 1024


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed 1-, 2- and 3-grams of the letters of each text (other characters: word ends), and the
    letters of each text."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in low], np.int64)
    codes = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(low)), size)
    codes = np.where(letters[codes], codes, 0)
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    codes, text = codes[keep], text[keep]
    full = np.bincount(text[codes != 0], minlength=len(low))
    before = np.concatenate([[0], codes[:-1]]).astype(np.uint32)
    after = np.concatenate([codes[1:], [0]]).astype(np.uint32)
    inside = codes != 0
    c, b, a, t = codes[inside], before[inside], after[inside], text[inside]
    one = c * np.uint32(0x9E3779B1)
    two = (b * np.uint32(0x85EBCA6B)) ^ one ^ np.uint32(0x5BD1E995)
    two = two * np.uint32(0xC2B2AE35)
    three = (two ^ (a * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    base = t * DIMS
    out = np.zeros(len(low) * DIMS, np.int64)
    for h in (one, two, three):
        h = h ^ (h >> np.uint32(15))
        out += np.bincount(base + (h % np.uint32(DIMS)).astype(np.int64), minlength=len(low) * DIMS)
    return out.reshape(len(low), DIMS), full


def scaled(counts: np.ndarray) -> np.ndarray:
    return (counts * (SCALE / np.maximum(1, counts.sum(axis=1, keepdims=True)))).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each of k classes: the exhaustive code up to 6 classes, else the best of random codes."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 6:
        columns = [c for c in itertools.product((-1, 1), repeat=k) if c[0] == 1 and min(c) < 0]
        return np.array(columns, np.float32).T
    rng = np.random.default_rng(seed)
    width = int(np.ceil(15 * np.log2(k)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (k, width))
        if (np.abs(code.sum(axis=0)) == k).any():
            continue
        apart = (width - (code @ code.T)[np.triu_indices(k, 1)].max()) / 2
        if apart > most:
            best, most = code, apart
    return best


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one logistic classifier for each column of y (-1 and 1), by full-batch Adam."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        margin = np.clip(y * (x @ w + b), -30, 30)
        g = -y / (1 + np.exp(margin)) / len(x)
        for k, (p, d) in enumerate(((w, x.T @ g + decay * w), (b, g.sum(axis=0)))):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w, b


class Model:
    """Classifiers of the codewords' bits, weights of the bits, and the languages."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.languages = languages
        self.code = codewords(len(languages))
        self.w, self.b = logistic(x, self.code[y])
        # A bit weighs as much as its classifier beats chance on the training rows.
        right = (np.sign(x @ self.w + self.b) == self.code[y]).mean(axis=0)
        self.trust = np.maximum(right - 0.5, 1e-3)
        self.trust /= self.trust.sum()

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The weighted logistic loss of each text against each language's codeword."""
        f = np.clip(x @ self.w + self.b, -20, 20)
        return np.log1p(np.exp(-f[:, None, :] * self.code[None])) @ self.trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest and next languages, score from 0 to 1, and whether the two are too close to tell."""
        loss = self.losses(x)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        second = order[:, min(1, loss.shape[1] - 1)]
        p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        rows = np.arange(len(loss))
        score = p[rows, best] / p.sum(axis=1)
        close = (loss[rows, second] - loss[rows, best] < AMBIGUOUS) & (best != second)
        return best, second, score, close


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from a bounded sample of labelled rows: of each language the PER_LANGUAGE distinct texts with the smallest
    hashes, fewer where languages are many, at least one, so that ALL_ROWS in all are not exceeded. Of more than ALL_ROWS
    languages the ones with the most texts are learned. None without labelled rows with letters."""
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    h = F.xxhash64("text", F.lit(1))
    place = h.cast("double") / float(1 << 64) + 0.5
    # Copies of a text are one: what is counted is what can be drawn.
    stats = labelled.groupBy("lang").agg(F.count_distinct(h).alias("n"), F.min(place).alias("least"))
    known = stats.orderBy(F.desc("n"), "lang").limit(ALL_ROWS).collect()
    if not known:
        return None
    each = max(1, min(PER_LANGUAGE, ALL_ROWS // len(known)))
    # So many hashes lie below the bound that all but surely `each` of them do; ranks then cut those few to `each`.
    wide = each + 5 * each**0.5 + 10
    bounds = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], wide / r["n"])) for r in known], "lang string, bound double")
    near = labelled.join(F.broadcast(bounds), "lang").where(place <= F.col("bound")).select("text", "lang").distinct()  # bounds: ALL_ROWS rows at most
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "text"))
    chosen = near.withColumn("rank", rank).where(F.col("rank") <= each).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for block in common.blocks(batches, "text"):
            for start in range(0, block.num_rows, 256):
                part = block.slice(start, 256)
                texts = part.column(0).to_pylist()
                # Short pieces are learned as well, so that short texts are judged by what they are like.
                pieces = [q for t in texts for q in (t, t[: len(t) // 2][-40:], t[len(t) // 2 :][:80])]
                counts, full = ngram_counts(pieces, letters)
                names = [x for x in part.column(1).to_pylist() for _ in range(3)]
                keep = np.nonzero(full)[0]
                packed = [counts[k].astype(np.uint16).tobytes() if counts[k].max() < 65536 else (counts[k] * 65535 // counts[k].max()).astype(np.uint16).tobytes() for k in keep]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in keep], pa.string()), pa.array(packed, pa.binary())], names=["lang", "counts"])

    rows = chosen.mapInArrow(run, "lang string, counts binary").toArrow()
    if not rows.num_rows:
        return None
    languages = sorted(set(rows.column("lang").to_pylist()))
    index = {x: k for k, x in enumerate(languages)}
    y = np.array([index[x] for x in rows.column("lang").to_pylist()])
    x = np.empty((rows.num_rows, DIMS), np.float32)
    for k, c in enumerate(rows.column("counts")):
        x[k] = scaled(np.frombuffer(c.as_py(), np.uint16)[None].astype(np.int64))[0]
    order = np.lexsort((x @ np.arange(DIMS, dtype=np.float32), y))  # the same sums whatever order the rows came in
    return Model(languages, x[order], y[order])


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all but text), lang_pred, score, runner_up and ambiguous.

    Null text, text without a letter, or no model: `und`, score 0. Equal texts get equal answers.
    """
    made = ["lang_pred", "score", "runner_up", "ambiguous"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, *made)]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for block in common.blocks(batches, "__text"):
            for start in range(0, block.num_rows, BLOCK_ROWS):
                part = block.slice(start, BLOCK_ROWS)
                counts, full = ngram_counts(part.column(len(keep)).to_pylist(), letters)
                if model is None:
                    columns = [["und"] * len(full), [0.0] * len(full), [None] * len(full), [True] * len(full)]
                else:
                    best, second, score, close = model.decode(scaled(counts))
                    some = full > 0
                    columns = [
                        [model.languages[b] if s else "und" for b, s in zip(best, some)],
                        np.where(some, score, 0.0).astype(np.float64),
                        [model.languages[b] if s and b != a else None for a, b, s in zip(best, second, some)],
                        close | ~some,
                    ]
                types = (pa.string(), pa.float64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(columns, types))], names=[*keep, *made])

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text")).mapInArrow(
        run, fields + "lang_pred string, score double, runner_up string, ambiguous boolean"
    )


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~common.held_out()))
    return identify(docs.select("doc_id", common.held_out().alias("held_out"), "text"), model)
