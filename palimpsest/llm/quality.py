"""Document quality by Bradley-Terry ranking: all pairs of a better and a worse document, logistic loss on feature
differences, a quantile threshold. Tasks sum what the fit needs; no row is left out of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

#: Rows of a class and pairs that tests fit plainly, to compare with; the operator trains on all.
PER_CLASS, PAIRS = 1500, 30_000
#: Bins of scores: for gradients, for curvature, and those whose bounds the threshold is chosen from.
BINS, COARSE, FINE = 256, 16, 8192
BLOCK_ROWS = 4096

CLASSES = ("other", "upper", "lower", "digit", "blank", "line", "exclaim", "stop", "quote", "bar", "symbol", "bracket", "control", "accent_upper", "lead")


def byte_classes() -> np.ndarray:
    k = {c: i for i, c in enumerate(CLASSES)}
    out = np.zeros(256, np.int64)
    for name, members in (("exclaim", b"!?"), ("stop", b".,;:"), ("quote", b"'\"`"), ("bar", b"|"), ("symbol", b"#$%&*@^~_+=\\/"), ("bracket", b"<>{}[]()"), ("blank", b" \t\x0b\x0c\r"), ("line", b"\n")):
        out[list(members)] = k[name]
    out[65:91], out[97:123], out[48:58] = k["upper"], k["lower"], k["digit"]
    out[[*range(9), *range(14, 32), 127]] = k["control"]
    out[192:256] = k["lead"]
    return out


def _distinct(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h for each text number."""
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return np.bincount(t[new], minlength=n)


def features(col: pa.Array, classes: np.ndarray) -> np.ndarray:
    """A row of numbers for each text: shares of kinds of characters, words and lines, and how much repeats."""
    data, offs = common.utf8(col)
    n = len(offs) - 1
    size = np.diff(offs)
    text = np.repeat(np.arange(n), size)
    kind = classes[data]
    second = (data >= 0x80) & (data <= 0x9E)
    if len(data):
        second[1:] &= data[:-1] == 0xC3
        second[0] = False
    counts = np.bincount(text * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, len(CLASSES)).astype(np.float64)
    counts[:, CLASSES.index("accent_upper")] = np.bincount(text[second], minlength=n)
    chars = np.maximum(1, size)[:, None]
    starts, ends, owner = common.words(data, offs)
    length = ends - starts
    w = np.bincount(owner, minlength=n).astype(np.float64)
    one = np.maximum(1, w)
    total = np.bincount(owner, length, n)
    square = np.bincount(owner, length.astype(np.float64) ** 2, n)
    h = common.span_hashes(data, starts, ends)
    single = _distinct(owner, h, n) / one
    inner = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pairs = common.mix(h[:-1] * np.uint64(3) + h[1:])[inner] if len(h) else h
    double = _distinct(owner[1:][inner], pairs, n) / np.maximum(1, w - 1)
    tail = classes[data[ends - 1]] if len(ends) else ends
    head = classes[data[starts]] if len(starts) else starts
    name = CLASSES.index
    word_kinds = [np.bincount(owner[m], minlength=n) / one for m in (tail == name("exclaim"), tail == name("symbol"), tail == name("stop"), head == name("upper"), head == name("bar"), head == name("digit"), length == 1)]
    line = np.nonzero(data == 10)[0]
    cut = np.union1d(offs, line + 1)
    cut = cut[cut <= len(data)]
    a, b = cut[:-1], cut[1:]
    line_owner = np.searchsorted(offs, a, "right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(np.float64) if len(a) else np.zeros(n)
    line_h = common.span_hashes(data, a, b) if len(a) else np.zeros(0, np.uint64)
    unique_lines = _distinct(line_owner, line_h, n) / np.maximum(1, lines)
    short_lines = np.bincount(line_owner[(b - a) < 60], minlength=n) / np.maximum(1, lines) if len(a) else lines
    mean = total / one
    plain = [np.log1p(size), np.log1p(w), mean, np.sqrt(np.maximum(0, square / one - mean**2)), single, double, np.log1p(lines), unique_lines, short_lines, np.log1p(w / np.maximum(1, lines)), single * np.log1p(w)]
    shares = np.concatenate([counts / chars, np.stack(word_kinds, 1)], 1)
    base = np.concatenate([np.stack(plain, 1), shares, np.sqrt(shares)], 1)
    return base


class Model:
    """Weights of the standardised features, the threshold (and its quantile) and the steepness around it."""

    def __init__(self, w: np.ndarray, mean: np.ndarray, deviation: np.ndarray, threshold: float, quantile: float, steepness: float) -> None:
        self.w, self.mean, self.deviation = w, mean, deviation
        self.threshold, self.quantile, self.steepness = threshold, quantile, steepness

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.steepness * (self._standard(x) @ self.w - self.threshold), -30, 30)))


def _feature_rows(df: DataFrame, keep: list[str], made: list[tuple[str, pa.DataType, str]], of) -> DataFrame:
    fields = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {s}" for n, _, s in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for block in common.blocks(batches, "__text", 1 << 20):
            for start in range(0, block.num_rows, BLOCK_ROWS):
                part = block.slice(start, BLOCK_ROWS)
                x = features(part.column(len(keep)), classes)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, t) for c, (_, t, _) in zip(of(x), made))], names=[*keep, *(n for n, _, _ in made)])

    return df.mapInArrow(run, fields)


def _summed(rows: DataFrame, of, like: list[np.ndarray]) -> list[np.ndarray]:
    """Sums over all rows (__label, x) of the arrays that of(labels, features) makes of a batch; one row a task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros_like(a) for a in like]
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                total = [a + b for a, b in zip(total, of(np.asarray(batch.column(0)).astype(np.int64), x))]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel() for a in total]).tobytes()], pa.binary())], names=["sums"])

    total, ends = np.zeros(sum(a.size for a in like)), np.cumsum([a.size for a in like])
    for row in rows.mapInArrow(run, "sums binary").toLocalIterator():
        total = total + np.frombuffer(row["sums"])
    return [part.reshape(a.shape) for part, a in zip(np.split(total, ends[:-1]), like)]


def _fit(rows: DataFrame, steps: int = 15, decay: float = 1e-3) -> Model | None:
    """The model of all pairs of rows of label 1 and 0. The mean loss of the pairs, its gradient and its curvature follow
    from how many rows of each label have a score and from their features' sums, by bins of scores."""
    width = len(rows.first()["x"]) if not rows.isEmpty() else 0
    count, first, second = _summed(rows, lambda y, x: (np.bincount(y, minlength=2).astype(float), x.sum(0), (x * x).sum(0)), [np.zeros(2), np.zeros(width), np.zeros(width)])
    if not count.all():
        return None
    mean = first / count.sum()
    model = Model(np.zeros(width), mean, np.sqrt(np.maximum(0, second / count.sum() - mean**2)) + 1e-9, 0.0, 0.0, 1.0)
    pairs, spread, middle = count[0] * count[1], np.eye(width), np.zeros(width)

    def scores(w: np.ndarray) -> tuple[float, float]:
        """Lowest score and width of all that bins tell apart."""
        sd = np.sqrt(max(1e-12, w @ spread @ w))
        return middle @ w - 8 * sd, 16 * sd

    def binned(w: np.ndarray) -> list[np.ndarray]:
        low, wide = scores(w)

        def of(y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
            z = model._standard(x)
            at = np.clip((z @ w - low) / wide * BINS, 0, BINS - 1).astype(np.int64)
            n, sums, squares = np.zeros((2, BINS)), np.zeros((2, BINS, width)), np.zeros((2, COARSE, width, width))
            np.add.at(n, (y, at), 1.0)
            np.add.at(sums, (y, at), z)
            group = y * COARSE + at * COARSE // BINS
            for g in np.unique(group):
                part = z[group == g]
                squares[g // COARSE, g % COARSE] = part.T @ part
            return [n, sums, squares]

        return _summed(rows, of, [np.zeros((2, BINS)), np.zeros((2, BINS, width)), np.zeros((2, COARSE, width, width))])

    w, step, before = model.w, np.zeros(width), np.inf
    for _ in range(steps):
        n, sums, squares = binned(w)
        s = (sums @ w) / np.maximum(1, n)
        apart = np.clip(s[1][:, None] - s[0][None, :], -30, 30)
        wrong = 1 / (1 + np.exp(apart))  # how likely a pair of two bins would be told the other way
        loss = n[1] @ np.log1p(np.exp(-apart)) @ n[0] / pairs + decay / 2 * (w @ w)
        if loss > before + 1e-12:
            step = step / 2
            w = w - step
            continue
        before, curve = loss, wrong * (1 - wrong)
        middle = sums.sum((0, 1)) / count.sum()
        spread = squares.sum((0, 1)) / count.sum() - np.outer(middle, middle)
        gradient = (wrong.T @ n[1] @ sums[0] - wrong @ n[0] @ sums[1]) / pairs + decay * w
        bend = np.stack([curve.T @ n[1], curve @ n[0]])
        share = (bend * n).reshape(2, COARSE, -1).sum(2) / np.maximum(1, n.reshape(2, COARSE, -1).sum(2))
        cross = sums[1].T @ curve @ sums[0]
        hessian = ((squares * share[:, :, None, None]).sum((0, 1)) - cross - cross.T) / pairs + decay * np.eye(width)
        values, vectors = np.linalg.eigh(hessian)
        step = -vectors @ ((vectors.T @ gradient) / np.maximum(values, decay))
        if np.abs(step).max() < 1e-4:
            break
        w = w + step
    low, wide = scores(w)

    def told(y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        s = model._standard(x) @ w
        return [np.bincount(y * FINE + np.clip((s - low) / wide * FINE, 0, FINE - 1).astype(np.int64), minlength=2 * FINE).reshape(2, FINE).astype(float), np.bincount(y, s, 2)]

    n, total = _summed(rows, told, [np.zeros((2, FINE)), np.zeros(2)])
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, axis=1)], axis=1)  # rows below each bound of bins
    right = 1 - below[1] / count[1] + below[0] / count[0]
    top = np.nonzero(np.isclose(right, right.max()))[0]
    best = (top[0] + top[-1]) / 2
    apart = total[1] / count[1] - total[0] / count[0]
    return Model(w, model.mean, model.deviation, float(low + wide * best / FINE), float(below[:, int(best)].sum() / count.sum()), 4.0 / max(1e-6, apart))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model | None:
    """A model of all labelled rows. Null ids and labels other than 0 and 1 are left out; of several labels of an id the
    lowest holds. None when either label is missing. Only features meet the labels, as texts are long."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("__label"))
    made = _feature_rows(docs.where(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("__text")), [key], [("x", pa.list_(pa.float64()), "array<double>")], lambda x: [x.tolist()])
    rows = common.written(made.join(known, key).select("__label", "x"), "features")
    return _fit(rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)))


def score(df: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of df and `name`, from 0 to 1, at least 0.5 where the text ranks above the threshold.

    Null text counts as empty; equal texts score alike; without a model every score is 0.5. A column of df that is
    named like `name` is replaced.
    """
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes = byte_classes()
        for col in batches:
            out = [np.zeros(0)]
            for block in common.blocks([pa.RecordBatch.from_arrays([col], names=["t"])], "t", 1 << 20):
                for start in range(0, block.num_rows, BLOCK_ROWS):
                    part = block.column(0).slice(start, BLOCK_ROWS)
                    out.append(model.score(features(part, classes)) if model else np.full(len(part), 0.5))
            yield pa.array(np.concatenate(out))

    keep = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*keep, run(F.col(f"`{text}`")).alias(name))  # only texts go to Python


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.load(spark, sf_dir, "labels").where(~common.held_out())
    model = train(docs.where(~common.held_out()), labels)
    narrow = docs.select("doc_id", common.held_out().alias("held_out"), "text")
    return score(narrow, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
