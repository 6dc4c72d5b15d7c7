"""The pipeline's stages, each on its own input."""

import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa

from palimpsest.llm import common, ngramjoin, quality

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.load(spark, DIR, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "mixing", "bpe"]
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, DIR), name)
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "near_duplicates":
            groups = ngramjoin.join(docs).where("n_shingles > 0").groupBy("component_id").count()
            assert groups.where("count > 1").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0


def test_empty_and_null_documents(spark):
    schema = common.load(spark, DIR, "documents").schema
    rows = [(None, None, None, None, None), (1, "", "en", "src1", 0), (2, None, "en", "src1", None), (2, None, "en", "src1", None)]
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, DIR), name)
        assert docs.count() >= 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_one_document_of_each_group_stays(spark):
    """Near copies in chains, exact copies, repeated rows, short, empty and null texts, null ids: against all pairs."""
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(12)]
    rows = []
    for k in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((1000 - k, " ".join(w), "en", "s", 1))
    rows += [(2000, "A b", "en", "s", 1), (2001, "a B", "en", "s", 1), (2002, "", "en", "s", 0), (2003, None, "en", "s", 0), (2004, "", "en", "s", 0), (None, base[0], "en", "s", 1), rows[0], rows[0]]
    schema = common.load(spark, DIR, "documents").schema
    got = sorted(tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), DIR).where("doc_id is not null").select(*corpus_pipeline.COLUMNS).collect())
    known = {r[0]: r for r in rows if r[0] is not None}
    sets = {i: shingles(r[1]) for i, r in known.items()}
    top = {i: i for i in known}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in known:
        for j in known:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    assert [r[0] for r in got] == sorted(i for i in known if root(i) == i) and all(tuple(known[r[0]]) == r for r in got) and schema.names == list(corpus_pipeline.COLUMNS)


def test_quality_model_by_definition(spark):
    """The model that the operator trains is the one that a plain fit on the same pairs gives, and it ranks by it."""
    docs, labels = common.load(spark, DIR, "documents"), common.load(spark, DIR, "labels")
    model = quality.train(docs, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    rows = [(r["text"], known[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in known]
    x = quality.features(pa.array([t for t, _ in rows], pa.string()), quality.byte_classes())
    y = np.array([q for _, q in rows])
    order = np.lexsort(np.concatenate([x.T, y[None]]))
    x, y = x[order], y[order]
    assert len(rows) <= 2 * quality.PER_CLASS and np.allclose(model.mean, x.mean(0))
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    rng = np.random.default_rng(11)
    pairs = z[rng.choice(np.nonzero(y == 1)[0], quality.PAIRS)] - z[rng.choice(np.nonzero(y == 0)[0], quality.PAIRS)]
    loss = lambda w: np.log1p(np.exp(-np.clip(pairs @ w, -30, 30))).mean() + 0.5e-3 * (w @ w)
    # Nothing near does better by more than the steps left: the loss is convex.
    around = [loss(model.w + 0.05 * d) for d in np.random.default_rng(3).standard_normal((50, len(model.w)))]
    assert loss(model.w) < loss(np.zeros(len(model.w))) and loss(model.w) <= min(around) + 1e-4
    s = z @ model.w
    right = lambda c: (s[y == 1] >= c).mean() + (s[y == 0] < c).mean()
    assert right(model.threshold) >= max(right(c) for c in s) - 0.05
