"""Packs, attention, quality of retrieval and affect against plain Python, with ties, nulls and empty tables."""

import random

import pytest

from palimpsest.operators import audits


@pytest.fixture(scope="module")
def store():
    pick = random.Random(5)
    rows = []
    for k in range(60):
        affect = pick.choice(["negative", "positive", "arousing", "neutral", None])
        rows.append((f"m{k:02d}", k, "x" * pick.choice([0, 5, 40, 90, 300]), pick.choice([[], ["a"], ["b", "a"], ["c"]]), pick.choice([0.5, 0.7, 0.9]), pick.choice([0.5, 0.6, 0.8]), affect))
    return rows


@pytest.fixture(scope="module")
def mem(spark, store):
    return spark.createDataFrame(store, "id string, seq int, content string, cues array<string>, strength double, importance double, affect string").cache()


FOUND = "query_id long, rank int, id string, score double, overlap double, retrievability double"


@pytest.fixture(scope="module")
def found():
    pick = random.Random(8)
    out = []
    for q in range(12):
        for r, k in enumerate(pick.sample(range(60), pick.choice([0, 1, 4, 5])), 1):
            out.append((q, r, f"m{k:02d}", round(0.9 - 0.1 * r, 2), pick.choice([0.0, 0.5]), 0.25))
    return out


@pytest.mark.parametrize("budget", [1, 100, 350, 10_000])
def test_packs_fill_their_budget_greedily(spark, store, mem, found, budget):
    by_id = {r[0]: r for r in store}
    want = []
    for pack in range(4):
        best = {}
        for q, _, i, score, overlap, _ in found:
            if q // 3 == pack and overlap > 0:
                best[i] = max(best.get(i, 0), score)
        used, place = 0, 0
        for i in sorted(best, key=lambda i: (-best[i], -by_id[i][1])):
            if used + len(by_id[i][2]) <= budget or place == 0:
                used += len(by_id[i][2])
                want.append((pack, place, i, best[i], used))
                place += 1
    df = spark.createDataFrame(found, FOUND).selectExpr("*", "query_id div 3 AS pack")
    assert sorted(map(tuple, audits.context_packs(df, mem, budget).collect())) == sorted(want)
    assert audits.context_packs(df.limit(0), mem, budget).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_attention_lists_what_distracts(spark, store, mem, found, k):
    want = set()
    for q in {f[0] for f in found}:
        hits = [(f[1], f[2]) for f in found if f[0] == q and f[1] <= k]
        want |= {(q, "relevant", r, i, len(hits)) for r, i in hits}
        rest = sorted((-m[4], -m[5], -m[1], m[0]) for m in store if m[4] >= 0.7 and m[5] >= 0.6 and m[0] not in {i for _, i in hits})
        want |= {(q, "suppressed", n, m[3], len(rest)) for n, m in enumerate(rest[:k], 1)}
    got = [tuple(r) for r in audits.attention(spark.createDataFrame(found, FOUND), mem, k).collect()]
    assert len(got) == len(want) and set(got) == want


def test_quality_of_retrieval(spark, found):
    asked = spark.range(12).withColumnRenamed("id", "query_id")
    tops = [f for f in found if f[1] == 1]
    hits = sum(f[4] > 0 for f in tops)
    row = audits.retrieval_quality(asked, spark.createDataFrame(found, FOUND)).first()
    assert row["evaluated"] == 12 and row["hit_rate"] == round(hits / 12, 3) and row["weak_rate"] == round((12 - hits) / 12, 3)
    assert row["avg_top_score"] == round(sum(f[3] for f in tops) / len(tops), 3)
    none = audits.retrieval_quality(asked.limit(0), spark.createDataFrame([], FOUND)).first()
    assert (none["evaluated"], none["hit_rate"], none["verdict"]) == (0, 0.0, "poor")


def test_emotion_advice(store, mem):
    row = audits.emotion_advice(mem).first()
    negative = [r for r in store if r[6] == "negative"]
    assert row["memories"] == 60 and row["negative"] == len(negative) and row["neutral"] == sum(r[6] in (None, "neutral") for r in store)
    counts = {}
    for r in negative:
        if r[3]:
            counts[r[3][0]] = counts.get(r[3][0], 0) + 1
    assert row["topics"] == ",".join(f"{t}:{n}" for t, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3])
    assert audits.emotion_advice(mem.limit(0)).first()["advice"] == "keep"
    assert audits.emotion_advice(mem.where("affect = 'negative'")).first()["advice"] == "reappraise"
