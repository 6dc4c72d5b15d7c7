"""Streams against a fold of the whole, row by row."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.streaming import access, due


def slow_fold(rows):
    n = good = bad = streak = last = 0
    strength = 0.5
    for _, r in rows.sort_values(["ts", "event_id"]).iterrows():
        n, last = n + 1, max(last, r["ts"].value // 1000)
        if r["event_type"] in ("purchase", "signup"):
            good, streak, strength = good + 1, streak + 1, min(1.0, strength + 0.05)
        elif r["event_type"] == "error":
            bad, streak, strength = bad + 1, 0, max(0.3, strength - 0.05)
    return n, good, bad, streak, strength, last


def test_fold_of_stream_equals_fold_of_all(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    got = {r["user_id"]: tuple(r)[1:] for r in access.folded(spark, path).collect()}
    for user, rows in pd.read_parquet(path).groupby("user_id"):
        want = slow_fold(rows)
        assert got[user] == (*want[:4], round(want[4], 6))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["purchase", "signup", "error", "view"]), max_size=60), st.integers(0, 60))
def test_fold_in_pieces(kinds, cut):
    rows = pd.DataFrame({"event_id": range(len(kinds)), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(kinds)), "s"), "event_type": kinds})
    state = access.fold_one(None, rows.iloc[:cut])
    state = access.fold_one(state, rows.iloc[cut:])
    want = slow_fold(rows)
    assert state[:4] == want[:4] and abs(state[4] - want[4]) < 1e-9 and state[5] == want[5]


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    """Each arrival is read once; what the sink has of a batch is written over when it comes again."""
    rows = spark.range(30).select("id", (F.col("id") % 3).cast("int").alias("part"))
    seen = []

    def run(stream):
        out = access.run_into(stream.select("id"), str(tmp_path / "into"))
        seen.append(out.count())
        return out

    out = access.replayed(rows, F.col("part"), 3, run)
    assert seen == [10, 20, 30] and {r["id"] for r in out.collect()} == set(range(30)) and out.select("batch").distinct().count() == 3


def test_settings_are_given_back(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with access.settings(spark, {key: "3", "spark.some.other": "x"}):
        assert spark.conf.get(key) == "3"
    assert spark.conf.get(key) == before and spark.conf.get("spark.some.other", None) is None


def test_due_intents_in_buckets(spark, tmp_path):
    """Many intents to a bucket: state is kept for them together, and each is told once, unless it was cancelled by then."""
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = []
    for i in range(60):
        rows.append((i, day(i % 10), "remember", day(i % 10 + i % 7 - 2), i % 10 // 4))
        if i % 4 == 0:
            rows.append((i, day(i % 10 + i % 3), "cancel", None, (i % 10 + i % 3) // 4))
    rows += [(900, day(1), "cancel", None, 0), (901, day(12), "remember", day(40), 3), (None, day(2), "remember", day(2), 0)]
    events = spark.createDataFrame(rows, due.INTENT_EVENTS + ", slice int")
    run = lambda stream: access.run_into(due.due_intents(stream.drop("slice"), "1 day", 3), str(tmp_path / "due"), "update", due.STORE)
    got = sorted((r["id"], r["due_ms"]) for r in access.replayed(events, F.col("slice"), 4, run).collect())
    gone = {r[0]: r[1] for r in rows if r[2] == "cancel"}
    ms = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() * 1000)
    want = sorted((i, ms(d)) for i, _, kind, d, _ in rows if i is not None and kind == "remember" and d <= day(11) and not (i in gone and gone[i] <= d))
    assert got == want and len(got) > 30


def test_due_intents_call_python_for_buckets(spark):
    """The state's key is a bucket, so calls of Python don't grow with each intent."""
    stream = spark.readStream.format("rate").load().selectExpr("value id", "timestamp at", "'remember' kind", "timestamp due_at")
    plan = due.due_intents(stream, buckets=8)._jdf.queryExecution().logical().toString()
    assert "bucket" in plan and due.buckets_for(9_000_000) == 2250 and due.buckets_for(0) == 1
