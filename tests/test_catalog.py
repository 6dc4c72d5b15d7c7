"""Queries against their SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from palimpsest.plans import catalog, kept, more  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query or two of each kind; with ALL_QUERIES set in the environment all that have SQL.
NAMES = sorted(catalog.ORACLES) if os.environ.get("ALL_QUERIES") else ["mem_view", "terms_index", "semantic_upsert", "next_interval", "review_load", "spacing_plan", "recall_keyword", "merge_duplicates", "detect_conflicts", "rem_links", "communities", "life_story", "mastery_map", "cosine_topk", "intent_conflicts", "time_cell_nearest", "stream_sessions", "turn_segments", "asof_events", "cube_flags", "inverted_index", "memory_health", "effort_estimate", "check", "recall_trace", "index_after_merges", "vector_index_contents", "temporal_anchor", "value_anchor", "transitive_premises", "integration_chains", "interleaved_plan", "stream_windows_append", "stream_intents_due", "stream_access_merged"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 100


def test_plans_push_filters_and_prune_columns(spark):
    df = catalog.QUERIES["tpch_q1_like"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "CartesianProduct" not in plan
