"""Passes of recall and anchors that the given tables don't reach: dates, orders, premises, Chinese records."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import when
from palimpsest.operators import anchors, composed, consolidate, graph, index, ingest, insights, plans, vector
from palimpsest.sources import memories

NOW = memories.now  # a column needs a session


def stored(spark, rows, kind="episodic"):
    """Rows (content, cues) as memories m1, m2, ..."""
    df = spark.createDataFrame([(c, cues, k) for k, (c, cues) in enumerate(rows)], "content string, cues array<string>, input_pos int").withColumn("kind", F.lit(kind))
    return ingest.prepared(df, NOW(), 0, auto_cues=False).checkpoint()


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")


@pytest.fixture(autouse=True)
def folder(spark):
    memories.shared.shared_dir(spark)


def events(spark):
    rows = [("2024-01-05 Anna moved", ["anna", "2024-01-05"]), ("2024-01-09 Anna paints", ["anna", "2024-01-09"]), ("2024-02-20 Anna sings", ["anna", "2024-02-20"]), ("2024-01-01 Anna rests", ["anna", "2024-01-01"]), ("2024-01-06 Ben sails", ["ben", "2024-01-06"])]
    return stored(spark, rows)


def test_time_cells(spark):
    mem = events(spark)
    got = {(r["query_id"], r["id"]): (round(r["boost"], 4), r["force"]) for r in composed.time_cells(asked(spark, "what did anna do after 2024-01-05", "what did anna do before 2024-01-05", "two events after 2024-01-05 for anna", "anna 2024-01-05", "after 2024-01-05"), mem).collect()}
    assert got[0, "m1"] == (0.55, True) and got[0, "m2"] == (0.44, True) and not got[0, "m3"][1]
    assert got[1, "m4"] == (0.55, True) and (1, "m2") not in got
    assert got[2, "m3"] == (0.55, True) and not got[2, "m2"][1]
    assert {q for q, _ in got} == {0, 1, 2} and all(i != "m5" for _, i in got)


def test_event_chain_and_steps(spark):
    mem = events(spark)
    chain = {r["id"]: r["next_id"] for r in graph.event_chain(mem).collect()}
    assert chain == {"m4": "m1", "m1": "m2", "m2": "m3", "m3": None, "m5": None}
    links = graph.batch_links(mem)
    found = composed.recall_all(asked(spark, "what did anna do after 2024-01-05"), mem, links, NOW(), 5)
    assert found.where("rank = 1").first()["id"] == "m1" and found.where("rank = 2").first()["id"] == "m2"
    steps = [r["id"] for r in composed.in_steps(found, mem).orderBy("step").collect()]
    assert [i for i in steps if i != "m5"] == ["m4", "m1", "m2", "m3"]


def test_premises(spark):
    mem = stored(spark, [("小明比小红高", ["小明", "小红"]), ("她喜欢画画", ["小红"]), ("买了3本书", ["小明"])], "semantic")
    got = {(r["query_id"], r["id"]) for r in composed.premises(asked(spark, "小明和小红谁最高", "小明一共花了多少钱", "小明是谁"), mem).collect()}
    assert got == {(0, "m1"), (0, "m3"), (1, "m3")}


def test_anchors(spark):
    mem = stored(spark, [("航班 MU523 上午起飞", ["航班"]), ("记得航班提醒", ["航班"]), ("收纳箱放进了毛衣", ["收纳"]), ("2024年1月5日复查牙齿", ["牙齿"]), ("2023年12月1日复查牙齿", ["牙齿"]), ("2024年6月1日复查牙齿", ["牙齿"])])
    questions = asked(spark, "航班号是多少", "收纳箱收纳了哪些东西", "上次复查牙齿", "下次复查牙齿")
    found = spark.createDataFrame([(0, 1, "m2", 0.5)], "query_id long, rank int, id string, score double")
    got = {(r["query_id"], r["anchor"]): r["id"] for r in anchors.anchored(questions, found, mem).collect()}
    assert got[0, "entity"] == "m1" and got[1, "purchase"] == "m3"
    items = index.item_terms(mem).select("id", F.lit(None).alias("x")).join(mem.select("id", "content"), "id")
    from palimpsest.functions import text

    items = items.select("id", F.array_distinct(text.tokenize(F.col("content"), cjk=True)).alias("terms"))
    latest = {r["query_id"]: r["id"] for r in anchors.latest_of(questions, mem, items, F.to_date(NOW())).collect()}
    assert latest[2] == "m4" and latest[3] == "m6"


def test_dates_asked_for(spark):
    mem = stored(spark, [("a", ["date:2024-1-5"]), ("b", ["date:2024-02-10"]), ("c", ["date:2023-01-09"]), ("d", ["x"])])
    got = {(r["query_id"], r["id"]) for r in anchors.dated(asked(spark, "in 2023", "in january", "after 2024-01-20", "what"), mem).collect()}
    assert got == {(0, "m3"), (1, "m1"), (1, "m3"), (2, "m2")}
    boost = mem.crossJoin(asked(spark, "after 2024-01-20")).select("id", when.date_boost(when.cue_date(F.col("cues")), when.asked_time(F.col("query"))).alias("b"))
    assert {r["id"] for r in boost.collect() if r["b"]} == {"m2"}


def test_context_and_dense(spark):
    mem = stored(spark, [("red paint", ["red"]), ("red wall", ["red"])]).withColumn("context", F.when(F.col("id") == "m2", "kitchen"))
    plain = composed.recall.scored(asked(spark, "red"), mem, NOW()).collect()
    rich = composed.recall.scored(asked(spark, "red").withColumn("context", F.lit("kitchen")), mem, NOW()).collect()
    gain = {r["id"]: round(r["score"] - next(p["score"] for p in plain if p["id"] == r["id"]), 6) for r in rich}
    assert gain["m1"] == 0 and gain["m2"] > 0.1
    state = spark.createDataFrame([(0, f"m{k}", k, s, o, 0.5, o > 0) for k, (s, o) in enumerate([(0.9, 0.5), (0.85, 0.5), (0.5, 0.5), (0.45, 0.5), (0.1, 0.2), (0.3, 0.0)])], "query_id int, id string, seq int, score double, overlap double, retrievability double, matched boolean")
    near = spark.createDataFrame([(0, f"m{k}", 0.5) for k in range(6)], "query_id int, id string, cosine double")
    got = {r["id"]: (round(r["score"], 6), r["matched"]) for r in composed.reranked_dense(state, near).collect()}
    assert got["m3"] == (0.55, True) and got["m4"] == (0.1, True) and got["m5"] == (0.4, True)


def test_progress_and_reflection(spark):
    mem = stored(spark, [("fact one", ["x"]), ("event b", ["x"]), ("event c", ["x"])]).withColumn("kind", F.when(F.col("id") == "m1", "semantic").otherwise("episodic")).withColumn("evidence_count", F.lit(2).cast("long"))
    links = graph.batch_links(mem)
    assert consolidate.reflected(mem, links, lambda texts: " & ".join(texts)).first()["content"] == "event b & event c"
    assert consolidate.reflected(mem, links, lambda texts: 1 / 0).count() == 0
    one = insights.snapshot(mem, NOW())
    assert insights.progress(one, one.withColumn("reviewed_ratio", F.col("reviewed_ratio") + 0.5)).first()["verdict"] == "improving"


def test_goals(spark):
    rows = asked(spark, "参考阿丽和小波准备旅行，预算和时间有限制", "买书").select(plans.effort_of(F.col("query")), plans.plan_size(F.col("query")), plans.noun_of(F.lit("订车"))).collect()
    assert [tuple(r) for r in rows] == [("high", 14, "车"), ("low", 6, "车")]


def test_embedders(spark):
    rows = spark.createDataFrame([("abc def",), ("abc def",), (None,)], "content string")
    got = [r["embedding"] for r in vector.embeddings(rows).collect()]
    assert got[0] == got[1] and max(abs(a - b) for a, b in zip(got[0], vector.embed("abc def"))) < 1e-12 and set(got[2]) == {0.0}
    own = vector.embedder("callable", lambda texts: [[float(len(t))] for t in texts])
    assert [r["embedding"] for r in own(rows, "content").collect()] == [[7.0], [7.0], [0.0]]
    assert vector.embedder("none") is None
    with pytest.raises(ValueError):
        vector.embedder("other")


def test_store_operations(spark):
    mem = stored(spark, [("a b", ["xx"]), ("c d", ["xx"]), ("e f", ["yy"])])
    assert [r["id"] for r in ingest.get(mem, ["m1", "m3", "no"]).collect()] == ["m3", "m1"]
    links = graph.batch_links(mem)
    assert [r["id"] for r in graph.related(links, mem, "m1").collect()] == ["m2"] and graph.related(links, mem, "m1", 2).count() == 0
    report = graph.association_report(mem, links).first()
    assert (report["connected"], report["isolated"], report["pairs"]) == (2, 1, 1)
    left = ingest.deleted({"memories": mem, "links": links}, mem.where("id = 'm1'"))
    assert left["memories"].count() == 2 and left["links"].count() == 0
    assert ingest.deleted({"memories": mem}, mem, only_recycled=True)["memories"].count() == 3
    assert ingest.link_budget(1) == 64 and ingest.link_budget(100) == 32 and ingest.link_budget(10**6) == 8
    parts = index.inverted(mem, 1).where("term = 'xx'").collect()
    assert sorted(i for p in parts for i in p["ids"]) == ["m1", "m2"]
    rows = index.numbered(spark.range(1000).withColumn("k", F.xxhash64("id")), ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1000))
