"""Whole results and steps that grow no faster than their input."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from palimpsest.operators import consolidate, graph, ingest, insights, planning, plans, reports
from palimpsest.plans import more


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_intents_are_told_without_shuffling_pairs(spark):
    rows = [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:59:59", "a"), (3, "2024-01-01 01:00:00", "a"), (4, "2024-01-03 00:00:00", "b"), (5, None, "b")]
    intents = spark.createDataFrame(rows, "id long, due string, context_cue string").select("id", F.col("due").cast("timestamp").alias("due_at"), "context_cue", F.lit("active").alias("status"))
    pairs = planning.intent_conflicts(intents)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, "time"), (1, 3, "context"), (2, 3, "time"), (4, 5, "context")]
    assert "LeftAnti" not in _plan(pairs)


def test_links_of_shared_cues_are_whole(spark):
    """500 episodes of two cues are 124,750 pairs; two such groups are more than the budget of a night."""
    mem = spark.range(1000).selectExpr("concat('m', id) AS id", "id AS seq", "'episodic' AS kind", "array(concat('a', id % 2), concat('b', id % 2)) AS cues")
    assert graph.rem_links(mem).count() == 2 * 500 * 499 // 2


def test_all_facts_of_a_text_count_as_merged(spark, monkeypatch):
    """Two facts of one text were there before a third comes."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    facts = lambda rows, top: ingest.prepared(spark.createDataFrame(rows, "content string, kind string, input_pos int"), now, top)
    mem = facts([("one text", "semantic", 0), ("one text", "semantic", 1), ("other", "semantic", 2)], 0)
    new = facts([("One  text", "semantic", 0), ("fresh", "semantic", 1)], 10)
    monkeypatch.setattr(more, "_new", lambda t: new)
    got = {r["id"]: r["merged"] for r in more._merged(SimpleNamespace(mem=mem)).collect()}
    assert got == {"m1": 3, "m12": 1}


def test_interference_makes_no_pairs(spark):
    """Copies, one that shares half and a text without words under one cue: shares 1, 0.5 (twice) and 0."""
    rows = [("a", "river stone"), ("b", "stone river"), ("c", "stone market"), ("d", "")]
    got = reports.interference(spark.createDataFrame(rows, "id string, content string").withColumn("cues", F.array(F.lit("x"))))
    assert [tuple(r) for r in got.collect()] == [("x", 4, round((1 + 0.5 + 0.5) / 6, 6))]
    assert "InArrow" not in _plan(got)


def test_memories_to_rewrite_are_counted_without_pairs(spark):
    """Against brute force, with copies of a text, a memory without cues and one of more cues than are counted by parts."""
    rows = [(f"m{k}", k, f"text {k % 4}", f"h{k % 4}" if k % 7 else None, [f"a{k % 2}", f"b{k % 3}", f"c{k % 5}"][: k % 4]) for k in range(40)] + [("w", 40, "wide", "w", [f"a{j}" for j in range(9)])]
    mem = spark.createDataFrame(rows, "id string, seq long, content string, content_hash string, cues array<string>").withColumns(
        {"created_at": F.current_timestamp(), "last_access_at": F.lit(None).cast("timestamp"), "strength": F.lit(1.0), "storage_strength": F.lit(1.0), "review_streak": F.lit(0.0), "affect": F.lit(None).cast("string")}
    )
    got = insights.reconsolidation(mem.select("id"), mem, F.current_timestamp(), most=1000)
    for r in got.collect():
        own = next(x for x in rows if x[0] == r["id"])
        near = [x for x in rows if x[0] != r["id"] and set(x[4]) & set(own[4])]
        assert (r["related"], r["conflicts"]) == (len(near), sum(1 for x in near if None not in (x[3], own[3]) and x[3] != own[3]))
    counted = insights._counted(mem.select("id", "content_hash", "cues"), mem.select("id", "content_hash", "cues"))
    assert "id = target" not in _plan(counted)


def test_components_of_long_paths(spark):
    """A path whose ids go up and down takes more rounds than labels that spread by one link each would have had."""
    order = sorted(range(300), key=lambda k: (k * 7919) % 300)
    rows = [tuple(sorted((f"n{a:03}", f"n{b:03}"))) for a, b in zip(order, order[1:]) if a // 100 == b // 100]
    top = {f"n{k:03}": f"n{k:03}" for k in range(300)}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in rows:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    links = spark.createDataFrame(rows, "src string, dst string").withColumn("weight", F.lit(1.0))
    assert {r["id"]: r["community"] for r in graph.communities(links).collect()} == {x: root(x) for pair in rows for x in pair}


def test_rehearsal_meets_words_and_not_records(spark):
    """10,000 records of two words are two rows before steps meet them; a record counts once where both words are told."""
    told = spark.range(10_000).selectExpr("id", "'p' AS person", "IF(id % 2 = 0, 'mix', 'bake') AS step", "IF(id % 2 = 0, 'mix', 'bread') AS noun", "id % 4 = 0 AS ok", "1L AS weight")
    plan = spark.createDataFrame([(1, 0, "a", "p", "bake the bread"), (1, 1, "b", "p", "mix"), (1, 2, "c", "p", "rest"), (1, 3, "d", "q", "mix")], "query_id long, pos int, id string, person string, content string")
    got = plans.rehearsed(plan, told.drop("id"))
    assert {r["id"]: (r["success_probability"], r["weakest"]) for r in got.collect()} == {"a": (0.0, True), "b": (0.5, False), "c": (0.5, False), "d": (0.5, False)}


def test_linked_memories_are_told_without_links(spark):
    """A cue of all, a cue of two, one that repeats in a memory, and one of its own; 300 share the first."""
    rows = [(f"m{k:03}", k, ["all", f"p{k // 2}" if k % 3 else f"own{k}"]) for k in range(300)] + [("twice", 300, ["x", "x"]), ("none", 301, [])]
    mem = spark.createDataFrame(rows, "id string, seq long, cues array<string>")
    links = graph.batch_links(mem)
    want = {x for r in links.collect() for x in (r["src"], r["dst"])}
    got = graph.linked_ids(mem)
    assert sorted(r["id"] for r in got.collect()) == sorted(want) and 0 < len(want) < 300


def test_health_counts_without_broadcasts(spark):
    """The parts of the report meet as rows; ids that have links count as the links do."""
    mem = spark.createDataFrame([(f"m{k}", k, [f"c{k // 3}"]) for k in range(8)], "id string, seq long, cues array<string>")
    none = spark.createDataFrame([], "id string")
    clashes = spark.createDataFrame([(2,)], "clashes long")
    by_links, by_ids = (insights.health(mem, x, none, none, clashes, mem.where("seq = 0")) for x in (graph.batch_links(mem), graph.linked_ids(mem)))
    assert by_ids.first() == by_links.first() and by_ids.first()["linked"] == 8
    assert "Join" not in _plan(insights.health(mem, none, none, none, clashes, none))


def test_conflicts_pair_no_words_in_a_shuffle(spark):
    """Words come to the facts of a cue before they are paired: no join by id stands above the one by cue."""
    rows = [(f"f{k}", k, "semantic", f"stone river {k % 3}x", f"h{k % 3}", ["stone", f"c{k % 2}"], 0.9, 0.5) for k in range(9)] + [("g", 9, "semantic", "stone", "g", ["stone"], 0.9, 0.5)]
    mem = spark.createDataFrame(rows, "id string, seq long, kind string, content string, content_hash string, cues array<string>, confidence double, importance double")
    found = consolidate.conflicts(mem)
    want = {(f"f{a}", f"f{b}"): "stone" if (a + b) % 2 else min("stone", f"c{a % 2}") for a in range(9) for b in range(a + 1, 9) if a % 3 != b % 3}
    assert {(r["id_a"], r["id_b"]): r["cue"] for r in found.collect()} == want
    assert _plan(found).count("Join Inner, (id") == 0 and "content" not in _plan(found).replace("content_hash", "")
