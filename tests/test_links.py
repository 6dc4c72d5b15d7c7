"""Links of larger tables."""

import pytest

from palimpsest.operators import consolidate, graph


@pytest.mark.parametrize("members, kept", [(203, True), (204, False)])
def test_cue_limit_grows_with_the_table(spark, members, kept):
    """Of 20,399 memories, cues of 203 are linked, of 204 not."""
    cues = f"CASE WHEN id < {members} THEN array('shared', concat('own', id)) ELSE array(concat('own', id)) END"
    mem = spark.range(20_399).selectExpr("concat('m', id) AS id", "id AS seq", f"{cues} AS cues")
    want = set()
    for a in range(members if kept else 0):
        for b in [x for x in range(members - 1, members - 66, -1) if x != a][:64]:
            want.add(tuple(sorted((f"m{a}", f"m{b}"))))
    links = graph.batch_links(mem)
    assert {(r["src"], r["dst"]) for r in links.collect()} == want
    assert graph.unlinked_pairs(mem, links).count() == (members * (members - 1) // 2 - len(want) if kept else 0)


def test_unlinked_pairs_by_rule_and_by_links(spark):
    """The links' rule says the same as the links; no pair is shuffled for it."""
    cues = "array(concat('a', id % 3), concat('b', id % 4), 'all', concat('own', id))"
    mem = spark.range(150).selectExpr("concat('m', id) AS id", "id AS seq", f"{cues} AS cues")
    links = graph.batch_links(mem, per_item=9)
    rows = {r["id"]: set(r["cues"]) for r in mem.collect()}
    linked = {(r["src"], r["dst"]) for r in links.collect()}
    want = sorted((a, b, min(rows[a] & rows[b])) for a in rows for b in rows if a < b and (a, b) not in linked)
    assert sorted(map(tuple, graph.unlinked_pairs(mem, links, part_rows=20).collect())) == want and want
    by_rule = graph.unlinked_pairs(mem, per_item=9, part_rows=20)
    assert sorted(map(tuple, by_rule.collect())) == want
    assert "Aggregate" not in by_rule._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_reflections_come_last(spark):
    """Facts with the same episodes share their texts, and none is ranked with its text."""
    rows = [(f"f{i}", i, "semantic", 2, f"2024-01-0{i + 1}", "fact") for i in range(4)] + [(f"e{i}", 10 + i, "episodic", 1, f"2024-02-{28 - i}", f"text {i}") for i in range(25)]
    mem = spark.createDataFrame(rows, "id string, seq long, kind string, evidence_count long, at string, content string").selectExpr("*", "cast(at as timestamp) created_at")
    links = [("e%d" % e, "f%d" % f, 1.0) for f, some in enumerate([range(25), range(25), [3], [1, 2]]) for e in some]
    got = consolidate.reflections(mem, spark.createDataFrame(links, "src string, dst string, weight double"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    first = [f"text {i}" for i in range(19, -1, -1)]
    assert {r["id"]: (r["n"], r["contents"]) for r in got.collect()} == {"f0": (20, first), "f1": (20, first), "f3": (2, ["text 2", "text 1"])}


def test_links_of_cues_of_any_number(spark):
    """Of 900 episodes, cues of 900 and 600 link as others do; each pair once, with all that it shares; a repeated cue counts once."""
    cues = "IF(id % 3 < 2, array('all', 'most', concat('c', id % 7), 'all'), array('all', concat('c', id % 7)))"
    mem = spark.range(900).selectExpr("concat('m', id) AS id", "id AS seq", "'episodic' AS kind", f"{cues} AS cues")
    rows = {r["id"]: set(r["cues"]) for r in mem.collect()}
    want = {(a, b): round(0.8 + 0.1 * len(rows[a] & rows[b]), 6) for a in rows for b in rows if a < b and len(rows[a] & rows[b]) > 1}
    for part_rows in (64, 500):
        links = graph.rem_links(mem, part_rows=part_rows)
        got = links.collect()
        assert len(got) == len(want) and {(r["src"], r["dst"]): r["weight"] for r in got} == want
    assert "Aggregate [src" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert graph.rem_links(mem, most=599).count() == 0
