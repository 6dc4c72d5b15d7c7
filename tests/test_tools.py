"""Stores, tools that change them, the server and the command line."""

import io
import json
import threading
import urllib.request

import pytest

from palimpsest import __main__ as command
from palimpsest import render, server
from palimpsest.operators import reports
from palimpsest.sources import memories
from palimpsest.tools import StoreTools, Toolbox


@pytest.fixture
def tools(spark, tmp_path):
    box = StoreTools(spark, memories.open_store(spark, str(tmp_path / "store")))
    box.remember_many(
        [
            {"content": "The capital city bike costs 300 euros", "kind": "semantic", "cues": ["bike", "price"]},
            {"content": "Repaired the bike brake on Monday", "cues": ["bike", "repair"]},
            {"content": "The garden needs water every evening", "kind": "semantic", "cues": ["garden"]},
            {"content": "  ", "kind": "semantic"},
            {"content": "the capital  city bike costs 300 euros", "kind": "semantic", "cues": ["money"]},
        ]
    )
    return box


def test_ingest_merges_facts_and_links(tools):
    rows = {r["id"]: r for r in tools.memories.collect()}
    assert len(rows) == 3
    fact = next(r for r in rows.values() if "capital" in r["content"])
    assert fact["cues"][:2] == ["bike", "price"] and "money" in fact["cues"] and fact["seq"] == 1
    other = next(r for r in rows.values() if "Repaired" in r["content"])
    assert (min(fact["id"], other["id"]), max(fact["id"], other["id"])) in {(r["src"], r["dst"]) for r in tools.links.collect()}


def test_writes(tools):
    ids = {r["content"][:6]: r["id"] for r in tools.memories.collect()}
    garden, bike = ids["The ga"], ids["Repair"]
    assert tools.update(bike, "Repaired the bike chain").first()["revision_count"] == 1
    with pytest.raises(ValueError):
        tools.update(garden, "The capital city bike costs 300 euros")
    assert tools.forget(bike).first()[0] and not tools.forget(bike).first()[0]
    assert tools.restore(bike).first()[0]
    assert tools.tag_memories([bike], add=["Wheels"], remove=["repair"]).first()["cues"][-1] == "wheels"
    assert tools.suppress_memories([garden, "nothing"]).count() == 1
    assert garden not in {r["id"] for r in tools.toolbox().call("recall", query="garden water").collect()}
    assert tools.suppressed_report().count() == 1 and tools.unsuppress_memories([garden]).count() == 0
    assert tools.review(bike, True).first()["retrieval_successes"] == 1
    assert tools.review_batch([{"id": bike, "success": True}, {"id": bike, "success": False}, {"id": bike, "success": True}]).first()["review_streak"] == 1.0
    tools.forget(bike)
    assert tools.purge().first()[0] == 1 and tools.memories.count() == 2 and tools.links.where("src = 'x'").count() == 0


def test_recall_changes_what_it_recalls(tools):
    before = {r["id"]: r for r in tools.memories.collect()}
    found = tools.recall("what does the bike cost", 2).collect()
    after = {r["id"]: r for r in tools.memories.collect()}
    hit = next(r["id"] for r in found if r["matched"])
    assert after[hit]["access_count"] == before[hit]["access_count"] + 1 and after[hit]["retrieval_successes"] == 1
    assert tools.recall_log().first()["query"] == "what does the bike cost"


def test_outcomes_plans_and_intents(tools):
    for ok in (True, True, False):
        tools.record_outcome("小明搬家", "订车", ok)
    told = tools.toolbox()
    row = told.call("predict_step", s="订车").first()
    assert row["trials"] == 3 and row["success_probability"] == 0.667
    assert told.call("plan_quality", plan=["调研需求", "设计架构", "开发功能", "测试功能"]).first()["verdict"] == "fair"
    assert [r["step"] for r in told.call("plan_rewrite", plan=["测试一下", "写需求", "再测试"]).orderBy("pos").collect()] == ["调研需求", "测试功能"]
    assert told.call("effort_estimate", plan=["需求", {"step": "测试", "depends_on": [0]}, "散步"]).first().asDict() == {"plan_id": 0, "total": 11.0, "critical": 9.0, "buffered": 13.2}
    assert told.call("plan_tracker", plan=["a", "b"], statuses={"0": "done"}).first()["ratio"] == 0.5
    tools.intent_remember("call", "2024-01-01 10:00:00")
    ident = tools.intent_remember("call back", "2024-01-01 10:30:00").where("content = 'call back'").first()["id"]
    assert tools.toolbox().call("intent_conflicts").first()["kind"] == "time"
    assert tools.toolbox().call("action_queue").where("clash").count() == 2
    assert tools.intent_complete(ident).where("status = 'completed'").count() == 1
    assert tools.intent_cancel(ident).where("status = 'cancelled'").count() == 0


def test_night_and_vectors(tools):
    assert tools.rebuild_vectors().first()[0] == 3 and tools.rebuild_vectors().first()[0] == 3
    assert tools.sleep().count() == 1 and tools.memories.count() >= 3


def test_snapshots(spark, tools, tmp_path):
    store = tools.store
    version = store.version("memories")
    store.write("memories", store.read("memories"), expected=version)
    with pytest.raises(memories.ConcurrentWrite):
        store.write("memories", store.read("memories"), expected=version)
    assert store.vacuum("memories") >= 1 and store.read("memories").count() == 3
    store.put_setting("a", "1")
    store.put_setting("a", "2")
    assert store.get_setting("a") == "2" and store.get_setting("b") is None
    tools.suppress_memories([store.read("memories").first()["id"]])
    tools.intent_remember("x", "2024-01-01")
    store.export_json(str(tmp_path / "out"))
    other = StoreTools(spark, memories.open_store(spark))
    other.store.import_json(str(tmp_path / "out"))
    assert (other.memories.count(), other.intents.count(), other.suppressed.count()) == (3, 1, 1)


def test_reading_tools_answer(tools):
    box = tools.toolbox()
    ids = [r["id"] for r in tools.memories.collect()]
    calls = {
        "compare_memories": {"id_a": ids[0], "id_b": ids[1]}, "summarize_cluster": {"memory_ids": ids}, "session_summary": {"memory_ids": ids}, "recall_full": {"query": "bike"},
        "recognition_check": {"query": "bike brake", "memory_id": ids[0]}, "retrieval_assist": {"query": "bike"}, "plan": {"goal": "bike"}, "math_ladder": {"problem": "3加4"},
        "numeric_reasoning": {"problem": "3米2公里"}, "weekly_review": {}, "memory_health": {}, "learning_loop": {}, "association_report": {}, "goal_progress": {"goal": "bike"},
    }
    for name, arguments in calls.items():
        assert box.call(name, **arguments).columns
    assert box.call("memory_health").first()["score"] <= 100
    with pytest.raises(KeyError):
        box.call("nothing")
    assert len(tools.names()) >= 130
    assert "<svg" in render.memory_map_svg(reports.memory_map(tools.memories, tools.now))


def test_server_and_command_line(spark, tools, capsys):
    ask = lambda **r: server.answer({"jsonrpc": "2.0", "id": 1, **r}, tools)
    assert ask(method="ping")["result"] == {} and {"name": "recall"} in ask(method="tools/list")["result"]["tools"]
    assert ask(method="what")["error"]["code"] == server.METHOD
    assert ask(method="tools/call", params={"name": "what"})["error"]["code"] == server.PARAMS
    assert ask(method="tools/call", params={"name": "stats", "arguments": {"x": 1}})["error"]["code"] == server.PARAMS
    assert ask(method="tools/call", params={"name": "stats"})["result"]["content"][0]["total"] == 3
    assert server.answer({"method": "ping"}, tools) is None
    out = io.StringIO()
    server.serve_lines(tools, ["{", "", json.dumps({"id": 2, "method": "initialize"})], out)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert lines[0]["error"]["code"] == server.PARSE and lines[1]["result"]["serverInfo"]
    http = server.http_server(tools)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    body = json.dumps({"id": 3, "method": "ping"}).encode()
    with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{http.server_port}", body)) as r:
        assert json.loads(r.read())["id"] == 3
    http.shutdown()
    assert command.main([tools.store.path, "stats"], spark) == 0 and '"total":3' in capsys.readouterr().out
    assert command.main([tools.store.path, "nothing"], spark) == 1 and command.main([], spark) == 2


def test_bounds(spark):
    from palimpsest.tools import bounded

    assert bounded("top_k", 0) == 1 and bounded("limit", 10**9) == 5000
    assert Toolbox(spark, memories.open_store(spark).read("memories")).call("stats").first()["total"] == 0
