"""Commits over several tables, kept indexes and idempotent merges."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import index, stored
from palimpsest.sources import memories
from palimpsest.sources.ledger import ConcurrentWrite, Ledger
from palimpsest.streaming import access


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "ledger"))


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_tables_change_together(spark, ledger):
    t = ledger.transaction()
    t.write("a", spark.range(3))
    t.append("b", spark.range(2))
    assert ledger.head() == 0 and numbers(t.read("a")) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        ledger.read("a")
    assert t.commit() == 1
    t = ledger.transaction()
    t.append("b", spark.range(5, 6))
    t.drop("a")
    t.commit()
    assert numbers(ledger.read("b")) == [0, 1, 5] and numbers(ledger.read("a", 1)) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        ledger.read("a")


def test_a_crash_between_tables_is_invisible(spark, ledger):
    ledger.update(lambda t: (t.write("a", spark.range(1)), t.write("b", spark.range(1))))
    lost = ledger.transaction()
    lost.write("a", spark.range(7))
    lost.write("b", spark.range(7))  # and then the driver is gone
    assert numbers(ledger.read("a")) == numbers(ledger.read("b")) == [0]
    assert ledger.vacuum() == 2 and ledger.vacuum() == 0 and numbers(ledger.read("b")) == [0]


def test_two_writers(spark, ledger):
    """Of two that replace what both have read, one has to start anew; who only appends never has to."""
    ledger.update(lambda t: t.write("a", spark.range(1)))
    one, two = ledger.transaction(), ledger.transaction()
    one.write("a", one.read("a").union(spark.range(1, 2)))
    two.write("a", two.read("a").union(spark.range(2, 3)))
    one.commit()
    with pytest.raises(ConcurrentWrite):
        two.commit()
    three, four = ledger.transaction(), ledger.transaction()
    three.append("log", spark.range(1))
    four.append("log", spark.range(1, 2))
    four.commit()
    three.commit()
    assert numbers(ledger.read("a")) == [0, 1] and numbers(ledger.read("log")) == [0, 1]


def test_many_writers_lose_nothing(spark, ledger):
    """Threads add to one table by reading and replacing it, and to another by appending."""
    ledger.update(lambda t: (t.write("sum", spark.range(0)), t.put("n", 0)))
    failed = []

    def run(k):
        def change(t):
            t.write("sum", t.read("sum").union(spark.range(k, k + 1)).coalesce(1))
            t.append("log", spark.range(k, k + 1).coalesce(1))
            t.put("n", t.get("n") + 1)

        try:
            ledger.update(change, tries=50)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and ledger.state()["properties"]["n"] == 5 and ledger.head() == 6
    assert numbers(ledger.read("sum")) == numbers(ledger.read("log")) == list(range(5))


def test_store_deletes_with_all_that_hangs_on_a_memory(spark, tmp_path):
    store = memories.open_store(spark, str(tmp_path / "store"))
    mem = memories.migrated(spark.createDataFrame([(f"m{k}", "x") for k in range(3)], "id string, content string"))
    links = spark.createDataFrame([("m0", "m1", 1.0), ("m1", "m2", 1.0)], "src string, dst string, weight double")
    store.write_all({"memories": mem, "links": links, "suppressed": mem.select("id")})
    head = store.ledger.head()
    store.delete_memories(spark.createDataFrame([("m0",), ("zz",)], "id string"))
    assert store.ledger.head() == head + 1
    assert [numbers(store.read(n)) for n in ("memories", "links", "suppressed")] == [["m1", "m2"], ["m1"], ["m1", "m2"]]
    row = store.read("memories").first()
    assert (row["trust"], row["cues"], row["occurred_at"], row["status"]) == (0.5, [], None, "active")


def test_a_replayed_batch_counts_once(spark, tmp_path):
    store = memories.open_store(spark, str(tmp_path / "store"))
    mem = memories.migrated(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string"))
    store.write("memories", mem)
    batch = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-02 00:00:00"), ("gone", "2024-01-02 00:00:00")], "memory_id string, at string").select("memory_id", F.col("at").cast("timestamp").alias("ts"))
    assert access.take_accesses(store.ledger, batch, 0) and not access.take_accesses(store.ledger, batch, 0)
    assert access.take_accesses(store.ledger, batch.limit(1), 1) and not access.take_accesses(store.ledger, batch, 1)
    assert access.take_accesses(store.ledger, batch, 0, "another stream")
    assert access.fold_accesses(store.ledger) == 3 and access.fold_accesses(store.ledger) == 0
    assert not access.take_accesses(store.ledger, batch, 1)
    assert {r["id"]: r["access_count"] for r in store.read("memories").collect()} == {"a": 5, "b": 0}


def mem_rows(spark, rows):
    return spark.createDataFrame([(i, c, list(q)) for i, c, q in rows], "id string, content string, cues array<string>")


def test_term_index_equals_a_rebuild(spark, ledger):
    words = stored.TermIndex(ledger, "terms")
    state = {}

    def put(rows):
        words.put(mem_rows(spark, rows))
        state.update({i: (c, q) for i, c, q in rows})

    def same():
        want = index.term_index(mem_rows(spark, [(i, c, q) for i, (c, q) in state.items()]))
        rows = sorted(map(tuple, words.terms().select("id", "term").collect()))
        assert rows == sorted(map(tuple, want.select("id", "term").collect()))
        assert sorted(map(tuple, words.df().collect())) == sorted(map(tuple, want.groupBy("term").count().collect()))
        assert words.size() == len(state)

    put([(f"m{k}", f"apple tree number{k}", ["garden"]) for k in range(6)])
    same()
    put([("m1", "pear tree", ["garden"]), ("m9", "apple pie", [])])
    same()
    words.remove(spark.createDataFrame([("m2",), ("nobody",)], "id string"))
    del state["m2"]
    same()
    put([("m2", "apple again", [])])
    same()
    words.compact()
    same()
    put([("m2", "", [])])
    words.remove(spark.createDataFrame([("m9",)], "id string"))
    del state["m9"]
    same()
    assert sorted(r["id"] for r in words.find(["apple"]).collect()) == ["m0", "m3", "m4", "m5"]
    assert words.df(["apple", "nowhere"]).collect()[0]["df"] == 4


def test_find_opens_its_folders_only(spark, ledger):
    words = stored.TermIndex(ledger, "terms")
    words.put(mem_rows(spark, [(f"m{k}", f"word{k} other{k}", []) for k in range(200)]))
    plan = words.find(["word7"])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan
    assert len({f.split("folder=")[1].split("/")[0] for f in words.find(["word7"]).inputFiles() if "folder=" in f}) > 1  # the scan lists all, the filter picks
    assert [r["id"] for r in words.find(["word7"]).collect()] == ["m7"]


def test_vector_index_after_changes(spark, ledger):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    vecs = stored.VectorIndex.create(ledger, "v", 16, 600)
    frame = lambda ids: spark.createDataFrame([(int(k), x[k].tolist()) for k in ids], "id long, vector array<float>")
    vecs.add(frame(range(500)))
    vecs.remove(spark.range(0, 500, 7).withColumnRenamed("id", "id"))
    x[10:20] = -x[10:20]
    vecs.add(frame(range(10, 20)))
    vecs.add(frame(range(500, 600)))
    there = {*range(600)} - ({*range(0, 500, 7)} - {*range(10, 20)})
    for _ in range(2):  # before and after compaction
        assert vecs.size() == len(there) and {r["id"] for r in vecs.has(spark.range(620)).where("present").collect()} == there
        queries = frame([k for k in sorted(there) if k % 3 == 0]).withColumnRenamed("id", "query")
        found = {}
        for r in vecs.search(queries).collect():
            found.setdefault(r["query"], []).append((r["id"], r["similarity"]))
        ids = np.array(sorted(there))
        unit = x[ids] / np.linalg.norm(x[ids], axis=1, keepdims=True)
        hits = total = 0
        for q in [k for k in sorted(there) if k % 3 == 0]:
            s = unit @ (x[q] / np.linalg.norm(x[q]))
            best = [k for k in ids[np.argsort(-s)] if k != q][:10]
            got = found.get(q, [])
            assert all(i in there and abs(v - float(s[np.searchsorted(ids, i)])) < 1e-5 for i, v in got)
            hits, total = hits + len({i for i, _ in got} & set(best)), total + 10
        assert hits / total >= 0.9
        vecs.compact()
    with pytest.raises(ValueError):
        vecs.add(spark.createDataFrame([(1, [0.5])], "id long, vector array<float>"))
    vecs.clear()
    assert vecs.size() == 0 and vecs.search(queries).count() == 0
