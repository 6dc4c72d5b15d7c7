"""Text and curve functions on hand-made rows."""

import math

from pyspark.sql import functions as F

from palimpsest.functions import curve, numeric, text, when
from palimpsest.operators import planning, plans, vector
from palimpsest.sources import memories


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_latin_tokens(spark):
    tokens = lambda s: one(spark, s, lambda c: text.tokenize(c))
    assert tokens("The 2026-02-01 state-of-art bike, a Bike x1") == ["2026-02-01", "state-of-art", "bike", "bike", "x1"]
    assert tokens(None) == [] and tokens("the a of") == []
    assert tokens("schön") == ["sch"]


def test_chinese_tokens(spark):
    tokens = lambda s: one(spark, s, lambda c: text.tokenize(c, cjk=True))
    assert tokens("2026年3月1日买书") == ["2026-03-01", "买", "书", "买书"]
    assert "2026-05-02" in tokens("2026年五月二日")
    assert "3本" in tokens("三本") and "300元" in tokens("花了三百元") and "12000元" in tokens("一万二千元")
    assert one(spark, "一亿五千万", text.zh_number) == 150_000_000
    assert one(spark, "两千五百", text.zh_number) == 2500


def test_cues_and_mood(spark):
    cues = spark.createDataFrame([([" A  b", "a b", "", "C"],)], "x array<string>").select(text.normalize_cues(F.col("x"))).first()[0]
    assert cues == ["a b", "c"]
    assert one(spark, "so happy", text.mood) == "positive"
    assert one(spark, "happy and angry", text.mood) is None
    assert one(spark, "cities", text.inflections) == ["city"] and one(spark, "was", text.inflections) == []


def test_synonyms_are_added_once(spark):
    df = spark.createDataFrame([(["spent", "re-do_it", "price"],)], "x array<string>")
    assert df.select(text.expand_synonyms(F.col("x"))).first()[0] == ["spent", "re-do_it", "price", "cost", "paid", "bought", "spending", "re", "do", "amount", "fee"]


def test_published_decay_figures(spark):
    rows = spark.createDataFrame([("positive",), (None,)], "affect string").select(
        "affect", F.lit(1.0).alias("strength"), F.lit(1.0).alias("storage_strength"), F.lit(0.0).alias("review_streak"),
        F.lit(None).cast("timestamp").alias("last_access_at"), (memories.now() - F.make_dt_interval(F.lit(30))).alias("created_at"),
    )
    got = [round(r[0], 3) for r in rows.select(curve.retrievability(memories.now())).collect()]
    assert got == [0.421, 0.237] and math.isclose(math.exp(-0.002 * 720), 0.237, abs_tol=1e-3)


def test_store_snapshots(spark, tmp_path):
    store = memories.open_store(spark, tmp_path)
    assert store.read("memories").count() == 0
    row = {"id": "a", "seq": 1, "kind": "semantic", "content": "x", "status": "active", "cues": ["k"]}
    store.write("memories", spark.createDataFrame([row], memories.SCHEMA))
    store.merge("memories", spark.createDataFrame([{**row, "content": "y"}], memories.SCHEMA))
    store.export_json(str(tmp_path / "out"))
    other = memories.open_store(spark, tmp_path / "other")
    assert [r["content"] for r in other.import_json(str(tmp_path / "out")).collect()] == ["y"]
    assert store.delete("memories", store.read("memories")).count() == 0


def test_embedding_is_unit_length_and_deterministic():
    a, b = vector.embed("buy a bicycle"), vector.embed("buy a bicycle")
    assert a == b and math.isclose(sum(x * x for x in a), 1.0, rel_tol=1e-9) and not any(vector.embed(""))


def test_levels_of_a_chain_and_the_critical_path(spark):
    """A plain chain of more than twenty steps, one that branches, and steps without needs."""
    plan = spark.createDataFrame([(0, k, f"s{k}") for k in range(25)] + [(1, k, f"t{k}") for k in range(4)], "plan_id long, pos int, step string")
    needs = spark.createDataFrame([(0, k, k - 1) for k in range(1, 25)] + [(1, 2, 0), (1, 2, 1)], "plan_id long, pos int, needs int")
    placed = plans.levels(plan, needs)
    levels = {(r["plan_id"], r["pos"]): r["level"] for r in placed.collect()}
    assert [levels[0, k] for k in range(25)] == list(range(25)) and [levels[1, k] for k in range(4)] == [0, 0, 1, 0]
    path = {p: sorted(r["pos"] for r in plans.critical_path(placed, needs).where(f"plan_id = {p}").collect()) for p in (0, 1)}
    assert path == {0: list(range(25)), 1: [0, 2]}


def test_clashes_are_counted_as_listed(spark):
    rows = [(k, f"2024-01-01 {k % 5:02d}:{k * 7 % 60:02d}:00", "ab "[k % 3].strip(), "active" if k % 7 else "cancelled") for k in range(60)]
    intents = spark.createDataFrame(rows, "id long, due string, context_cue string, status string").select("id", F.col("due").cast("timestamp").alias("due_at"), "context_cue", "status")
    assert planning.clash_count(intents).first()[0] == planning.intent_conflicts(intents).count()
    listed = {x for r in planning.intent_conflicts(intents).collect() for x in (r["id_a"], r["id_b"])}
    queue = planning.action_queue(intents, F.lit("2024-01-01 02:30:00").cast("timestamp"), 100)
    assert all(r["clash"] == (r["id"] in listed) for r in queue.collect())
    assert planning.clash_count(intents.limit(0)).first()[0] == 0


def test_hashed_search_finds_most_neighbours(spark):
    rows = memories.table(spark, "/root/testdata/sf0.01", "embeddings")
    ids = [0, 100, 200, 300, 400]
    exact = {(r["query"], r["id"]) for r in vector.top_k(rows, ids).collect()}
    found = {(r["query"], r["id"]) for r in vector.lsh_top_k(rows, ids, 64).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_places_and_synonyms(spark):
    assert one(spark, "昨天在会议室里开会", text.place_of) == "会议室"
    assert one(spark, "去公司开会", text.place_of) == "公司开会"[:2] and one(spark, "在现在", text.place_of) is None
    assert one(spark, "nowhere", text.place_of) is None
    terms = spark.createDataFrame([(["旅游", "手机", "oil"],)], "x array<string>")
    got = terms.select(text.expand_zh_synonyms(F.col("x"))).first()[0]
    assert set(got) == {"旅游", "旅行", "手机", "电话", "phone", "oil", "机油"}


def test_questions(spark):
    kinds = {"一共花了多少钱": "math", "谁最高": "transitive", "小明比小红高吗": "compare", "what is it": None}
    for q, want in kinds.items():
        assert one(spark, q, text.question_kind) == want
    assert one(spark, "买了三本书", lambda c: text.has_dimension(c, F.lit("math"))) is True
    assert one(spark, "天气", lambda c: text.has_dimension(c, F.lit("math"))) is False
    assert one(spark, "小明比小红高，小红比小丽高，谁最高", text.pack_size) == 10 and one(spark, "x", text.pack_size) == 6
    cue = lambda q, c: spark.createDataFrame([(q, c)], "q string, c string").select(text.cue_in(F.col("c"), F.col("q"))).first()[0]
    assert cue("The Cat sat", "cat") and not cue("concatenate", "cat") and cue("去图书馆", "图书")


def test_times(spark):
    got = spark.createDataFrame([("What changed after 2024-01-05?",), ("the first trip in May 2023",), ("may I go before 2024/2/3",)], "q string")
    rows = got.select(*(c.cast("string").alias(n) for n, c in when.asked_time(F.col("q")).items())).collect()
    assert tuple(rows[0])[:3] == ("newest", "2024-01-05", None) and rows[0]["year"] == "2024"
    assert rows[1]["direction"] == "oldest" and rows[1]["month"] == "5" and rows[1]["year"] == "2023"
    assert rows[2]["direction"] == "oldest" and rows[2]["before"] == "2024-02-03"
    assert one(spark, "Who came before and after?", when.order_asked) == "before" and one(spark, "two events after", when.hops_asked) == 2
    assert str(one(spark, "2024年1月5日和3月7日", when.latest_date)) == "2024-03-07"
    assert str(one(spark, "二零 2024年五月二日", when.latest_date)) == "2024-05-02" and one(spark, "x", when.latest_date) is None


def test_numbers(spark):
    check = lambda p, s=None: spark.createDataFrame([(p, s)], "p string, s double").select(*(c.alias(n) for n, c in numeric.numeric_check(F.col("p"), F.col("s")).items())).first()
    assert check("走了3米和2公里")["mixed_units"] and check("8除以0")["zero_division"] and check("8除以05")["verdict"] == "consistent"
    assert check("2小时行驶120公里", 60.0)["speed_agrees"] and check("2小时行驶200公里", 60.0)["verdict"] == "review_needed"
    assert [q["unit"] for q in check("3元 2.5 小时")["quantities"]] == ["元", "小时"]
    ladder = spark.createDataFrame([("3加4",)], "p string").select(*(c.alias(n) for n, c in numeric.math_ladder(F.col("p")).items())).first()
    assert ladder["templates"] == ["a + b = c"] and ladder["verdict"] == "ready"
    fall = spark.createDataFrame([("从20米落下",)], "p string").select(*(c.alias(n) for n, c in numeric.simulated(F.col("p")).items())).first()
    assert fall["outcome"] == 2.02
