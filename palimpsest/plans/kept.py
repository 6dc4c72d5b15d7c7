"""Queries over kept indexes, dated records and chains, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import audits, chains, consolidate, dated, index, plans, stored
from palimpsest.plans.catalog import _CAL, _CONFLICTS, Tables, plain, query
from palimpsest.plans.oracle import ASKED, MEM, TRIES, tokens
from palimpsest.sources import memories as source
from palimpsest.sources import shared

# --- kept indexes: memories come in two lots, some are rewritten, some go, and in between the index is compacted


def _kept_terms(t: Tables) -> stored.TermIndex:
    words = stored.TermIndex(stored.open_ledger(t.spark), "terms")
    rows = shared.written(t.act.select("id", "seq", "content", "cues"), "memories")
    words.put(rows.where("seq % 3 <> 0"))
    words.put(rows.where("seq % 3 = 0"))
    words.remove(rows.where("seq % 17 = 4"))
    words.compact()
    words.put(rows.where("seq % 10 = 1").withColumn("content", F.concat("content", F.lit(" zebra-crossing"))))
    words.remove(rows.where("seq % 23 = 5"))
    return words


_KEPT = f""", lot AS (SELECT id, CASE WHEN seq % 10 = 1 THEN content || ' zebra-crossing' ELSE content END AS content, cues FROM act WHERE NOT (seq % 17 = 4 AND seq % 10 <> 1) AND seq % 23 <> 5),
kept AS (SELECT id, unnest(list_distinct(list_concat({tokens('content')}, flatten(list_transform(cues, lambda c: {tokens('c')}))))) AS term FROM lot)
"""
query("index_after_merges", _KEPT + "SELECT id, term FROM kept")(lambda t: _kept_terms(t).terms().select("id", "term"))
query("index_df_merged", _KEPT + "SELECT term, count(*) AS df FROM kept GROUP BY term")(lambda t: _kept_terms(t).df())
query("find_by_terms_stored", _KEPT + "SELECT term, id FROM kept WHERE term IN ('zebra-crossing', 'src3', 'the', 'une')")(lambda t: _kept_terms(t).find(["zebra-crossing", "src3", "the", "une"]))


def _kept_vectors(spark: SparkSession, sf_dir: str) -> stored.VectorIndex:
    rows = source.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dim = rows.select(F.size("vector").alias("n")).where("n > 0").first()["n"]
    vecs = stored.VectorIndex.create(stored.open_ledger(spark), "vectors", dim, rows.count())
    vecs.add(rows.where("id % 10 <> 9"))
    vecs.remove(rows.where("id % 13 = 5"))
    vecs.compact()
    vecs.add(rows.where("id % 10 = 9"))
    vecs.add(rows.where("id % 25 = 7").withColumn("vector", F.transform("vector", lambda x: -x)))
    vecs.remove(rows.where("id % 31 = 3"))
    return vecs


_HELD = "held AS (SELECT vec_id AS id, CASE WHEN vec_id % 25 = 7 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS vector FROM embeddings WHERE (vec_id % 13 <> 5 OR vec_id % 10 = 9 OR vec_id % 25 = 7) AND vec_id % 31 <> 3)"
plain("vector_index_contents", f"WITH {_HELD} SELECT e.vec_id AS id, h.id IS NOT NULL AS present, round(h.vector[1]::DOUBLE, 6) AS first FROM embeddings e LEFT JOIN held h ON e.vec_id = h.id")(lambda s, d: _contents(s, d))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = _kept_vectors(spark, sf_dir)
    asked = source.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return vecs.has(asked).join(vecs.vectors(), "id", "left").select("id", "present", F.round(F.get("vector", 0).cast("double"), 6).alias("first"))


@plain("vector_index_search")
def _vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest that the index finds for every hundredth id that it holds."""
    vecs = _kept_vectors(spark, sf_dir)
    queries = vecs.vectors().where("id % 100 = 0").select(F.col("id").alias("query"), "vector")
    return vecs.search(queries)


query("gaps_semantic")(lambda t: chains.semantic_gaps(t.asked(), index.exploded(t.items), t.act))

# --- orders

query("interleaved_plan", """, c AS (SELECT id, seq, importance, coalesce(cues[1], id) AS category FROM act), s AS (SELECT *, count(*) OVER (PARTITION BY category) AS size, count(*) OVER () AS total FROM c),
n AS (SELECT *, row_number() OVER (ORDER BY size DESC, category, importance DESC, seq DESC) - 1 AS n, max(size) OVER () AS most FROM s)
SELECT CASE WHEN most > total - most + 1 THEN CASE WHEN n < most THEN CASE WHEN n <= total - most THEN 2 * n ELSE total - most + n END ELSE 2 * (n - most) + 1 END
  ELSE CASE WHEN n < (total + 1) // 2 THEN 2 * n ELSE 2 * (n - (total + 1) // 2) + 1 END END AS place, id, category FROM n""")(lambda t: chains.interleaved_plan(t.act))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = source.table(spark, sf_dir, "orders")
    return orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("cues"), F.lit("").alias("content"), F.lit("episodic").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"), F.col("o_orderkey").alias("seq"))


plain("event_chains", "SELECT 'c' || o_custkey AS topic, count(*) AS events, round((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 8.64e10, 1) AS span_days FROM orders GROUP BY o_custkey HAVING count(*) >= 2 AND (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 8.64e10 <= 400.04")(
    lambda s, d: chains.event_chains(_episodes(s, d), 400.0)
)
plain("integration_chains", """WITH e AS (SELECT o_orderkey AS k, o_custkey AS c, epoch_us(o_orderdate) AS us, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS us0 FROM orders),
m AS (SELECT *, sum(CASE WHEN us0 IS NULL OR us - us0 > 60 * 8.64e10 THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY us, k ROWS UNBOUNDED PRECEDING) AS run FROM e),
r AS (SELECT *, count(*) OVER (PARTITION BY c, run) AS size FROM m)
SELECT 'c' || c AS topic, dense_rank() OVER (PARTITION BY c ORDER BY run)::INT AS chain, row_number() OVER (PARTITION BY c, run ORDER BY us, k) - 1 AS pos, 'o' || k AS id FROM r WHERE size >= 2""")(lambda s, d: chains.chain_runs(_episodes(s, d), 60.0))

# --- comparisons that follow from others: each part is dearer than one or two others, as records say


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = source.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    p = lambda k: F.concat(F.lit("p"), k.cast("string"))
    near = part.where("k > 0").select(F.concat(F.lit("a"), F.col("k").cast("string")).alias("id"), F.concat(p(F.col("k")), F.lit("比"), p(F.expr("k div 2")), F.lit("贵")).alias("content"))
    far = part.where("k % 3 = 0 and k > 0").select(F.concat(F.lit("b"), F.col("k").cast("string")).alias("id"), F.concat(p(F.expr("k div 3")), F.lit("比"), p(F.col("k")), F.lit("便宜。")).alias("content"))
    return near.unionByName(far)


_PARTS = """WITH RECURSIVE edges AS (SELECT g, l, min(id) AS id FROM (SELECT p_partkey AS g, p_partkey // 2 AS l, 'a' || p_partkey AS id FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3, 'b' || p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0) WHERE g <> l GROUP BY g, l),
"""


@plain("transitive_premises", _PARTS + """asks AS (SELECT p_partkey AS q, p_partkey // 12 AS goal FROM part WHERE p_partkey % 5 = 0),
ways AS (SELECT q, goal, q AS name, 0 AS hops, CAST([] AS VARCHAR[]) AS way FROM asks UNION ALL
  SELECT w.q, w.goal, e.l, w.hops + 1, list_append(w.way, e.id) FROM ways w JOIN edges e ON e.g = w.name WHERE w.hops < 4),
hit AS (SELECT q, hops, way, row_number() OVER (PARTITION BY q ORDER BY hops, way) AS k FROM ways WHERE name = goal AND hops > 0)
SELECT q AS query_id, hops, array_to_string(way, ',') AS premises FROM hit WHERE k = 1""")
def _transitive_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each fifth part is dearer than the one with a twelfth of its number."""
    part = source.table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("k"))
    asks = part.select(F.col("k").alias("query_id"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("greater"), F.concat(F.lit("p"), F.expr("k div 12").cast("string")).alias("less"), F.lit("贵").alias("scale"))
    found = chains.transitive_premises(asks, chains.comparisons(_compared(spark, sf_dir)))
    return found.select("query_id", "hops", F.array_join("premises", ",").alias("premises"))


# --- anchors: orders as dated records (visits, prices, notices, opening hours) and what customers ask about them

TODAY = 19980101


def _day(at) -> str:
    return F.concat(F.year(at).cast("string"), F.lit("年"), F.month(at).cast("string"), F.lit("月"), F.dayofmonth(at).cast("string"), F.lit("日"))


def _dated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source.table(spark, sf_dir, "orders")
    at, name = F.col("o_orderdate"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("-plan"))
    later = F.date_add(at, 3)
    day = _day(at)
    kind = F.col("o_orderkey") % 4
    content = (
        F.when(kind == 0, F.concat(name, F.lit(" 体检 "), day))
        .when(kind == 1, F.concat(name, F.lit(" 价格 "), F.floor("o_totalprice").cast("string"), F.lit("元 "), day))
        .when(kind == 2, F.concat(F.lit("通知 "), name, F.lit(" 改到"), F.month(later).cast("string"), F.lit("月"), F.dayofmonth(later).cast("string"), F.lit("日，原定"), day))
        .otherwise(F.concat(name, F.lit(" 营业 9:00-18:00 "), day))
    )
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("c"), content.alias("content"), F.array().cast("array<string>").alias("cues"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = source.table(spark, sf_dir, "orders").where("o_custkey % 10 = 0")
    return o.groupBy(F.col("o_custkey").alias("c")).agg(F.max_by("o_orderdate", "o_orderkey").alias("last"), F.slice(F.array_sort(F.collect_set("o_orderkey")), 1, 2).alias("firsts"))


def _anchors(spark: SparkSession, sf_dir: str, kinds: dict[int, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, what was found for them so far, records and their terms."""
    mem = shared.written(_dated_records(spark, sf_dir), "records")
    who = shared.written(_customers(spark, sf_dir), "customers")
    name = F.concat(F.lit("c"), F.col("c").cast("string"), F.lit("-plan"))
    which = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in kinds.items()))
    asks = who.select("c", "last", "firsts", F.explode(which).alias("a"))
    day = F.concat(F.month("last").cast("string"), F.lit("月"), F.dayofmonth("last").cast("string"), F.lit("日"))
    text = F.concat(name, F.when(F.col("a.k") == 4, F.concat(F.lit(" "), day)).otherwise(F.col("a.w")))
    asks = asks.select((F.col("c") * 10 + F.col("a.k")).alias("query_id"), text.alias("query"), "firsts")
    found = asks.select("query_id", F.posexplode("firsts").alias("pos", "o")).select("query_id", F.concat(F.lit("o"), F.col("o").cast("string")).alias("id"), (F.col("pos") + 1).alias("rank"), (0.5 - 0.1 * F.col("pos")).alias("score"))
    items = mem.select("id", F.array_distinct(dated.text.tokenize(F.col("content"), cjk=True)).alias("terms"))
    return asks.select("query_id", "query"), found, mem, shared.written(items, "terms")


_RECORDS = """WITH rec AS MATERIALIZED (SELECT 'o' || o_orderkey AS id, o_custkey AS c, o_orderkey AS k, o_orderkey % 4 AS kind, year(o_orderdate) AS y, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS f,
    year(o_orderdate) * 10000 + month(o_orderdate + INTERVAL 3 DAY) * 100 + day(o_orderdate + INTERVAL 3 DAY) AS b,
    CASE WHEN o_orderkey % 4 = 2 THEN month(o_orderdate + INTERVAL 3 DAY) || '月' || day(o_orderdate + INTERVAL 3 DAY) || '日' ELSE '' END || ' ' || year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS days FROM orders),
who AS (SELECT o_custkey AS c, max_by(month(o_orderdate) || '月' || day(o_orderdate) || '日', o_orderkey) AS frag FROM orders WHERE o_custkey % 10 = 0 GROUP BY o_custkey),
nth AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k) AS n FROM rec WHERE c % 10 = 0),
ask AS (SELECT c, frag, unnest({kinds}) AS a FROM who),
held AS MATERIALIZED (SELECT c * 10 + a AS query_id, a, nth.*, n AS rank, 0.5 - 0.1 * (n - 1) AS score FROM ask JOIN nth USING (c) WHERE n <= 2),
free AS MATERIALIZED (SELECT c * 10 + a AS query_id, a, frag, nth.* FROM ask JOIN nth USING (c))
"""
_TEMPORAL = _RECORDS.replace("{kinds}", "[1, 2, 3, 4]") + f""", cand AS (SELECT query_id, a, id, CASE WHEN a <> 2 THEN f WHEN kind = 2 THEN b ELSE f END AS target, CASE WHEN a <> 2 THEN 0 WHEN kind = 2 AND b <> f THEN 1 ELSE 0 END AS weak FROM free WHERE n > 2 AND a IN (1, 2, 3)
    AND (CASE WHEN a <> 2 THEN kind <> 2 AND f <= {TODAY} WHEN kind = 2 THEN b > {TODAY} ELSE f > {TODAY} END)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a = 1 THEN -target ELSE target END, weak, id) AS o FROM cand) WHERE o = 1),
bad AS (SELECT h.*, b.target, b.id AS best, b.weak, CASE WHEN h.a = 2 THEN NOT (h.f > {TODAY} OR (h.kind = 2 AND h.b > {TODAY})) ELSE h.kind = 2 END AS out FROM held h JOIN best b USING (query_id)),
rest AS (SELECT *, CASE WHEN a <> 2 THEN kind <> 2 AND f <= {TODAY} AND (CASE WHEN a = 1 THEN f >= target ELSE f <= target END) WHEN kind = 2 THEN b > {TODAY} AND b <= target ELSE f > {TODAY} AND f <= target END AS covers
  FROM (SELECT *, bool_and(out) OVER (PARTITION BY query_id) AS none FROM bad) WHERE none OR NOT out),
front AS (SELECT *, min(CASE WHEN covers THEN rank END) OVER (PARTITION BY query_id) AS front FROM rest),
kept AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank <> front, rank) AS rank, id, score, CASE WHEN rank = front THEN 'kept' END AS anchor FROM front WHERE front IS NOT NULL),
joined AS (SELECT query_id, id, score, NULL AS anchor FROM front WHERE front IS NULL UNION ALL SELECT DISTINCT query_id, best, CASE WHEN weak = 0 THEN 0.62 ELSE 0.60 END, CASE a WHEN 1 THEN 'last' WHEN 2 THEN 'next' ELSE 'first' END FROM front WHERE front IS NULL),
tok AS (SELECT DISTINCT id, unnest([regexp_extract(days, '^(\\d+)月', 1), regexp_extract(days, '^\\d+月(\\d+)日', 1)]) AS t FROM rec WHERE kind = 2),
rare AS (SELECT t FROM tok WHERE length(t) = 2 GROUP BY t HAVING count(*) <= 200),
num AS (SELECT c * 10 + 4 AS query_id, frag, unnest([regexp_extract(frag, '^(\\d+)月', 1), regexp_extract(frag, '月(\\d+)日', 1)]) AS t FROM who),
met AS (SELECT query_id, frag, id, days FROM free WHERE a = 4 UNION SELECT query_id, frag, id, days FROM num JOIN rare USING (t) JOIN tok USING (t) JOIN rec USING (id)),
onday AS (SELECT query_id, min(id) AS id FROM met WHERE contains(replace(days, ' ', ''), frag) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.query_id = met.query_id AND h.id = met.id) GROUP BY query_id),
dayed AS (SELECT query_id, id, score, NULL AS anchor FROM held WHERE query_id IN (SELECT query_id FROM onday) UNION ALL SELECT query_id, id, 0.62, 'day' FROM onday),
allr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank, id, score, anchor FROM (SELECT * FROM joined UNION ALL SELECT * FROM dayed) UNION ALL SELECT * FROM kept)
SELECT query_id, rank::INT AS rank, id, round(score::DOUBLE, 6) AS score, anchor FROM allr UNION ALL SELECT query_id, rank::INT, id, round(score::DOUBLE, 6), NULL FROM held WHERE query_id NOT IN (SELECT query_id FROM allr)"""


@plain("temporal_anchor", _TEMPORAL)
def _temporal_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tenth customer: the last visit, the next, the first, and what there was on one day."""
    asks, found, mem, items = _anchors(spark, sf_dir, {1: "上次是哪天", 2: "下次是哪天", 3: "第一次是哪天", 4: ""})
    return dated.temporal_anchor(asks, found, mem, items, TODAY, common=200)  # what all dates share names no record


_VALUE = _RECORDS.replace("{kinds}", "[5, 6]") + """, pick AS (SELECT query_id, id, CASE WHEN a = 5 THEN 0.63 ELSE 0.62 END AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN a = 5 THEN -f ELSE 0 END, id) AS o
  FROM free WHERE (a = 5 AND kind = 1 AND n <> 1) OR (a = 6 AND kind = 3 AND n > 2)),
moved AS (SELECT query_id, id, score, 'value' AS anchor FROM pick WHERE o = 1 UNION ALL SELECT h.query_id, h.id, h.score, NULL FROM held h JOIN pick p ON p.query_id = h.query_id AND p.o = 1 AND p.id <> h.id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC)::INT AS rank, id, round(score::DOUBLE, 6) AS score, anchor FROM moved
UNION ALL SELECT query_id, rank::INT, id, round(score::DOUBLE, 6), NULL FROM held WHERE query_id NOT IN (SELECT query_id FROM moved)"""


@plain("value_anchor", _VALUE)
def _value_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each tenth customer: the price, and the opening hours."""
    asks, found, mem, items = _anchors(spark, sf_dir, {5: "多少钱", 6: "营业几点"})
    return dated.value_anchor(asks, found, mem, items, common=200)


plain("record_quantities", "SELECT 'o' || o_orderkey AS id, floor(o_totalprice)::DOUBLE AS value, '元' AS unit FROM orders WHERE o_orderkey % 4 = 1")(
    lambda s, d: _dated_records(s, d).select("id", F.explode(dated.quantities(F.col("content"))).alias("q")).select("id", "q.value", "q.unit")
)


# --- audits

query("memory_audit", _CONFLICTS + """SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'recycled') AS recycled, count(*) FILTER (status = 'active' AND kind = 'semantic') AS semantic, count(*) FILTER (status = 'active' AND kind = 'episodic') AS episodic,
 count(*) FILTER (status = 'active' AND revision_count > 0) AS revised, count(*) FILTER (status = 'active' AND affect IS NOT NULL) AS emotional, (SELECT count(*) FROM act WHERE r < 0.5) AS due_now, (SELECT round(avg(r), 3) FROM act) AS avg_retrievability, (SELECT round(avg(importance), 6) FROM act) AS avg_importance, (SELECT count(*) FROM conf) AS conflicts FROM mem""")(
    lambda t: audits.memory_audit(t.mem, consolidate.conflicts(t.act), t.now)
)
query("check", _CONFLICTS.replace(", facts", ", " + ASKED.rstrip() + ", facts", 1) + f""", lb AS (SELECT id, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM (SELECT id, {_CAL} AS c FROM act))
SELECT query_id, 'item' AS part, id AS name, label FROM found JOIN lb USING (id) WHERE rank <= 3
UNION ALL SELECT query_id, 'gap', unnest(list_sort(list(DISTINCT term))[1:8]), NULL FROM qt WHERE term NOT IN (SELECT term FROM terms) GROUP BY query_id
UNION ALL SELECT DISTINCT query_id, 'blocked', id, NULL FROM qt JOIN cues ON cue = term WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM found WHERE rank <= 3)
UNION ALL SELECT query_id, 'conflict', NULL, (SELECT count(*) FROM conf)::VARCHAR FROM qs""")(
    lambda t: audits.check(t.asked(), t.found(3), t.act, index.exploded(t.items), index.cue_index(t.act), consolidate.conflicts(t.act), t.now)
)
query("recall_trace", ASKED + """, ct AS (SELECT query_id, count(*) AS terms, count(*) FILTER (brought > 0) AS brought FROM hits GROUP BY query_id), bk AS (SELECT query_id, count(*) AS returned FROM found WHERE rank <= 5 GROUP BY query_id),
 st AS (SELECT query_id, coalesce(terms, 0) AS terms, coalesce(brought, 0) AS brought, coalesce(returned, 0) AS returned FROM qs LEFT JOIN ct USING (query_id) LEFT JOIN bk USING (query_id))
SELECT query_id, 'store' AS stage, (SELECT count(*) FROM act) AS n FROM st UNION ALL SELECT query_id, 'terms', terms FROM st UNION ALL SELECT query_id, 'brought', brought FROM st UNION ALL SELECT query_id, 'scored', least(brought, 100) FROM st UNION ALL SELECT query_id, 'returned', returned FROM st""", MEM + ", ")(
    lambda t: audits.recall_trace(t.asked(), t.act, t.items, t.found(5), 5)
)
query("schema_samples", """, g AS (SELECT *, coalesce(cues[1], '（无标签）') AS tp, row_number() OVER (PARTITION BY coalesce(cues[1], '（无标签）') ORDER BY seq, id) AS k FROM act)
SELECT tp AS topic, count(*) AS n, round(avg(importance), 6) AS avg_importance, count(*) FILTER (kind = 'semantic') AS facts, count(*) FILTER (kind = 'episodic') AS episodes, string_agg(substr(content, 1, 24), '|' ORDER BY k) FILTER (k <= 3) AS samples FROM g GROUP BY tp""")(
    lambda t: audits.schema_samples(t.act).withColumn("samples", F.array_join("samples", "|"))
)
query("life_highlights", """, g AS (SELECT *, date_diff('day', DATE '2023-01-01', created_at::DATE) // 14 AS period FROM act), n AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY importance DESC, seq DESC) AS k FROM g)
SELECT period::INT AS period, strftime(DATE '2023-01-01' + (period * 14)::INT, '%Y-%m-%d') AS start, strftime(DATE '2023-01-01' + (period * 14 + 13)::INT, '%Y-%m-%d') AS stop, count(*) AS events, round(avg(importance), 6) AS avg_importance, string_agg(id, ',' ORDER BY k) FILTER (k <= 3) AS highlights FROM n GROUP BY period""")(
    lambda t: audits.life_highlights(t.act).withColumn("highlights", F.array_join("highlights", ","))
)
query("timeline_items", "SELECT strftime(created_at, '%Y-%m-%d') AS day, id, round(importance, 3) AS importance FROM act WHERE kind = 'episodic' AND created_at >= TIMESTAMP '2023-12-20' AND created_at < TIMESTAMP '2024-01-20' ORDER BY created_at, seq LIMIT 100")(
    lambda t: audits.timeline_items(t.act, source.now("2023-12-20 00:00:00"), source.now("2024-01-20 00:00:00"))
)
query("learner_scale", f"SELECT *, CASE pace WHEN 'fast' THEN 1.2 WHEN 'struggling' THEN 0.8 ELSE 1.0 END::DOUBLE AS scale FROM (SELECT count(*) AS memories, sum({TRIES})::BIGINT AS reviews, round(sum(retrieval_successes) / sum({TRIES}), 3) AS success_rate, round(avg(r), 3) AS avg_retrievability, round(avg(importance), 3) AS avg_importance, CASE WHEN sum({TRIES}) = 0 THEN 'unknown' WHEN sum(retrieval_successes) / sum({TRIES}) >= 0.8 THEN 'fast' WHEN sum(retrieval_successes) / sum({TRIES}) >= 0.6 THEN 'steady' ELSE 'struggling' END AS pace FROM act)")(
    lambda t: audits.learner_scale(t.act, t.now)
)
query("rumination_verdict", """, tp AS (SELECT topic, count(*) AS n, count(*) FILTER (access_count >= 5) AS risky FROM act WHERE affect IN ('negative', 'arousing') GROUP BY topic), one AS (SELECT coalesce(sum(n), 0)::BIGINT AS negative, coalesce(sum(risky), 0)::BIGINT AS risky, coalesce(max(risky), 0) AS most_of_topic FROM tp)
SELECT *, CASE WHEN risky >= 3 OR most_of_topic >= 2 THEN 'high' WHEN risky > 0 THEN 'medium' ELSE 'low' END AS risk FROM one""")(lambda t: audits.rumination_verdict(t.act))
query("sleep_surprises", "SELECT id, round(least(1.0, strength + 0.05), 4) AS strength, retrieval_successes + 1 AS retrieval_successes FROM act WHERE retrieval_failures > retrieval_successes")(
    lambda t: plans.surprises(t.act.select("id", (F.col("retrieval_failures") > F.col("retrieval_successes")).alias("surprise")), t.act)
)

query("context_pack", ASKED + """, sc AS (SELECT query_id // 5 AS pack, f.id, max(f.score) AS score, any_value(seq) AS seq, any_value(length(content)) AS letters FROM found f JOIN act USING (id) WHERE rank <= 3 AND f.overlap > 0 GROUP BY 1, 2),
 od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY score DESC, seq DESC) AS k FROM sc),
 fold AS (SELECT pack, k, id, score, letters::BIGINT AS used, true AS took FROM od WHERE k = 1
  UNION ALL SELECT o.pack, o.k, o.id, o.score, CASE WHEN f.used + o.letters <= 6000 THEN f.used + o.letters ELSE f.used END, f.used + o.letters <= 6000 FROM fold f JOIN od o ON o.pack = f.pack AND o.k = f.k + 1)
SELECT pack, (row_number() OVER (PARTITION BY pack ORDER BY k) - 1)::INT AS place, id, round(score, 6) AS score, used::INT AS used FROM fold WHERE took""", MEM + ", ")(
    lambda t: audits.context_packs(t.found(3).withColumn("pack", F.expr("query_id div 5")), t.act, 6000)
)
query("attention_filter", ASKED + """, st AS MATERIALIZED (SELECT id, strength, importance, seq FROM act WHERE strength >= 0.7 AND importance >= 0.6), hit AS (SELECT query_id, id, rank FROM found WHERE rank <= 5),
 ot AS (SELECT q.query_id, st.*, row_number() OVER (PARTITION BY q.query_id ORDER BY strength DESC, importance DESC, seq DESC) AS place, count(*) OVER (PARTITION BY q.query_id) AS n
  FROM (SELECT DISTINCT query_id FROM hit) q, st WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = q.query_id AND h.id = st.id))
SELECT query_id, 'relevant' AS part, rank AS place, id, count(*) OVER (PARTITION BY query_id) AS "all" FROM hit UNION ALL SELECT query_id, 'suppressed', place, id, n FROM ot WHERE place <= 5""", MEM + ", ")(
    lambda t: audits.attention(t.found(5), t.act)
)
query("retrieval_quality", ASKED + """, one AS (SELECT count(*) AS evaluated, round(count(*) FILTER (overlap > 0) / count(*), 3) AS hit_rate, round((count(*) - count(*) FILTER (overlap > 0)) / count(*), 3) AS weak_rate,
 coalesce(round(avg(score), 3), 0.0)::DOUBLE AS avg_top_score, coalesce(round(avg(retrievability), 3), 0.0)::DOUBLE AS avg_top_retrievability FROM qs LEFT JOIN (SELECT * FROM found WHERE rank = 1) USING (query_id))
SELECT *, CASE WHEN hit_rate >= 0.8 THEN 'good' WHEN hit_rate >= 0.5 THEN 'fair' ELSE 'poor' END AS verdict FROM one""", MEM + ", ")(lambda t: audits.retrieval_quality(t.asked(), t.found(1)))
query("explain_memory", """, dg AS (SELECT src AS id, 2 * count(*) AS d FROM both_ways GROUP BY 1)
SELECT id, kind, array_to_string(cues, ',') AS cues, round(r, 3) AS retrievability, round(importance, 3) AS importance, round(strength, 3) AS strength, round(confidence, 3) AS confidence, evidence_count, coalesce(d, 0)::BIGINT AS linked_count,
 seq % 29 = 0 AS suppressed, access_count, epoch_us(last_access_at) AS last_access_us, review_streak, epoch_us(last_review_at) AS last_review_us FROM act LEFT JOIN dg USING (id)""")(
    lambda t: audits.explained(t.act, t.links(), t.act.where("seq % 29 = 0"), t.now).withColumns({"cues": F.array_join("cues", ","), "last_access_us": F.unix_micros("last_access_at"), "last_review_us": F.unix_micros("last_review_at")}).drop("last_access_at", "last_review_at")
)
query("emotion_advice", """, one AS (SELECT count(*) AS memories, count(*) FILTER (affect = 'positive') AS positive, count(*) FILTER (affect = 'negative') AS negative, count(*) FILTER (affect = 'arousing') AS arousing, count(*) FILTER (affect IS NULL OR affect = 'neutral') AS neutral,
 round(count(*) FILTER (affect = 'negative') / count(*), 3) AS negative_ratio FROM act), tp AS (SELECT cues[1] AS topic, count(*) AS n FROM act WHERE affect = 'negative' AND len(cues) > 0 GROUP BY 1 ORDER BY n DESC, topic LIMIT 3)
SELECT *, (SELECT coalesce(string_agg(topic || ':' || n, ',' ORDER BY n DESC, topic), '') FROM tp) AS topics, CASE WHEN negative_ratio >= 0.4 THEN 'reappraise' WHEN negative_ratio >= 0.2 THEN 'rewrite' ELSE 'keep' END AS advice FROM one""")(lambda t: audits.emotion_advice(t.act))
query("temporal_hints", """SELECT 'o' || o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'latest' WHEN 1 THEN 'next' WHEN 2 THEN 'first' END AS hint FROM orders""", "")(
    lambda t: source.table(t.spark, t.dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), dated.temporal_hint(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "上次是哪天").when(F.col("o_orderkey") % 4 == 1, "下次是哪天").when(F.col("o_orderkey") % 4 == 2, "第一次是哪天").otherwise("多少钱"))).alias("hint"))
)
