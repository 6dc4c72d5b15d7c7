"""The queries of this library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import curve, text
from palimpsest.operators import consolidate, graph, index, planning, practice, recall, reports, review, vector
from palimpsest.plans import general
from palimpsest.plans.oracle import ASKED, ASKED_ALL, AROUSED, DUE_AT, IDLE, INTERVAL, MEM, RATE, TRIES, TS, hours, tokens
from palimpsest.sources import memories as source
from palimpsest.sources import shared
from palimpsest.streaming import access, due

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The memory tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.now = spark, sf_dir, source.now()
        self.mem = source.memories(spark, sf_dir)
        self.act = source.active(self.mem)

    def links(self) -> DataFrame:
        return graph.batch_links(self.act)

    @cached_property
    def linked(self) -> DataFrame:
        return shared.written(self.links(), "links")

    def asked(self) -> DataFrame:
        return source.table(self.spark, self.dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    @cached_property
    def items(self) -> DataFrame:
        return index.stored_terms(self.act)

    @cached_property
    def known(self) -> tuple[DataFrame, DataFrame]:
        """Terms of the benchmark's texts and the candidates they bring, made once for all passes of a query."""
        terms = recall.asked_terms(self.asked(), self.items)
        return terms, shared.written(recall.candidates(self.asked(), self.act, self.items, asked=terms), "candidates")

    def found(self, k: int = 10) -> DataFrame:
        return recall.recall(self.asked(), self.act, self.now, k, self.items, known=self.known)

    def intents(self) -> DataFrame:
        orders = source.table(self.spark, self.dir, "orders")
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderkey") % 50 == 0, "cancelled").otherwise("active")
        return orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("due_at"), F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey").cast("string")).alias("context_cue"), status.alias("status"))


def query(name: str, sql: str | None = None, prefix: str = MEM):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = prefix + sql
        return f

    return add


def plain(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- tables and indexes

query("mem_view", "SELECT id, seq, kind, origin, round(trust, 6) AS trust, access_count, round(importance, 6) AS importance, round(strength, 6) AS strength, round(storage_strength, 6) AS storage_strength, round(confidence, 6) AS confidence, evidence_count, status, affect, epoch_us(created_at) AS created_us, epoch_us(last_access_at) AS accessed_us, epoch_us(last_review_at) AS reviewed_us, array_to_string(cues, ',') AS cues FROM mem")(
    lambda t: t.mem.select("id", "seq", "kind", "origin", F.round("trust", 6).alias("trust"), "access_count", F.round("importance", 6).alias("importance"), F.round("strength", 6).alias("strength"), F.round("storage_strength", 6).alias("storage_strength"), F.round("confidence", 6).alias("confidence"), "evidence_count", "status", "affect", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_access_at").alias("accessed_us"), F.unix_micros("last_review_at").alias("reviewed_us"), F.array_join("cues", ",").alias("cues"))
)
query("content_hash", "SELECT id, content_hash FROM mem")(lambda t: t.mem.select("id", "content_hash"))
query("terms_index", "SELECT id, term FROM terms")(lambda t: index.term_index(t.act).select("id", "term"))
query("cues_index", "SELECT id, cue, pos FROM cues")(lambda t: index.cue_index(t.act).select("id", "cue", F.col("pos").cast("long")))
query("term_df", "SELECT term, count(*) AS df FROM terms GROUP BY term")(lambda t: index.term_df(t.act))
query("term_idf", "SELECT term, count(*) AS df, round(least(greatest(0.0, ln(((SELECT count(*) FROM act) - count(*) + 0.5) / (count(*) + 0.5))), 4.0), 6) AS idf FROM terms GROUP BY term")(lambda t: index.term_idf(t.act))
query("stats_overview", "SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND kind = 'episodic') AS episodic, count(*) FILTER (status = 'active' AND kind = 'semantic') AS semantic, round(avg(importance) FILTER (status = 'active'), 6) AS avg_importance, round(avg(strength) FILTER (status = 'active'), 6) AS avg_strength, (SELECT count(DISTINCT c) FROM (SELECT unnest(cues) AS c FROM mem)) AS cues FROM mem")(lambda t: index.stats(t.mem))
query("semantic_upsert", """SELECT kind, content_hash, min_by(id, seq) AS id, min(seq) AS seq, round(max(importance), 6) AS importance, round(max(confidence), 6) AS confidence, sum(access_count)::BIGINT AS access_count, max(evidence_count) AS evidence_count,
 max_by(origin, (trust, -seq)) AS origin, array_to_string(list_filter(flatten(list(cues ORDER BY seq)), lambda x, i: list_position(flatten(list(cues ORDER BY seq)), x) = i), ',') AS cues FROM mem GROUP BY kind, content_hash""")(
    lambda t: index.merge_rows(t.mem).select("kind", "content_hash", "id", "seq", F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"), "access_count", "evidence_count", "origin", F.array_join("cues", ",").alias("cues"))
)
query("strongest", "SELECT id, importance FROM act ORDER BY importance DESC, seq DESC LIMIT 50")(lambda t: index.strongest(t.mem, 50).select("id", "importance"))
query("newest", "SELECT id, seq FROM act ORDER BY seq DESC LIMIT 50")(lambda t: index.scan(t.mem, limit=50).select("id", "seq"))
query("trash", "SELECT id FROM mem WHERE status = 'recycled' ORDER BY seq DESC LIMIT 50")(lambda t: index.scan(t.mem, status="recycled", limit=50).select("id"))
query("export_active", "SELECT id, kind, content, importance FROM act")(lambda t: t.act.select("id", "kind", "content", "importance"))
query("find_by_cue", "SELECT id FROM act WHERE list_contains(cues, 'src3')")(lambda t: index.find_by_cue(t.act, " SRC3").select("id"))
query("importance_rule", "SELECT id, round(least(greatest(0.4 + CASE WHEN regexp_matches(lower(content), 'important|remember|critical|essential|always|never|priority|must') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(lower(content), 'love|hate|afraid|happy|sad|anxious|angry') THEN 0.15 ELSE 0 END + 0.1 * trust + 0.1 * least(access_count / 5.0, 1.0), 0), 1), 6) AS importance FROM act")(
    lambda t: t.act.select("id", F.round(text.importance(F.col("content"), F.col("trust"), F.col("access_count")), 6).alias("importance"))
)
query("revised", "SELECT id, content_hash AS old_hash, revision_count + 1 AS revision_count, round((confidence + 0.4) / 2, 6) AS confidence, round(greatest(0.3, 0.8 * strength), 6) AS strength FROM act WHERE kind = 'semantic'")(
    lambda t: index.update_content(t.act, t.act.where("kind = 'semantic'").select("id", F.concat("content", F.lit(" .")).alias("content")), t.now).where("updated_at is not null").join(t.act.select("id", F.col("content_hash").alias("old_hash")), "id").select("id", "old_hash", "revision_count", F.round("confidence", 6).alias("confidence"), F.round("strength", 6).alias("strength"))
)
plain("turn_segments", """WITH p AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(text, '[。！？!?；;\\n]+'), lambda x: trim(x)), lambda x: x <> '')[1:4] AS parts FROM conversations)
SELECT conv_id, turn, role, (generate_subscripts(parts, 1) - 1)::INT AS part, unnest(parts) AS content, CASE WHEN length(unnest(parts)) <= 60 THEN 'semantic' ELSE 'episodic' END AS kind FROM p""")(
    lambda spark, d: index.turn_segments(source.table(spark, d, "conversations"))
)

# --- forgetting and review

query("retrievability", "SELECT id, round(r, 6) AS retrievability FROM act")(lambda t: review.with_r(t.act, t.now).select("id", F.round("r", 6).alias("retrievability")))
query("effective_decay", f"SELECT id, {RATE} AS rate FROM act")(lambda t: t.act.select("id", curve.decay_rate().alias("rate")))
query("due_items", "SELECT id, importance, round(r, 6) AS retrievability, round(abs(r - 0.45), 6) AS difficulty FROM act WHERE r < 0.5")(lambda t: review.due_rows(t.act, t.now))
query("review_due", "SELECT id, importance, round(r, 6) AS retrievability FROM act WHERE r < 0.5 ORDER BY importance DESC, round(r, 9), seq DESC LIMIT 20")(lambda t: review.due(t.act, t.now))
query("due_difficulty", "SELECT id, importance, round(r, 6) AS retrievability FROM act WHERE r < 0.5 ORDER BY round(abs(r - 0.45), 9), seq DESC LIMIT 20")(lambda t: review.due(t.act, t.now, "difficulty"))
query("next_review_at", f"SELECT id, review_streak, round({INTERVAL}, 6) AS interval_hours, epoch({DUE_AT})::BIGINT AS next_review_s, {DUE_AT} < {TS} AS overdue FROM act")(lambda t: review.next_reviews(t.act, t.now))
query("next_interval", f"SELECT id, round(r, 6) AS retrievability, round(24.0 * least(4.0, pow(1.5, least(review_streak, 12))) * CASE WHEN {TRIES} >= 3 THEN CASE WHEN retrieval_successes / {TRIES} >= 0.8 THEN 1.2 WHEN retrieval_successes / {TRIES} < 0.5 THEN 0.5 ELSE 1.0 END ELSE 1.0 END * CASE WHEN importance >= 0.7 THEN 0.8 ELSE 1.0 END * CASE WHEN r >= 0.7 THEN 1.3 WHEN r < 0.3 THEN 0.6 ELSE 1.0 END, 6) AS next_interval_hours FROM act")(lambda t: review.next_intervals(t.act, t.now))
query("curve_fit", f"""SELECT id, attempts, round(ok, 6) AS success_rate, round(rate, 8) AS rate_per_hour, round(least(30.0, CASE WHEN r > 0.4 THEN ln(r / 0.4) / rate / 24.0 ELSE 0 END), 6) AS days_to_threshold
 FROM (SELECT *, {RATE} / coalesce(least(2.0, 0.5 + ok), 1.0) AS rate FROM (SELECT *, {TRIES} AS attempts, CASE WHEN {TRIES} > 0 THEN retrieval_successes / {TRIES} END AS ok FROM act))""")(lambda t: review.curve_fit(t.act, t.now))
query("calibrate_decay", f"SELECT count(*) AS n, round(CASE WHEN count(*) >= 5 THEN least(greatest(ln(2.0) / median(span), 0.0005), 0.02) ELSE 0.002 END, 8) AS rate FROM (SELECT {hours('created_at', 'last_access_at')} AS span FROM act WHERE access_count > 0) WHERE span >= 1")(lambda t: review.calibrate(t.act, t.now))
query("affect_decay", f"SELECT id, affect, charge, round(charge * 30.0, 6) AS persistence_days, CASE WHEN charge = 0 THEN 'processed' WHEN charge <= 0.5 THEN 'fading' ELSE 'persistent' END AS state FROM (SELECT *, round(greatest(0.0, 1.0 - review_streak / 3.0), 6) AS charge FROM act WHERE affect IN {AROUSED})")(lambda t: review.affect_decay(t.act))
query("spacing_plan", "SELECT id, topic, day, row_number() OVER (PARTITION BY day, topic ORDER BY importance DESC, seq DESC) AS turn FROM (SELECT *, least(6, round_even(least(1.0, r) * 6, 0)::INT) AS day FROM act)")(lambda t: review.spacing_plan(t.act, t.now))
query("review_load", f"SELECT count(*) FILTER (r < 0.5) AS due_now, count(*) FILTER (due < {TS}) AS overdue, count(*) FILTER (due <= {TS} + to_days(7)) - count(*) FILTER (due < {TS}) AS due_within_days, count(*) FILTER (r < 0.3) AS weak, count(*) FILTER (due <= {TS} + to_days(7)) + count(*) FILTER (due < {TS}) AS load_index FROM (SELECT *, {DUE_AT} AS due FROM act)")(lambda t: review.load(t.act, t.now))
query("review_consistency", f"SELECT count(*) AS reviewed, count(*) FILTER (late <= 0) AS on_time, count(*) - count(*) FILTER (late <= 0) AS overdue, round(count(*) FILTER (late <= 0) / nullif(count(*), 0), 6) AS adherence, round(avg(late) FILTER (late > 0), 6) AS avg_days_late FROM (SELECT {hours(DUE_AT, TS)} / 24.0 AS late FROM act WHERE last_review_at IS NOT NULL)")(lambda t: review.consistency(t.act, t.now))
query("forgetting_curve_points", f"SELECT id, day::INT AS day, round(strength * storage_strength * exp(-{RATE} * ({IDLE} + day * 24)), 6) AS retrievability FROM act, unnest([0, 10, 20, 30]) AS u(day)")(lambda t: review.curve_points(t.act, t.now))
query("cramming_plan", f"SELECT id, need, ntile(3) OVER (ORDER BY need DESC, seq DESC)::INT AS session FROM (SELECT id, seq, round(importance * (1 - least(1.0, strength * storage_strength * exp(-{RATE} * ({IDLE} + 72)))), 6) AS need FROM act ORDER BY need DESC, seq DESC LIMIT 12)")(lambda t: review.cramming(t.act, t.now))
query("working_set", "SELECT id, epoch_us(last_access_at) AS accessed_us FROM act WHERE last_access_at IS NOT NULL ORDER BY last_access_at DESC, seq DESC LIMIT 7")(lambda t: review.working_set(t.act))
_GROW = f"0.1 * (1 + 0.45 * least(1.0, {IDLE} / 168)) * (1 + 0.5 * least(greatest(1 - least(1.0, r), 0), 1))"
_OWN = "(confidence * (0.45 + 0.55 * least(1.0, r)) * (0.8 + 0.2 * least(access_count, 3) / 3) * (0.95 + 0.05 * least(evidence_count, 5) / 5))"
_CAL = f"(CASE WHEN {TRIES} >= 2 THEN (1 - 0.5 * least(1.0, {TRIES} / 5.0)) * {_OWN} + 0.5 * least(1.0, {TRIES} / 5.0) * (retrieval_successes + 1) / ({TRIES} + 2) ELSE {_OWN} END)"
query("review_outcomes", f"SELECT id, round(CASE WHEN ok THEN least(1.0, strength + g) ELSE greatest(0.3, strength - 0.05) END, 6) AS strength, round(CASE WHEN ok THEN least(2.0, storage_strength + 0.3 * g) ELSE storage_strength END, 6) AS storage_strength, CASE WHEN ok THEN review_streak + 1 - CASE WHEN c >= 0.7 THEN 0.0 ELSE 0.5 END ELSE 0.0 END AS review_streak, retrieval_successes + ok::INT AS retrieval_successes, retrieval_failures + (NOT ok)::INT AS retrieval_failures FROM (SELECT *, seq % 3 <> 0 AS ok, {_GROW} AS g, {_CAL} AS c FROM act)")(
    lambda t: review.reviewed(t.act, t.act.select("id", (F.col("seq") % 3 != 0).alias("success")), t.now)
)

_PRACTICE = f"0.12 * CASE WHEN gen THEN 1.15 ELSE 1 END * (1 + 0.45 * least(1.0, {IDLE} / 168)) * (1 + 0.5 * least(greatest(1 - least(1.0, r), 0), 1))"
query("practice_answer", f"""SELECT id, ok AS success, gen AS generated, round(least(1.0, strength + CASE WHEN ok THEN {_PRACTICE} ELSE 0.05 END), 6) AS strength, CASE WHEN ok THEN review_streak + 1 ELSE 0.0 END AS review_streak
 FROM (SELECT *, ok AND a <> c AS gen FROM (SELECT *, length(a) > 0 AND (contains(c, a) OR contains(a, c) OR (length(a) >= 2 AND sh >= 2 AND sh / greatest(len(la), 1) >= 0.6)) AS ok
  FROM (SELECT *, len(list_intersect(la, list_distinct(string_split(c, '')))) AS sh FROM (SELECT *, list_distinct(string_split(a, '')) AS la
   FROM (SELECT *, regexp_replace(content, '\\s+', '', 'g') AS c, regexp_replace(CASE seq % 3 WHEN 0 THEN 'zq 90 $' WHEN 1 THEN content ELSE substr(content, 5, 40) END, '\\s+', '', 'g') AS a FROM act)))))""")(
    lambda t: practice.answered(t.act, t.act.select("id", F.when(F.col("seq") % 3 == 0, "zq 90 $").when(F.col("seq") % 3 == 1, F.col("content")).otherwise(F.substring("content", 5, 40)).alias("attempt")), t.now)
)
query("test_generator", "SELECT id, CASE WHEN k % 2 = 1 THEN 'cue' ELSE 'cloze' END AS kind, CASE WHEN k % 2 = 1 THEN cues[1] ELSE substr(content, 1, length(content) - floor(length(content) / 3)::INT) || '____' END AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY importance DESC, seq DESC) AS k FROM act)")(lambda t: practice.tests(t.act))

# --- recall

query("candidates_idf", ASKED_ALL + "SELECT query_id, id, hits, round(idf_hits, 6) AS idf_hits, k AS rank FROM best", MEM + ", ")(lambda t: recall.candidates(t.asked(), t.act, t.items, None, common=None).select("query_id", "id", "hits", F.round("idf_hits", 6).alias("idf_hits"), "rank"))
query("recall_keyword", ASKED + "SELECT * FROM found WHERE rank <= 5", MEM + ", ")(lambda t: t.found(5))
query("recall_batch", ASKED + "SELECT query_id, count(*) AS n, round(max(score), 6) AS best, count(*) FILTER (confident) AS confident FROM found GROUP BY query_id", MEM + ", ")(lambda t: t.found().groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.count_if("confident").alias("confident")))
query("recall_fallback", "SELECT id, seq, score FROM (SELECT id, seq, round(0.25 * least(1.0, r) + 0.40 * importance + 0.06 * trust + 0.05 * confidence + CASE WHEN affect IN " + AROUSED + " THEN 0.05 ELSE 0 END + CASE WHEN evidence_count >= 3 THEN 0.03 ELSE 0 END + CASE WHEN evidence_count > 1 THEN least(0.08, 0.02 * (evidence_count - 1)) ELSE 0 END, 6) AS score FROM act WHERE id IN (SELECT id FROM act ORDER BY seq DESC LIMIT 150) OR id IN (SELECT id FROM act ORDER BY importance DESC, seq DESC LIMIT 50)) ORDER BY score DESC, seq DESC LIMIT 5")(lambda t: recall.fallback(t.act, t.now))
query("rrf_fusion", ASKED + """SELECT query_id, id, round(sum(part), 9) AS fused FROM (
  SELECT query_id, id, 1.0 / (60 + rank) AS part FROM found UNION ALL
  SELECT query_id, id, 1.6 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY idf_hits_r DESC, id)) FROM (SELECT query_id, id, round(idf_hits, 9) AS idf_hits_r FROM best WHERE k <= 24)) GROUP BY ALL""", MEM + ", ")(
    lambda t: recall.fused({"score": (t.found(), 1.0), "idf": (t.known[1], 1.6)})
)
query("confident_flag", ASKED + "SELECT query_id, confident FROM found WHERE rank = 1", MEM + ", ")(lambda t: t.found(1).select("query_id", "confident"))
query("conflict_flag", ASKED + "SELECT DISTINCT query_id, f.id FROM found f JOIN act a ON f.id = a.id JOIN cues c ON c.cue = a.cues[1] JOIN act b ON b.id = c.id WHERE rank = 1 AND b.evidence_count >= 3 * greatest(1, a.evidence_count) AND b.trust >= a.trust", MEM + ", ")(lambda t: recall.conflict_flags(t.found(1), t.act))
query("spread_activation", ASKED + """SELECT query_id, id, round(max(score * 0.95 * pow(0.985, k)), 9) AS boost FROM (
  SELECT f.query_id, b.id, f.score, row_number() OVER (PARTITION BY f.query_id, f.id ORDER BY abs(b.seq - a.seq), b.seq DESC) - 1 AS k FROM found f JOIN act a ON a.id = f.id JOIN both_ways l ON l.src = f.id JOIN act b ON b.id = l.dst WHERE f.rank <= 5)
 WHERE k < 50 GROUP BY ALL""", MEM + ", ")(lambda t: recall.spread(t.found(), t.links(), t.act))
query("pattern_separation", ASKED + """, side AS (SELECT f.*, a.cues, a.content_hash, a.evidence_count FROM found f JOIN act a USING (id)),
riv AS (SELECT s.*, t.evidence_count AS te FROM side s JOIN side t ON s.query_id = t.query_id AND t.rank = 1 WHERE s.rank > 1 AND s.content_hash <> t.content_hash AND len(list_intersect(s.cues, t.cues)) >= 2 AND len(list_intersect(s.cues, t.cues)) / len(list_distinct(list_concat(s.cues, t.cues))) >= 0.35)
SELECT query_id, id, score, round(CASE WHEN evidence_count = m THEN score + 0.04 WHEN evidence_count * 2 <= m THEN greatest(0.05, 0.3 * score) ELSE score - 0.08 END, 6) AS separated FROM (SELECT *, greatest(te, max(evidence_count) OVER (PARTITION BY query_id)) AS m FROM riv)""", MEM + ", ")(lambda t: recall.separation(t.found(), t.act))
query("pattern_completion", ASKED + """, roots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS kk FROM found WHERE overlap >= 0.25 AND overlap < 0.95) WHERE kk <= 4)
SELECT query_id, id, round(max(score * 0.9 * least(1.0, conf)), 6) AS boost FROM (SELECT f.query_id, b.id, f.score, a.confidence AS conf, a.cues AS ca, b.cues AS cb, row_number() OVER (PARTITION BY f.query_id, f.id ORDER BY abs(b.seq - a.seq), b.seq DESC) AS k FROM roots f JOIN act a ON a.id = f.id JOIN both_ways l ON l.src = f.id AND l.weight >= 0.8 JOIN act b ON b.id = l.dst) WHERE k <= 8 AND len(list_intersect(ca, cb)) >= 2 GROUP BY ALL""", MEM + ", ")(lambda t: recall.completion(t.found(), t.links(), t.act))
query("knowledge_gaps", ASKED + "SELECT query_id, array_to_string(list_sort(list(DISTINCT term))[1:8], ',') AS gaps FROM qt WHERE term NOT IN (SELECT term FROM terms) GROUP BY query_id", MEM + ", ")(lambda t: recall.gaps(t.asked(), index.term_index(t.act)).select("query_id", F.array_join("gaps", ",").alias("gaps")))
query("blocked_retrievals", ASKED + "SELECT DISTINCT query_id, id FROM qt JOIN cues ON cue = term WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM found)", MEM + ", ")(lambda t: recall.blocked(t.asked(), t.found(), index.cue_index(t.act)))
query("reinforce_effects", ASKED + """SELECT id, round(least(1.0, strength + g), 6) AS strength, round(least(2.0, storage_strength + 0.3 * g), 6) AS storage_strength, access_count + 1 AS access_count, retrieval_successes + 1 AS retrieval_successes
 FROM (SELECT act.*, (0.05 + 0.15 * o) * (1 + 0.5 * least(greatest(1 - least(1.0, rr), 0), 1)) AS g FROM act JOIN (SELECT id, max(overlap) AS o, max(retrievability) AS rr FROM found WHERE rank <= 5 GROUP BY id) USING (id))""", MEM + ", ")(lambda t: recall.effects(t.found(5), t.act))

# --- consolidation

query("replay_recent", f"SELECT id, round(least(1.0, strength + g), 6) AS strength, round(least(2.0, storage_strength + g), 6) AS storage_strength FROM (SELECT *, 0.02 * (1 - 0.5 * age / 7.0) * (0.5 + importance) AS g FROM (SELECT *, {hours('created_at', TS)} / 24.0 AS age FROM act WHERE kind = 'episodic' ORDER BY seq DESC LIMIT 64) WHERE age <= 7 AND importance >= 0.4)")(lambda t: consolidate.replay_recent(t.act, t.now))
query("merge_duplicates", "SELECT id, n, greatest(own, e) AS evidence_count, importance, round(least(1.0, c + 0.05 * (n - 1)), 6) AS confidence FROM (SELECT min_by(id, (seq, id)) AS id, count(*) AS n, min_by(evidence_count, (seq, id)) AS own, sum(evidence_count)::BIGINT AS e, max(importance) AS importance, min_by(confidence, (seq, id)) AS c FROM act WHERE kind = 'episodic' GROUP BY content_hash HAVING count(*) > 1)")(lambda t: consolidate.merge_duplicates(t.act))
query("promote", f"""SELECT a.id, s.content_hash IS NOT NULL AS known, len(cues)::INT AS n_cues, round(least(1.0, 0.6 + 0.08 * evidence_count + CASE WHEN felt THEN 0.05 ELSE 0 END), 6) AS confidence
 FROM (SELECT *, coalesce(affect IN {AROUSED}, false) AS felt, {hours('created_at', TS)} AS age FROM act WHERE kind = 'episodic') a LEFT JOIN (SELECT DISTINCT content_hash FROM act WHERE kind = 'semantic') s USING (content_hash)
 WHERE access_count >= CASE WHEN felt THEN 1 ELSE 2 END AND age >= CASE WHEN felt THEN 12 ELSE 24 END AND (importance >= 0.6 OR access_count >= 3)""")(lambda t: consolidate.promote(t.act, t.now))
query("prune_preview", f"SELECT id, importance FROM act WHERE importance < 0.2 AND access_count = 0 AND {hours('created_at', TS)} >= 720")(lambda t: consolidate.prunable(t.act, t.now))
query("weak_replay", "SELECT id, round(least(1.0, strength + g), 6) AS strength, round(least(2.0, storage_strength + g), 6) AS storage_strength FROM (SELECT *, 0.03 * (0.5 + importance) AS g FROM act WHERE kind = 'semantic' AND importance >= 0.6 AND r < 0.35 ORDER BY importance DESC, seq DESC LIMIT 100)")(lambda t: consolidate.weak_replay(t.act, t.now))
_CONFLICTS = f""", facts AS MATERIALIZED (SELECT *, list_distinct(w) AS words FROM act WHERE kind = 'semantic' AND confidence >= 0.6),
fc AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue ORDER BY confidence DESC, importance DESC, seq DESC) AS k FROM (SELECT id, seq, content_hash, confidence, importance, words, unnest(cues) AS cue FROM facts)) WHERE k <= 120),
prs AS MATERIALIZED (SELECT cue, id_a, id_b FROM (SELECT a.cue, a.id AS id_a, b.id AS id_b, row_number() OVER (PARTITION BY a.cue ORDER BY a.k, b.k) AS p FROM fc a JOIN fc b ON a.cue = b.cue AND a.k < b.k AND a.content_hash <> b.content_hash WHERE len(list_filter(list_intersect(a.words, b.words), lambda x: NOT list_contains({tokens('a.cue')}, x))) > 0) WHERE p <= 1000),
conf AS MATERIALIZED (SELECT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b, min(cue) AS cue FROM prs GROUP BY 1, 2)
"""
query("detect_conflicts", _CONFLICTS + "SELECT id_a, id_b, cue FROM conf")(lambda t: consolidate.conflicts(t.act))
_PREF = f"round(2 * evidence_count + confidence + importance + 0.2 * least(access_count, 5) + trust + 1 / (1 + {hours('created_at', TS)} / 168), 6)"
query("conflict_advice", _CONFLICTS + f"SELECT id_a, id_b, a.s AS score_a, b.s AS score_b, CASE WHEN abs(a.s - b.s) < 0.08 THEN 'clarify' WHEN a.s > b.s THEN id_a ELSE id_b END AS prefer FROM conf JOIN (SELECT id AS id_a, {_PREF} AS s FROM act) a USING (id_a) JOIN (SELECT id AS id_b, {_PREF} AS s FROM act) b USING (id_b)")(lambda t: consolidate.advice(t.act, consolidate.conflicts(t.act), t.now))
query("rem_links", "SELECT src, dst, round(0.8 + 0.1 * n, 6) AS weight FROM (SELECT a.id AS src, b.id AS dst, count(*) AS n FROM cues a JOIN cues b ON a.cue = b.cue AND a.id < b.id JOIN act x ON x.id = a.id AND x.kind = 'episodic' JOIN act y ON y.id = b.id AND y.kind = 'episodic' GROUP BY 1, 2 HAVING count(*) >= 2)")(lambda t: graph.rem_links(t.act))
query("emotion_growth", f"SELECT id, round(least(1.0, confidence + 0.03 * (evidence_count - 1)), 6) AS confidence, round(least(2.0, storage_strength + 0.05 * (evidence_count - 1)), 6) AS storage_strength, round(least(1.0, strength + 0.03), 6) AS strength FROM act WHERE affect IN {AROUSED} AND evidence_count >= 2")(lambda t: consolidate.emotion_growth(t.act))
query("emotion_links", f", fe AS (SELECT id, content_hash, unnest(cues) AS cue FROM act WHERE affect IN {AROUSED}) SELECT DISTINCT a.id AS src, b.id AS dst, 1.2::DOUBLE AS weight FROM fe a JOIN fe b ON a.cue = b.cue AND a.id < b.id AND a.content_hash <> b.content_hash WHERE a.cue IN (SELECT cue FROM fe GROUP BY cue HAVING count(*) <= 500)")(lambda t: consolidate.emotion_links(t.act))
query("accommodate", "SELECT DISTINCT a.id FROM (SELECT id, evidence_count, trust, unnest(cues) AS cue FROM act WHERE kind = 'semantic' AND confidence >= 0.5) a JOIN (SELECT evidence_count, trust, unnest(cues) AS cue FROM act WHERE kind = 'semantic' AND confidence >= 0.5) b USING (cue) WHERE b.evidence_count >= 3 * a.evidence_count AND b.trust >= a.trust")(lambda t: consolidate.accommodated(t.act))
query("sleep_report")(lambda t: consolidate.sleep_report(t.act, t.now))

# --- graph

query("link_batch", "SELECT src, dst, weight FROM links")(lambda t: t.links())
query("assoc_degree", "SELECT src AS id, count(*) AS degree, round(sum(weight), 6) AS weight FROM both_ways GROUP BY src")(lambda t: graph.degrees(t.links()))
query("communities", """, lab AS (SELECT src AS node, src AS label FROM both_ways UNION SELECT b.src, l.label FROM lab l JOIN both_ways b ON b.dst = l.node WHERE l.label < b.src)
SELECT node AS id, min(label) AS community FROM lab GROUP BY node""")(lambda t: _checkpointed(t, graph.communities))
query("multi_hop", ", hop1 AS (SELECT DISTINCT dst FROM both_ways WHERE src = 'd1' AND dst <> 'd1'), hop2 AS (SELECT DISTINCT b.dst FROM hop1 h JOIN both_ways b ON b.src = h.dst WHERE b.dst <> 'd1' AND b.dst NOT IN (SELECT dst FROM hop1)) SELECT 'd1' AS id, 0 AS hop UNION ALL SELECT dst, 1 FROM hop1 UNION ALL SELECT dst, 2 FROM hop2")(lambda t: graph.ring(t.links(), ["d1"], 2))
query("bridge_suggestions", """, nw AS MATERIALIZED (SELECT id, seq FROM act ORDER BY seq DESC LIMIT 60), nc AS (SELECT nw.id, nw.seq, cue FROM nw JOIN cues USING (id)),
 pr AS (SELECT least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst, a.seq AS sa, b.seq AS sb, min(a.cue) AS cue, count(*) AS shared FROM nc a JOIN nc b ON a.cue = b.cue AND a.seq > b.seq GROUP BY ALL)
SELECT src, dst, cue, shared FROM pr WHERE (src, dst) NOT IN (SELECT (src, dst) FROM links) ORDER BY sa DESC, sb DESC LIMIT 20""")(lambda t: graph.bridges(t.act, t.links()))
query("unlinked_pairs", "SELECT a.id AS src, b.id AS dst, min(a.cue) AS cue FROM cues a JOIN cues b ON a.cue = b.cue AND a.id < b.id WHERE a.cue IN (SELECT cue FROM rare) AND (a.id, b.id) NOT IN (SELECT (src, dst) FROM links) GROUP BY 1, 2")(lambda t: graph.unlinked_pairs(t.act))
query("kg_export", "SELECT src, dst, weight FROM links")(lambda t: graph.kg_edges(t.act, t.links()))
query("topic_successors", "SELECT id, lead(id) OVER (PARTITION BY topic ORDER BY created_at, seq) AS next_id FROM act")(lambda t: graph.successors(t.act))

# --- reports

query("memory_map", "SELECT topic, count(*) AS n, round(avg(r), 6) AS avg_r, round(avg(importance), 6) AS avg_importance, CASE WHEN avg(r) < 0.3 THEN 'weak' WHEN avg(r) < 0.7 THEN 'ok' ELSE 'strong' END AS state FROM act GROUP BY topic")(lambda t: reports.memory_map(t.act, t.now))
query("schema_report", "SELECT topic, count(*) AS n, count(*) FILTER (kind = 'semantic') AS facts, count(*) FILTER (kind = 'episodic') AS episodes, max_by(id, seq) AS newest FROM act GROUP BY topic")(lambda t: reports.schema_report(t.act))
query("coverage", "SELECT topic, count(*) AS n, count(last_review_at) AS reviewed, round(count(last_review_at) / count(*), 6) AS share, CASE WHEN count(last_review_at) = 0 THEN 'unreviewed' WHEN count(last_review_at) / count(*) < 0.5 THEN 'partial' ELSE 'good' END AS state FROM act GROUP BY topic")(lambda t: reports.coverage(t.act))
query("mastery_map", f"SELECT topic, n, round(acc, 6) AS accuracy, round(0.5 * acc + 0.3 * rr + 0.2 * least(1.0, n / 3), 6) AS mastery FROM (SELECT topic, count(*) AS n, avg(least(1.0, r)) AS rr, CASE WHEN sum({TRIES}) >= 3 THEN sum(retrieval_successes) / sum({TRIES}) ELSE avg(confidence) END AS acc FROM act GROUP BY topic)")(lambda t: reports.mastery(t.act, t.now))
query("metacog", f"SELECT topic, n::BIGINT AS attempts, round(c, 6) AS confidence, round(a, 6) AS accuracy, round(c - a, 6) AS gap, CASE WHEN c - a >= 0.15 THEN 'over' WHEN c - a <= -0.15 THEN 'under' ELSE 'fair' END AS state FROM (SELECT topic, sum({TRIES}) AS n, sum(confidence * {TRIES}) / sum({TRIES}) AS c, sum(retrieval_successes) / sum({TRIES}) AS a FROM act WHERE {TRIES} > 0 GROUP BY topic)")(lambda t: reports.metacog(t.act))
query("source_calibration", "SELECT origin, count(*) AS n, round(avg(trust), 6) AS avg_trust, round(avg(0.4 * confidence + 0.3 * least(1.0, evidence_count / 3) + 0.2 * importance + 0.1 * trust), 6) AS score FROM act GROUP BY origin")(lambda t: reports.source_calibration(t.act))
query("forgetting_risk", "SELECT id, round(importance * (1 - least(1.0, r)), 6) AS risk FROM act")(lambda t: reports.risks(t.act, t.now))
query("forgetting_balance", "SELECT topic, n, most, least, round(most / uses, 6) AS top_share FROM (SELECT topic, count(*) AS n, max(access_count) AS most, min(access_count) AS least, sum(access_count) AS uses FROM act GROUP BY topic) WHERE most >= 3 * greatest(1, least) AND most >= 3")(lambda t: reports.balance(t.act))
_STORY = ", story AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, topic) AS rank FROM (SELECT floor((created_at::DATE - DATE '2023-01-01') / 14)::INT AS period, topic, count(*) AS n FROM act GROUP BY ALL)) "
query("life_story", _STORY + "SELECT period, strftime(DATE '2023-01-01' + period * 14, '%Y-%m-%d') AS start, topic, n, rank::INT AS rank FROM story WHERE rank <= 5")(lambda t: reports.life_story(t.act))
query("topic_drift", _STORY + ", top AS (SELECT * FROM story WHERE rank <= 5), nw AS (SELECT topic, n FROM top WHERE period = (SELECT max(period) FROM top)), od AS (SELECT topic, n FROM top WHERE period = (SELECT max(period) FROM top) - 1) SELECT topic, coalesce(od.n, 0) AS before, coalesce(nw.n, 0) AS now, CASE WHEN od.n IS NULL THEN 'new' WHEN nw.n IS NULL THEN 'gone' WHEN nw.n > od.n THEN 'grew' WHEN nw.n < od.n THEN 'shrank' ELSE 'same' END AS change FROM nw FULL JOIN od USING (topic)")(lambda t: reports.drift(t.act))
query("timeline", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, min_by(id, seq) AS first_id FROM act WHERE kind = 'episodic' GROUP BY 1")(lambda t: reports.timeline(t.act))
query("similarity_pairs", """, ws AS MATERIALIZED (SELECT id, list_distinct(w) AS w FROM act), wt AS MATERIALIZED (SELECT id, unnest(w) AS t FROM ws),
pp AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM wt a JOIN wt b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, similarity FROM (SELECT a, b, round(common / least(len(x.w), len(y.w)), 6) AS similarity FROM pp JOIN ws x ON x.id = a JOIN ws y ON y.id = b) WHERE similarity >= 0.6""")(lambda t: reports.similar_pairs(t.act))
query("interference", """, ws AS MATERIALIZED (SELECT id, list_distinct(w) AS w FROM act), wt AS MATERIALIZED (SELECT id, unnest(w) AS t FROM ws),
pp AS MATERIALIZED (SELECT a.id AS a, b.id AS b, count(*) AS common FROM wt a JOIN wt b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2),
cs AS MATERIALIZED (SELECT cue, count(*) AS n FROM cues GROUP BY cue HAVING count(*) >= 3)
SELECT a.cue, any_value(n) AS members, round(avg(coalesce(common, 0) / greatest(1, least(len(x.w), len(y.w)))), 6) AS interference FROM cs JOIN cues a USING (cue) JOIN cues b ON b.cue = a.cue AND a.id < b.id
 JOIN ws x ON x.id = a.id JOIN ws y ON y.id = b.id LEFT JOIN pp ON pp.a = a.id AND pp.b = b.id GROUP BY a.cue""")(lambda t: _checkpointed(t, lambda _: reports.interference(t.act)))
query("difficulty", "SELECT topic, CASE WHEN r >= 0.75 THEN 'easy' WHEN r >= 0.35 THEN 'useful' WHEN r >= 0.12 THEN 'hard' ELSE 'lost' END AS level, count(*) AS n FROM act GROUP BY ALL")(lambda t: reports.difficulty(t.act, t.now))
query("emotion_profile", "SELECT *, CASE WHEN negative_ratio >= 0.4 THEN 'heavy' WHEN negative_ratio >= 0.2 THEN 'mixed' ELSE 'light' END AS state FROM (SELECT topic, count(*) AS n, count(*) FILTER (affect = 'negative') AS negative, round(count(*) FILTER (affect = 'negative') / count(*), 6) AS negative_ratio FROM act WHERE affect IS NOT NULL GROUP BY topic)")(lambda t: reports.emotions(t.act))
query("rumination", "SELECT topic, count(*) AS n, max(access_count) AS most FROM act WHERE affect IN ('negative', 'arousing') AND access_count >= 5 GROUP BY topic")(lambda t: reports.rumination(t.act))
query("cue_diversity", "SELECT *, CASE WHEN cues >= 3 THEN 'robust' WHEN cues = 2 THEN 'ok' ELSE 'fragile' END AS state FROM (SELECT id, count(*) AS cues, count(*) FILTER (cue IN (SELECT cue FROM cues GROUP BY cue HAVING count(*) > 4)) AS overloaded FROM cues GROUP BY id)")(lambda t: reports.cue_diversity(t.act))
query("encoding_quality", "SELECT id, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'fair' ELSE 'weak' END AS state FROM (SELECT id, CASE WHEN len(cues) >= 3 THEN 25 WHEN len(cues) >= 1 THEN 15 ELSE 0 END + CASE WHEN affect IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN importance >= 0.7 THEN 15 WHEN importance >= 0.4 THEN 10 ELSE 0 END + CASE WHEN strength >= 0.7 THEN 15 ELSE 0 END + CASE WHEN length(content) >= 20 THEN 15 WHEN length(content) >= 10 THEN 8 ELSE 5 END AS score FROM act)")(lambda t: reports.encoding_quality(t.act))
query("consolidation_forecast", f"SELECT id, round(least(1.0, 0.4 * importance + 0.3 * coalesce(affect IN {AROUSED}, false)::INT + 0.3 * CASE WHEN r < 0.6 THEN 0.5 ELSE 0 END), 6) AS priority, round((1 - least(1.0, r)) * importance, 6) AS gain FROM act")(lambda t: reports.forecast(t.act, t.now))
query("calibration_ece", f"SELECT bucket, sum(n)::BIGINT AS attempts, round(sum(confidence * n) / sum(n), 6) AS confidence, round(sum(retrieval_successes) / sum(n), 6) AS accuracy FROM (SELECT least(4, floor(confidence * 5))::INT AS bucket, confidence, retrieval_successes, {TRIES} AS n FROM act WHERE {TRIES} > 0) GROUP BY bucket")(lambda t: reports.calibration_error(t.act))
query("confidence", f"SELECT id, round(o, 6) AS confidence, round(c, 6) AS calibrated, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS label, c < 0.4 OR (origin = 'inference' AND confidence < 0.8) AS should_confirm FROM (SELECT *, {_OWN} AS o, {_CAL} AS c FROM act)".replace("SELECT id, round(o", "SELECT id, round(o").replace("AND confidence < 0.8", "AND act_conf < 0.8").replace("(SELECT *, ", "(SELECT id, origin, confidence AS act_conf, "))(lambda t: reports.confidences(t.act, t.now))
query("memory_status", "SELECT count(*) AS active, count(*) FILTER (r < 0.5) AS due, count(*) FILTER (revision_count > 0) AS revised, count(affect) AS emotional, round(avg(r), 6) AS avg_r FROM act")(lambda t: reports.status(t.act, t.now))
query("learner_profile", f"SELECT n::BIGINT AS attempts, round(s / n, 6) AS success_rate, CASE WHEN n = 0 THEN 'unknown' WHEN s / n >= 0.8 THEN 'fast' WHEN s / n >= 0.6 THEN 'steady' ELSE 'struggling' END AS pace FROM (SELECT sum({TRIES}) AS n, sum(retrieval_successes) AS s FROM act)")(lambda t: reports.learner(t.act))
query("memory_integration", ", tt AS (SELECT id, topic FROM act), ins AS (SELECT a.topic, count(*) AS links FROM links JOIN tt a ON a.id = src JOIN tt b ON b.id = dst WHERE a.topic = b.topic GROUP BY 1) SELECT topic, members, coalesce(ins.links, 0) AS links FROM (SELECT topic, count(*) AS members FROM tt GROUP BY topic HAVING count(*) >= 2) LEFT JOIN ins USING (topic)")(lambda t: reports.integration(t.act, t.links()))
# --- vectors

_COS = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_NEAR = f"WITH nr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM (SELECT q.vec_id AS query, v.vec_id AS id, v.label, {_COS} AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)) "


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = source.table(spark, d, "embeddings")
    return rows, rows.where("vec_id % 100 = 0").select("vec_id")


plain("cosine_topk", _NEAR + "SELECT query, id, similarity, rank FROM nr WHERE rank <= 10")(lambda s, d: vector.top_k(*_vectors(s, d)))
plain("label_knn_vote", _NEAR + "SELECT query, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS k FROM (SELECT query, label, count(*) AS votes FROM nr WHERE rank <= 9 GROUP BY ALL)) WHERE k = 1")(lambda s, d: vector.knn_vote(*_vectors(s, d)))
plain("lsh_candidates")(lambda s, d: vector.lsh_top_k(*_vectors(s, d), dim=64))
query("ngram_embed")(lambda t: vector.embeddings(t.act.select("id", "content")).select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding")))


def _checkpointed(t: Tables, f) -> DataFrame:
    """Operators that cut lineage by checkpoint() need its folder set."""
    shared.shared_dir(t.spark)
    return f(t.links())


# --- intents and outcomes, mapped from orders

_INT = "WITH it AS MATERIALIZED (SELECT o_orderkey AS id, o_orderdate AS due_at, o_orderpriority || '/' || o_custkey AS context_cue, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 50 = 0 THEN 'cancelled' ELSE 'active' END AS status FROM orders) "
_IN = "TIMESTAMP '1997-01-01'"


def _then():
    return F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")


query("intent_due", _INT + f"SELECT id, epoch(due_at)::BIGINT AS due_s FROM it WHERE status = 'active' AND due_at <= {_IN}", "")(lambda t: planning.due_intents(t.intents(), _then()))
query("intent_report", _INT + f"SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'active' AND due_at < {_IN}) AS overdue, (SELECT id FROM it WHERE status = 'active' AND due_at >= {_IN} ORDER BY due_at, id LIMIT 1) AS next_id FROM it", "")(lambda t: planning.intent_report(t.intents(), _then()))
query("intent_conflicts", _INT + """, ac AS MATERIALIZED (SELECT *, epoch(due_at) AS t FROM it WHERE status = 'active')
SELECT a.id AS id_a, b.id AS id_b, 'time' AS kind FROM ac a JOIN ac b ON a.id < b.id AND abs(a.t - b.t) < 3600 UNION ALL SELECT a.id, b.id, 'context' FROM ac a JOIN ac b ON a.id < b.id AND a.context_cue = b.context_cue AND abs(a.t - b.t) >= 3600""", "")(lambda t: planning.intent_conflicts(t.intents()))
query("action_queue", _INT + f""", ac AS MATERIALIZED (SELECT *, epoch(due_at) AS t, (epoch_us(due_at) - epoch_us({_IN})) / 3.6e9 AS h FROM it WHERE status = 'active'), tp AS (SELECT * FROM ac ORDER BY (h <= 0) DESC, h, id LIMIT 50)
SELECT id, h <= 0 AS overdue, h <= 1 AS urgent, round(h, 6) AS hours, EXISTS (SELECT 1 FROM ac WHERE ac.id <> tp.id AND (abs(ac.t - tp.t) < 3600 OR ac.context_cue = tp.context_cue)) AS clash FROM tp""", "")(lambda t: planning.action_queue(t.intents(), _then(), 50))
plain("outcome_rates", "SELECT step, trials, round(p, 6) AS rate, round(2 * abs(p - 0.5), 6) AS confidence FROM (SELECT o_orderpriority AS step, count(*) AS trials, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1)")(
    lambda s, d: planning.outcome_rates(source.table(s, d, "orders").select(F.col("o_orderpriority").alias("step"), (F.col("o_orderstatus") == "F").alias("ok")))
)
plain("time_cell_nearest", """WITH r AS (SELECT a.l_orderkey AS anchor_id, CASE WHEN o.o_orderdate > a.l_shipdate THEN 'after' ELSE 'before' END AS side, o.o_orderkey AS event_id, abs(epoch_us(o.o_orderdate) - epoch_us(a.l_shipdate)) AS gap
  FROM (SELECT l_orderkey, l_shipdate, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1) a JOIN orders o ON o.o_custkey = a.o_custkey WHERE o.o_orderdate <> a.l_shipdate)
SELECT anchor_id, side, k, event_id FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, side ORDER BY gap, event_id)::INT AS k FROM r) WHERE k <= 2""")(
    lambda s, d: planning.nearest_events(
        source.table(s, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("event_at")),
        source.table(s, d, "lineitem").where("l_linenumber = 1").join(source.table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("anchor_id"), F.col("o_custkey").alias("person"), F.col("l_shipdate").alias("anchor_at")),
    )
)

# --- streams

plain("stream_access_fold")(lambda s, d: access.folded(s, f"{d}/events.parquet"))
plain("stream_tumbling", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")(lambda s, d: access.tumbling(s, f"{d}/events.parquet"))
plain("stream_sessions", """SELECT user_id, min(us) AS start_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")(lambda s, d: access.sessions(s, f"{d}/events.parquet"))
plain("stream_turns", ORACLES["turn_segments"])(lambda s, d: access.turns(s, f"{d}/conversations.parquet"))

plain("stream_turns_kept", """WITH p AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(text, '[。！？!?；;\\n]+'), lambda x: trim(x)), lambda x: x <> '')[1:4] AS parts FROM conversations
 WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'user' AND turn = 0 AND length(text) % 5 = 0))
SELECT conv_id, turn, role, (generate_subscripts(parts, 1) - 1)::INT AS part, unnest(parts) AS content, CASE WHEN length(unnest(parts)) <= 60 THEN 'semantic' ELSE 'episodic' END AS kind FROM p""")(
    lambda s, d: access.turns(s, f"{d}/conversations.parquet", source.table(s, d, "conversations").where("role = 'user' and turn = 0 and length(text) % 5 = 0"))
)

#: Events as they arrive in four slices: every fifth 40 hours late, every seventh twice, the second time six hours later.
SLICES = 4
_ARRIVED = f"""WITH ev AS (SELECT event_id, ts, event_type, value, ts + CASE WHEN event_id % 5 = 0 THEN INTERVAL 40 HOUR ELSE INTERVAL 0 HOUR END AS arrival FROM events),
arrived AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (arrival + INTERVAL 6 HOUR AS arrival) FROM ev WHERE event_id % 7 = 0),
span AS (SELECT min(epoch_us(arrival)) AS a, max(epoch_us(arrival)) AS b FROM arrived),
sliced AS (SELECT event_id, ts, event_type, value, least({SLICES - 1}, (epoch_us(arrival) - a) * {SLICES} // (b - a))::INT AS slice FROM arrived, span),
"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the slice in which they arrive."""
    late = F.when(F.col("event_id") % 5 == 0, F.expr("interval 40 hours")).otherwise(F.expr("interval 0 hours"))
    ev = source.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    ev = ev.withColumn("arrival", F.unix_micros(F.col("ts") + late))
    rows = ev.unionByName(ev.where("event_id % 7 = 0").withColumn("arrival", F.col("arrival") + 6 * 3_600_000_000))
    span = rows.agg(F.min("arrival").alias("a"), F.max("arrival").alias("b"))
    return rows.crossJoin(F.broadcast(span)).withColumn("slice", F.least(F.lit(SLICES - 1), F.expr(f"(arrival - a) * {SLICES} div (b - a)")).cast("int")).drop("arrival", "a", "b")  # span is one row


@plain("stream_windows_append", _ARRIVED + f"""marks AS (SELECT slice, date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY AS mark FROM sliced GROUP BY slice),
before AS (SELECT s.slice, max(m.mark) AS mark FROM (SELECT DISTINCT slice FROM sliced) s LEFT JOIN marks m ON m.slice < s.slice GROUP BY s.slice),
taken AS (SELECT DISTINCT event_id, ts, event_type, value FROM sliced JOIN before USING (slice) WHERE mark IS NULL OR ts > mark)
SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS value FROM taken
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(mark) FROM marks) GROUP BY 1, 2""")
def _stream_windows_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arrivals(spark, sf_dir)
    into = shared.shared_path(spark, "windows")
    return access.replayed(rows, F.col("slice"), SLICES, lambda stream: access.run_into(access.windows(stream), into)).drop("batch")


_INTENT_EVENTS = f"""WITH it AS (SELECT o_orderkey AS id, o_orderdate AS told_at, o_orderdate + to_days((o_orderkey % 30 - 3)::INT) AS due_at FROM orders),
gone AS (SELECT o_orderkey AS id, o_orderdate + to_days((o_orderkey % 20)::INT) AS cancelled_at FROM orders WHERE o_orderkey % 11 = 0),
mark AS (SELECT greatest((SELECT max(told_at) FROM it), (SELECT max(cancelled_at) FROM gone)) - INTERVAL 2 DAY AS mark)
"""


@plain("stream_intents_due", _INTENT_EVENTS + """SELECT id, epoch_ms(due_at) AS due_ms FROM it LEFT JOIN gone USING (id), mark WHERE due_at <= mark AND (cancelled_at IS NULL OR cancelled_at > due_at)""")
def _stream_intents_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intents: due some days later or up to three days before they come; every eleventh is cancelled."""
    key = F.col("o_orderkey")
    orders = source.table(spark, sf_dir, "orders").select(key.alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    told = orders.select("id", "at", F.lit("remember").alias("kind"), (F.col("at") + days(F.col("id") % 30 - 3)).alias("due_at"))
    gone = orders.where("id % 11 = 0").select("id", (F.col("at") + days(F.col("id") % 20)).alias("at"), F.lit("cancel").alias("kind"), F.lit(None).cast("timestamp").alias("due_at"))
    events = told.unionByName(gone)
    span = events.agg(F.min(F.unix_micros("at")).alias("a"), F.max(F.unix_micros("at")).alias("b"))
    rows = events.crossJoin(F.broadcast(span)).withColumn("slice", F.least(F.lit(SLICES - 1), F.expr(f"(unix_micros(at) - a) * {SLICES} div (b - a)")).cast("int")).drop("a", "b")  # span is one row
    into, buckets = shared.shared_path(spark, "due"), due.buckets_for(events.count())
    return access.replayed(rows, F.col("slice"), SLICES, lambda stream: access.run_into(due.due_intents(stream, "2 days", buckets), into, "update", due.STORE)).select("id", "due_ms")


@query("stream_access_merged", """, acc AS (SELECT 'd' || (event_id % (SELECT n FROM cnt)) AS id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT id, access_count + coalesce(n, 0) AS access_count, epoch_us(greatest(last_access_at, t)) AS accessed_us FROM mem LEFT JOIN acc USING (id)""")
def _stream_access_merged(t: Tables) -> DataFrame:
    """Purchases as accesses in three batches, the first of which comes again, folded into the memories half-way."""
    n = source.table(t.spark, t.dir, "documents").count()
    events = source.table(t.spark, t.dir, "events").where("event_type = 'purchase'")
    rows = events.select("event_id", F.concat(F.lit("d"), (F.col("event_id") % n).cast("string")).alias("memory_id"), F.col("ts").cast("timestamp").alias("ts"))
    store = source.open_store(t.spark, shared.shared_path(t.spark, "accessed"))
    store.write("memories", t.mem.select("id", "access_count", "last_access_at"))
    checkpoint = f"{store.path}/checkpoint"

    def run(stream: DataFrame) -> DataFrame:
        access.merge_accesses(stream, store.ledger, checkpoint)
        access.take_accesses(store.ledger, rows, 0)  # what a driver does that was lost before it could note the batch
        return access.fold_accesses(store.ledger)

    access.replayed(rows, F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int"), 3, run)
    return store.read("memories").select("id", "access_count", F.unix_micros("last_access_at").alias("accessed_us"))


for _name, (_f, _sql) in general.ALL.items():
    plain(_name, _sql)(_f)
