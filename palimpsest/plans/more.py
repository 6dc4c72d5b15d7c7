"""Further queries by name, each with its SQL: ingest, store operations, composed recall, plans, practice, insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import composed, consolidate, fits, graph, index, ingest, insights, planning, plans, practice, recall, review, vector
from palimpsest.plans.catalog import _CONFLICTS, _IN, _INT, Tables, _then, plain, query
from palimpsest.plans.oracle import ASKED, ASKED_WHOLE, DUE_AT, IDLE, MEM, TRIES, TS, tokens
from palimpsest.sources import memories as source
from palimpsest.sources import shared

#: Word lists of the queries over the given tables, whose texts are not Chinese.
VERBS, RISKS, TAGS = ("the", "una", "der"), ("%%%", "!!"), {"success": ("the", "les"), "failure": ("el ", "une"), "lesson": ("und", "der")}
RULES = {"the": 4.0, "ing": 6.0, "tion": 8.0}


def contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


# --- ingest: the parts of conversation turns are remembered


def _records(t: Tables) -> DataFrame:
    parts = index.turn_segments(source.table(t.spark, t.dir, "conversations"))
    return parts.select("content", "kind", F.array("role").alias("cues"), F.struct("conv_id", "turn", "part").alias("input_pos"))


def _new(t: Tables) -> DataFrame:
    shared.shared_dir(t.spark)
    top = t.mem.agg(F.max("seq")).first()[0] or 0
    return shared.written(ingest.prepared(_records(t), t.now, top), "new")


_GOOD = "list_filter(w, lambda t: length(t) >= 2 AND NOT (regexp_full_match(t, '[a-z0-9]+') AND length(t) < 4))"
_STRONG, _FELT = "important|remember|critical|essential|always|never|priority|must", "love|hate|afraid|happy|sad|anxious|angry"
_NEW = f""", parts AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(text, '[。！？!?；;\\n]+'), lambda x: trim(x)), lambda x: x <> '')[1:4] AS parts FROM conversations),
segs AS (SELECT conv_id, turn, role, generate_subscripts(parts, 1) AS part, unnest(parts) AS content FROM parts),
numbered AS (SELECT *, (SELECT max(seq) FROM mem) + row_number() OVER (ORDER BY conv_id, turn, part) AS seq, {tokens('content')} AS w FROM segs),
new AS MATERIALIZED (SELECT 'm' || seq AS id, seq, CASE WHEN length(content) <= 60 THEN 'semantic' ELSE 'episodic' END AS kind, content, sha256(lower(trim(regexp_replace(content, '\\s+', ' ', 'g')))) AS content_hash, w,
  list_filter(list_concat([role], g), lambda x, i: list_position(list_concat([role], g), x) = i) AS cues,
  least(greatest(0.4 + CASE WHEN regexp_matches(lower(content), '{_STRONG}') THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(lower(content), '{_FELT}') THEN 0.15 ELSE 0 END + 0.1 * 0.8, 0), 1) AS importance
 FROM (SELECT *, list_filter(gg, lambda x, i: list_position(gg, x) = i)[1:6] AS g FROM (SELECT *, {_GOOD} AS gg FROM numbered)))
"""
query("ingest_rows", _NEW + "SELECT id, seq, kind, content_hash, array_to_string(cues, ',') AS cues, round(importance, 6) AS importance FROM new")(
    lambda t: _new(t).select("id", "seq", "kind", "content_hash", F.array_join("cues", ",").alias("cues"), F.round("importance", 6).alias("importance"))
)
query("ingest_terms", _NEW + f"SELECT DISTINCT id, unnest(list_concat(w, flatten(list_transform(cues, lambda c: {tokens('c')})))) AS term FROM new")(lambda t: index.term_index(_new(t)).select("id", "term"))
query("ingest_merged", _NEW + """, facts AS (SELECT id, seq, content_hash, cues, importance FROM new WHERE kind = 'semantic'
  UNION ALL SELECT id, seq, content_hash, cues, importance FROM mem WHERE kind = 'semantic' AND content_hash IN (SELECT content_hash FROM new WHERE kind = 'semantic'))
SELECT min_by(id, seq) AS id, min(seq) AS seq, 'semantic' AS kind, round(max(importance), 6) AS importance, count(*) AS merged FROM facts GROUP BY content_hash
UNION ALL SELECT id, seq, kind, round(importance, 6), 1 FROM new WHERE kind = 'episodic'""")(lambda t: _merged(t))


def _merged(t: Tables) -> DataFrame:
    rows, became = ingest.remembered(t.mem, _new(t))
    n = became.groupBy("id").agg(F.count("*").alias("merged"))
    old = t.mem.where("kind = 'semantic'").groupBy("kind", "content_hash").agg(F.count("*").alias("old"))  # all facts of a text, not only the one that stays
    return rows.join(n, "id").join(old, ["kind", "content_hash"], "left").select("id", "seq", "kind", F.round("importance", 6).alias("importance"), (F.col("merged") + F.coalesce("old", F.lit(0))).alias("merged"))


query("ingest_links", _NEW + """, allc AS MATERIALIZED (SELECT id, seq, unnest(cues) AS cue FROM act UNION ALL SELECT id, seq, unnest(cues) FROM new),
pr AS (SELECT DISTINCT n.id AS a, c.id AS b, c.seq FROM (SELECT id, unnest(cues) AS cue FROM new) n JOIN allc c ON n.cue = c.cue AND n.id <> c.id)
SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst, 1.0::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY seq DESC, b) AS k FROM pr) WHERE k <= 8""")(lambda t: _ingest_links(t))


def _ingest_links(t: Tables) -> DataFrame:
    new = _new(t)
    return ingest.new_links(t.act.select("id", "seq", "cues").unionByName(new.select("id", "seq", "cues")), new, 8)


# --- store operations

_ASKED_IDS = "id IN ('d1', 'd2', 'd19', 'd38', 'd77')"
_IDS = ["d1", "d2", "d19", "d38", "d77"]
query("multi_get", f"SELECT id, seq FROM act WHERE {_ASKED_IDS}")(lambda t: ingest.get(t.mem, _IDS).select("id", "seq"))
query("lookup_by_id", f"SELECT id, status FROM mem WHERE {_ASKED_IDS}")(lambda t: ingest.get(t.mem, _IDS, any_status=True).select("id", "status"))
query("lookup_by_hash", "SELECT content_hash, min_by(id, seq) AS id FROM mem WHERE kind = 'semantic' AND content_hash IN (SELECT content_hash FROM mem WHERE seq % 10 = 1) GROUP BY content_hash")(
    lambda t: ingest.by_hash(t.mem, "semantic", t.mem.where("seq % 10 = 1").select("content"))
)
query("recycled_page", "SELECT id, seq FROM mem WHERE status = 'recycled' AND seq > 100 ORDER BY seq LIMIT 20")(lambda t: ingest.recycled_page(t.mem, 100, 20))
query("inverted_index", """, sized AS (SELECT id, term, ceil(count(*) OVER (PARTITION BY term) / 100.0)::BIGINT AS parts FROM terms)
SELECT term, (('0x' || substr(md5(id), 1, 8))::BIGINT % parts)::INT AS part, array_to_string(list_sort(list(id)), ',') AS ids FROM sized GROUP BY 1, 2""")(
    lambda t: index.inverted(t.act, 100).select("term", "part", F.array_join("ids", ",").alias("ids"))
)
query("find_by_terms", "SELECT DISTINCT id FROM terms WHERE term IN ('thing', 'heat', 'tion')")(lambda t: index.find_by_terms(index.term_index(t.act), ["thing", "heat", "tion"]))
query("terms_removed", "SELECT id, term FROM terms WHERE id NOT IN (SELECT id FROM act WHERE seq % 3 = 0)")(lambda t: index.without_terms(index.term_index(t.act), t.act.where("seq % 3 = 0")).select("id", "term"))
query("link_weights", "SELECT a, b, coalesce(weight, 0.0) AS weight FROM (SELECT id AS a, 'd' || (seq + 49) AS b FROM act) p LEFT JOIN links ON src = least(a, b) AND dst = greatest(a, b)")(
    lambda t: ingest.link_weight(t.links(), t.act.select(F.col("id").alias("a"), F.concat(F.lit("d"), F.col("seq") + 49).alias("b")))
)
query("deleted_recycled", """SELECT 'memories' AS name, count(*) AS n FROM mem WHERE NOT (status = 'recycled' AND seq % 2 = 0)
UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'cues', count(*) FROM (SELECT id, unnest(cues) FROM mem WHERE NOT (status = 'recycled' AND seq % 2 = 0))""")(lambda t: _deleted(t))


def _deleted(t: Tables) -> DataFrame:
    tables = {"memories": t.mem, "cues": index.cue_index(t.mem), "links": t.links()}
    left = ingest.deleted(tables, t.mem.where("seq % 2 = 0"), only_recycled=True)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


query("suppressed_recall", ASKED.replace("FROM act)", "FROM act WHERE seq % 5 <> 0)").replace("JOIN act USING (id)", "JOIN (SELECT * FROM act WHERE seq % 5 <> 0) act USING (id)").replace("FROM terms", "FROM (SELECT * FROM terms WHERE id NOT IN (SELECT id FROM act WHERE seq % 5 = 0)) terms").replace("JOIN terms", "JOIN (SELECT * FROM terms WHERE id NOT IN (SELECT id FROM act WHERE seq % 5 = 0)) terms") + "SELECT query_id, rank, id, score FROM found WHERE rank <= 5", MEM + ", ")(
    lambda t: recall.recall(t.asked(), t.act, t.now, 5, t.items, ingest.suppress(t.act.select("id").limit(0), t.act.where("seq % 5 = 0").select("id"), t.act)).select("query_id", "rank", "id", "score")
)
query("stats_with_links", "SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, (SELECT count(*) FROM links) AS links FROM mem")(lambda t: index.stats(t.mem, t.links()).select("total", "active", "links"))
query("forgotten", "SELECT id FROM act WHERE r < 0.2")(lambda t: review.with_r(t.act, t.now).where("r < 0.2").select("id"))
query("refused_updates", "SELECT DISTINCT a.id FROM mem a JOIN mem b ON a.kind = 'semantic' AND b.kind = 'semantic' AND b.id = 'd' || (a.seq + 3) JOIN mem c ON c.kind = 'semantic' AND c.content_hash = b.content_hash AND c.id <> a.id WHERE a.content_hash <> b.content_hash")(lambda t: _refused(t))


def _refused(t: Tables) -> DataFrame:
    facts = t.mem.where("kind = 'semantic'")
    other = facts.select(F.col("id").alias("o"), "content")
    changes = facts.select("id", F.concat(F.lit("d"), F.col("seq") + 3).alias("o")).join(other, "o").select("id", "content")
    return ingest.refused(t.mem, changes)


query("knowledge_graph_nodes", "SELECT id, substr(content, 1, 40) AS label, kind FROM act")(lambda t: graph.kg_nodes(t.act))

# --- recall as one query

_SPREAD = """, s0 AS MATERIALIZED (SELECT query_id, id, seq, score, lap, true AS matched FROM scored),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq DESC) AS rk FROM s0) WHERE rk <= 5),
b1 AS (SELECT query_id, id, round(max(score * 0.95 * pow(0.985, k)), 9) AS boost FROM (SELECT f.query_id, b.id, f.score, row_number() OVER (PARTITION BY f.query_id, f.id ORDER BY abs(b.seq - f.seq), b.seq DESC) - 1 AS k FROM r1 f JOIN both_ways l ON l.src = f.id JOIN act b ON b.id = l.dst) WHERE k < 50 GROUP BY ALL),
s1 AS MATERIALIZED (SELECT query_id, id, act.seq, round(greatest(coalesce(score, boost), coalesce(boost, score)), 9) AS score, coalesce(lap, 0.0) AS lap, coalesce(matched, false) AS matched FROM s0 FULL JOIN b1 USING (query_id, id) JOIN act USING (id)),
r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS kk FROM (SELECT *, round(lap, 6) AS lap6, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq DESC) AS rk FROM s1) WHERE lap6 >= 0.25 AND lap6 < 0.95) WHERE kk <= 4),
b2 AS MATERIALIZED (SELECT query_id, id, round(max(score * 0.9 * least(1.0, conf)), 6) AS boost FROM (SELECT f.query_id, b.id, f.score, a.confidence AS conf, a.cues AS ca, b.cues AS cb, row_number() OVER (PARTITION BY f.query_id, f.id ORDER BY abs(b.seq - a.seq), b.seq DESC) AS k
  FROM r2 f JOIN act a ON a.id = f.id JOIN both_ways l ON l.src = f.id AND l.weight >= 0.8 JOIN act b ON b.id = l.dst) WHERE k <= 8 AND len(list_intersect(ca, cb)) >= 2 GROUP BY ALL),
b2k AS (SELECT query_id, id, boost FROM (SELECT b2.*, s1.id IS NOT NULL AS known, row_number() OVER (PARTITION BY b2.query_id, s1.id IS NOT NULL ORDER BY boost DESC, b2.id) AS k FROM b2 LEFT JOIN s1 ON s1.query_id = b2.query_id AND s1.id = b2.id) WHERE known OR k <= 16),
s2 AS MATERIALIZED (SELECT query_id, id, act.seq, round(greatest(coalesce(score, boost), coalesce(boost, score)), 9) AS score, coalesce(lap, 0.0) AS lap, coalesce(matched, false) AS matched FROM s1 FULL JOIN b2k USING (query_id, id) JOIN act USING (id)),
r3 AS MATERIALIZED (SELECT s.*, a.cues, a.content_hash, a.evidence_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq DESC) AS rk FROM s2) s JOIN act a USING (id) WHERE rk <= 10),
riv AS (SELECT s.*, t.evidence_count AS te FROM r3 s JOIN r3 t ON s.query_id = t.query_id AND t.rk = 1 WHERE s.rk > 1 AND s.content_hash <> t.content_hash AND len(list_intersect(s.cues, t.cues)) >= 2 AND len(list_intersect(s.cues, t.cues)) / len(list_distinct(list_concat(s.cues, t.cues))) >= 0.35),
sep AS (SELECT query_id, id, round(CASE WHEN evidence_count = m THEN score + 0.04 WHEN evidence_count * 2 <= m THEN greatest(0.05, 0.3 * score) ELSE score - 0.08 END, 6) AS separated FROM (SELECT *, greatest(te, max(evidence_count) OVER (PARTITION BY query_id)) AS m FROM riv)),
s3 AS (SELECT s2.* REPLACE (coalesce(separated, score) AS score) FROM s2 LEFT JOIN sep USING (query_id, id)),
fin AS MATERIALIZED (SELECT *, row_number() OVER w AS rank, lead(score, 1, -1.0) OVER w AS nxt FROM s3 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, seq DESC)),
whole AS MATERIALIZED (SELECT query_id, rank, id, score, matched, rank = 1 AND score >= 0.45 AND score - nxt >= 0.03 AS confident FROM fin WHERE rank <= 5)
"""


def _whole(t: Tables, **how) -> DataFrame:
    return composed.recall_all(t.asked(), t.act, t.linked, t.now, 5, t.items, **how)


query("recall_full", ASKED + _SPREAD + "SELECT query_id, rank, id, round(score, 6) AS score, matched, confident FROM whole", MEM + ", ")(lambda t: _whole(t).select("query_id", "rank", "id", "score", "matched", "confident"))
query("recall_second_look", ASKED + _SPREAD + """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN sure THEN score ELSE score + 0.08 * least(2, evidence_count - 1) + greatest(0.0, 0.03 * (trust - 0.8)) END, 9) DESC, rank) AS rank, id
 FROM (SELECT w.*, evidence_count, trust, bool_or(confident) OVER (PARTITION BY query_id) AS sure FROM (SELECT * REPLACE (round(score, 9) AS score) FROM whole) w JOIN act USING (id))""", MEM + ", ")(lambda t: _whole(t, look_again=True).select("query_id", "rank", "id"))
query("elaborated_links", ASKED + _SPREAD + """, tops AS (SELECT query_id, id FROM whole WHERE matched), prs AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM tops a JOIN tops b ON a.query_id = b.query_id AND a.id < b.id)
SELECT src, dst, round(least(1.0, coalesce(weight, 0.0) + 0.05), 6) AS weight FROM prs LEFT JOIN links USING (src, dst)""", MEM + ", ")(lambda t: composed.elaborated(_whole(t), t.linked))
query("recall_misses", ASKED + _SPREAD + "SELECT id, retrieval_failures + n AS retrieval_failures FROM act JOIN (SELECT id, count(DISTINCT query_id) AS n FROM whole WHERE NOT matched GROUP BY id) USING (id)", MEM + ", ")(lambda t: composed.missed(_whole(t), t.act))
query("rif_rivals", ASKED + _SPREAD + """, nb AS (SELECT w.query_id, w.rank, l.dst AS id, a.cues AS ca, b.cues AS cb, b.seq FROM whole w JOIN both_ways l ON l.src = w.id JOIN act a ON a.id = w.id JOIN act b ON b.id = l.dst
   WHERE w.matched AND (w.query_id, l.dst) NOT IN (SELECT (query_id, id) FROM whole) AND len(list_intersect(a.cues, b.cues)) >= 2 AND (w.query_id, l.dst) IN (SELECT (query_id, id) FROM hits)),
 pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, seq DESC) AS k FROM (SELECT query_id, id, min(rank) AS rank, max(seq) AS seq FROM nb GROUP BY ALL))
SELECT id, round(least(strength, greatest(0.7, strength - 0.01 * n)), 6) AS strength FROM act JOIN (SELECT id, count(*) AS n FROM pk WHERE k <= 12 GROUP BY id) USING (id)""", MEM + ", ")(lambda t: composed.rivals(_whole(t), t.asked(), t.linked, t.act, t.items))
_ORDERED = ", first3 AS (SELECT query_id, base, low FROM qs)"
query("cue_overlap", ASKED + """, cw AS (SELECT DISTINCT id, unnest(regexp_extract_all(regexp_replace(cue, '^(sid|date|session|id|topic):', ''), '[a-z0-9]+')) AS w FROM cues WHERE regexp_matches(cue, '[0-9]') OR regexp_matches(cue, '^(sid|date|session|id|topic):')),
 lq AS (SELECT item_id AS query_id, term AS w FROM (SELECT item_id, unnest(list_distinct(list_concat(""" + tokens("text") + ", ['src' || item_id % 30]))) AS term FROM benchmark) WHERE length(term) >= 4) SELECT query_id, id, round(count(*) / greatest(1.0, sqrt(any_value(n))), 6) AS cue_overlap FROM lq JOIN cw USING (w) JOIN (SELECT query_id, count(*) AS n FROM lq GROUP BY 1) USING (query_id) WHERE length(w) >= 4 GROUP BY query_id, id", MEM + ", ")(
    lambda t: composed.cue_overlap(_with_source(t), t.act).withColumn("cue_overlap", F.round("cue_overlap", 6))
)


def _with_source(t: Tables) -> DataFrame:
    return t.asked().withColumn("query", F.concat("query", F.lit(" src"), (F.col("query_id") % 30).cast("string")))


query("recall_fused_full", ASKED_WHOLE + """, fu AS (SELECT query_id, id, sum(part) AS fused FROM (SELECT query_id, id, 1.0 / (60 + rank) AS part FROM ranked WHERE rank <= 24 UNION ALL
   SELECT query_id, id, 1.6 / (60 + k) FROM best WHERE k <= 24) GROUP BY ALL),
 mm AS (SELECT fu.*, seq, low, epoch_us(created_at) AS us, min(epoch_us(created_at)) OVER (PARTITION BY query_id) AS lo, max(epoch_us(created_at)) OVER (PARTITION BY query_id) AS hi FROM fu JOIN act USING (id) JOIN (SELECT query_id, low FROM qs) USING (query_id)),
 rec AS (SELECT *, CASE WHEN hi = lo THEN 0.5 ELSE (us - lo) / (hi - lo) END AS fresh, regexp_extract_all(low, '[a-z'']+') AS ws FROM mm)
 SELECT query_id, id, fused, rank FROM (SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seq DESC)::INT AS rank FROM (SELECT query_id, id, seq, round(round(fused, 9) + 0.08 * CASE WHEN len(list_intersect(ws, ['latest', 'recent', 'recently', 'current', 'currently', 'now', 'since', 'updated', 'changed', 'update', 'newest'])) > 0 THEN fresh
   WHEN len(list_intersect(ws, ['first', 'earliest', 'initially', 'started', 'began'])) > 0 THEN 1 - fresh ELSE 0 END, 9) AS fused FROM rec)) WHERE rank <= 5""", MEM + ", ")(lambda t: _fused(t))


def _fused(t: Tables) -> DataFrame:
    terms = recall.asked_terms(t.asked(), t.items)
    met = shared.written(recall.reached(t.asked(), t.act, t.now, t.items, terms, 24), "reached")
    passes = {"score": (recall.recall(t.asked(), t.act, t.now, 24, t.items, known=(terms, met)), 1.0), "idf": (recall.candidates(t.asked(), t.act, t.items, asked=terms, common=None), 1.6)}
    return composed.recall_fused(t.asked(), t.act, passes)


query("recall_steps", ASKED + "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS step, id FROM found WHERE rank <= 10", MEM + ", ")(lambda t: composed.in_steps(t.found(10), t.act).select("query_id", "step", "id"))
query("concept_cover", ASKED + """, ch AS (SELECT item_id AS query_id, unnest(list_filter(list_transform(string_split_regex(text, '[和与以及、,，]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 1)) AS chunk FROM benchmark),
 sv AS MATERIALIZED (SELECT DISTINCT query_id, chunk, list_distinct(""" + tokens("chunk") + """) AS tt FROM ch WHERE query_id IN (SELECT query_id FROM ch GROUP BY 1 HAVING count(*) > 1)),
 tw AS (SELECT query_id, chunk, len(tt) AS n, unnest(tt) AS term FROM sv WHERE len(tt) > 0),
 hh AS (SELECT query_id, chunk, id, round(count(*) / any_value(n) + CASE WHEN contains(any_value(content) || ' ' || array_to_string(any_value(cues), ' '), chunk) THEN 0.5 ELSE 0 END, 4) AS score FROM tw JOIN terms USING (term) JOIN act USING (id) GROUP BY query_id, chunk, id),
 kk AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk ORDER BY score DESC, id) AS k FROM hh)
 SELECT query_id, chunk, id, score, bool_or(score >= 0.35 AND (query_id, id) IN (SELECT (query_id, id) FROM found WHERE rank <= 5)) OVER (PARTITION BY query_id, chunk) AS covered FROM kk WHERE k <= 3 QUALIFY score >= 0.35""", MEM + ", ")(
    lambda t: composed.covered(t.asked(), t.found(5), t.act, t.items).distinct()
)
query("reasoning_trace", ASKED + """, ev AS (SELECT query_id, count(*) AS evidence, sum(len(list_distinct(regexp_extract_all(substr(content, 1, 48), '-?[0-9]+(?:\\.[0-9]+)?')))) AS more FROM found JOIN act USING (id) WHERE rank <= 5 AND score >= 0.05 GROUP BY query_id)
SELECT item_id AS query_id, coalesce(evidence, 0) AS evidence, (len(list_distinct(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?'))) + coalesce(more, 0))::BIGINT AS numbers, CASE WHEN coalesce(evidence, 0) > 0 THEN 'consistent' ELSE 'review_needed' END AS verdict FROM benchmark LEFT JOIN ev ON query_id = item_id""", MEM + ", ")(lambda t: insights.reasoned(t.asked(), t.found(5), t.act))
query("recognition_check", ASKED + f""", cd AS (SELECT query_id, id FROM (SELECT query_id, 'd' || (query_id % 100 + 1) AS id FROM qs) JOIN act USING (id)),
 ws AS (SELECT cd.query_id, cd.id, base, list_distinct(list_concat({tokens('content')}, cues)) AS words FROM cd JOIN qs USING (query_id) JOIN act USING (id)),
 ov AS (SELECT *, len(list_intersect(base, words)) / greatest(1, least(len(base), len(words))) AS o FROM ws)
SELECT query_id, id, round(o, 3) AS overlap, CASE WHEN (query_id, id) NOT IN (SELECT (query_id, id) FROM found) THEN 'unmatched' WHEN o >= 0.6 THEN 'recollection' WHEN o > 0 THEN 'familiarity' ELSE 'unmatched' END AS verdict FROM ov""", MEM + ", ")(
    lambda t: insights.recognised(t.asked().withColumn("id", F.concat(F.lit("d"), F.col("query_id") % 100 + 1)), t.found(10), t.act)
)
query("retrieval_assist", ASKED + f""", cw AS (SELECT DISTINCT act.id, topic, cue, unnest({tokens('cue')}) AS term FROM act JOIN cues USING (id)),
 bc AS (SELECT query_id, topic AS cue, max(n) AS matched FROM (SELECT query_id, id, topic, cue, count(*) AS n FROM cw JOIN qt USING (term) GROUP BY ALL) GROUP BY query_id, topic),
 tw AS (SELECT query_id, id, count(*) AS n FROM (SELECT id, unnest(list_distinct(w)) AS term FROM act) JOIN qt USING (term) GROUP BY ALL),
 bt AS (SELECT query_id, c AS cue, max(n) AS matched FROM (SELECT query_id, n, unnest(cues[1:3]) AS c FROM tw JOIN act USING (id)) GROUP BY 1, 2),
 al AS (SELECT *, 'cue' AS source FROM bc UNION ALL SELECT *, 'content' FROM bt WHERE (query_id, cue) NOT IN (SELECT (query_id, cue) FROM bc))
SELECT query_id, cue, source, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (source = 'cue') DESC, matched DESC, cue)::INT AS rank FROM al) WHERE rank <= 8""", MEM + ", ")(lambda t: insights.assisted(t.asked(), t.act))

# --- plans: a conversation is a plan, a turn a step

_PLAN = "WITH pl AS MATERIALIZED (SELECT conv_id AS plan_id, turn AS pos, trim(text) AS step FROM conversations WHERE trim(text) <> ''), an AS MATERIALIZED (SELECT DISTINCT l.plan_id, l.pos, e.pos AS needs FROM pl l JOIN pl e ON l.plan_id = e.plan_id AND e.pos < l.pos AND contains(l.step, substr(e.step, 1, 8))) "


def _plan(s, d: str) -> DataFrame:
    return source.table(s, d, "conversations").where("trim(text) <> ''").select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("pos"), F.trim("text").alias("step"))


def _needs(s, d: str) -> DataFrame:
    """Every third turn needs the one before it and that three before."""
    return _plan(s, d).withColumn("depends_on", F.when(F.col("pos") % 3 == 0, F.array(F.col("pos") - 1, F.col("pos") - 3)).otherwise(F.array().cast("array<bigint>")))


_HOUR = "round(CASE " + " ".join(f"WHEN contains(step, '{w}') THEN {h}" for w, h in RULES.items()) + " ELSE 2.0 END * CASE WHEN length(step) > 12 THEN 1.2 ELSE 1.0 END, 1)"
query("plan_quality", ", " + _PLAN[len("WITH ") :] + f""", one AS (SELECT plan_id, count(*) AS steps, count(*) FILTER ({contains('step', VERBS)}) AS verb_steps, count(DISTINCT step) < count(*) AS repeats FROM pl GROUP BY plan_id),
 pw AS (SELECT DISTINCT plan_id, unnest({tokens('step')}) AS term FROM pl),
 al AS (SELECT plan_id, round(count(k.term) / count(*), 3) AS alignment FROM pw LEFT JOIN (SELECT DISTINCT term FROM terms) k USING (term) GROUP BY plan_id),
 o2 AS (SELECT *, plan_id IN (SELECT plan_id FROM an) AS ordered, coalesce(alignment, 0.0) AS agreed FROM one LEFT JOIN al USING (plan_id))
SELECT plan_id, steps, verb_steps, repeats, ordered, agreed AS alignment, score, CASE WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'weak' END AS verdict FROM (SELECT *, greatest(0, least(100, round_even(round(25 + 30.0 * verb_steps / steps + 20.0 * least(1.0, agreed)
  + CASE WHEN ordered OR (steps >= 4 AND verb_steps = steps AND NOT repeats) THEN 15 ELSE 5 END - CASE WHEN steps <= 12 THEN 0 ELSE least(15, abs(steps - 6)) END - CASE WHEN repeats THEN 10 ELSE 0 END, 9), 0)::INT)) AS score FROM o2)""")(
    lambda t: plans.quality(_plan(t.spark, t.dir), index.exploded(t.items), verbs=VERBS)
)
plain("plan_tracker", _PLAN + """, st AS (SELECT *, CASE pos % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'blocked' WHEN 2 THEN 'in_progress' ELSE 'pending' END AS status FROM pl)
SELECT plan_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'blocked') AS blocked, round(count(*) FILTER (status = 'done') / count(*), 3) AS ratio FROM st GROUP BY plan_id""")(
    lambda s, d: plans.tracked(_plan(s, d), _plan(s, d).select("plan_id", "pos", F.element_at(F.array(*map(F.lit, ("done", "blocked", "in_progress", "?", "pending"))), (F.col("pos") % 5 + 1).cast("int")).alias("status")))
)
plain("decision_review", _PLAN + """, dr AS (SELECT plan_id, count(*) AS steps, count(*) FILTER (pos % 3 = 0) AS success, count(*) FILTER (pos % 3 = 1) AS failure, round(count(*) FILTER (pos % 3 = 0) / count(*), 3) AS rate FROM pl GROUP BY plan_id)
SELECT *, round_even(round(rate * 100, 6), 0)::INT AS score, CASE WHEN round_even(round(rate * 100, 6), 0) >= 80 THEN 'good' WHEN round_even(round(rate * 100, 6), 0) >= 50 THEN 'fair' ELSE 'poor' END AS verdict FROM dr""")(
    lambda s, d: plans.decisions(_plan(s, d), _plan(s, d).select("plan_id", "pos", F.when(F.col("pos") % 3 == 0, "success").when(F.col("pos") % 3 == 1, "failure").otherwise("skipped").alias("status")))
)
_LEVELS = _PLAN.replace("WITH ", "WITH RECURSIVE ", 1) + """, nd AS MATERIALIZED (SELECT plan_id, pos, u AS needs FROM pl, unnest([pos - 1, pos - 3]) AS t(u) WHERE pos % 3 = 0 AND u >= 0 AND (plan_id, u) IN (SELECT (plan_id, pos) FROM pl)
  UNION SELECT plan_id, pos, needs FROM an WHERE pos % 3 <> 0),
 wk AS (SELECT plan_id, pos, 0 AS level FROM pl UNION SELECT nd.plan_id, nd.pos, wk.level + 1 FROM wk JOIN nd ON nd.plan_id = wk.plan_id AND nd.needs = wk.pos),
 lv AS MATERIALIZED (SELECT plan_id, pos, max(level) AS level FROM wk GROUP BY 1, 2) """
plain("dependency_map", _LEVELS + "SELECT plan_id, pos, level FROM lv")(lambda s, d: _levels(s, d).select("plan_id", "pos", "level"))
plain("parallel_groups", _LEVELS + "SELECT plan_id, level, count(*) AS n FROM lv GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: plans.parallel_groups(_levels(s, d)))
_CRITICAL = _LEVELS + """, top AS (SELECT plan_id, pos, level FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY level DESC, pos) AS k FROM lv) WHERE k = 1),
 cp AS (SELECT plan_id, pos, level FROM top UNION ALL SELECT plan_id, pos, level FROM (SELECT l.plan_id, l.pos, l.level, row_number() OVER (PARTITION BY l.plan_id ORDER BY l.pos) AS k
   FROM cp c JOIN nd n ON n.plan_id = c.plan_id AND n.pos = c.pos JOIN lv l ON l.plan_id = n.plan_id AND l.pos = n.needs AND l.level = c.level - 1) WHERE k = 1) """
plain("critical_path", _CRITICAL + "SELECT plan_id, pos, level FROM cp")(lambda s, d: _critical(s, d))
plain("effort_estimate", _CRITICAL + f""", tt AS (SELECT plan_id, round(sum({_HOUR}), 1) AS total FROM pl GROUP BY plan_id), ct AS (SELECT plan_id, round(sum({_HOUR}), 1) AS critical FROM cp JOIN pl USING (plan_id, pos) GROUP BY plan_id)
SELECT plan_id, total, critical, round(total * 1.2, 1) AS buffered FROM tt JOIN ct USING (plan_id)""")(lambda s, d: plans.effort(_needs(s, d), 2.0, RULES))


def _critical(s, d: str) -> DataFrame:
    needs = plans.dependencies(_needs(s, d))
    return plans.critical_path(_levels(s, d), needs).select("plan_id", "pos", "level")


def _levels(s, d: str) -> DataFrame:
    rows = _needs(s, d)
    needs = plans.dependencies(rows).join(rows.select("plan_id", F.col("pos").alias("needs")), ["plan_id", "needs"], "left_semi")
    return plans.levels(rows.drop("depends_on"), needs)


plain("plan_rewrite", _PLAN + """, nw AS (SELECT plan_id, CASE WHEN contains(step, 'the') THEN 'plan' WHEN contains(step, 'ing') THEN 'make' WHEN contains(step, 'e') THEN 'test' ELSE '完成' || step END AS step, min(pos) AS f FROM pl GROUP BY ALL)
SELECT plan_id, (row_number() OVER (PARTITION BY plan_id ORDER BY CASE step WHEN 'plan' THEN 0 WHEN 'make' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, f) - 1)::INT AS pos, step FROM nw""")(
    lambda s, d: plans.rewritten(_plan(s, d), {"the": "plan", "ing": "make", "e": "test"}, ("plan", "make", "test"))
)
query("lesson_learned", "SELECT id, tag FROM (SELECT id, CASE " + " ".join(f"WHEN {contains('content', w)} THEN '{k}'" for k, w in TAGS.items()) + " END AS tag FROM act) WHERE tag IS NOT NULL")(lambda t: plans.lessons(t.act, TAGS))
query("transfer_report", ", pt AS (SELECT DISTINCT conv_id AS plan_id, turn AS pos, unnest(" + tokens("trim(text)") + ") AS term FROM conversations WHERE conv_id % 100 = 0), tg AS (SELECT id, CASE " + " ".join(f"WHEN {contains('content', w)} THEN '{k}'" for k, w in TAGS.items()) + " END AS tag FROM act) SELECT plan_id, pos, id, tag, count(*) AS common FROM pt JOIN terms USING (term) JOIN tg USING (id) WHERE tag IS NOT NULL GROUP BY ALL")(
    lambda t: plans.transfer(_plan(t.spark, t.dir).where("plan_id % 100 = 0"), t.act, t.items, TAGS)
)
query("plan_support", ASKED + "SELECT query_id, count(*) AS support, round(max(score), 6) AS best FROM found WHERE rank <= 3 GROUP BY query_id", MEM + ", ")(lambda t: t.found(3).groupBy("query_id").agg(F.count("*").alias("support"), F.round(F.max("score"), 6).alias("best")))
query("project_brief", ASKED + f"SELECT query_id, id, {contains('content', VERBS)} AS requirement, {contains('content', RISKS)} AS risk FROM found JOIN act USING (id) WHERE rank <= 8", MEM + ", ")(lambda t: plans.brief(t.found(8), t.act, VERBS, RISKS))
#: Orders are due on days, so intents clash in time where they are due on the same one.
_CLASHES = """it2 AS (SELECT o_orderkey AS id, o_orderdate AS d, o_orderpriority || '/' || o_custkey AS context_cue FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 50 <> 0),
 cl AS (SELECT ((SELECT count(*) FROM it2 a JOIN it2 b ON a.d = b.d AND a.id < b.id) + (SELECT count(*) FROM it2 a JOIN it2 b ON a.context_cue = b.context_cue AND a.id < b.id AND a.d <> b.d))::BIGINT AS clashes)"""
query("project_risk", _CONFLICTS + f", rk AS (SELECT count(*) FILTER ({contains('content', RISKS)}) AS risks FROM act), ic AS (SELECT o_orderkey AS id, o_orderdate AS due_at FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 50 <> 0 AND o_orderdate <= {_IN}), {_CLASHES} SELECT risks, conflicts, overdue, clashes, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'moderate' ELSE 'low' END AS verdict FROM (SELECT *, least(100, 10 * risks + 15 * conflicts + 15 * overdue + 10 * clashes)::BIGINT AS score FROM rk, (SELECT count(*) AS conflicts FROM conf), (SELECT count(*) AS overdue FROM ic), cl)")(
    lambda t: plans.risk(t.act, consolidate.conflicts(t.act), planning.due_intents(t.intents(), _then()), planning.clash_count(t.intents()), RISKS)
)
query("goal_replay", _CONFLICTS.replace(", facts", ", " + ASKED.rstrip() + ", facts", 1) + ", ev AS (SELECT query_id, count(*) AS evidence, count(*) FILTER (contains(content, 'the')) AS lessons FROM found JOIN act USING (id) WHERE rank <= 5 AND score >= 0.05 GROUP BY query_id) SELECT query_id, evidence, lessons, round(0.4 * least(1.0, evidence / 5) + CASE WHEN lessons > 0 THEN 0.3 ELSE 0 END + CASE WHEN (SELECT count(*) FROM conf) = 0 THEN 0.3 ELSE 0 END, 3) AS replay_score FROM ev")(
    lambda t: plans.replayed(t.found(5), t.act, consolidate.conflicts(t.act), 5, ("the",))
)

# --- outcomes: orders are results of steps (priorities) for persons (customers)

_OUT = "WITH oc AS MATERIALIZED (SELECT o_orderkey AS id, lpad((o_custkey % 90)::VARCHAR, 2, '0') AS person, o_orderpriority AS step, o_orderstatus = 'F' AS ok, 1 + o_orderkey % 3 AS weight FROM orders) "


def _outcomes(s, d: str) -> DataFrame:
    rows = source.table(s, d, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), F.lpad((F.col("o_custkey") % 90).cast("string"), 2, "0").alias("person"), F.col("o_orderpriority").alias("step"), plans.noun_of(F.col("o_orderpriority")).alias("noun"), (F.col("o_orderstatus") == "F").alias("ok"), (1 + F.col("o_orderkey") % 3).alias("weight"))


plain("predict_step", _OUT + "SELECT step, round(p, 3) AS success_probability, round(2 * abs(p - 0.5), 3) AS confidence, trials FROM (SELECT step, sum(weight) FILTER (ok) / sum(weight) AS p, sum(weight)::BIGINT AS trials FROM oc GROUP BY step)")(lambda s, d: plans.predicted(_outcomes(s, d).select("step"), _outcomes(s, d)))
plain("sleep_replay", _OUT + "SELECT step AS noun, sum(weight) FILTER (ok)::BIGINT AS good, sum(weight)::BIGINT AS trials, '步骤“' || step || '”的历史成功率：' || sum(weight) FILTER (ok)::BIGINT || '/' || sum(weight)::BIGINT || '。' AS content FROM oc GROUP BY step HAVING sum(weight) >= 2")(lambda s, d: plans.consolidated_outcomes(_outcomes(s, d)))
plain("record_outcome", _OUT + """, pr AS (SELECT step, sum(weight) FILTER (ok) / sum(weight) AS p FROM oc GROUP BY step), rs AS (SELECT p_partkey, 'goal' || p_partkey AS goal, (SELECT list_sort(list(DISTINCT step)) FROM oc)[p_partkey % 5 + 1] AS step, p_partkey % 2 = 0 AS ok FROM part),
 er AS (SELECT *, abs(ok::INT - p) AS e FROM rs JOIN pr USING (step))
SELECT '项目“' || goal || '”的步骤“' || step || '”执行' || CASE WHEN ok THEN '成功' ELSE '失败' END || '。' AS content, round(least(0.95, 0.75 + 0.15 * e), 3) AS importance, (3 + (e >= 0.6)::INT)::INT AS cues FROM er""")(lambda s, d: _recorded(s, d))


def _recorded(s, d: str) -> DataFrame:
    steps = _outcomes(s, d).agg(F.sort_array(F.collect_set("step")).alias("steps"))  # five priorities
    rows = source.table(s, d, "part").crossJoin(F.broadcast(steps))
    results = rows.select(F.concat(F.lit("goal"), "p_partkey").alias("goal"), F.get("steps", (F.col("p_partkey") % 5).cast("int")).alias("step"), (F.col("p_partkey") % 2 == 0).alias("ok"), F.col("p_partkey").alias("input_pos"))
    return plans.recorded(results, _outcomes(s, d)).select("content", "importance", F.size("cues").alias("cues"))


#: Goals bring up memories whose second cue is a language; outcomes of languages order them.
_LANG = ", oc AS (SELECT id AS rec, substr(topic, 1, 2) AS person, cues[2] AS step, seq % 3 <> 0 AS ok, evidence_count AS weight FROM act) "


def _told(t: Tables) -> DataFrame:
    return t.act.select("id", F.substring(F.get("cues", 0), 1, 2).alias("person"), F.get("cues", 1).alias("step"), F.get("cues", 1).alias("noun"), (F.col("seq") % 3 != 0).alias("ok"), F.col("evidence_count").alias("weight"))


_PLANNED = _LANG + """, sm AS (SELECT person, step AS word, sum(CASE WHEN ok THEN weight ELSE -weight END) AS x FROM oc GROUP BY 1, 2),
 rw AS (SELECT query_id, rank, f.id, score, content, substr(topic, 1, 2) AS person FROM found f JOIN act USING (id) WHERE rank <= 5 AND NOT contains(content, '执行成功') AND NOT contains(content, '执行失败')),
 dl AS (SELECT query_id, id, max_by(x, (length(word), word)) AS x FROM rw JOIN sm USING (person) WHERE contains(content, word) GROUP BY 1, 2),
 planned AS MATERIALIZED (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY delta DESC, rank) - 1)::INT AS pos, id, round(score + delta, 4) AS score, delta, person, content FROM (SELECT rw.*, round(coalesce(greatest(-0.15, least(0.15, 0.08 * x)), 0.0), 6) AS delta FROM rw LEFT JOIN dl USING (query_id, id))) """


def _planned(t: Tables) -> DataFrame:
    return plans.planned(t.found(5), t.act, _told(t))


query("plan_for_goal", ASKED + _PLANNED + "SELECT query_id, pos, id, score, delta FROM planned", MEM + ", ")(lambda t: _planned(t).select("query_id", "pos", "id", "score", "delta"))
query("replan", ASKED + _PLANNED + """, bad AS (SELECT DISTINCT person FROM oc WHERE NOT ok AND step = 'en')
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY avoided, pos) - 1)::INT AS pos, id, avoided FROM (SELECT *, contains(content, 'en') AND ((SELECT count(*) FROM bad) = 0 OR person IN (SELECT person FROM bad)) AS avoided FROM planned)""", MEM + ", ")(
    lambda t: plans.replanned(_planned(t), t.asked().select("query_id", F.lit("en").alias("failed_step")), _told(t))
)
query("plan_rehearsal", ASKED + _PLANNED + """, pp AS (SELECT query_id, p.id, sum(weight) FILTER (ok) / sum(weight) AS p FROM planned p JOIN oc ON oc.person = p.person AND contains(content, step) GROUP BY 1, 2)
SELECT query_id, pos, id, round(p, 3) AS success_probability, round(2 * abs(p - 0.5), 3) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY p, pos) = 1 AS weakest FROM (SELECT pl.query_id, pos, pl.id, coalesce(CASE WHEN pp.id IS NOT NULL THEN coalesce(p, 0.0) END, 0.5) AS p FROM planned pl LEFT JOIN pp USING (query_id, id))""", MEM + ", ")(lambda t: plans.rehearsed(_planned(t), _told(t)))

# --- practice

_FELT_IN = "coalesce(affect IN ('positive', 'negative', 'arousing'), false)"
_TRIED = f"CASE WHEN {TRIES} > 0 THEN retrieval_successes / {TRIES} ELSE 0.5 END"
_CARDS = f""", hd AS MATERIALIZED (SELECT *, round(abs(r - 0.45), 9) AS hard, {_FELT_IN} AS felt FROM act),
 p1 AS (SELECT *, 0 AS late FROM hd WHERE r < 0.5 ORDER BY hard, seq DESC LIMIT 20), p2 AS (SELECT *, 1 AS late FROM (SELECT * FROM hd WHERE r < 0.65 ORDER BY hard, seq DESC LIMIT 20) WHERE felt AND id NOT IN (SELECT id FROM p1) ORDER BY hard, seq DESC LIMIT 5),
 cd AS (SELECT *, row_number() OVER (ORDER BY (NOT felt)::INT, late, hard, seq DESC) AS k FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) WHERE {IDLE} >= 24.0 * CASE WHEN {TRIES} > 0 AND {_TRIED} < 0.5 THEN 0.6 WHEN {TRIES} > 0 AND {_TRIED} >= 0.9 THEN 1.3 ELSE 1.0 END),
 lp AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY k) AS lap FROM cd WHERE k <= 10),
 cards AS MATERIALIZED (SELECT *, CASE WHEN len(cues) >= 3 THEN cues[{TRIES} % len(cues) + 1] || ' / ' || cues[({TRIES} + 1) % len(cues) + 1] ELSE array_to_string(cues[1:2], ' / ') END AS cue, row_number() OVER (ORDER BY lap, k)::INT AS turn FROM lp) """
query("practice_due", _CARDS + "SELECT id, cue, turn FROM cards")(lambda t: practice.due(t.act, t.now, 10))
query("practice_plan", _CARDS + f"SELECT id, cue, kind, epoch({DUE_AT})::BIGINT AS next_review_s, {DUE_AT} < {TS} AS overdue, round(r, 6) AS retrievability, round({_TRIED}, 6) AS success_rate FROM cards")(lambda t: practice.plan(practice.due(t.act, t.now, 10), t.act, t.now))
query("practice_forecast", f"SELECT id, epoch(due)::BIGINT AS due_s, due < {TS} AS overdue, round(r, 6) AS retrievability FROM (SELECT *, {DUE_AT} AS due FROM act) WHERE due <= {TS} + to_days(7)")(lambda t: practice.forecast(t.act, t.now))
query("practice_report", "SELECT count(*) AS n, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, round(count(*) FILTER (ok) / count(*), 3) AS success_rate, round(avg(r), 3) AS mean_retrievability, round(min(r), 3) AS min_retrievability, round(max(r), 3) AS max_retrievability FROM (SELECT r, seq % 2 = 0 AND length(regexp_replace(content, '\\s+', '', 'g')) > 0 AS ok FROM act)")(
    lambda t: practice.report(t.act, t.act.select("id", F.when(F.col("seq") % 2 == 0, F.col("content")).otherwise("§").alias("attempt")), t.now)
)
_REPORT = "SELECT count(*) AS n, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, round(count(*) FILTER (ok) / count(*), 3) AS success_rate, round(avg(r), 3) AS mean_retrievability, round(min(r), 3) AS min_retrievability, round(max(r), 3) AS max_retrievability FROM (SELECT r, seq % 2 = 0 AND length(regexp_replace(content, '\\s+', '', 'g')) > 0 AS ok FROM act)"
query("practice_session", _CARDS + f""", rp AS ({_REPORT})
SELECT 'plan' AS part, id, cue AS detail, round(r, 6)::DOUBLE AS value FROM cards
UNION ALL SELECT 'report', NULL, unnest(['n', 'successes', 'failures', 'success_rate', 'mean_retrievability', 'min_retrievability', 'max_retrievability']), unnest([n, successes, failures, success_rate, mean_retrievability, min_retrievability, max_retrievability]::DOUBLE[]) FROM rp""")(
    lambda t: practice.session(t.act, t.act.select("id", F.when(F.col("seq") % 2 == 0, F.col("content")).otherwise("§").alias("attempt")), t.now, 10)
)
query("review_batch", """, an AS (SELECT 'd' || (event_id % (SELECT n FROM cnt)) AS id, event_id AS pos, event_type <> 'error' AS ok FROM events),
 sm AS (SELECT id, count(*) AS reviews, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (pos > coalesce(lf, -1)) AS tail FROM (SELECT *, max(pos) FILTER (NOT ok) OVER (PARTITION BY id) AS lf FROM an) GROUP BY id)
SELECT id, reviews, retrieval_successes + good AS retrieval_successes, retrieval_failures + bad AS retrieval_failures, CASE WHEN bad = 0 THEN review_streak + good ELSE tail END::DOUBLE AS review_streak FROM act JOIN sm USING (id)""")(lambda t: _batch(t))


def _batch(t: Tables) -> DataFrame:
    n = source.table(t.spark, t.dir, "documents").count()
    rows = source.table(t.spark, t.dir, "events")
    return practice.review_batch(t.act, rows.select(F.concat(F.lit("d"), (F.col("event_id") % n).cast("string")).alias("id"), F.col("event_id").alias("pos"), (F.col("event_type") != "error").alias("success")))


# --- graph

query("association_report", ", cn AS (SELECT count(DISTINCT src) AS connected, count(*) AS ends FROM both_ways) SELECT (SELECT count(*) FROM act) AS memories, connected, (SELECT count(*) FROM act) - connected AS isolated, (ends / 2)::BIGINT AS pairs, round(ends / (SELECT count(*) FROM act), 6) AS average FROM cn")(lambda t: graph.association_report(t.act, t.links()))
_COMMUNITY = ", lab AS (SELECT src AS node, src AS label FROM both_ways UNION SELECT b.src, l.label FROM lab l JOIN both_ways b ON b.dst = l.node WHERE l.label < b.src), cm AS MATERIALIZED (SELECT node AS id, min(label) AS community FROM lab GROUP BY node)"
query("community_report", _COMMUNITY + """, cc AS (SELECT community, cue, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, cue) AS k FROM cm JOIN cues USING (id) GROUP BY 1, 2),
 mb AS (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY seq) AS k FROM cm JOIN act USING (id))
SELECT community, count(*) AS size, (SELECT array_to_string(list(id ORDER BY k), ',') FROM mb WHERE mb.community = cm.community AND k <= 4) AS members, (SELECT array_to_string(list(cue ORDER BY k), ',') FROM cc WHERE cc.community = cm.community AND k <= 3) AS top_cues FROM cm GROUP BY community""")(lambda t: _communities(t))


def _communities(t: Tables) -> DataFrame:
    shared.shared_dir(t.spark)
    return graph.community_report(t.act, t.linked)


_HOPS = ", hop1 AS (SELECT DISTINCT dst FROM both_ways WHERE src = 'd1' AND dst <> 'd1'), hop2 AS (SELECT DISTINCT b.dst FROM hop1 h JOIN both_ways b ON b.src = h.dst WHERE b.dst <> 'd1' AND b.dst NOT IN (SELECT dst FROM hop1))"
query("related_ring", _HOPS + " SELECT id FROM act JOIN hop2 ON id = dst ORDER BY seq, content LIMIT 50")(lambda t: graph.related(t.linked, t.act, "d1", 2))
query("multi_hop_report", _HOPS + " SELECT 1 AS hop, count(*) AS n, array_to_string(list_sort(list(dst)), ',') AS ids FROM hop1 HAVING count(*) > 0 UNION ALL SELECT 2, count(*), array_to_string(list_sort(list(dst)), ',') FROM hop2 HAVING count(*) > 0")(lambda t: graph.hop_report(t.linked, ["d1"], 2))
plain("event_chain", "SELECT id, lead(id) OVER (PARTITION BY person, session ORDER BY day, seq) AS next_id FROM (SELECT 'o' || o_orderkey AS id, o_orderkey AS seq, o_custkey AS person, (o_orderkey % 4) AS session, o_orderdate::DATE AS day FROM orders)")(lambda s, d: _chain(s, d))


def _chain(s, d: str) -> DataFrame:
    """Orders as episodes of their customers: the date stands in the text, the session in a cue."""
    o = source.table(s, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.lit("episodic").alias("kind"), F.concat(F.lit("ordered on "), day).alias("content"), F.array(F.concat(F.lit("session"), F.col("o_orderkey") % 4), F.concat(F.lit("c"), "o_custkey")).alias("cues"))
    return graph.event_chain(rows).select("id", "next_id")


# --- night

query("rem_resolve", _CONFLICTS + ", nn AS (SELECT id, count(*) AS n FROM (SELECT unnest([id_a, id_b]) AS id FROM conf WHERE id_a IN (SELECT id FROM act WHERE confidence > 0.5) AND id_b IN (SELECT id FROM act WHERE confidence > 0.5)) GROUP BY id) SELECT id, round(greatest(0.4, confidence - 0.1 * n), 6) AS confidence FROM act JOIN nn USING (id)")(lambda t: consolidate.rem_resolved(t.act, consolidate.conflicts(t.act)))
query("reflect", ", ep AS (SELECT l.src AS fact, e.seq, e.created_at, e.content FROM both_ways l JOIN act f ON f.id = l.src AND f.kind = 'semantic' AND f.evidence_count >= 2 JOIN act e ON e.id = l.dst AND e.kind = 'episodic'), kk AS (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY seq) AS k FROM ep) SELECT fact AS id, count(*) AS n, sha256(array_to_string(list(content ORDER BY created_at, seq), '|')) AS digest FROM kk WHERE k <= 20 GROUP BY fact HAVING count(*) >= 2")(
    lambda t: consolidate.reflections(t.act, t.linked).select("id", "n", F.sha2(F.array_join("contents", "|"), 256).alias("digest"))
)

# --- insights

query("compare_memories", """, pr AS (SELECT a.id AS a, b.id AS b FROM act a JOIN act b ON b.id = 'd' || (a.seq + 49)), ws AS MATERIALIZED (SELECT id, list_distinct(w) AS w, cues, content FROM act),
 cp AS (SELECT a, b, len(list_intersect(x.w, y.w)) / greatest(1, least(len(x.w), len(y.w))) AS o, len(list_intersect(x.cues, y.cues)) AS c, x.content <> y.content AS differ FROM pr JOIN ws x ON x.id = a JOIN ws y ON y.id = b)
SELECT a, b, round(o, 3) AS overlap, c::INT AS shared_cues, CASE WHEN o >= 0.6 THEN 'duplicate' WHEN c > 0 AND differ THEN 'conflict' ELSE 'distinct' END AS verdict FROM cp""")(
    lambda t: insights.compared(t.act.select(F.col("id").alias("a"), F.concat(F.lit("d"), F.col("seq") + 49).alias("b")).join(t.act.select(F.col("id").alias("b")), "b"), t.act)
)
_CL = ", cl AS MATERIALIZED (SELECT (seq // 40)::BIGINT AS cluster, act.* FROM act)"


def _clusters(t: Tables) -> DataFrame:
    return t.act.select(F.floor(F.col("seq") / 40).alias("cluster"), "id")


query("summarize_cluster", _CL + """, cn AS (SELECT cluster, count(*) AS m FROM cl GROUP BY cluster), cc AS (SELECT cluster, cue FROM (SELECT cluster, id, unnest(cues) AS cue FROM cl) JOIN cn USING (cluster) GROUP BY 1, 2 HAVING count(DISTINCT id) = any_value(m)),
 tt AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, term) AS k FROM (SELECT cluster, unnest(w) AS term FROM cl) GROUP BY 1, 2)
SELECT cluster, count(*) AS memories, sum(evidence_count)::BIGINT AS evidence, sum(length(content))::BIGINT AS chars, coalesce((SELECT array_to_string(list_sort(list(cue)), ',') FROM cc WHERE cc.cluster = cl.cluster), '') AS common_cues, coalesce((SELECT array_to_string(list(term ORDER BY k), ',') FROM tt WHERE tt.cluster = cl.cluster AND k <= 6), '') AS top_terms FROM cl GROUP BY cluster""")(lambda t: insights.clusters(_clusters(t), t.act))
query("session_summary", _CL + """, fk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY seq) AS k, list_distinct(w) AS dw FROM cl),
 pr AS (SELECT a.cluster, len(list_intersect(a.dw, b.dw)) / greatest(1, least(len(a.dw), len(b.dw))) AS o, len(list_intersect(a.cues, b.cues)) AS c, a.content <> b.content AS differ FROM fk a JOIN fk b ON a.cluster = b.cluster AND a.k < b.k WHERE a.k <= 20 AND b.k <= 20),
 ps AS (SELECT cluster, least(5, count(*) FILTER (o < 0.6 AND c > 0 AND differ)) AS conflicts, least(5, count(*) FILTER (o >= 0.6)) AS duplicates FROM pr GROUP BY cluster)
SELECT cluster, count(*) AS total, count(*) FILTER (kind = 'semantic') AS facts, count(*) FILTER (kind = 'episodic') AS events, coalesce(any_value(conflicts), 0) AS conflicts, coalesce(any_value(duplicates), 0) AS duplicates FROM cl LEFT JOIN ps USING (cluster) GROUP BY cluster""")(lambda t: insights.sessions(_clusters(t), t.act))
_META = f", mt AS (SELECT topic, round(sum(confidence * {TRIES}) / sum({TRIES}) - sum(retrieval_successes) / sum({TRIES}), 6) AS gap FROM act WHERE {TRIES} > 0 GROUP BY topic)"
_SNAP = f"(SELECT count(*) AS memories, round(avg(r), 3) AS avg_retrievability, round(count(*) FILTER ({TRIES} > 0) / count(*), 3) AS reviewed_ratio, round(avg(round(importance * (1 - least(1.0, r)), 3)), 3) AS avg_risk FROM act), (SELECT round(1 - coalesce(avg(abs(gap)), 0), 3) AS calibration_score, count(*) AS topics FROM mt)"
query("retrieval_snapshot", _META + f" SELECT * FROM {_SNAP}")(lambda t: insights.snapshot(t.act, t.now))
query("reconsolidation_plan", """, tg AS (SELECT * FROM act WHERE seq % 50 = 1), nr AS (SELECT DISTINCT g.id, g.content_hash AS h, a.id AS o, a.content_hash AS oh FROM (SELECT id, content_hash, unnest(cues) AS cue FROM tg) g JOIN cues c USING (cue) JOIN act a ON a.id = c.id WHERE a.id <> g.id)
SELECT tg.id, coalesce(related, 0) AS related, coalesce(conflicts, 0) AS conflicts, round(r, 6) AS retrievability, coalesce(conflicts, 0) > 0 AS ready FROM tg LEFT JOIN (SELECT id, count(*) AS related, least(5, count(*) FILTER (h <> oh)) AS conflicts FROM nr GROUP BY id) n USING (id)""")(lambda t: insights.reconsolidation(t.act.where("seq % 50 = 1").select("id"), t.act, t.now))
query("analogy_bridge", """, sp AS MATERIALIZED (SELECT id, topic, cues, list_distinct(w) AS w, contains(content, 'lead') OR contains(content, 'cause') AS rel FROM act ORDER BY sha256(id) LIMIT 60),
 sc AS (SELECT a.id AS a, b.id AS b, round(least(1.0, 0.4 * coalesce(len(list_intersect(a.cues, b.cues)) / nullif(len(list_distinct(list_concat(a.cues, b.cues))), 0), 0) + 0.6 * coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0) + CASE WHEN a.rel AND b.rel THEN 0.2 ELSE 0 END), 3) AS structure FROM sp a JOIN sp b ON a.id < b.id AND a.topic <> b.topic)
SELECT * FROM sc WHERE structure >= 0.1""")(lambda t: insights.analogies(t.act, least=0.1, relations=("lead", "cause")))
_MAST = f", ms AS MATERIALIZED (SELECT topic, round(0.5 * acc + 0.3 * rr + 0.2 * least(1.0, n / 3), 6) AS mastery FROM (SELECT topic, count(*) AS n, avg(least(1.0, r)) AS rr, CASE WHEN sum({TRIES}) >= 3 THEN sum(retrieval_successes) / sum({TRIES}) ELSE avg(confidence) END AS acc FROM act GROUP BY topic))"
query("transfer_prompt", _MAST + ", tp AS (SELECT * FROM ms ORDER BY (mastery >= 0.7) DESC, mastery DESC, topic LIMIT 3) SELECT topic, mastery, (SELECT max_by(id, seq) FROM act a WHERE a.topic = tp.topic) AS id FROM tp WHERE mastery >= 0.7 OR NOT EXISTS (SELECT 1 FROM tp t2 WHERE t2.mastery >= 0.7)")(lambda t: insights.prompts(t.act, t.now))
query("goal_progress", _MAST + ", gl AS (SELECT 'src' || g AS goal FROM unnest([1, 2, 30, 999]) AS u(g)), bb AS (SELECT goal, max_by({'topic': topic, 'mastery': mastery}, (mastery, topic)) AS b FROM gl LEFT JOIN ms ON contains(lower(topic), goal) OR contains(goal, lower(topic)) GROUP BY goal) SELECT goal, b.topic AS topic, coalesce(b.mastery, 0.0) AS mastery, CASE WHEN coalesce(b.mastery, 0.0) >= 0.7 THEN 'mastered' WHEN coalesce(b.mastery, 0.0) >= 0.4 THEN 'in_progress' ELSE 'not_started' END AS status FROM bb")(
    lambda t: insights.goal_progress(t.spark.createDataFrame([("src1",), ("src2",), ("src30",), ("src999",)], "goal string"), t.act, t.now)
)
query("pre_sleep_review", "SELECT id, importance, round(r, 6) AS retrievability FROM act WHERE importance >= 0.6 AND r < 0.5 ORDER BY importance DESC, seq DESC LIMIT 5")(lambda t: insights.before_sleep(t.act, t.now))
query("sleep_advice", _CONFLICTS + f", od AS (SELECT count(*) AS overdue_intents FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 50 <> 0 AND o_orderdate <= {_IN}) SELECT (SELECT count(*) FROM (SELECT 1 FROM act WHERE importance >= 0.6 AND r < 0.5 LIMIT 5)) AS to_review, (SELECT count(*) FROM conf) AS conflicts, overdue_intents, (SELECT count(*) FROM (SELECT topic FROM act GROUP BY topic HAVING count(last_review_at) = 0)) AS unreviewed_topics FROM od")(
    lambda t: insights.sleep_advice(t.act, consolidate.conflicts(t.act), planning.due_intents(t.intents(), _then()), t.now)
)
query("sleep_inference", ", pr AS (SELECT a.topic, count(*) AS pairs FROM act a JOIN act b ON a.topic = b.topic AND a.seq < b.seq AND a.content_hash <> b.content_hash GROUP BY 1) SELECT topic, pairs, pairs AS ready FROM pr ORDER BY ready DESC, topic LIMIT 20")(lambda t: insights.sleep_pairs(t.act, t.now))
query("schema_fit", """, sz AS (SELECT topic FROM act GROUP BY topic HAVING count(*) >= 2), cw AS MATERIALIZED (SELECT id, topic, unnest(cues) AS x FROM act), tw AS MATERIALIZED (SELECT id, topic, unnest(list_distinct(w)) AS x FROM act),
 pc AS MATERIALIZED (SELECT topic, x, count(*) AS n FROM cw WHERE topic IN (SELECT topic FROM sz) GROUP BY 1, 2), pt AS MATERIALIZED (SELECT topic, x, count(*) AS n FROM tw WHERE topic IN (SELECT topic FROM sz) GROUP BY 1, 2),
 idt AS MATERIALIZED (SELECT a.id, a.topic AS home, s.topic FROM act a, sz s),
 fc AS (SELECT i.id, i.topic, count(*) FILTER (n - (home = i.topic)::INT > 0) AS both, any_value(sz) AS size, any_value(whole) - count(*) FILTER (home = i.topic AND n = 1) AS whole FROM idt i JOIN cw ON cw.id = i.id LEFT JOIN pc ON pc.topic = i.topic AND pc.x = cw.x JOIN (SELECT id, count(*) AS sz FROM cw GROUP BY id) q ON q.id = i.id JOIN (SELECT topic, count(*) AS whole FROM pc GROUP BY topic) u ON u.topic = i.topic GROUP BY 1, 2),
 ft AS (SELECT i.id, i.topic, count(*) FILTER (n - (home = i.topic)::INT > 0) AS both, any_value(sz) AS size, any_value(whole) - count(*) FILTER (home = i.topic AND n = 1) AS whole FROM idt i JOIN tw ON tw.id = i.id LEFT JOIN pt ON pt.topic = i.topic AND pt.x = tw.x JOIN (SELECT id, count(*) AS sz FROM tw GROUP BY id) q ON q.id = i.id JOIN (SELECT topic, count(*) AS whole FROM pt GROUP BY topic) u ON u.topic = i.topic GROUP BY 1, 2),
 fits AS (SELECT id, topic, round(least(1.0, 0.6 * coalesce(fc.both / nullif(fc.size + fc.whole - fc.both, 0), 0) + 0.4 * coalesce(ft.both / nullif(ft.size + ft.whole - ft.both, 0), 0)), 6) AS fit FROM idt LEFT JOIN fc USING (id, topic) LEFT JOIN ft USING (id, topic)),
 bs AS (SELECT id, max_by(topic, (fit, topic)) AS best_schema, max(fit) AS fit FROM fits WHERE fit > 0 GROUP BY id)
SELECT act.id, best_schema, coalesce(fit, 0.0) AS fit, CASE WHEN fit >= 0.5 THEN 'assimilate' WHEN fit >= 0.3 THEN 'borderline' ELSE 'accommodate' END AS state FROM act LEFT JOIN bs USING (id)""")(lambda t: fits.schema_fit(t.act))
plain("intent_clashes", "WITH " + _CLASHES + " SELECT clashes FROM cl")(lambda s, d: planning.clash_count(Tables(s, d).intents()))
query("memory_health", _CONFLICTS + f""", {_CLASHES}, sz AS (SELECT (SELECT count(*) FROM act) AS n, (SELECT count(DISTINCT src) FROM both_ways) AS linked, (SELECT count(*) FROM (SELECT cue FROM cues GROUP BY cue HAVING count(*) >= 3)) AS crowded, (SELECT count(*) FROM conf) AS conflicts,
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 50 <> 0 AND o_orderdate <= {_IN}) AS overdue_intents, (SELECT clashes FROM cl) AS intent_clashes, (SELECT count(*) FROM act WHERE seq % 500 = 0) AS suppressed)
SELECT *, greatest(0, 100 - (least(20, round_even(round((1.0 - round(linked / greatest(1, n), 3)) * 50, 6), 0)::INT) + least(15, 3 * crowded) + least(20, 4 * conflicts) + least(10, 2 * overdue_intents) + least(10, 3 * intent_clashes) + least(5, suppressed)))::BIGINT AS score FROM sz""")(
    lambda t: _health(t)
)


def _health(t: Tables) -> DataFrame:
    mem = shared.written(t.act.select("id", "seq", "cues"), "health")  # all but conflicts read no more of memories
    return insights.health(mem, graph.linked_ids(mem), consolidate.conflicts(t.act), planning.due_intents(t.intents(), _then()), planning.clash_count(t.intents()), mem.where("seq % 500 = 0"))


query("weekly_review", _META + f" SELECT memories, avg_risk, calibration_score, topics, weak_topics FROM (SELECT memories, avg_risk, calibration_score FROM {_SNAP}), (SELECT count(*) AS topics, count(*) FILTER (s < 0.5) AS weak_topics FROM (SELECT count(last_review_at) / count(*) AS s FROM act GROUP BY topic))")(lambda t: insights.weekly(t.act, t.now))
query("nightly_routine", f"(SELECT 'tonight' AS slot, id FROM (SELECT *, round(least(1.0, 0.4 * importance + 0.3 * {_FELT_IN}::INT + 0.3 * CASE WHEN r < 0.6 THEN 0.5 ELSE 0 END), 6) AS p FROM act) ORDER BY p DESC, seq DESC LIMIT 3) UNION ALL (SELECT 'tomorrow', id FROM act ORDER BY importance DESC, seq DESC LIMIT 3)")(lambda t: insights.nightly(t.act, t.now))
query("working_set_budget", ", ws AS (SELECT * FROM act WHERE last_access_at IS NOT NULL ORDER BY last_access_at DESC, seq DESC LIMIT 8) SELECT topic, count(*) AS n, round((SELECT count(*) FROM ws) / 7, 3) AS load_ratio, CASE WHEN (SELECT count(*) FROM ws) > 7 THEN 'overloaded' WHEN (SELECT count(*) FROM ws) > 4 THEN 'optimal' ELSE 'underutilized' END AS verdict FROM ws GROUP BY topic")(lambda t: insights.budget(t.act))
query("learning_loop", _META + _MAST + f" SELECT (SELECT min_by(topic, (mastery, topic)) FROM ms) AS focus, (SELECT count(*) FROM act WHERE last_review_at IS NOT NULL AND {DUE_AT} < {TS}) AS overdue, memories, topics FROM {_SNAP}")(lambda t: practice.learning_loop(t.act, t.now).select("focus", "overdue", "memories", "topics"))

# --- vectors and texts

plain("dense_pass", "WITH nr AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.label < 5) SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS rank FROM nr) WHERE rank <= 24")(lambda s, d: _dense(s, d))


def _dense(s, d: str) -> DataFrame:
    rows = source.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return vector.dense_pass(rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), rows.where("label < 5"), rows.select("id", "vector"))


query("synonyms", ASKED + "SELECT query_id, len(base)::INT AS base FROM qs", MEM + ", ")(lambda t: t.asked().select("query_id", F.size(F.array_distinct(text.tokenize(F.col("query")))).alias("base")))
