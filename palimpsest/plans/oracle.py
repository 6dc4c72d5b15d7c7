"""DuckDB SQL of the memory view and of the queries over it."""

from __future__ import annotations

from palimpsest.functions import lexicon as L
from palimpsest.sources.memories import NOW

TS = f"TIMESTAMP '{NOW}'"


def strings(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


STOP = strings(L.STOPWORDS)
AROUSED = "(" + ", ".join(f"'{a}'" for a in L.AROUSED) + ")"
COMPOUND = "[a-z0-9]+(?:[-_][a-z0-9]+)+"


def tokens(x: str) -> str:
    low = f"lower({x})"
    return (
        f"list_concat(list_filter(regexp_extract_all({low}, '{COMPOUND}'), lambda t: NOT list_contains({STOP}, t)), "
        f"list_filter(regexp_extract_all(regexp_replace({low}, '{COMPOUND}', ' ', 'g'), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t)))"
    )


def hours(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 3.6e9)"


RATE = f"(CASE WHEN affect IN {AROUSED} AND review_streak < 3 THEN {L.DECAY_RATE} * 0.6 ELSE {L.DECAY_RATE} END)"
IDLE = f"greatest(0.0, {hours('coalesce(last_access_at, created_at)', TS)})"

MEM = f"""WITH RECURSIVE cnt AS (SELECT count(*) AS n FROM documents),
usage AS (SELECT event_id % (SELECT n FROM cnt) AS doc_id, max(ts) AS last_access_at, count(*) AS access_count,
    count(*) FILTER (event_type IN ('purchase', 'signup')) AS retrieval_successes, count(*) FILTER (event_type = 'error') AS retrieval_failures
  FROM events GROUP BY 1),
toks AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS w FROM documents),
good AS MATERIALIZED (SELECT doc_id, w, list_filter(w, lambda t: length(t) >= 2 AND NOT (regexp_full_match(t, '[a-z0-9]+') AND length(t) < 4)) AS g FROM toks),
firsts AS MATERIALIZED (SELECT doc_id, w, list_filter(g, lambda t, i: list_position(g, t) = i)[1:3] AS c3 FROM good),
mem AS MATERIALIZED (
  SELECT 'd' || doc_id AS id, doc_id + 1 AS seq, CASE WHEN doc_id % 4 = 0 THEN 'semantic' ELSE 'episodic' END AS kind, text AS content,
    sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS content_hash,
    {strings(L.ORIGINS)}[doc_id % 5 + 1] AS origin, 0.5::DOUBLE + 0.02::DOUBLE * substr(source, 4)::INT AS trust,
    list_filter(list_concat([source, lang], c3), lambda t, i: list_position(list_concat([source, lang], c3), t) = i) AS cues,
    {TS} - to_days((doc_id % 60)::INT) - to_hours((doc_id % 24)::INT) AS created_at, last_access_at,
    CASE WHEN doc_id % 3 = 0 THEN {TS} - to_days((doc_id % 60 - 1)::INT) - to_hours((doc_id % 24)::INT) END AS last_review_at,
    coalesce(access_count, 0) AS access_count, coalesce(retrieval_successes, 0) AS retrieval_successes, coalesce(retrieval_failures, 0) AS retrieval_failures,
    least(greatest(round(0.2::DOUBLE + 0.6::DOUBLE * coalesce(quality, 0) + 0.01::DOUBLE * (doc_id % 20), 2), 0), 1) AS importance,
    0.5::DOUBLE + 0.05::DOUBLE * (doc_id % 10) AS strength, 0.8::DOUBLE + 0.1::DOUBLE * (doc_id % 8) AS storage_strength,
    0.4::DOUBLE + 0.06::DOUBLE * (doc_id % 11) AS confidence, CASE WHEN doc_id % 19 = 0 THEN 'recycled' ELSE 'active' END AS status,
    CASE WHEN toxic = 1 THEN 'negative' WHEN doc_id % 17 = 0 THEN 'positive' END AS affect, 1 + doc_id % 5 AS evidence_count,
    (doc_id % 4)::DOUBLE AS review_streak, CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS revision_count, w
  FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN usage USING (doc_id) LEFT JOIN firsts USING (doc_id)),
act AS MATERIALIZED (SELECT *, strength * storage_strength * exp(-{RATE} * {IDLE}) AS r, cues[1] AS topic FROM mem WHERE status = 'active'),
terms AS MATERIALIZED (SELECT id, unnest(list_distinct(list_concat(w, flatten(list_transform(cues, lambda c: {tokens('c')}))))) AS term FROM act),
cues AS MATERIALIZED (SELECT id, seq, unnest(cues) AS cue, generate_subscripts(cues, 1) - 1 AS pos FROM act),
rare AS (SELECT cue FROM cues GROUP BY cue HAVING count(*) <= greatest(200, (SELECT count(*) FROM act) // 100)),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.seq AS b_seq FROM cues a JOIN cues b ON a.cue = b.cue AND a.id <> b.id WHERE a.cue IN (SELECT cue FROM rare) GROUP BY ALL),
links AS MATERIALIZED (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst, 1.0::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b_seq DESC) AS k FROM near) WHERE k <= 64),
both_ways AS MATERIALIZED (SELECT src, dst, weight FROM links UNION ALL SELECT dst, src, weight FROM links)
"""

DUE_AT = f"(coalesce(last_review_at, {TS}) + to_microseconds(round(24.0 * pow(2.0, CASE WHEN review_streak < 1 THEN greatest(-2.0, review_streak - 1) ELSE least(review_streak - 1, 8.0) END) * 3600000000)::BIGINT))"
INTERVAL = "24.0 * pow(2.0, CASE WHEN review_streak < 1 THEN greatest(-2.0, review_streak - 1) ELSE least(review_streak - 1, 8.0) END)"
TRIES = "(retrieval_successes + retrieval_failures)"

_MOODS = {m: "regexp_matches(low, '" + "|".join(w) + "')" for m, w in L.MOODS.items()}
MOOD = "CASE WHEN " + " + ".join(f"{x}::INT" for x in _MOODS.values()) + " = 1 THEN CASE " + " ".join(f"WHEN {x} THEN '{m}'" for m, x in _MOODS.items()) + " END END"

#: Queries of recall: the benchmark's texts.
ASKED = f"""qs AS MATERIALIZED (SELECT item_id AS query_id, list_distinct({tokens('text')}) AS base, lower(text) AS low FROM benchmark),
qt AS MATERIALIZED (SELECT query_id, len(base) AS nq, unnest(base) AS term FROM qs),
n AS (SELECT count(*) AS n FROM act),
dfs AS MATERIALIZED (SELECT term, count(*) AS df, least(greatest(0.0, ln(((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5))), 4.0) AS idf FROM terms WHERE term IN (SELECT term FROM qt) GROUP BY term),
qavg AS MATERIALIZED (SELECT query_id, sum(coalesce(idf, 0)) / count(*) AS idf_avg FROM qt LEFT JOIN dfs USING (term) GROUP BY query_id),
hits AS MATERIALIZED (SELECT query_id, id, nq, count(*) AS hits, sum(idf) AS idf_hits, count(*) FILTER (df <= 5000 OR (SELECT n FROM n) < 1000) AS brought FROM qt JOIN terms USING (term) JOIN dfs USING (term) GROUP BY ALL),
best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(idf_hits, 9) DESC, id) AS k FROM hits WHERE brought > 0),
sizes AS MATERIALIZED (SELECT id, count(*) AS ni FROM terms GROUP BY id),
rows0 AS MATERIALIZED (SELECT *, hits / greatest(1.0, sqrt(greatest(1, nq) * least(ni, greatest(nq * 2, 8)))) AS lap FROM best JOIN qavg USING (query_id) JOIN sizes USING (id) JOIN act USING (id) JOIN (SELECT query_id, low FROM qs) USING (query_id) WHERE k <= 100),
scored AS MATERIALIZED (SELECT *, round(0.40 * lap * CASE WHEN idf_avg > 0 AND idf_hits > 0 THEN least(1.0 + 0.5 * (idf_hits / greatest(idf_avg, 1e-6) - 1.0), 2.0) ELSE 1.0 END
   + 0.25 * least(1.0, r) + 0.20 * importance + 0.06 * trust + 0.05 * confidence + CASE WHEN affect IN {AROUSED} THEN 0.05 ELSE 0 END + CASE WHEN evidence_count >= 3 THEN 0.03 ELSE 0 END
   + CASE WHEN kind = 'episodic' AND (contains(low, 'after') OR contains(low, 'next') OR contains(low, 'then')) THEN 0.05 ELSE 0 END
   + CASE WHEN evidence_count > 1 THEN least(0.08, 0.02 * (evidence_count - 1)) ELSE 0 END
   + CASE WHEN affect = {MOOD} THEN 0.05 ELSE 0 END
   + CASE WHEN kind = 'semantic' AND regexp_matches(low, 'what is|what''s|favorite|prefers|which is|who is|when is') THEN 0.03 ELSE 0 END, 6) AS score FROM rows0),
ranked AS MATERIALIZED (SELECT query_id, id, score, round(lap, 6) AS overlap, round(r, 6) AS retrievability, row_number() OVER w AS rank, lead(score, 1, -1.0) OVER w AS nxt
  FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, seq DESC)),
found AS MATERIALIZED (SELECT query_id, rank, id, score, overlap, retrievability, rank = 1 AND score >= 0.45 AND score - nxt >= 0.03 AS confident FROM ranked WHERE rank <= 10)
"""

#: The same where every memory that has a term of a query is a candidate, however common the term is.
ASKED_ALL = ASKED.replace(", count(*) FILTER (df <= 5000 OR (SELECT n FROM n) < 1000) AS brought", "").replace(" WHERE brought > 0", "")
#: And where all candidates are scored.
ASKED_WHOLE = ASKED_ALL.replace(" WHERE k <= 100", "")
