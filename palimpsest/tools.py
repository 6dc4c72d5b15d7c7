"""Named tools over a store's memories: one callable for each, with bounded arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import numeric, text
from palimpsest.operators import anchors, audits, chains, composed, consolidate, dated, fits, graph, index, ingest, insights, planning, plans, practice, recall, reports, review, vector
from palimpsest.sources import memories as source

#: The least and most of numeric arguments.
BOUNDS = {"top_k": (1, 500), "limit": (1, 5000), "days": (1, 3650)}


def bounded(name: str, value: int) -> int:
    low, high = BOUNDS[name]
    return max(low, min(high, int(value)))


class Toolbox:
    """Tools over one table of memories at one instant; each returns a DataFrame and changes nothing."""

    def __init__(self, spark: SparkSession, mem: DataFrame, at: str = source.NOW, intents: DataFrame | None = None) -> None:
        self.spark, self.mem, self.now, self.intents = spark, mem, source.now(at), intents
        self.act = source.active(mem)
        self._links: DataFrame | None = None

    @property
    def links(self) -> DataFrame:
        if self._links is None:
            self._links = graph.batch_links(self.act)
        return self._links

    def _asked(self, queries: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")

    def recall(self, query: str, top_k: int = 5) -> DataFrame:
        return self.search_batch([query], top_k)

    def search_batch(self, queries: list[str], top_k: int = 5) -> DataFrame:
        return recall.recall(self._asked(queries), self.act, self.now, bounded("top_k", top_k))

    def _answers(self, answers) -> DataFrame:
        """Attempts as rows; of several of one memory the last counts."""
        last = {x["id"]: x.get("attempt", "") for x in answers}
        return self.spark.createDataFrame(list(last.items()), "id string, attempt string")

    def recall_trace(self, query: str) -> DataFrame:
        """How many memories each stage of a recall leaves."""
        items = index.stored_terms(self.act)
        asked = self._asked([query])
        return audits.recall_trace(asked, self.act, items, recall.recall(asked, self.act, self.now, 50, items), 50)

    def retrieval_quality(self, queries: list[str]) -> DataFrame:
        """One row: how many questions find something by its words, and how well."""
        return audits.retrieval_quality(self._asked(queries), self.search_batch(queries, 1))

    def check(self, query: str, top_k: int = 3) -> DataFrame:
        """What is known about an answer: results with how sure they are, gaps, blocked memories, contradictions."""
        items = index.stored_terms(self.act)
        asked = self._asked([query])
        found = recall.recall(asked, self.act, self.now, bounded("top_k", top_k), items)
        return audits.check(asked, found, self.act, index.exploded(items), index.cue_index(self.act), consolidate.conflicts(self.act), self.now)

    def _today(self) -> int:
        row = self.spark.range(1).select((F.year(self.now) * 10000 + F.month(self.now) * 100 + F.dayofmonth(self.now)).alias("t")).first()
        return row["t"]

    def recall_whole(self, query: str, top_k: int = 5) -> DataFrame:
        """Composed recall with its anchors and annotations."""
        return composed.recall_whole(self._asked([query]), self.act, self.links, self.now, self._today(), bounded("top_k", top_k))

    def temporal_anchor(self, query: str, top_k: int = 4) -> DataFrame:
        """The results of a question about time, with the record that its date anchors; other questions as they are."""
        items = index.stored_terms(self.act, cjk=True)
        asked = self._asked([query])
        found = recall.recall(asked, self.act, self.now, bounded("top_k", top_k), items, cjk=True).select("query_id", "rank", "id", "score")
        told = dated.temporal_anchor(asked, found, self.act, items, self._today(), top_k)
        rest = found.join(told.select("query_id").distinct(), "query_id", "left_anti").withColumn("anchor", F.lit(None).cast("string"))
        return told.unionByName(rest)

    def temporal_hint(self, query: str) -> DataFrame:
        return self._asked([query]).select(dated.temporal_hint(F.col("query")).alias("hint"))

    def knowledge_gaps(self, query: str, semantic: bool = False) -> DataFrame:
        """Words of a query that no memory has; with semantic, that none comes near to."""
        terms = index.term_index(self.act)
        return chains.semantic_gaps(self._asked([query]), terms, self.act) if semantic else recall.gaps(self._asked([query]), terms)

    def gaps(self, query: str) -> DataFrame:
        return recall.gaps(self._asked([query]), index.term_index(self.act))

    def attention_filter(self, query: str, limit: int = 5) -> DataFrame:
        """What belongs to a task, and the strong and important memories that would only distract from it."""
        k = bounded("limit", limit)
        return audits.attention(self.recall(query, k), self.act, k)

    def context_pack(self, queries: list[str], budget: int = 1200, top_k: int = 3) -> DataFrame:
        """The best memories of several queries that fit a number of characters."""
        found = self.search_batch(queries, top_k).withColumn("pack", F.lit(0))  # top_k for each query at most
        return audits.context_packs(found, self.act, budget).drop("pack")

    def explain_memory(self, memory_id: str, suppressed: DataFrame | None = None) -> DataFrame:
        none = self.act.limit(0).select("id") if suppressed is None else suppressed
        return audits.explained(self.act.where(F.col("id") == memory_id), self.links, none, self.now)

    def multi_hop_report(self, start: list[str], depth: int = 2) -> DataFrame:
        return graph.ring(self.links, start, depth).groupBy("hop").agg(F.count("*").alias("n"))

    def timeline_report(self, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
        """The earliest episodes in a range of time, by day."""
        return audits.timeline_items(self.act, *(source.now(x) if x else None for x in (start, end)), bounded("limit", limit))

    def intent_due(self) -> DataFrame:
        return planning.due_intents(self.intents, self.now)

    def names(self) -> dict[str, Callable[..., DataFrame]]:
        a, now = self.act, self.now
        return {
            "recall": self.recall, "search": self.recall, "search_batch": self.search_batch, "recall_trace": self.recall_trace, "retrieval_quality": self.retrieval_quality,
            "check": self.check, "recall_whole": self.recall_whole, "temporal_hint": self.temporal_hint, "context_pack": self.context_pack, "attention_filter": self.attention_filter, "explain_memory": self.explain_memory,
            "multi_hop_report": self.multi_hop_report, "timeline_report": self.timeline_report, "intent_due": self.intent_due,
            "stats": lambda: index.stats(self.mem), "export_memories": lambda: a, "working_set": lambda limit=7: review.working_set(a, bounded("limit", limit)),
            "calibrate_decay": lambda: review.calibrate(a, now), "review_due": lambda limit=20: review.due(a, now, limit=bounded("limit", limit)),
            "review_load": lambda days=7: review.load(a, now, bounded("days", days)), "review_consistency": lambda: review.consistency(a, now),
            "next_interval": lambda: review.next_intervals(a, now), "curve_fit": lambda: review.curve_fit(a, now), "affect_decay": lambda: review.affect_decay(a),
            "spacing_plan": lambda days=7: review.spacing_plan(a, now, bounded("days", days)), "cramming_plan": lambda hours=72.0: review.cramming(a, now, hours),
            "forgetting_export": lambda days=30, step=10: review.curve_points(a, now, bounded("days", days), step),
            "sleep": lambda: consolidate.sleep_report(a, now), "list_conflicts": lambda: consolidate.conflicts(a),
            "conflict_advice": lambda: consolidate.advice(a, consolidate.conflicts(a), now), "resolve_conflicts": lambda: consolidate.accommodated(a),
            "dedupe_memories": lambda: consolidate.merge_duplicates(a), "cleanup_preview": lambda: consolidate.prunable(a, now),
            "memory_status": lambda: reports.status(a, now), "memory_map": lambda: reports.memory_map(a, now), "schema_report": lambda: audits.schema_samples(a),
            "coverage_report": lambda: reports.coverage(a), "mastery_map": lambda: reports.mastery(a, now), "metacog_report": lambda: reports.metacog(a),
            "source_calibration": lambda: reports.source_calibration(a), "forgetting_risk": lambda: reports.risks(a, now), "forgetting_balance": lambda: reports.balance(a),
            "life_story": lambda days=14: reports.life_story(a, bounded("days", days)), "life_highlights": lambda days=14: audits.life_highlights(a, bounded("days", days)), "topic_drift_report": lambda days=14: reports.drift(a, bounded("days", days)),
            "similarity_report": lambda threshold=0.6: reports.similar_pairs(a, threshold), "interference_report": lambda: reports.interference(a),
            "difficulty_estimator": lambda: reports.difficulty(a, now), "emotion_advice": lambda: audits.emotion_advice(a), "rumination_check": lambda: audits.rumination_verdict(a),
            "cue_diversity": lambda: reports.cue_diversity(a), "encoding_quality": lambda: reports.encoding_quality(a), "consolidation_forecast": lambda: reports.forecast(a, now),
            "learner_profile": lambda: audits.learner_scale(a, now), "schema_fit": lambda: fits.schema_fit(a), "memory_integration": lambda: reports.integration(a, self.links),
            "memory_health": self.health, "association_report": lambda: graph.association_report(a, self.links),
            "community_report": lambda: graph.community_report(a, self.links), "bridge_suggestions": lambda limit=20: graph.bridges(a, self.links, bounded("limit", limit)), "kg_export": lambda: graph.kg_edges(a, self.links),
            "intent_report": lambda: planning.intent_report(self.intents, now), "intent_conflicts": lambda minutes=60: planning.intent_conflicts(self.intents, minutes),
            "action_queue": lambda limit=50: planning.action_queue(self.intents, now, bounded("limit", limit)),
            **self._more(),
        }

    def _intents(self) -> DataFrame:
        return self.spark.createDataFrame([], source.INTENTS) if self.intents is None else self.intents

    def health(self) -> DataFrame:
        intents = self._intents()
        return insights.health(self.act, self.links, consolidate.conflicts(self.act), planning.due_intents(intents, self.now), planning.intent_conflicts(intents), self._ids([]))

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _plan(self, plan: list) -> DataFrame:
        """Steps given as texts, or as {step or action, depends_on}; blank ones are left out."""
        rows = [(s, None) if isinstance(s, str) else (s.get("step") or s.get("action") or "", s.get("depends_on")) for s in plan]
        rows = [(str(s).strip(), d) for s, d in rows if str(s).strip()]
        return self.spark.createDataFrame([(0, k, s, d) for k, (s, d) in enumerate(rows)], "plan_id int, pos int, step string, depends_on array<int>")

    def _told(self) -> DataFrame:
        return plans.outcomes(self.act)

    def _planned(self, goal: str, top_k: int | None = None) -> DataFrame:
        asked = self._asked([goal])
        size = top_k or asked.select(plans.plan_size(F.col("query"))).first()[0]
        return plans.planned(self.search_batch([goal], size), self.act, self._told())

    def _statuses(self, results: dict) -> DataFrame:
        rows = [(0, int(k), v if isinstance(v, str) else v.get("status", "unknown")) for k, v in results.items()]
        return self.spark.createDataFrame(rows, "plan_id int, pos int, status string")

    def _more(self) -> dict[str, Callable[..., DataFrame]]:
        a, now = self.act, self.now
        one = lambda q: self._asked([q])
        clustered = lambda ids: self.spark.createDataFrame([(0, i) for i in ids], "cluster int, id string")
        step = lambda s: self.spark.createDataFrame([(s,)], "step string")
        overdue = lambda: planning.due_intents(self._intents(), now)
        shown = lambda q, columns: one(q).select(*(c.alias(n) for n, c in columns(F.col("query")).items()))
        return {
            "recall_full": lambda query, top_k=5: composed.recall_all(one(query), a, self.links, now, bounded("top_k", top_k)),
            "reason": lambda query: composed.recall_all(one(query), a, self.links, now, one(query).select(text.pack_size(F.col("query"))).first()[0]),
            "plan": lambda goal, top_k=None: self._planned(goal, top_k), "predict_step": lambda s: plans.predicted(step(s), self._told()),
            "replan": lambda goal, failed_step, top_k=14: plans.replanned(self._planned(goal, top_k), self.spark.createDataFrame([(0, failed_step)], "query_id long, failed_step string"), self._told()),
            "plan_rehearsal": lambda goal, top_k=14: plans.rehearsed(self._planned(goal, top_k), self._told()),
            "plan_quality": lambda plan, context_memory_ids=(): plans.quality(self._plan(plan), index.term_index(a.where(F.col("id").isin(*context_memory_ids))) if context_memory_ids else None),
            "plan_support": lambda plan, top_k=3: self.search_batch([r["step"] for r in self._plan(plan).orderBy("pos").collect()], top_k),
            "dependency_map": lambda plan: plans.levels(self._plan(plan).drop("depends_on"), plans.dependencies(self._plan(plan))),
            "effort_estimate": lambda plan, base_hours=2.0: plans.effort(self._plan(plan), base_hours), "plan_rewrite": lambda plan: plans.rewritten(self._plan(plan)),
            "plan_tracker": lambda plan, statuses=None: plans.tracked(self._plan(plan), self._statuses(statuses or {})),
            "decision_review": lambda plan, results: plans.decisions(self._plan(plan), self._statuses(results)),
            "transfer_report": lambda plan: plans.transfer(self._plan(plan), a, index.stored_terms(a)), "lesson_learned": lambda: plans.lessons(a),
            "project_brief": lambda title, limit=8: plans.brief(self.recall(title, limit), a), "goal_replay": lambda goal, top_k=5: plans.replayed(self.recall(goal, top_k), a, consolidate.conflicts(a), top_k),
            "project_risk": lambda: plans.risk(a, consolidate.conflicts(a), overdue(), planning.intent_conflicts(self._intents())),
            "numeric_reasoning": lambda problem: shown(problem, lambda q: numeric.numeric_check(q, F.lit(None).cast("double"))),
            "math_ladder": lambda problem: shown(problem, numeric.math_ladder), "physics_simulate": lambda scene: shown(scene, numeric.simulated),
            "reasoning_trace": lambda problem, top_k=5: insights.reasoned(one(problem), self.recall(problem, top_k), a),
            "compare_memories": lambda id_a, id_b: insights.compared(self.spark.createDataFrame([(id_a, id_b)], "a string, b string"), a),
            "summarize_cluster": lambda memory_ids: insights.clusters(clustered(memory_ids), a), "session_summary": lambda memory_ids: insights.sessions(clustered(memory_ids), a),
            "recognition_check": lambda query, memory_id: insights.recognised(one(query).withColumn("id", F.lit(memory_id)), self.recall(query, 10), a),
            "retrieval_snapshot": lambda: insights.snapshot(a, now), "retrieval_assist": lambda query, limit=8: insights.assisted(one(query), a, bounded("limit", limit)),
            "reconsolidation_plan": lambda memory_id: insights.reconsolidation(self._ids([memory_id]), a, now), "analogy_bridge": lambda limit=5: insights.analogies(a, limit=bounded("limit", limit)),
            "transfer_prompt": lambda count=3: insights.prompts(a, now, count), "analogy_prompt": lambda count=3: insights.prompts(a, now, count, 0.0),
            "goal_progress": lambda goal: insights.goal_progress(self.spark.createDataFrame([(goal,)], "goal string"), a, now),
            "sleep_advice": lambda: insights.sleep_advice(a, consolidate.conflicts(a), overdue(), now), "sleep_inference": lambda limit=20: insights.sleep_pairs(a, now, bounded("limit", limit)),
            "weekly_review": lambda: insights.weekly(a, now), "nightly_routine": lambda limit=3: insights.nightly(a, now, bounded("limit", limit)),
            "working_set_budget": lambda limit=8: insights.budget(a, bounded("limit", limit)), "memory_audit": lambda: audits.memory_audit(self.mem, consolidate.conflicts(a), now), "interleaved_plan": lambda limit=20: chains.interleaved_plan(a, bounded("limit", limit)), "sleep_replay": lambda: plans.consolidated_outcomes(self._told()),
            "practice_due": lambda limit=5: practice.due(a, now, bounded("limit", limit)), "practice_plan": lambda limit=5: practice.plan(practice.due(a, now, bounded("limit", limit)), a, now),
            "practice_forecast": lambda days=7: practice.forecast(a, now, bounded("days", days)), "test_generator": lambda: practice.tests(a),
            "practice_report": lambda answers: practice.report(a, self.spark.createDataFrame([(x["id"], x.get("attempt", "")) for x in answers], "id string, attempt string"), now),
            "practice_session": lambda answers=(), limit=5: practice.session(a, self._answers(answers), now, bounded("limit", limit)), "learning_loop": lambda: practice.learning_loop(a, now), "agent_learning_session": lambda answers=(): practice.learning_session(a, self._answers(answers), now),
            "sleep_and_plan": lambda days=7: practice.night_and_plan(a, source.active(consolidate.sleep(self.mem, self.links, now)[0]), consolidate.sleep_report(a, now), now, bounded("days", days)), "concept_cover": lambda query, top_k=5: composed.covered(one(query), self.recall(query, top_k), a, index.stored_terms(a)),
            "temporal_anchor": self.temporal_anchor,
        }

    def call(self, name: str, **arguments) -> DataFrame:
        tools = self.names()
        if name not in tools:
            raise KeyError(f"no tool {name!r}")
        return tools[name](**arguments)


class StoreTools:
    """Tools that change a store: each writes new snapshots of the tables that it changes and returns what changed."""

    def __init__(self, spark: SparkSession, store: source.Store, at: str = source.NOW) -> None:
        self.spark, self.store, self.now = spark, store, source.now(at)

    @property
    def memories(self) -> DataFrame:
        return self.store.read("memories")

    @property
    def links(self) -> DataFrame:
        return self.store.read_or("links", "src string, dst string, weight double")

    @property
    def suppressed(self) -> DataFrame:
        return self.store.read_or("suppressed", "id string")

    @property
    def intents(self) -> DataFrame:
        return self.store.read_or("intents", source.INTENTS)

    def toolbox(self) -> Toolbox:
        """Reading tools over what is not suppressed."""
        return Toolbox(self.spark, self.memories.join(self.suppressed, "id", "left_anti"), intents=self.intents)

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def remember_many(self, records: list[dict], link: bool = True) -> DataFrame:
        """Records (content, kind, cues, importance, context, affect) as memories; new_id, id: which memory each became."""
        names = {"content": "string", "kind": "string", "cues": "array<string>", "importance": "double", "confidence": "double", "context": "string", "affect": "string", "origin": "string"}
        rows = [(*(r.get(n) for n in names), k) for k, r in enumerate(records)]
        df = self.spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in names.items()) + ", input_pos int")
        mem = self.memories
        top = mem.agg(F.max("seq")).first()[0] or 0
        new = source.shared.written(ingest.prepared(df, self.now, top), "new")
        changed, became = ingest.remembered(mem, new)
        became = source.shared.written(became, "became")
        self.store.merge("memories", source.shared.written(changed, "changed"))
        if link:
            active = source.active(self.memories)
            more = ingest.new_links(active, active.join(became.select("id").distinct(), "id", "left_semi"), ingest.link_budget(len(records)))
            self.store.write("links", ingest.with_links(self.links, more))
        return became

    def remember(self, content: str, **record) -> DataFrame:
        return self.remember_many([{"content": content, **record}])

    def remember_turn(self, content: str, role: str = "user") -> DataFrame:
        turn = self.spark.createDataFrame([(0, 0, role, content)], "conv_id long, turn long, role string, text string")
        return self.remember_many([{"content": r["content"], "kind": r["kind"]} for r in index.turn_segments(turn).orderBy("part").collect()])  # four parts at most

    def update(self, memory_id: str, content: str) -> DataFrame:
        """Rewrites a memory; a fact that would equal another one raises ValueError."""
        change = self.spark.createDataFrame([(memory_id, content)], "id string, content string")
        if not ingest.refused(self.memories, change).isEmpty():
            raise ValueError("another fact says the same")
        self.store.write("memories", index.update_content(self.memories, change, self.now), expected=self.store.version("memories"))
        return ingest.get(self.memories, [memory_id], any_status=True)

    def _status(self, memory_id: str, old: str, new: str) -> DataFrame:
        hit = self.memories.where((F.col("id") == memory_id) & (F.col("status") == old)).select("id")
        done = hit.agg((F.count("*") > 0).alias("done"))
        out = self.spark.createDataFrame([(done.first()[0],)], "done boolean")
        self.store.write("memories", index.set_status(self.memories, [memory_id], new), expected=self.store.version("memories"))
        return out

    def forget(self, memory_id: str) -> DataFrame:
        return self._status(memory_id, "active", "recycled")

    def restore(self, memory_id: str) -> DataFrame:
        return self._status(memory_id, "recycled", "active")

    def purge(self) -> DataFrame:
        """Deletes recycled memories with their links; how many."""
        ids = source.shared.written(self.memories.where("status = 'recycled'").select("id"), "purged")
        versions = {n: self.store.version(n) for n in ("memories", "links")}
        self.store.write_all(ingest.deleted({"memories": self.memories, "links": self.links}, ids, only_recycled=True), versions)
        return ids.agg(F.count("*").alias("purged"))

    def tag_memories(self, ids: list[str], add: list[str] = (), remove: list[str] = ()) -> DataFrame:
        self.store.write("memories", index.tag(self.memories, ids, add, remove), expected=self.store.version("memories"))
        return ingest.get(self.memories, ids).select("id", "cues")

    def suppress_memories(self, ids: list[str]) -> DataFrame:
        return self.store.write("suppressed", ingest.suppress(self.suppressed, self._ids(ids), self.memories))

    def unsuppress_memories(self, ids: list[str]) -> DataFrame:
        return self.store.write("suppressed", ingest.unsuppress(self.suppressed, self._ids(ids)))

    def suppressed_report(self) -> DataFrame:
        return ingest.suppressed_report(self.suppressed, self.memories)

    def _changed(self, side: DataFrame, columns: list[str]) -> DataFrame:
        """Writes the columns of side (id, ...) into the memories."""
        side = source.shared.written(side.select("id", *columns), "changes")
        rows = self.memories.join(side.select("id", *(F.col(c).alias(f"__{c}") for c in columns)), "id", "left")
        types = {f.name: f.dataType for f in source.SCHEMA}
        rows = rows.withColumns({c: F.coalesce(F.col(f"__{c}").cast(types[c]), F.col(c)) for c in columns}).select(*types)
        self.store.write("memories", rows, expected=self.store.version("memories"))
        return side

    def review(self, memory_id: str, success: bool) -> DataFrame:
        asked = self.spark.createDataFrame([(memory_id, success)], "id string, success boolean")
        new = review.reviewed(self.memories, asked, self.now).withColumn("last_review_at", self.now)
        return self._changed(new, ["strength", "storage_strength", "review_streak", "retrieval_successes", "retrieval_failures", "last_review_at"])

    def review_batch(self, answers: list[dict]) -> DataFrame:
        rows = self.spark.createDataFrame([(x["id"], k, bool(x["success"])) for k, x in enumerate(answers)], "id string, pos int, success boolean")
        return self._changed(practice.review_batch(self.memories, rows), ["retrieval_successes", "retrieval_failures", "review_streak"])

    def practice_answer(self, memory_id: str, attempt: str) -> DataFrame:
        asked = self.spark.createDataFrame([(memory_id, attempt)], "id string, attempt string")
        return self._changed(practice.answered(self.memories, asked, self.now), ["strength", "review_streak"])

    def record_outcome(self, goal: str, step: str, success: bool, note: str | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(goal, step, success, note, 0)], "goal string, step string, ok boolean, note string, input_pos int")
        row = plans.recorded(asked, plans.outcomes(self.memories)).first()
        return self.remember_many([{"content": row["content"], "cues": row["cues"], "importance": row["importance"], "origin": "agent"}])

    def intent_remember(self, content: str, due_at: str, context_cue: str = "") -> DataFrame:
        rows = self.spark.createDataFrame([(content, due_at, context_cue)], "content string, due string, context_cue string")
        new = rows.select(F.substring(F.sha2(F.concat_ws("|", "content", "due", "context_cue"), 256), 1, 16).alias("id"), F.col("due").cast("timestamp").alias("due_at"), "context_cue", "content")
        return self.store.write("intents", planning.remembered_intents(self.intents, new))

    def intent_complete(self, intent_id: str) -> DataFrame:
        return self.store.write("intents", planning.set_intent(self.intents, [intent_id], "completed"))

    def intent_cancel(self, intent_id: str) -> DataFrame:
        return self.store.write("intents", planning.set_intent(self.intents, [intent_id], "cancelled"))

    def sleep(self) -> DataFrame:
        """A night: memories and links after all phases, and what each touched."""
        versions = {n: self.store.version(n) for n in ("memories", "links")}
        report = source.shared.written(consolidate.sleep_report(source.active(self.memories), self.now), "sleep")
        mem, links = consolidate.sleep(self.memories, self.links, self.now)
        self.store.write_all({"memories": mem, "links": links}, versions)
        return report

    def rebuild_vectors(self) -> DataFrame:
        """Texts without a vector get one; how many vectors there are."""
        cache = self.store.read_or("vectors", "content_hash string, embedding array<double>")
        out = self.store.write("vectors", vector.cached(source.active(self.memories), cache, vector.embedder("ngram")))
        return out.agg(F.count("*").alias("vectors"))

    def recall(self, query: str, top_k: int = 5) -> DataFrame:
        """Recall with what it does: strengths and counts of what was recalled, failures of what was not found by its words,
        weakened rivals, new links, and a line in the log."""
        box = self.toolbox()
        asked = box._asked([query])
        items = index.stored_terms(box.act)
        found = source.shared.written(composed.recall_all(asked, box.act, self.links, self.now, bounded("top_k", top_k), items), "found")
        gained = recall.effects(found.where("matched"), self.memories).withColumn("last_access_at", self.now)
        weaker, failed = composed.rivals(found, asked, self.links, box.act, items), composed.missed(found, self.memories)
        links = source.shared.written(ingest.with_links(self.links, composed.elaborated(found, self.links)), "links")
        weaker, failed = source.shared.written(weaker, "weaker"), source.shared.written(failed, "failed")
        self._changed(gained, ["strength", "storage_strength", "access_count", "retrieval_successes", "last_access_at"])
        self._changed(weaker, ["strength"])
        self._changed(failed, ["retrieval_failures"])
        self.store.write("links", links)
        log = self.store.read_or("recall_log", "at timestamp, query string, ids array<string>")
        line = found.agg(self.now.alias("at"), F.lit(query).alias("query"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
        self.store.write("recall_log", log.unionByName(line))
        return found

    def recall_log(self, limit: int = 100) -> DataFrame:
        return self.store.read_or("recall_log", "at timestamp, query string, ids array<string>").orderBy(F.desc("at")).limit(min(100, bounded("limit", limit)))

    def names(self) -> dict[str, Callable[..., DataFrame]]:
        """All tools, those that change the store and those that read it."""
        own = ("remember", "remember_many", "remember_turn", "update", "forget", "restore", "purge", "tag_memories", "suppress_memories", "unsuppress_memories", "suppressed_report", "review", "review_batch", "practice_answer", "record_outcome", "intent_remember", "intent_complete", "intent_cancel", "sleep", "rebuild_vectors", "recall", "recall_log")
        return self.toolbox().names() | {n: getattr(self, n) for n in own} | {
            "export_memories": lambda path: self.store.export_json(path) or self.memories.agg(F.count("*").alias("n")),
            "import_memories": lambda path: self.store.import_json(path).agg(F.count("*").alias("n")),
        }

    def call(self, name: str, **arguments) -> DataFrame:
        tools = self.names()
        if name not in tools:
            raise KeyError(f"no tool {name!r}")
        return tools[name](**arguments)
