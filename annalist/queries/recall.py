"""Questions, recall as a whole, evidence, episodes, queues and views: the queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import atoms
from annalist.functions import questions as Q
from annalist.functions import text as T
from annalist.functions.text import digest
from annalist.functions.time import DAY_US, NO_END, micros
from annalist.operators import consolidate, evaluate, evidence, fusion, governance, ontology, rules, scope, search, vectors, versions
from annalist.operators import questions as standing
from annalist.operators.ledger import SLOT
from annalist.queries import retrieval
from annalist.queries.histories import _ledger_of
from annalist.queries.state import admission_decisions
from annalist.sources import queue
from annalist.sources.tables import table

_AT_US = 1_780_272_000_000_000
_NOW_US = 891_388_800_000_000  # 1998-04-01


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_events", "id", "event_type", "content").filter("event_type = 'user.message' AND content IS NOT NULL AND id IS NOT NULL")
    return rows.groupBy("id").agg(F.min("content").alias("content"))


def query_clauses(spark: SparkSession, d: str) -> DataFrame:
    """The clauses of each user's message."""
    return _questions(spark, d).select("id", F.posexplode(Q.clauses("content")).alias("clause_no", "clause"))


def query_facets(spark: SparkSession, d: str) -> DataFrame:
    """What messages and documents call for besides their own words: both are asked with, so that every facet occurs."""
    docs = table(spark, d, "documents", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content")).filter("content IS NOT NULL")
    spoken = _questions(spark, d).withColumn("content", F.concat(F.lit("How many did I buy: "), F.col("content")))
    both = _questions(spark, d).unionByName(docs).unionByName(spoken.withColumn("id", F.concat(F.lit("q"), F.col("id"))))
    return both.select("id", Q.facet("content").alias("f")).filter("f IS NOT NULL").select("id", F.col("f.name").alias("facet"), F.size("f.groups").alias("groups"), F.array_join(F.array_sort("f.terms"), " ").alias("terms"))


#: Tokens of a recalled bundle, and candidates that the retrievers of a question may bring together.
BUDGET, SHARED = 2048, 60


def governed_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall as a whole, for every document whose id is divisible by 50: retrievers, fusion, guard, packing.

    The lexical retriever (texts with at least half of the terms) takes its share of the candidates, the vector retriever what is left
    of them; ranks are fused; what is of another workspace or newer than the question is refused; what is left is packed within a budget. Only a
    question for which no retriever found anything is asked again for texts with any of its terms.
    """
    indexed, how = retrieval._index(spark, d)
    docs = table(spark, d, "documents", "doc_id", "workspace_id", "created_at", "text")
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("workspace_id").alias("own"), F.col("created_at").alias("asked_at"))

    def lexical(share: float) -> DataFrame:
        rows = search.bm25_indexed(indexed, *how, retrieval.POOL + 1, share).filter("doc_id <> query_id").withColumn("score", F.round("score", 6))
        return search.top(rows, ["query_id"], [F.desc("score"), F.col("doc_id")], retrieval.POOL).select("query_id", "doc_id", "rank")

    first = lexical(0.5)
    taken = first.groupBy("query_id").agg(F.count("*").alias("_n"))
    unit = retrieval._unit(spark, d).join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id")
    near = vectors.nearest(unit.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), unit, retrieval.POOL)
    near = near.join(taken, "query_id", "left").filter(F.col("rank") <= SHARED - F.coalesce("_n", F.lit(0))).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    found = first.withColumn("route", F.lit("found")).unionByName(near.withColumn("route", F.lit("found")))
    missed = asked.join(found, "query_id", "left_anti").select("query_id")
    found = found.unionByName(lexical(0).join(missed, "query_id", "left_semi").withColumn("route", F.lit("fallback")))
    fused = fusion.reciprocal_ranks(found, ["query_id", "route"], "doc_id").withColumn("score", F.round("score", 9))
    guarded = fused.join(docs, "doc_id").join(asked, "query_id").filter((F.col("workspace_id").isNull() | F.col("own").isNull() | (F.col("workspace_id") == F.col("own"))) & (F.col("created_at") <= F.col("asked_at")))
    items = guarded.select("query_id", "route", F.col("doc_id").cast("string").alias("id"), "score", T.token_estimate("text").cast("bigint").alias("size"))
    return fusion.greedy(items, ["query_id", "route"], ["id", "score", "size"], "query_id bigint, route string, id string, position int, used bigint", fusion.within_budget(BUDGET))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """The events each claim names as its sources: case, evidence."""
    rows = table(spark, d, "claims", "id", "provenance_json").filter("id IS NOT NULL")
    return rows.select(F.col("id").alias("case"), F.explode(F.from_json(F.get_json_object("provenance_json", "$.source_event_ids"), "array<string>")).alias("evidence")).distinct()


def evidence_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Since when and until when the sources of a claim, of which any shows its value and all together its time, support it."""
    named = _named(spark, d)
    alternatives = named.select("case", F.lit("value").alias("field"), F.col("evidence").alias("alternative"), "evidence").unionByName(named.select("case", F.lit("time").alias("field"), F.lit("all").alias("alternative"), "evidence"))
    events = table(spark, d, "memory_events", "id", "actor", "content_hash", "occurred_at", "archived_at").filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("actor", "content_hash", "occurred_at", "archived_at")).alias("e"))
    events = events.select(F.col("id").alias("evidence"), F.col("id").alias("source"), F.col("e.actor").alias("family"), F.col("e.content_hash").alias("revision"), micros("e.occurred_at").alias("lo"), micros("e.archived_at").alias("hi"))
    out = evidence.proofs(alternatives, named.join(events, "evidence"))
    return out.withColumn("to_us", F.when(F.col("to_us") == NO_END, -1).otherwise(F.col("to_us")))


def evidence_branch_score(spark: SparkSession, d: str) -> DataFrame:
    """How much of the better of two bodies of evidence, named or linked, is linked to a claim, and what is linked though it is archived."""
    named = _named(spark, d)
    linked = table(spark, d, "claim_sources").filter("claim_id IS NOT NULL AND event_id IS NOT NULL").select(F.col("claim_id").alias("case"), F.col("event_id").alias("evidence")).distinct()
    branches = named.withColumn("branch", F.lit("named")).unionByName(linked.withColumn("branch", F.lit("linked")))
    live = table(spark, d, "memory_events", "id", "archived_at").filter("archived_at IS NULL").select(F.col("id").alias("evidence")).distinct()
    out = evidence.best_branch(branches, linked, branches.select("case", "evidence").join(live, "evidence"))
    return out.withColumn("recall", F.round("recall", 6))


def claim_projection(spark: SparkSession, d: str) -> DataFrame:
    """Claims with an ontology payload as assertions, or what is wrong with them."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def claims(name: str, p: str, key: str, kind: str, predicate: str, made: F.Column) -> DataFrame:
        rows = table(spark, d, name)
        subject = F.struct(text(p, key).alias("id"), F.lit(kind).alias("class"))
        payload = F.to_json(F.struct(F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), made.alias("object")).alias("$ontology")))
        return rows.select(text(p, key).alias("id"), F.lit("p").alias("partition_key"), F.lit(" Active").alias("status"), payload.alias("value_json"), F.lit(0).cast("bigint").alias("from_us"))

    entity = lambda p, c, kind: F.struct(text(p, c).alias("id"), F.lit(kind).alias("class"))
    literal = lambda c: F.struct(F.col(c).cast("string").alias("literal"))
    parts = [
        claims("customer", "c", "c_custkey", "customer", "located_in", entity("n", "c_nationkey", "nation")),
        claims("supplier", "s", "s_suppkey", "supplier", "located_in", literal("s_name")),
        claims("nation", "n", "n_nationkey", "nation", "located_in", entity("r", "n_regionkey", "region")),
        claims("region", "r", "r_regionkey", "region", "borders", entity("r", "r_regionkey", "region")),
        claims("part", "p", "p_partkey", "part", "size", literal("p_size")),
    ]
    properties = spark.createDataFrame([("located_in", "party", "place"), ("size", "part", None)], "predicate string, domain_class string, range_class string")
    below = [("customer", "party"), ("supplier", "party"), ("nation", "place"), ("region", "place"), *((c, c) for c in ("customer", "supplier", "nation", "region", "part", "party", "place"))]
    made = ontology.projected(reduce(DataFrame.unionByName, parts), properties, spark.createDataFrame(below, "child string, parent string"))
    return made.select("id", "assertion_id", "subject", "predicate", F.coalesce("object", "literal").alias("object"), "problem")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as jobs: enqueued when ordered, claimed two days before a line ships, acknowledged or failed when it does (returned lines fail)."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    job, tenant, priority = F.col("o_orderkey").cast("string").alias("job"), (F.col("o_custkey") % 7).cast("string").alias("tenant"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")
    none = F.lit(None).cast("bigint").alias("until_us")
    begun = orders.select(job, F.lit(0).cast("bigint").alias("seq"), F.lit("enqueue").alias("action"), micros("o_orderdate").alias("at_us"), none, tenant, priority)
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    lines = lines.withColumn("n", F.row_number().over(w).cast("bigint")).withColumn("t", micros("l_shipdate"))
    step = lambda seq, action, at, until: F.struct(seq.alias("seq"), action.alias("action"), at.alias("at_us"), until.alias("until_us"))
    steps = F.array(step(2 * F.col("n") - 1, F.lit("claim"), F.col("t") - 2 * DAY_US, F.col("t") + DAY_US), step(2 * F.col("n"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("ack"), F.col("t"), F.lit(None).cast("bigint")))
    steps = F.when(F.col("l_returnflag") == "N", F.slice(steps, 1, 1)).otherwise(steps)
    made = lines.select(F.col("l_orderkey").cast("string").alias("job"), F.explode(steps).alias("s")).select("job", "s.*", F.lit(None).cast("string").alias("tenant"), F.lit(None).cast("int").alias("priority"))
    return begun.unionByName(made)


def queue_state(spark: SparkSession, d: str) -> DataFrame:
    """What the jobs of a queue have come to at an instant, folded from its log."""
    return queue.folded(_log(spark, d), _NOW_US)


def queue_leases(spark: SparkSession, d: str) -> DataFrame:
    """The jobs that a worker of capacity 60 claims next, at most 40 a tenant with those it holds."""
    return queue.leases(_log(spark, d), _NOW_US, 60, DAY_US, 40).select("job", "seq", "until_us")


def _episodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "memory_events", "id", "user_id", "session_id", "event_type", "occurred_at", "archived_at", "content").filter("id IS NOT NULL AND user_id IS NOT NULL")
    once = rows.groupBy("id").agg(F.min(F.struct("user_id", "session_id", "event_type", "occurred_at", "archived_at", "content")).alias("e")).select("id", "e.*")
    at = ["occurred_at", "id"]
    with_decision = consolidate.latest_parent(once, ["user_id"], at, F.col("event_type") == "commitment", "id").withColumnRenamed("parent", "decision_id")
    both = consolidate.latest_parent(with_decision, ["user_id"], at, F.col("event_type") == "agent.tool.completed", "id")
    tools = both.filter(F.col("event_type").isin("agent.tool.completed", "tool.failed"))
    outcomes = tools.select(F.col("user_id").alias("scope"), "id", F.col("session_id").alias("run"), "decision_id", F.when(F.col("event_type") == "tool.failed", F.col("parent")).alias("corrects"), F.col("archived_at").isNull().alias("active"))
    runs = once.select(F.col("user_id").alias("scope"), F.col("session_id").alias("run"))
    decisions = once.filter("event_type = 'commitment'").select(F.col("user_id").alias("scope"), "id", F.col("session_id").alias("run"))
    rewards = tools.select(F.col("id").alias("outcome_id"), F.col("event_type").alias("definition"), (F.length("content") % 2).cast("string").alias("version"))
    return consolidate.attached(runs, decisions, outcomes), rewards


def episode_attachments(spark: SparkSession, d: str) -> DataFrame:
    """The commitments and tool results of each session, by name, by decision, or because it is its user's only one; a failure corrects the success before it."""
    return _episodes(spark, d)[0]


def episode_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sessions of a user can be compared: one reward each, all of one kind."""
    found, rewards = _episodes(spark, d)
    outcomes = found.filter("kind = 'outcome'").select("scope", "run", F.col("id").alias("outcome_id"))
    return consolidate.reward_keys(outcomes, rewards)


def procedure_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Per user whether the sessions that went well have one sequence of steps in common."""
    rows = table(spark, d, "memory_events", "id", "user_id", "session_id", "event_type", "occurred_at", "content_hash").filter("id IS NOT NULL AND user_id IS NOT NULL AND session_id IS NOT NULL")
    once = rows.groupBy("id").agg(F.min(F.struct("user_id", "session_id", "event_type", "occurred_at", "content_hash")).alias("e")).select("id", "e.*")
    return consolidate.common_sequences(once, "user_id", "session_id", ["occurred_at", "id"], "event_type", F.col("event_type") == "tool.failed", "content_hash", 1)


#: Blocks that a composed view may have (fixed value); a larger one says so.
MOST_BLOCKS = 16


def composed_view(spark: SparkSession, d: str) -> DataFrame:
    """What is believed of each partition on the first of June as one text with its digest, and when it changes next."""
    rows = _ledger_of(spark, d).filter((F.col("replaced_us") == NO_END) & (F.col("from_us") <= _AT_US) & (F.col("to_us") > _AT_US)).select(*SLOT, "claim_id", "to_us")
    size = rows.groupBy("partition_key").agg(F.count("*").alias("blocks"), F.min(F.when(F.col("to_us") < NO_END, F.col("to_us"))).alias("next_us"))
    small = rows.join(size.filter(F.col("blocks") <= MOST_BLOCKS).select("partition_key"), "partition_key")
    line = F.concat(F.coalesce("claim_key", F.lit("?")), F.lit(" = "), F.col("claim_id"))
    body = small.groupBy("partition_key").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return size.join(body, "partition_key", "left").select("partition_key", "blocks", F.when(F.col("body").isNull(), "over_capacity").otherwise("composed").alias("status"), F.sha2("body", 256).alias("digest"), "next_us")


def contextual_view(spark: SparkSession, d: str) -> DataFrame:
    """The state of each customer in words, by the orders that apply on their own conditions: certain, unclear or not known."""
    orders = table(spark, d, "orders")
    types = dict(orders.dtypes)
    weekdays = rules.condition({"op": "weekday", "attr": "o_orderdate", "value": [0, 1, 2, 3, 4]}, types)
    large = rules.condition({"op": "gt", "attr": "o_totalprice", "value": 20000}, types)
    odd = rules.condition({"op": "gt", "attr": "o_totalprice", "value": 450000}, types)
    applies = F.when(odd, F.lit(None).cast("boolean")).otherwise(rules.applicable([weekdays, large], []))
    domain = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus") == "O", "open").otherwise("rest")
    out = rules.composed(orders.select("o_custkey", domain.alias("domain"), applies.alias("applies"), F.col("o_orderstatus").alias("value")), ["o_custkey"], ["rest", "open", "urgent"])
    text = F.when(F.col("status") == "resolved", F.concat(F.lit("State "), F.col("value"), F.lit("."))).when(F.col("status") == "ambiguous", "Several states apply.").otherwise("Not certain which state applies.")
    return out.select("o_custkey", "status", text.alias("text"), digest("status", text).alias("digest"))


def admission_batches(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of the drafts of each event, which are published together or not at all."""
    links = table(spark, d, "claim_sources").filter("claim_id IS NOT NULL AND event_id IS NOT NULL").distinct()
    rows = links.join(admission_decisions(spark, d).select(F.col("id").alias("claim_id"), "decision"), "claim_id")
    per = rows.groupBy("event_id").agg(F.count_distinct("claim_id").alias("drafts"), F.max((F.col("decision") == "l0_only").cast("int")).alias("_bad"), F.max((F.col("decision") == "pending_verification").cast("int")).alias("_open"))
    return per.select("event_id", "drafts", F.when(F.col("_bad") == 1, "refused").when(F.col("_open") == 1, "held").otherwise("published").alias("outcome"))


def experiment_arms(spark: SparkSession, d: str) -> DataFrame:
    """Ways to retrieve compared on the same questions: mean share of hits of the asking document's source, over all planned and over completed runs."""
    source = table(spark, d, "documents", "doc_id", F.lower(F.trim("source")).alias("source"))
    items = source.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("source").alias("wanted"))

    def lexical(asked: DataFrame) -> DataFrame:
        return retrieval._hits(spark, d, 5).select("query_id", "doc_id")

    def adjacent(asked: DataFrame) -> DataFrame:
        return asked.select("query_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 5)).alias("doc_id"))

    def broken(asked: DataFrame) -> DataFrame:
        raise RuntimeError("no such service")

    def score(asked: DataFrame, found: DataFrame) -> DataFrame:
        hits = found.join(source, "doc_id").join(asked, "query_id")
        return hits.groupBy("query_id").agg(F.avg((F.col("source") == F.col("wanted")).cast("double")).alias("score"))

    out = evaluate.run_arms(items, "query_id", {"lexical": lexical, "adjacent": adjacent, "broken": broken}, score)
    return evaluate.arm_means(out)


def atom_statements(spark: SparkSession, d: str) -> DataFrame:
    """What users state about themselves, in English or Chinese."""
    said = _questions(spark, d).select("id", F.explode(F.array_distinct(atoms.sentences("content"))).alias("sentence"))
    return said.select("id", "sentence", atoms.statement("sentence").alias("s")).filter("s IS NOT NULL").select("id", "sentence", "s.predicate", "s.modality", "s.retention", "s.value")


def granted_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of a user's context that a grant covers: one of 30 days with each changed preference, withdrawn by a failed tool."""
    rows = table(spark, d, "memory_events", "id", "user_id", "event_type", "occurred_at").filter("id IS NOT NULL AND user_id IS NOT NULL")
    once = rows.groupBy("id").agg(F.min(F.struct("user_id", "event_type", "occurred_at")).alias("e")).select("id", "e.user_id", "e.event_type", micros("e.occurred_at").alias("at_us"))
    until = F.when(F.col("event_type") == "preference.changed", F.col("at_us") + 30 * DAY_US).otherwise(F.col("at_us"))
    grants = once.filter(F.col("event_type").isin("preference.changed", "tool.failed")).select("user_id", "at_us", until.alias("until_us"))
    return scope.granted(once.filter("event_type = 'memory.context.read'"), grants, ["user_id"]).select("user_id", "id", "until_us")


def leak_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """What the patterns for secrets find in events, by fingerprint, without what documents are known to hold."""
    events = table(spark, d, "memory_events", "id", "content").filter("id IS NOT NULL").distinct()
    known = governance.leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return governance.leaks(events, "id", "content", known)


def group_changes(spark: SparkSession, d: str) -> DataFrame:
    """Which customers' answers a change of orders touches: some orders are new, some gone, some of another price."""
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    old = rows.filter("o_custkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 40 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return standing.changed_groups(old, rows.filter("o_custkey % 13 <> 0"), ["o_custkey"], ["o_orderkey", "o_totalprice"])


def optimization_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type after the first of June against those before: how many are live, how long they are, how late they come."""
    rows = table(spark, d, "memory_events", "id", "event_type", "content", "occurred_at", "ingested_at", "archived_at").filter("id IS NOT NULL AND content IS NOT NULL")
    once = rows.groupBy("id").agg(F.min(F.struct("ingested_at", "event_type", "content", "occurred_at", "archived_at")).alias("e")).select("id", "e.*")
    once = once.select("event_type", (micros("occurred_at") >= _AT_US).alias("after"), F.col("archived_at").isNull().cast("double").alias("score"), F.length("content").cast("double").alias("cost"), (micros("ingested_at") - micros("occurred_at")).alias("late_us"))
    out = evaluate.compared(once.filter(~F.col("after")), once.filter("after"), ["event_type"], "score", "cost", "late_us")
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("score_change", "cost_ratio", "p95_ratio")), "verdict")


def validity_at(spark: SparkSession, d: str) -> DataFrame:
    """The claims that hold on the first of June by their own bounds, with these as instants."""
    rows = table(spark, d, "claims", "id", "valid_from", "valid_to").filter("id IS NOT NULL").distinct()
    held = rows.select("id", micros("valid_from").alias("from_us"), micros("valid_to").alias("to_us"))
    return held.filter(versions.holds_at("from_us", "to_us", _AT_US))


NAMES = (group_changes, optimization_comparison, validity_at, atom_statements, granted_reads, leak_fingerprints, query_clauses, query_facets, governed_recall, evidence_proofs, evidence_branch_score, claim_projection, queue_state, queue_leases, episode_attachments, episode_rewards, procedure_candidates, composed_view, contextual_view, admission_batches, experiment_arms)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def _sql_clauses(text: str) -> str:
    parts = r'(?s)"[^"\n]*"|“[^”\n]*”|‘[^’\n]*’|\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）|以及|与|、|[,，;；]|[A-Za-z0-9_]+|.'
    marks = ", ".join(f"'{m}'" for m in Q.SEPARATOR.split("|"))
    marked = f"array_to_string(list_transform(regexp_extract_all({text}, '{parts}'), lambda p: CASE WHEN lower(p) IN ({marks}) THEN chr(1) ELSE p END), '')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda c: regexp_replace(c, '^[ \t\n\x0B\f\r.?？]+|[ \t\n\x0B\f\r.?？]+$', '', 'g')), lambda c: length(c) > 0)"


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_forms(words: str) -> str:
    one = "CASE WHEN regexp_matches(t, '^[a-z]+$') AND length(t) > 4 AND suffix(t, 'ies') THEN [t, substr(t, 1, length(t) - 3) || 'y'] WHEN regexp_matches(t, '^[a-z]+$') AND length(t) > 3 AND suffix(t, 's') AND NOT regexp_matches(t, '(ss|us|is)$') THEN [t, substr(t, 1, length(t) - 1)] ELSE [t] END"
    return f"flatten(list_transform({words}, lambda t: {one}))"


def oracle_sql() -> dict[str, str]:
    from annalist.queries import histories, state
    from annalist.queries.retrieval import _BM25, _EST, POOL, sql_anchors, sql_budget, sql_terms

    said = "m AS (SELECT id, min(content) AS content FROM memory_events WHERE event_type = 'user.message' AND content IS NOT NULL AND id IS NOT NULL GROUP BY id)"
    facets = "WHEN list_has_any(w, " + _sql_list(Q.PERSONAL) + f") AND regexp_matches(low, '{Q.ADVICE}') THEN {{'name': 'personal_context', 'groups': 1, 'terms': list_concat({_sql_list(Q.PREFERENCES)}, {_sql_forms('a')})}}"
    for name, words in Q.ACTIONS.items():
        topic = _sql_forms(f"list_filter(a, lambda t: NOT list_contains({_sql_list(Q.COUNT_CONTEXT + words)}, t))")
        trigger = _sql_list(tuple(w for w in words if w not in Q.NO_TRIGGER))
        facets += f" WHEN regexp_matches(low, '{Q.COUNTING}') AND list_has_any(w, {trigger}) THEN CASE WHEN len({topic}) > 0 THEN {{'name': '{name}', 'groups': 2, 'terms': list_concat({_sql_list(words)}, {topic})}} END"
    named = "named AS (SELECT DISTINCT id AS c, unnest(CAST(json_extract(provenance_json, '$.source_event_ids') AS VARCHAR[])) AS e FROM claims WHERE json_valid(provenance_json) AND id IS NOT NULL)"
    log = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS n, epoch_us(l_shipdate) AS t FROM lineitem),
steps AS (SELECT l_orderkey AS k, 2 * n - 1 AS seq, 'claim' AS action, t - 172800000000 AS at_us, t + 86400000000 AS until_us FROM numbered UNION ALL SELECT l_orderkey, 2 * n, CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'ack' END, t, NULL FROM numbered WHERE l_returnflag <> 'N'),
f AS (SELECT o_orderkey AS k, CAST(o_custkey % 7 AS VARCHAR) AS tenant, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, epoch_us(o_orderdate) AS begun, count(s.k) FILTER (action = 'claim') AS attempts, coalesce(bool_or(action = 'ack'), false) AS done,
arg_max(action, seq) FILTER (action IN ('claim', 'fail')) AS last, max(seq) FILTER (action IN ('claim', 'fail')) AS last_seq, arg_max(s.at_us, seq) FILTER (action IN ('claim', 'fail')) AS last_at, arg_max(coalesce(until_us, -1), seq) FILTER (action IN ('claim', 'fail')) AS last_until
FROM orders LEFT JOIN steps s ON s.k = o_orderkey AND s.at_us <= {_NOW_US} WHERE epoch_us(o_orderdate) <= {_NOW_US} GROUP BY ALL),
st AS (SELECT *, CASE WHEN done THEN 'done' WHEN last = 'claim' AND last_until > {_NOW_US} THEN 'leased' WHEN attempts >= {queue.MOST_ATTEMPTS} THEN 'dead' ELSE 'pending' END AS status,
CASE WHEN last = 'fail' THEN last_at + CAST(least(300.0, pow(2.0, least(9, greatest(0, attempts - 1)))) * 1000000 AS BIGINT) WHEN last = 'claim' THEN last_until ELSE begun END AS due FROM f)"""
    episodes = """e AS (SELECT DISTINCT id, user_id, session_id, event_type, occurred_at, archived_at, content FROM memory_events WHERE id IS NOT NULL AND user_id IS NOT NULL),
x AS (SELECT *, last_value(CASE WHEN event_type = 'commitment' THEN id END IGNORE NULLS) OVER w AS decision_id, last_value(CASE WHEN event_type = 'agent.tool.completed' THEN id END IGNORE NULLS) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT DISTINCT user_id, session_id FROM e WHERE session_id IS NOT NULL), only_one AS (SELECT user_id, min(session_id) AS session_id FROM r GROUP BY 1 HAVING count(*) = 1),
d AS (SELECT user_id, session_id, id FROM e WHERE event_type = 'commitment' AND session_id IS NOT NULL UNION SELECT o.user_id, o.session_id, id FROM e JOIN only_one o ON o.user_id = e.user_id WHERE event_type = 'commitment' AND e.session_id IS NULL),
live AS (SELECT * FROM x WHERE event_type IN ('agent.tool.completed', 'tool.failed') AND archived_at IS NULL AND id NOT IN (SELECT before FROM x WHERE event_type = 'tool.failed' AND archived_at IS NULL AND before IS NOT NULL)),
o AS (SELECT user_id, session_id, id FROM live WHERE session_id IS NOT NULL UNION SELECT d.user_id, d.session_id, live.id FROM live JOIN d ON d.user_id = live.user_id AND d.id = live.decision_id UNION SELECT p.user_id, p.session_id, id FROM live JOIN only_one p ON p.user_id = live.user_id WHERE live.session_id IS NULL)"""
    ledger = histories.oracle_sql()["p1_ledger"]
    decisions = state.oracle_sql()["admission_decisions"]
    stated = " ".join(f"WHEN regexp_full_match(sentence, '{p.replace(chr(39), chr(39) * 2)}') THEN {{'predicate': '{a}', 'modality': '{b}', 'retention': '{c}', 'value': trim(regexp_extract(sentence, '^{p.replace(chr(39), chr(39) * 2)}$', 1))}}" for a, b, c, p in atoms.RULES)
    leaks = lambda t, k, c: " UNION ALL ".join(f"SELECT '{n}' AS pattern, '{s}' AS severity, {k} AS k, unnest(list_distinct(regexp_extract_all({c}, '{p.replace(chr(39), chr(39) * 2)}'))) AS m FROM {t}" for n, s, p, _ in governance.PATTERNS)
    return {
        "group_changes": """WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders), a AS (SELECT o_custkey, list_sort(list((o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN o_totalprice + 1 ELSE o_totalprice END))) AS x FROM r WHERE o_custkey % 11 <> 0 GROUP BY 1), b AS (SELECT o_custkey, list_sort(list((o_orderkey, o_totalprice))) AS y FROM r WHERE o_custkey % 13 <> 0 GROUP BY 1)
SELECT o_custkey, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x = y THEN 'same' ELSE 'changed' END AS effect FROM a FULL JOIN b USING (o_custkey)""",
        "optimization_comparison": """WITH f AS (SELECT * FROM memory_events WHERE id IS NOT NULL AND content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1), e AS (SELECT event_type, epoch_us(occurred_at) >= 1780272000000000 AS after, CASE WHEN archived_at IS NULL THEN 1.0 ELSE 0 END AS score, length(content) AS cost, epoch_us(ingested_at) - epoch_us(occurred_at) AS late FROM f),
g AS (SELECT event_type, after, avg(score) AS s, avg(cost) AS c, quantile_disc(late, 0.95) AS p FROM e GROUP BY ALL), j AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, b.s - a.s AS ds, b.c / nullif(a.c, 0) AS rc, b.p / nullif(a.p, 0) AS rp, a.s IS NULL OR b.s IS NULL AS missing FROM (SELECT * FROM g WHERE NOT after) a FULL JOIN (SELECT * FROM g WHERE after) b ON a.event_type = b.event_type)
SELECT event_type, round(ds, 6) AS score_change, round(rc, 6) AS cost_ratio, round(rp, 6) AS p95_ratio, CASE WHEN missing THEN 'incomplete' WHEN ds < -0.02 THEN 'regression' WHEN rc > 1.1 THEN 'too_costly' WHEN rp > 1.1 THEN 'too_slow' ELSE 'accepted' END AS verdict FROM j""",
        "validity_at": f"SELECT DISTINCT id, epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us FROM claims WHERE id IS NOT NULL AND epoch_us(valid_from) <= {_AT_US} AND (valid_to IS NULL OR epoch_us(valid_to) > {_AT_US})",
        "atom_statements": f"""WITH {said}, s AS (SELECT DISTINCT id, trim(unnest(regexp_split_to_array(content, '{atoms.ENDS}'))) AS sentence FROM m), f AS (SELECT id, sentence, CASE {stated} END AS f FROM s WHERE sentence <> '')
SELECT id, sentence, f.predicate, f.modality, f.retention, f.value FROM f WHERE f IS NOT NULL""",
        "granted_reads": """WITH e AS (SELECT DISTINCT id, user_id, event_type, epoch_us(occurred_at) AS t FROM memory_events WHERE id IS NOT NULL AND user_id IS NOT NULL), g AS (SELECT user_id, t, min(CASE WHEN event_type = 'preference.changed' THEN t + 2592000000000 ELSE t END) AS u FROM e WHERE event_type IN ('preference.changed', 'tool.failed') GROUP BY ALL)
SELECT r.user_id, r.id, g.u AS until_us FROM (SELECT * FROM e WHERE event_type = 'memory.context.read') r ASOF JOIN g ON r.user_id = g.user_id AND r.t >= g.t WHERE g.u > r.t""",
        "leak_fingerprints": f"""WITH ev AS (SELECT DISTINCT id, content FROM memory_events WHERE id IS NOT NULL AND content IS NOT NULL), dc AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), a AS ({leaks('ev', 'id', 'content')}), b AS ({leaks('dc', 'doc_id', 'text')})
SELECT pattern, severity, sha256(pattern || ':' || m) AS fingerprint, count(*) AS rows, min(k) AS sample FROM a WHERE pattern || ':' || m NOT IN (SELECT pattern || ':' || m FROM b) GROUP BY ALL""",
        "query_clauses": f"WITH {said}, c AS (SELECT id, {_sql_clauses('content')} AS c FROM m) SELECT id, CAST(i AS INT) AS clause_no, c[i + 1] AS clause FROM c, range(10000) r(i) WHERE i < len(c)",
        "query_facets": f"""WITH {said}, b AS (SELECT * FROM m UNION ALL SELECT 'd' || doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'q' || id, 'How many did I buy: ' || content FROM m),
t AS (SELECT id, replace(lower(content), 'ß', 'ss') AS low, {sql_terms('content')} AS w, {sql_anchors('content').replace('list_sort(', '(')} AS a FROM b), f AS (SELECT id, CASE {facets} END AS f FROM t)
SELECT id, f.name AS facet, CAST(f.groups AS INT) AS groups, array_to_string(list_sort(list_distinct(f.terms)), ' ') AS terms FROM f WHERE f IS NOT NULL""",
        "governed_recall": f"""WITH RECURSIVE {_BM25}, n AS (SELECT query_id, count(*) AS asked FROM q GROUP BY 1), r AS (SELECT query_id, doc_id, round(score, 6) AS score, hits >= 0.5 * asked AS literal FROM s JOIN n USING (query_id) WHERE doc_id <> query_id),
lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE literal QUALIFY rank <= {POOL}),
vec AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND a.vec_id IN (SELECT doc_id FROM documents) AND b.vec_id IN (SELECT doc_id FROM documents) QUALIFY rank <= {POOL}),
near AS (SELECT vec.* FROM vec LEFT JOIN (SELECT query_id, count(*) AS k FROM lex GROUP BY 1) USING (query_id) WHERE rank <= {SHARED} - coalesce(k, 0)),
found AS (SELECT *, 'found' AS route FROM lex UNION ALL SELECT *, 'found' FROM near),
again AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE query_id NOT IN (SELECT query_id FROM found) QUALIFY rank <= {POOL}),
fused AS (SELECT query_id, route, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT * FROM found UNION ALL SELECT *, 'fallback' FROM again) GROUP BY ALL),
cand AS (SELECT query_id || '|' || route AS grp_key, CAST(f.doc_id AS VARCHAR) AS id, CAST({_EST.format('d.text')} AS BIGINT) AS size, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, CAST(f.doc_id AS VARCHAR)) AS k FROM fused f JOIN documents d ON d.doc_id = f.doc_id JOIN documents a ON a.doc_id = query_id
  WHERE (d.workspace_id IS NULL OR a.workspace_id IS NULL OR d.workspace_id = a.workspace_id) AND d.created_at <= a.created_at), {sql_budget('grp_key', BUDGET)}
SELECT CAST(split_part(grp, '|', 1) AS BIGINT) AS query_id, split_part(grp, '|', 2) AS route, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY k) AS INT) AS position, used FROM g WHERE fits""",
        "evidence_proofs": f"""WITH {named}, ev AS (SELECT id, epoch_us(min(occurred_at)) AS lo, coalesce(epoch_us(min(archived_at)), 9223372036854775807) AS hi FROM memory_events WHERE id IS NOT NULL GROUP BY id),
g AS (SELECT c, count(*) AS n, count(ev.id) AS have, max(lo) AS lo, min(hi) AS hi FROM named LEFT JOIN ev ON ev.id = e GROUP BY c)
SELECT c AS case, CASE WHEN n = have AND lo < hi THEN 'supported' ELSE 'unsupported' END AS status, CAST(CASE WHEN n = have AND lo < hi THEN n ELSE 0 END AS INT) AS proofs, CASE WHEN n = have AND lo < hi THEN lo END AS from_us, CASE WHEN n = have AND lo < hi THEN CASE WHEN hi = 9223372036854775807 THEN -1 ELSE hi END END AS to_us FROM g""",
        "evidence_branch_score": f"""WITH {named}, l AS (SELECT DISTINCT claim_id AS c, event_id AS e FROM claim_sources WHERE claim_id IS NOT NULL AND event_id IS NOT NULL), b AS (SELECT c, 'named' AS branch, e FROM named UNION ALL SELECT c, 'linked', e FROM l), live AS (SELECT DISTINCT id FROM memory_events WHERE archived_at IS NULL),
x AS (SELECT b.*, (c, e) IN (SELECT (c, e) FROM l) AS seen, e IN (SELECT id FROM live) AS fine FROM b), p AS (SELECT c, branch, count(*) FILTER (seen) / count(*) AS recall, bool_and(fine) AS ok FROM x GROUP BY ALL), f AS (SELECT c, count(DISTINCT e) AS n FROM x WHERE seen AND NOT fine GROUP BY c)
SELECT p.c AS case, round(max(recall) FILTER (ok), 6) AS recall, coalesce(max(recall) FILTER (ok) = 1, false) AS complete, coalesce(any_value(n), 0) AS forbidden FROM p LEFT JOIN f ON f.c = p.c GROUP BY p.c""",
        "claim_projection": """WITH a AS (SELECT 'c' || c_custkey AS s, 'located_in' AS p, 'n' || c_nationkey AS o, NULL AS problem FROM customer UNION ALL SELECT 's' || s_suppkey, 'located_in', s_name, 'needs_entity' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'located_in', 'r' || n_regionkey, 'outside_domain' FROM nation
UNION ALL SELECT 'r' || r_regionkey, 'borders', 'r' || r_regionkey, 'unknown_property' FROM region UNION ALL SELECT 'p' || p_partkey, 'size', CAST(p_size AS VARCHAR), NULL FROM part)
SELECT s AS id, CASE WHEN problem IS NULL THEN sha256('1:p' || length(s) || ':' || s || length(p) || ':' || p || length(o) || ':' || o || '1:0') END AS assertion_id, s AS subject, p AS predicate, o AS object, problem FROM a""",
        "queue_state": f"WITH {log} SELECT CAST(k AS VARCHAR) AS job, tenant, priority, status, attempts, CASE WHEN status = 'pending' THEN due END AS due_us FROM st",
        "queue_leases": f"""WITH {log}, busy AS (SELECT tenant, count(*) AS n FROM st WHERE status = 'leased' GROUP BY 1), p AS (SELECT st.*, row_number() OVER (PARTITION BY tenant ORDER BY priority DESC, due, CAST(k AS VARCHAR)) AS rank FROM st WHERE status = 'pending' AND due <= {_NOW_US}),
c AS (SELECT p.* FROM p LEFT JOIN busy USING (tenant) WHERE rank + coalesce(busy.n, 0) <= 40 ORDER BY rank, priority DESC, due, CAST(k AS VARCHAR) LIMIT 60), m AS (SELECT k, max(seq) AS seq FROM steps GROUP BY 1)
SELECT CAST(c.k AS VARCHAR) AS job, coalesce(m.seq, 0) + 1 AS seq, {_NOW_US + DAY_US} AS until_us FROM c LEFT JOIN m ON m.k = c.k""",
        "episode_attachments": f"WITH {episodes} SELECT user_id AS scope, session_id AS run, 'decision' AS kind, id FROM d UNION ALL SELECT user_id, session_id, 'outcome', id FROM o",
        "episode_rewards": f"""WITH {episodes}, k AS (SELECT o.user_id, o.session_id, o.id, event_type || '/' || length(content) % 2 AS key FROM o JOIN e USING (id)), p AS (SELECT user_id, session_id, count(*) AS n, min(key) AS key FROM k GROUP BY ALL)
SELECT user_id AS scope, count(*) AS episodes, CASE WHEN min(n) <> 1 OR max(n) <> 1 THEN 'incomplete' WHEN min(key) <> max(key) THEN 'incompatible' ELSE 'comparable' END AS status, CASE WHEN min(n) = 1 AND max(n) = 1 AND min(key) = max(key) THEN min(key) END AS key FROM p GROUP BY user_id""",
        "procedure_candidates": """WITH e AS (SELECT DISTINCT id, user_id, session_id, event_type, occurred_at, content_hash FROM memory_events WHERE id IS NOT NULL AND user_id IS NOT NULL AND session_id IS NOT NULL),
r AS (SELECT user_id, session_id, count(*) AS n, count(DISTINCT occurred_at) AS t, bool_or(event_type = 'tool.failed') AS failed, string_agg(event_type, '>' ORDER BY occurred_at, id) AS s FROM e GROUP BY ALL), k AS (SELECT *, n BETWEEN 2 AND 32 AND t = n AS ok FROM r),
h AS (SELECT user_id, max(n) AS shared FROM (SELECT user_id, content_hash, count(DISTINCT session_id) AS n FROM e JOIN k USING (user_id, session_id) WHERE ok AND NOT failed GROUP BY ALL) GROUP BY 1),
g AS (SELECT user_id, count(*) AS runs, count(*) FILTER (ok AND NOT failed) AS successful, count(*) FILTER (ok AND failed) AS against, count(*) FILTER (k.n > 32) AS too_long, min(s) FILTER (ok AND NOT failed) AS lo, max(s) FILTER (ok AND NOT failed) AS hi FROM k GROUP BY 1),
z AS (SELECT g.*, CASE WHEN successful < 1 THEN 'too_few' WHEN lo <> hi THEN 'conflicting' WHEN shared > 1 THEN 'shared_sources' ELSE 'candidate' END AS status FROM g LEFT JOIN h USING (user_id))
SELECT user_id, runs, successful, against, too_long, status, CASE WHEN status = 'candidate' THEN lo END AS sequence FROM z""",
        "composed_view": f"""WITH l AS ({ledger}), v AS (SELECT * FROM l WHERE replaced_us = -1 AND from_us <= {_AT_US} AND (to_us = -1 OR to_us > {_AT_US}))
SELECT partition_key, count(*) AS blocks, CASE WHEN count(*) > {MOST_BLOCKS} THEN 'over_capacity' ELSE 'composed' END AS status, CASE WHEN count(*) <= {MOST_BLOCKS} THEN sha256(string_agg(coalesce(claim_key, '?') || ' = ' || claim_id, chr(10) ORDER BY coalesce(claim_key, '?') || ' = ' || claim_id)) END AS digest, min(to_us) FILTER (to_us <> -1) AS next_us FROM v GROUP BY 1""",
        "contextual_view": """WITH i AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS rank, CASE WHEN o_totalprice > 450000 THEN NULL ELSE isodow(o_orderdate) <= 5 AND o_totalprice > 20000 END AS applies, o_orderstatus AS v FROM orders),
t AS (SELECT *, max(rank) FILTER (applies) OVER (PARTITION BY o_custkey) AS top FROM i WHERE coalesce(applies, true)), g AS (SELECT o_custkey, CASE WHEN bool_or(applies IS NULL) THEN 'unknown' WHEN count(DISTINCT v) > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, min(v) AS v FROM t WHERE top IS NULL OR rank >= top GROUP BY 1),
x AS (SELECT o_custkey, status, CASE status WHEN 'resolved' THEN 'State ' || v || '.' WHEN 'ambiguous' THEN 'Several states apply.' ELSE 'Not certain which state applies.' END AS text FROM g) SELECT o_custkey, status, text, sha256(length(status) || ':' || status || length(text) || ':' || text) AS digest FROM x""",
        "admission_batches": f"""WITH a AS ({decisions}), l AS (SELECT DISTINCT claim_id, event_id FROM claim_sources WHERE claim_id IS NOT NULL AND event_id IS NOT NULL)
SELECT event_id, count(DISTINCT claim_id) AS drafts, CASE WHEN bool_or(decision = 'l0_only') THEN 'refused' WHEN bool_or(decision = 'pending_verification') THEN 'held' ELSE 'published' END AS outcome FROM l JOIN a ON a.id = claim_id GROUP BY event_id""",
        "experiment_arms": f"""WITH {_BM25}, src AS (SELECT doc_id, lower(trim(source)) AS source FROM documents), i AS (SELECT doc_id AS query_id, source AS wanted FROM src WHERE doc_id % 50 = 0),
hits AS (SELECT 'lexical' AS arm, query_id, doc_id FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) WHERE r <= 5 UNION ALL SELECT 'adjacent', query_id, query_id + k FROM i, range(1, 6) t(k)),
sc AS (SELECT arm, query_id, avg(CASE WHEN source = wanted THEN 1.0 ELSE 0 END) AS score FROM hits JOIN src USING (doc_id) JOIN i USING (query_id) WHERE source IS NOT NULL AND wanted IS NOT NULL GROUP BY ALL), arms AS (SELECT unnest(['lexical', 'adjacent', 'broken']) AS arm)
SELECT arms.arm, count(*) AS planned, count(score) AS completed, round(avg(coalesce(score, 0)), 6) AS planned_mean, round(avg(score), 6) AS completed_mean FROM arms CROSS JOIN i LEFT JOIN sc ON sc.arm = arms.arm AND sc.query_id = i.query_id GROUP BY 1""",
    }
