"""Evaluation, governance, consolidation and exact answers: the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import calc
from annalist.functions.text import clipped, digest
from annalist.functions.time import DAY_US, micros
from annalist.operators import consolidate, evaluate, governance, rules
from annalist.operators.counted import plain_key
from annalist.operators.scope import first_of
from annalist.queries.retrieval import bm25_topk
from annalist.sources.tables import table

_AT_US = 1_780_272_000_000_000


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """memory_events, each id once (by its least row of the columns)."""
    rows = table(spark, d, "memory_events", "id", *columns).filter("id IS NOT NULL")
    return rows.groupBy("id").agg(F.min(F.struct(*columns)).alias("_e")).select("id", "_e.*")


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well the lexical search finds documents of the source of the asking one: precision and recall at 20."""
    source = table(spark, d, "documents", "doc_id", F.lower(F.trim("source")).alias("source"))
    hits = bm25_topk(spark, d).join(source, "doc_id").withColumnRenamed("source", "got")
    hits = hits.join(source.select(F.col("doc_id").alias("query_id"), "source"), "query_id")
    size = source.groupBy("source").agg(F.count("*").alias("relevant"))
    per = hits.groupBy("query_id", "source").agg(F.count("*").alias("returned"), F.count_if(F.col("got") == F.col("source")).alias("hits")).join(size, "source")
    out = per.agg(F.count("*").alias("queries"), evaluate.micro(F.col("hits"), F.col("returned")).alias("p"), evaluate.micro(F.col("hits"), F.col("relevant")).alias("r"))
    return out.select("queries", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"))


def order_score(spark: SparkSession, d: str) -> DataFrame:
    """How far the lines of an order ship in the order they are numbered."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    w = Window.partitionBy("l_orderkey")
    ranked = lines.select("l_orderkey", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("expected"), F.row_number().over(w.orderBy("l_shipdate", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")).alias("actual"))
    return evaluate.order_score(ranked, ["l_orderkey"], "expected", "actual").select("l_orderkey", "items", F.round("order_score", 6).alias("score"))


def planned_vs_completed(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of tool runs per tenant, over all planned and over those that ended well."""
    rows = _events(spark, d, "tenant_id", "event_type", "content").filter(F.col("event_type").isin("agent.tool.completed", "tool.failed"))
    score = F.when(F.col("event_type") == "agent.tool.completed", F.least(F.lit(1.0), F.length("content") / 100))
    out = rows.withColumn("s", score).groupBy("tenant_id").agg(F.count("*").alias("planned"), F.count("s").alias("completed"), F.avg(F.coalesce("s", F.lit(0.0))).alias("a"), F.avg("s").alias("b"))
    return out.select("tenant_id", "planned", "completed", F.round("a", 6).alias("planned_mean"), F.round("b", 6).alias("completed_mean"))


def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderpriority", "o_orderstatus").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return rows.select("o_orderpriority", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def cluster_robust_ci(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.cluster_interval(table(spark, d, "events", "event_type", "user_id", "value"), ["event_type"], "user_id", "value")
    return out.select("event_type", "n", "clusters", F.round("mean", 6).alias("mean"), F.round("margin", 6).alias("margin"))


def evidence_support_score(spark: SparkSession, d: str) -> DataFrame:
    """Which share of the sources a claim names are among its links."""
    named = table(spark, d, "claims", "id", "provenance_json").filter("id IS NOT NULL").distinct()
    named = named.select("id", F.explode(F.from_json(F.get_json_object("provenance_json", "$.source_event_ids"), "array<string>")).alias("event_id")).distinct()
    links = table(spark, d, "claim_sources").select(F.col("claim_id").alias("id"), "event_id").distinct().withColumn("_l", F.lit(1))
    out = named.join(links, ["id", "event_id"], "left").groupBy("id").agg(F.count("*").alias("named"), F.count("_l").alias("linked"))
    return out.select("id", "named", "linked", F.round(F.col("linked") / F.col("named"), 6).alias("coverage"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d, "event_type", "occurred_at", "ingested_at").withColumn("late_us", micros("ingested_at") - micros("occurred_at"))
    return evaluate.exact_percentiles(rows, ["event_type"], "late_us", [0.5, 0.95, 1.0])


def resource_gate(spark: SparkSession, d: str) -> DataFrame:
    """Event types whose median delay after the first of June is over that before by more than a tenth."""
    rows = _events(spark, d, "event_type", "occurred_at", "ingested_at").withColumn("late_us", micros("ingested_at") - micros("occurred_at")).withColumn("after", micros("occurred_at") >= _AT_US)
    p = evaluate.exact_percentiles(rows, ["event_type", "after"], "late_us", [0.5])
    out = p.groupBy("event_type").agg(F.max(F.when(~F.col("after"), F.col("late_us"))).alias("baseline"), F.max(F.when(F.col("after"), F.col("late_us"))).alias("candidate"))
    return out.withColumn("worse", F.col("candidate") > F.col("baseline") * 1.1)


def cost_allocation(spark: SparkSession, d: str) -> DataFrame:
    """The price of each order's lines shared by the parts of it, and common costs shared by all parts."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_tax", "l_quantity")
    costs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("request_ids"), F.when(F.max("l_tax") < 0.075, F.sum("l_quantity")).alias("value"))
    costs = costs.withColumn("request_ids", F.when(F.col("l_orderkey") % 500 == 0, F.array().cast("array<bigint>")).otherwise(F.col("request_ids"))).withColumnRenamed("l_orderkey", "entry_id")
    out = evaluate.allocated(costs, table(spark, d, "part", F.col("p_partkey").alias("request_id")))
    return out.select("request_id", F.round("known", 6).alias("known"), F.round("total", 6).alias("total"))


def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals per ship flag that are unknown as soon as one part is."""
    rows = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_discount")
    value = F.when(F.col("l_discount") < 0.1, F.col("l_quantity"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("entries"), F.round(F.sum(value), 4).alias("known"), F.when(F.max(value.isNull()), None).otherwise(F.round(F.sum(value), 4)).alias("total"))


def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Whether purchases are worth more than clicks, by users as clusters."""
    rows = table(spark, d, "events", "user_id", "event_type", "value").filter(F.col("event_type").isin("purchase", "click"))
    out = evaluate.bootstrap(rows.withColumn("diff", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(-F.col("value"))).withColumn("all", F.lit("all")), ["all"], "user_id", "diff")
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


def capture_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Expected messages per tenant, and how many have a chat row."""
    due = _events(spark, d, "tenant_id", "event_type").filter(F.col("event_type").isin("user.message", "agent.model.completed"))
    got = table(spark, d, "unified_memory_pilot_v2", F.col("event_id").alias("id")).distinct().withColumn("_g", F.lit(1))
    out = due.join(got, "id", "left").groupBy("tenant_id").agg(F.count("*").alias("expected"), F.count("_g").alias("captured"))
    return out.withColumn("ratio", F.round(F.col("captured") / F.col("expected"), 6))


def extraction_scores(spark: SparkSession, d: str) -> DataFrame:
    """Claims in June against those in May as (slot, value) facts: true and false positives, precision and recall."""
    rows = table(spark, d, "claims", "partition_key", "claim_key", "value_json", "created_at").select("partition_key", plain_key("claim_key").alias("k"), F.trim("value_json").alias("v"), F.floor((micros("created_at") - _AT_US) / (31 * DAY_US)).alias("m"))
    facts = lambda m: rows.filter(F.col("m") == m).select("partition_key", "k", "v").na.drop().distinct()
    want, got = facts(-1).withColumn("_w", F.lit(1)), facts(0).withColumn("_g", F.lit(1))
    both = want.join(got, ["partition_key", "k", "v"], "full_outer")
    out = both.agg(F.count_if(F.col("_w").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_w").isNull()).alias("fp"), F.count_if(F.col("_g").isNull()).alias("fn"))
    return out.withColumn("precision", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6)).withColumn("recall", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6))


def index_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Chat rows against events: content that is missing, unexpected or different."""
    want = _events(spark, d, "event_type", "content").filter(F.col("event_type").isin("user.message", "agent.model.completed")).select("id", "content")
    got = table(spark, d, "unified_memory_pilot_v2", "event_id", "content").groupBy(F.col("event_id").alias("id")).agg(F.min("content").alias("content"))
    return evaluate.reconciled(want, got, ["id"], "content")


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers all of whose required checks hold."""
    lines = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_discount", "l_quantity")
    per = lines.groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"), F.avg("l_discount").alias("discount"), F.count("*").alias("lines"))
    return per.select("l_suppkey", governance.gates({"returned": (None, 0.36), "discount": (0.045, 0.055), "lines": (550, None)}).alias("reasons"))


def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    """Which stage each tenant's tools have reached by their share of failures."""
    rows = _events(spark, d, "tenant_id", "event_type").filter(F.col("event_type").isin("agent.tool.completed", "tool.failed"))
    per = rows.groupBy("tenant_id").agg(F.count("*").alias("runs"), F.round(F.avg((F.col("event_type") == "tool.failed").cast("double")), 6).alias("failed"))
    stage = F.when(F.col("runs") < 20, "offline").when(F.col("failed") > 0.45, "shadow").when(F.col("failed") > 0.4, "canary").otherwise("active")
    return per.select("tenant_id", "runs", "failed", stage.alias("stage"))


def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "memory_events", F.col("content").alias("t")).unionByName(table(spark, d, "documents", F.col("text").alias("t")))
    return governance.scanned(both, "t")


def redaction(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d, "content").filter("content IS NOT NULL")
    return rows.select("id", governance.redacted("content").alias("content"))


def dq_doctor(spark: SparkSession, d: str) -> DataFrame:
    """Integrity checks over the store, one row each."""
    claims = table(spark, d, "claims", "id", "partition_key", "claim_key", "status", "valid_from", "valid_to", "supersedes", "version", "confidence").filter("id IS NOT NULL").distinct()
    events = table(spark, d, "memory_events", "id").distinct()
    links = table(spark, d, "claim_sources").distinct()
    active = claims.filter(plain_key("status") == "active").groupBy("partition_key", plain_key("claim_key").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1")
    checks = [
        governance.finding("duplicate_active", "warning", active, "id"),
        governance.finding("orphan_source", "error", links.join(events, F.col("event_id") == F.col("id"), "left_anti"), "claim_id"),
        governance.finding("no_source", "error", claims.join(links, F.col("id") == F.col("claim_id"), "left_anti"), "id"),
        governance.finding("empty_interval", "warning", claims.filter("valid_to <= valid_from"), "id"),
        governance.finding("dangling_supersedes", "error", claims.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("s"), F.col("id").alias("i")).join(claims, F.col("s") == F.col("id"), "left_anti"), "i"),
        governance.finding("bad_confidence", "error", claims.filter("confidence IS NULL OR confidence < 0 OR confidence > 1"), "id"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def health_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c: table(spark, d, t).groupBy(F.lit(t).alias("table"), c.alias("status")).agg(F.count("*").alias("n"))
    return one("claims", plain_key("status")).unionByName(one("memory_events", F.col("retention_class"))).unionByName(one("unified_memory_pilot_v2", F.col("phase")))


def ledger_running_balance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return governance.running_balance(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "cents", 100_000_000).select("o_orderkey", "balance", "within")


def slot_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claims", "id", "tenant_id", "partition_key", "claim_key", "created_at").filter("id IS NOT NULL").distinct()
    rows = rows.select("tenant_id", F.concat_ws("/", "partition_key", plain_key("claim_key")).alias("slot"), "created_at")
    return governance.batches_of_slots(rows, "tenant_id", "slot", "created_at", 40)


def readiness_fold(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "needs_resolution").otherwise("pending")
    return governance.readiness(table(spark, d, "orders", "o_custkey", "o_orderstatus").withColumn("s", state), ["o_custkey"], "s").select("o_custkey", "n", "completed", "stage")


def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay in a cache of half of all characters, newest first."""
    docs = table(spark, d, "documents", "doc_id", "n_chars", "created_at").withColumn("t", micros("created_at").cast("double")).filter("t IS NOT NULL")
    half = docs.agg(F.sum("n_chars")).collect()[0][0] // 2
    return governance.kept_within(docs, "t", "doc_id", "n_chars", half).select("doc_id")


def episode_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d, "session_id", "user_id", "event_type", "occurred_at")
    out = consolidate.episodes(rows, ["session_id", "user_id", "id"], ["occurred_at", "id"], "event_type")
    return out.select("episode", "n", micros("first").alias("first_us"), micros("last").alias("last_us"), "outcome", "kinds")


def procedure_support(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for each way of shipping by supplier."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    runs = lines.select(F.col("l_suppkey").alias("action"), (F.col("l_returnflag") != "R").alias("good"), F.col("l_quantity").alias("quality"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return consolidate.procedures(runs, "action", "good", "quality", "id", 420).select("action", "support", "against", "refused")


def feedback_chain(spark: SparkSession, d: str) -> DataFrame:
    """Clicks with the view before them, purchases with the click before them."""
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    click = consolidate.latest_parent(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", "event_id").filter("event_type = 'click'")
    buy = consolidate.latest_parent(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "event_id").filter("event_type = 'purchase'")
    return click.unionByName(buy).select("event_id", "event_type", "parent")


def multi_step_procedures(spark: SparkSession, d: str) -> DataFrame:
    """How many sessions went through each sequence of steps, however long."""
    rows = _events(spark, d, "session_id", "event_type", "occurred_at").filter("session_id IS NOT NULL")
    seq = consolidate.step_sequences(rows, "session_id", ["occurred_at", "id"], "event_type")
    return seq.groupBy("sequence").agg(F.count("*").alias("runs"))


def late_parent_pending(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose superseded claim was known before them, after them, or never."""
    claims = table(spark, d, "claims", "id", "supersedes", "created_at").filter("id IS NOT NULL")
    once = first_of(claims, ["id"], ["created_at"])
    parents = once.select(F.col("id").alias("supersedes"), F.col("created_at").alias("_p"))
    state = F.when(F.col("_p").isNull(), "pending").when(F.col("_p") > F.col("created_at"), "late").otherwise("accepted")
    return once.filter("supersedes IS NOT NULL").join(parents, "supersedes", "left").select("id", state.alias("state"))


def interval_arithmetic_answers(spark: SparkSession, d: str) -> DataFrame:
    """How long each order took, and whether it is sure to have ended before thirty days were over."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("lo"), F.max(F.to_date("l_shipdate")).alias("hi"))
    rows = table(spark, d, "orders", "o_orderkey", F.to_date("o_orderdate").alias("day")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    limit = F.date_add("day", 30)
    return rows.select("o_orderkey", F.datediff("lo", "day").alias("least_days"), F.datediff("hi", "day").alias("most_days"), calc.elapsed_months(F.col("day"), F.col("hi")).alias("months"), calc.order_of(F.col("lo"), F.col("hi"), limit, limit).alias("against_limit"), calc.is_full_month(F.col("lo"), F.col("hi")).alias("full_month"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    """Digest and name-based UUID of each claim."""
    rows = table(spark, d, "claims", "id", "claim_key", "value_json").filter("id IS NOT NULL").distinct()
    return rows.select("id", digest("id", "claim_key", "value_json").alias("digest"), calc.named_uuid(F.col("id")).alias("uuid"))


def clipped_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.length(clipped("text", 80)).alias("n"))


def attribution_risks(spark: SparkSession, d: str) -> DataFrame:
    """Why a message may not speak for its author: quoted, hypothetical, of a third person."""
    rows = _events(spark, d, "event_type", "content").filter("event_type = 'user.message' AND content IS NOT NULL")
    why = rules.reasons(("quoted", F.col("content").rlike('["“”«»]')), ("hypothetical", F.col("content").rlike("(?i)\\b(if|would|could|might|falls)\\b")), ("third_party", F.col("content").rlike("(?i)\\b(he|she|they) (said|says|wants)\\b")))
    return rows.select("id", F.array_join(why, ",").alias("risks"))


def top_customers_by_region(spark: SparkSession, d: str) -> DataFrame:
    """A star join over the sample tables: revenue per region and segment."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    rows = per_order.join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "c_mktsegment").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("orders"))


NAMES = (ir_metrics, order_score, planned_vs_completed, wilson_ci, cluster_robust_ci, evidence_support_score, latency_percentiles, resource_gate, cost_allocation, cost_summary, paired_bootstrap, capture_coverage, extraction_scores, index_reconciliation, release_gate, promotion_gates, pii_scan, redaction, dq_doctor, health_counts, ledger_running_balance, slot_batches, readiness_fold, cache_eviction, episode_sessions, procedure_support, feedback_chain, multi_step_procedures, late_parent_pending, interval_arithmetic_answers, identities, clipped_text, attribution_risks, top_customers_by_region)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    from annalist.queries.retrieval import _BM25

    tools = "t AS (SELECT DISTINCT id, tenant_id, event_type, content FROM memory_events WHERE event_type IN ('agent.tool.completed', 'tool.failed'))"
    late = "e AS (SELECT id, event_type, occurred_at, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM memory_events) WHERE rn = 1), l AS (SELECT event_type, epoch_us(ingested_at) - epoch_us(occurred_at) AS late_us, epoch_us(occurred_at) >= 1780272000000000 AS after FROM e)"
    pats = [(n, s, p.replace("'", "''"), r) for n, s, p, r in governance.PATTERNS]
    scan = " UNION ALL ".join(f"SELECT '{n}' AS pattern, '{s}' AS severity, count(*) FILTER (regexp_matches(t, '{p}')) AS rows, coalesce(CAST(sum(len(regexp_extract_all(t, '{p}'))) AS BIGINT), 0) AS matches FROM x" for n, s, p, _ in pats)
    red = "content"
    for _, _, p, r in pats:
        red = f"regexp_replace({red}, '{p}', '{r}', 'g')"
    claims = "c AS (SELECT DISTINCT id, partition_key, claim_key, status, valid_from, valid_to, supersedes, version, confidence FROM claims WHERE id IS NOT NULL), ev AS (SELECT DISTINCT id FROM memory_events), l AS (SELECT DISTINCT * FROM claim_sources)"
    return {
        "clipped_text": "SELECT doc_id, least(80, length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS n FROM documents",
        "ir_metrics": f"""WITH {_BM25}, r AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 20),
src AS (SELECT doc_id, lower(trim(source)) AS source FROM documents), z AS (SELECT source, count(*) AS relevant FROM src GROUP BY 1),
h AS (SELECT query_id, a.source, count(*) AS returned, count(*) FILTER (b.source = a.source) AS hits FROM k JOIN src a ON a.doc_id = query_id JOIN src b ON b.doc_id = k.doc_id GROUP BY ALL)
SELECT count(*) AS queries, round(sum(hits) / sum(returned), 6) AS precision, round(sum(hits) / sum(relevant), 6) AS recall FROM h JOIN z USING (source)""",
        "order_score": """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber, l_suppkey, l_extendedprice) AS a FROM lineitem),
p AS (SELECT x.l_orderkey, count(*) FILTER (x.a < y.a) AS good, count(*) AS pairs FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.e < y.e GROUP BY 1), n AS (SELECT l_orderkey, count(*) AS items FROM r GROUP BY 1)
SELECT l_orderkey, items, coalesce(round(good / pairs, 6), 1.0) AS score FROM n LEFT JOIN p USING (l_orderkey)""",
        "planned_vs_completed": f"WITH {tools}, s AS (SELECT *, CASE WHEN event_type = 'agent.tool.completed' THEN least(1.0, length(content) / 100) END AS s FROM t) SELECT tenant_id, count(*) AS planned, count(s) AS completed, round(avg(coalesce(s, 0)), 6) AS planned_mean, round(avg(s), 6) AS completed_mean FROM s GROUP BY 1",
        "wilson_ci": """WITH r AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1), p AS (SELECT *, k / n AS p FROM r)
SELECT o_orderpriority, n, k, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM p""",
        "cluster_robust_ci": """WITH c AS (SELECT event_type, user_id, count(value) AS n, sum(value) AS s FROM events GROUP BY ALL), w AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS n, count(*) AS g, sum(s) / sum(n) AS m FROM c GROUP BY 1)
SELECT w.event_type, w.n, g AS clusters, round(m, 6) AS mean, round(1.96 * sqrt(g / (g - 1) * sum(pow(c.s - c.n * m, 2))) / w.n, 6) AS margin FROM w JOIN c USING (event_type) GROUP BY w.event_type, w.n, g, m""",
        "evidence_support_score": """WITH n AS (SELECT DISTINCT id, unnest(CAST(json_extract(provenance_json, '$.source_event_ids') AS VARCHAR[])) AS event_id FROM claims WHERE json_valid(provenance_json)), l AS (SELECT DISTINCT claim_id, event_id FROM claim_sources)
SELECT id, count(*) AS named, count(claim_id) AS linked, round(count(claim_id) / count(*), 6) AS coverage FROM n LEFT JOIN l ON id = claim_id AND n.event_id = l.event_id GROUP BY id""",
        "latency_percentiles": f"WITH {late}, p AS (SELECT unnest([0.5, 0.95, 1.0]) AS p) SELECT DISTINCT event_type, CAST(p AS DOUBLE) AS p, late_us FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY late_us) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM l), p WHERE rn = CAST(ceil(round(n * p, 9)) AS BIGINT)",
        "resource_gate": f"WITH {late}, m AS (SELECT event_type, after, quantile_disc(late_us, 0.5) AS v FROM l GROUP BY ALL), o AS (SELECT event_type, max(v) FILTER (NOT after) AS baseline, max(v) FILTER (after) AS candidate FROM m GROUP BY 1) SELECT *, candidate > baseline * 1.1 AS worse FROM o",
        "cost_allocation": """WITH c AS (SELECT l_orderkey, CASE WHEN l_orderkey % 500 = 0 THEN [] ELSE list(DISTINCT l_partkey) END AS ids, CASE WHEN max(l_tax) < 0.075 THEN sum(l_quantity) END AS v FROM lineitem GROUP BY 1),
o AS (SELECT unnest(ids) AS id, v / len(ids) AS v FROM c WHERE len(ids) > 0), a AS (SELECT coalesce(sum(v), 0) / (SELECT count(*) FROM part) AS each, coalesce(bool_or(v IS NULL), false) AS bad FROM c WHERE len(ids) = 0), g AS (SELECT id, sum(v) AS v, bool_or(v IS NULL) AS bad FROM o GROUP BY 1)
SELECT p_partkey AS request_id, round(coalesce(g.v, 0) + each, 6) AS known, CASE WHEN NOT coalesce(g.bad, false) AND NOT a.bad THEN round(coalesce(g.v, 0) + each, 6) END AS total FROM part LEFT JOIN g ON id = p_partkey, a""",
        "cost_summary": "SELECT l_returnflag, count(*) AS entries, round(sum(v), 4) AS known, CASE WHEN bool_or(v IS NULL) THEN NULL ELSE round(sum(v), 4) END AS total FROM (SELECT l_returnflag, CASE WHEN l_discount < 0.1 THEN l_quantity END AS v FROM lineitem) GROUP BY 1",
        "capture_coverage": "WITH e AS (SELECT DISTINCT id, tenant_id FROM memory_events WHERE event_type IN ('user.message', 'agent.model.completed')) SELECT tenant_id, count(*) AS expected, count(*) FILTER (id IN (SELECT event_id FROM unified_memory_pilot_v2)) AS captured, round(count(*) FILTER (id IN (SELECT event_id FROM unified_memory_pilot_v2)) / count(*), 6) AS ratio FROM e GROUP BY 1",
        "extraction_scores": """WITH r AS (SELECT DISTINCT partition_key, lower(trim(claim_key)) AS k, trim(value_json) AS v, floor((epoch_us(created_at) - 1780272000000000) / 2678400000000) AS m FROM claims WHERE value_json IS NOT NULL AND claim_key IS NOT NULL AND partition_key IS NOT NULL),
w AS (SELECT partition_key, k, v FROM r WHERE m = -1), g AS (SELECT partition_key, k, v FROM r WHERE m = 0), c AS (SELECT (SELECT count(*) FROM (SELECT * FROM w INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM w)) AS fp, (SELECT count(*) FROM (SELECT * FROM w EXCEPT SELECT * FROM g)) AS fn)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
        "index_reconciliation": """WITH w AS (SELECT DISTINCT id, content FROM memory_events WHERE event_type IN ('user.message', 'agent.model.completed')), g AS (SELECT event_id, min(content) AS content FROM unified_memory_pilot_v2 WHERE event_id IS NOT NULL GROUP BY 1)
SELECT coalesce(id, event_id) AS id, CASE WHEN event_id IS NULL THEN 'missing' WHEN id IS NULL THEN 'unexpected' ELSE 'mismatch' END AS problem FROM w FULL JOIN g ON id = event_id WHERE event_id IS NULL OR id IS NULL OR w.content IS DISTINCT FROM g.content""",
        "release_gate": """WITH p AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS r, avg(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, array_to_string(list_filter([CASE WHEN r > 0.36 THEN 'returned_high' END, CASE WHEN d < 0.045 THEN 'discount_low' WHEN d > 0.055 THEN 'discount_high' END, CASE WHEN n < 550 THEN 'lines_low' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""",
        "promotion_gates": f"WITH {tools}, p AS (SELECT tenant_id, count(*) AS runs, round(avg(CASE WHEN event_type = 'tool.failed' THEN 1.0 ELSE 0 END), 6) AS failed FROM t GROUP BY 1) SELECT tenant_id, runs, failed, CASE WHEN runs < 20 THEN 'offline' WHEN failed > 0.45 THEN 'shadow' WHEN failed > 0.4 THEN 'canary' ELSE 'active' END AS stage FROM p",
        "pii_scan": f"WITH x AS (SELECT content AS t FROM memory_events WHERE content IS NOT NULL UNION ALL SELECT text FROM documents WHERE text IS NOT NULL) {scan}",
        "redaction": f"SELECT DISTINCT id, {red} AS content FROM memory_events WHERE content IS NOT NULL",
        "dq_doctor": f"""WITH {claims}, d AS (SELECT min(id) AS id FROM c WHERE lower(trim(status)) = 'active' GROUP BY partition_key, lower(trim(claim_key)) HAVING count(*) > 1)
SELECT 'duplicate_active' AS code, 'warning' AS severity, count(*) AS n, min(id) AS sample FROM d
UNION ALL SELECT 'orphan_source', 'error', count(*), min(claim_id) FROM l WHERE event_id NOT IN (SELECT id FROM ev) OR event_id IS NULL
UNION ALL SELECT 'no_source', 'error', count(*), min(id) FROM c WHERE id NOT IN (SELECT claim_id FROM l WHERE claim_id IS NOT NULL)
UNION ALL SELECT 'empty_interval', 'warning', count(*), min(id) FROM c WHERE valid_to <= valid_from
UNION ALL SELECT 'dangling_supersedes', 'error', count(*), min(id) FROM c WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM c)
UNION ALL SELECT 'bad_confidence', 'error', count(*), min(id) FROM c WHERE confidence IS NULL OR confidence < 0 OR confidence > 1""",
        "health_counts": """SELECT 'claims' AS "table", lower(trim(status)) AS status, count(*) AS n FROM claims GROUP BY 2 UNION ALL SELECT 'memory_events', retention_class, count(*) FROM memory_events GROUP BY 2 UNION ALL SELECT 'unified_memory_pilot_v2', phase, count(*) FROM unified_memory_pilot_v2 GROUP BY 2""",
        "ledger_running_balance": """WITH b AS (SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM orders) SELECT o_orderkey, balance, balance <= 100000000 AS within FROM b""",
        "slot_batches": """WITH RECURSIVE r AS (SELECT DISTINCT id, tenant_id, partition_key, claim_key, created_at FROM claims WHERE id IS NOT NULL), s AS (SELECT tenant_id, concat_ws('/', partition_key, lower(trim(claim_key))) AS slot, min(created_at) AS f, count(*) AS members FROM r GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY f, slot) AS k FROM s), g AS (SELECT tenant_id, slot, members, k, CAST(1 AS BIGINT) AS batch, members AS used FROM c WHERE k = 1 UNION ALL
SELECT c.tenant_id, c.slot, c.members, c.k, CASE WHEN g.used + c.members > 40 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.used + c.members > 40 THEN c.members ELSE g.used + c.members END FROM g JOIN c ON c.tenant_id IS NOT DISTINCT FROM g.tenant_id AND c.k = g.k + 1) SELECT tenant_id, slot, members, batch FROM g""",
        "readiness_fold": """SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS completed, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'blocked' WHEN bool_and(o_orderstatus = 'F') THEN 'reached' ELSE 'processing' END AS stage FROM orders GROUP BY 1""",
        "cache_eviction": "SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY created_at DESC, doc_id ROWS UNBOUNDED PRECEDING) AS u FROM documents WHERE created_at IS NOT NULL) WHERE u <= (SELECT sum(n_chars) FROM documents WHERE created_at IS NOT NULL) // 2",
        "episode_sessions": """WITH e AS (SELECT DISTINCT id, session_id, user_id, event_type, occurred_at FROM memory_events), k AS (SELECT *, coalesce('session_id:' || session_id, 'user_id:' || user_id, 'id:' || id) AS episode FROM e)
SELECT episode, count(*) AS n, epoch_us(min(occurred_at)) AS first_us, epoch_us(max(occurred_at)) AS last_us, arg_max(event_type, (occurred_at, id)) AS outcome, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM k GROUP BY episode""",
        "procedure_support": "SELECT l_suppkey AS action, count(*) FILTER (l_returnflag <> 'R') AS support, count(*) FILTER (l_returnflag = 'R') AS against, CASE WHEN count(*) FILTER (l_returnflag <> 'R') < 420 THEN 'too_little_support' WHEN count(*) FILTER (l_returnflag = 'R') > count(*) FILTER (l_returnflag <> 'R') THEN 'mostly_fails' END AS refused FROM lineitem GROUP BY 1",
        "feedback_chain": """WITH p AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN v ELSE c END AS parent FROM p WHERE event_type IN ('click', 'purchase')""",
        "multi_step_procedures": """WITH e AS (SELECT DISTINCT id, session_id, event_type, occurred_at FROM memory_events WHERE session_id IS NOT NULL), s AS (SELECT session_id, string_agg(event_type, '>' ORDER BY occurred_at, id) AS sequence, count(*) AS n FROM e GROUP BY 1) SELECT sequence, count(*) AS runs FROM s WHERE n >= 2 GROUP BY 1""",
        "late_parent_pending": """WITH o AS (SELECT id, min(created_at) AS t, min(supersedes) AS s FROM claims GROUP BY id) SELECT a.id, CASE WHEN b.id IS NULL THEN 'pending' WHEN b.t > a.t THEN 'late' ELSE 'accepted' END AS state FROM o a LEFT JOIN o b ON b.id = a.s WHERE a.s IS NOT NULL""",
        "interval_arithmetic_answers": """WITH l AS (SELECT l_orderkey, min(l_shipdate)::DATE AS lo, max(l_shipdate)::DATE AS hi FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, o_orderdate::DATE AS day, lo, hi, o_orderdate::DATE + 30 AS lim FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderkey, lo - day AS least_days, hi - day AS most_days, (year(hi) * 12 + month(hi)) - (year(day) * 12 + month(day)) AS months, CASE WHEN hi < lim THEN 'before' WHEN lo > lim THEN 'after' WHEN lo = hi AND lo = lim THEN 'same' END AS against_limit, date_trunc('month', lo) = lo AND last_day(lo) = hi AS full_month FROM r""",
        "identities": """SELECT DISTINCT id, sha256(concat(length(id) || ':' || id, coalesce(length(claim_key) || ':' || claim_key, '-'), coalesce(length(value_json) || ':' || value_json, '-'))) AS digest,
substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST(('0x' || substr(h, 17, 1)) AS INT) % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(id)) AS h FROM claims WHERE id IS NOT NULL)""",
        "attribution_risks": r"""SELECT DISTINCT id, array_to_string(list_filter([CASE WHEN regexp_matches(content, '["“”«»]') THEN 'quoted' END, CASE WHEN regexp_matches(content, '(?i)\b(if|would|could|might|falls)\b') THEN 'hypothetical' END, CASE WHEN regexp_matches(content, '(?i)\b(he|she|they) (said|says|wants)\b') THEN 'third_party' END], lambda x: x IS NOT NULL), ',') AS risks FROM memory_events WHERE event_type = 'user.message' AND content IS NOT NULL""",
        "top_customers_by_region": """SELECT r_name, c_mktsegment, round(sum(rev), 2) AS revenue, count(*) AS orders FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    }
