"""Scopes, versions, rules: the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.time import NO_END, micros
from annalist.operators import rules, scope, versions
from annalist.operators.counted import counted_intervals, one_per_id, plain_key
from annalist.operators.coverage import coverage
from annalist.operators.ledger import SLOT, ledger
from annalist.operators.timeshards import find_cuts
from annalist.sources.tables import table

_AT = "2026-06-01 00:00:00"
_AT_US = 1_780_272_000_000_000


def _claims(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "claims", "id", *columns).filter("id IS NOT NULL")


def scope_visible_rows(spark: SparkSession, d: str) -> DataFrame:
    """How many claims the readers of each user and workspace see."""
    levels = ("user_id", "workspace_id")
    readers = table(spark, d, "memory_events", "tenant_id", "namespace", *levels).distinct()
    held = _claims(spark, d, "tenant_id", "namespace", *levels).distinct().groupBy("tenant_id", "namespace", *levels).agg(F.count("*").alias("n"))
    seen = scope.ancestors(readers, levels).alias("s")
    same = (F.col("s.tenant_id") == F.col("h.tenant_id")) & (F.col("s.namespace") == F.col("h.namespace"))
    for c in levels:
        same &= F.col(f"s.seen_{c}").eqNullSafe(F.col(f"h.{c}"))
    out = seen.join(held.alias("h"), same, "left").groupBy("s.tenant_id", "s.namespace", "s.user_id", "s.workspace_id")
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("visible"))


def scope_ancestor_keys(spark: SparkSession, d: str) -> DataFrame:
    scopes = table(spark, d, "memory_events", "tenant_id", "namespace", *scope.LEVELS).distinct()
    return scope.ancestors(scopes).select("tenant_id", "namespace", *(F.col(f"seen_{c}").alias(c) for c in scope.LEVELS)).distinct().select(scope.scope_key().alias("key"), "tenant_id")


def scope_level_chain(spark: SparkSession, d: str) -> DataFrame:
    scopes = table(spark, d, "memory_events", "tenant_id", "namespace", *scope.LEVELS).distinct()
    out = scope.chain(scopes)
    return out.groupBy("tenant_id", "namespace", *(F.col(f"seen_{c}").alias(c) for c in scope.LEVELS)).agg(F.count("*").alias("below"))


def idempotent_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_events", "partition_key", "idempotency_key", "ingested_at", "id")
    return scope.first_of(rows, ["partition_key", "idempotency_key"], ["ingested_at", "id"]).select("partition_key", "idempotency_key", "id", micros("ingested_at").alias("ingested_us"))


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_events", "id", "occurred_at").filter("id IS NOT NULL").distinct()
    return scope.page_after(rows, ["occurred_at", "id"], (_AT, ""), 100).select("id", micros("occurred_at").alias("at_us"))


def _bitemporal(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claims")
    rows = counted_intervals(claims, micros("created_at").alias("created_us"), "version", "supersedes", "value_json")
    return ledger(one_per_id(rows, "created_us"), find_cuts(counted_intervals(claims), SLOT, ["from_us", "to_us"]))


def bitemporal_as_of(spark: SparkSession, d: str) -> DataFrame:
    """What each slot held on the first of June, as it was known then."""
    at = (F.col("from_us") <= _AT_US) & (F.col("to_us") > _AT_US) & (F.col("recorded_us") <= _AT_US) & (F.col("replaced_us") > _AT_US)
    return _bitemporal(spark, d).filter(at).select(*SLOT, "claim_id")


def bitemporal_grid(spark: SparkSession, d: str) -> DataFrame:
    """How many slots had a value at the start of each month, as known at the start of each month."""
    months = [_AT_US + 86_400_000_000 * k for k in (-92, -61, -31, 0, 30, 61)]
    rows = _bitemporal(spark, d)

    def within(lo: str, hi: str) -> F.Column:
        return F.explode(F.filter(F.array(*(F.lit(m) for m in months)), lambda m: (m >= F.col(lo)) & (m < F.col(hi))))

    rows = rows.withColumn("valid_us", within("from_us", "to_us")).withColumn("known_us", within("recorded_us", "replaced_us"))
    return rows.groupBy("valid_us", "known_us").agg(F.count("*").alias("slots"))


def latest_version_known_at(spark: SparkSession, d: str) -> DataFrame:
    rows = _claims(spark, d, *SLOT, "created_at", "version").withColumn("claim_key", plain_key("claim_key")).select("id", *SLOT, micros("created_at").alias("created_us"), "version")
    out = versions.latest_known(rows, list(SLOT), "created_us", _AT_US, ["version", "id"])
    return out.select(*SLOT, "created_us", "version", "id", "next_known")


def interval_materialize(spark: SparkSession, d: str) -> DataFrame:
    """Which claim holds when, whatever its value."""
    claims = table(spark, d, "claims")
    rows = counted_intervals(claims, micros("created_at").alias("created_us"), "version", "supersedes", F.col("id").alias("value_json"))
    made = ledger(one_per_id(rows, "created_us"), find_cuts(counted_intervals(claims), SLOT, ["from_us", "to_us"]))
    return made.filter(F.col("replaced_us") == NO_END).select(*SLOT, "claim_id", "from_us", "to_us")


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    """When each customer had an order under way: from its date until its last line was shipped."""
    shipped = table(spark, d, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("until"))
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    spans = orders.select("o_custkey", micros("o_orderdate").alias("lo"), micros("until").alias("hi"))
    return coverage(spans, ("o_custkey",), "lo", "hi")


def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    """The part of each line's ten days after shipping that lies within thirty days of its order."""
    day = 86_400_000_000
    orders = table(spark, d, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("k"), micros("o_orderdate").alias("lo"), (micros("o_orderdate") + 30 * day).alias("hi"))
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").select(F.col("l_orderkey").alias("k"), "l_linenumber", micros("l_shipdate").alias("lo"), (micros("l_shipdate") + 10 * day).alias("hi"))
    both = versions.intersections(lines, orders, ["k"], "lo", "hi")
    return both.select("k", "l_linenumber", "start", "end")


def scd2_claims(spark: SparkSession, d: str) -> DataFrame:
    out = _scd2(spark, d)
    return out.select("user_id", "version", "event_type", micros("valid_from").alias("from_us"), micros("valid_to").alias("to_us"), "supersedes", "corroborations")


def _scd2(spark: SparkSession, d: str) -> DataFrame:
    return versions.scd2(table(spark, d, "events", "event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type")


def state_delta_feed(spark: SparkSession, d: str) -> DataFrame:
    return versions.delta_feed(_scd2(spark, d), ["user_id"], "event_type").select("user_id", micros("at").alias("at_us"), "operation", "before", "after")


def evidence_live_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Claims all of whose sources are still there."""
    links = table(spark, d, "claim_sources").select(F.col("claim_id").alias("id"), F.col("event_id").alias("source"))
    alive = table(spark, d, "memory_events", "id", "archived_at").filter("archived_at IS NULL").select(F.col("id").alias("source"))
    return scope.fully_supported(_claims(spark, d), links, alive, "id", "source")


def events_exist(spark: SparkSession, d: str) -> DataFrame:
    """Sources named by claims that are no events."""
    links = table(spark, d, "claim_sources").filter("event_id IS NOT NULL").distinct()
    return links.join(table(spark, d, "memory_events", F.col("id").alias("event_id")), "event_id", "left_anti").select("claim_id", "event_id")


def guard_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a claim isn't delivered as of the first of June, or null if it is."""
    at = F.lit(_AT).cast("timestamp_ntz")
    rows = _claims(spark, d, "status", "archived_at", "provenance_json", "valid_from", "valid_to", "confidence").distinct()
    sources = F.size(F.from_json(F.get_json_object("provenance_json", "$.source_event_ids"), "array<string>"))
    why = (
        F.when(plain_key("status") == "rejected", "deleted").when(F.col("archived_at") <= at, "archived").when(F.col("confidence") < 0.3, "untrusted")
        .when(F.coalesce(sources, F.lit(0)) <= 0, "missing_provenance").when(F.col("valid_from") > at, "not_yet_valid").when(F.col("valid_to") <= at, "expired")
    )
    return rows.select("id", why.alias("reason"))


def kleene_applicability(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    types = dict(orders.dtypes)
    when = [{"op": "or", "of": [{"op": "eq", "attr": "o_orderstatus", "value": "F"}, {"op": "gt", "attr": "o_totalprice", "value": 150000}]}, {"op": "in", "attr": "o_orderpriority", "value": ["1-URGENT", "2-HIGH", 3]}, {"op": "weekday", "attr": "o_orderdate", "value": [0, 1, 2, 3, 4]}]
    unless = [{"op": "lt", "attr": "o_totalprice", "value": 5000}, {"op": "eq", "attr": "o_orderstatus", "value": 1}]
    out = rules.applicable([rules.condition(c, types) for c in when], [rules.condition(c, types) for c in unless[:1]])
    strict = rules.applicable([], [rules.condition(unless[1], types)])
    return orders.select("o_orderkey", out.alias("applies"), strict.alias("strict"))


def admission_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = _claims(spark, d, "text", "confidence", "importance", "value_json", "valid_from", "valid_to", "status").distinct()
    why = rules.reasons(("no_text", F.coalesce(F.length("text"), F.lit(0)) == 0), ("low_confidence", F.col("confidence") < 0.4), ("no_value", F.col("value_json").isNull()), ("empty_interval", F.col("valid_to") <= F.col("valid_from")), ("rejected", plain_key("status") == "rejected"))
    out = rows.withColumn("reasons", why)
    decision = F.when(F.size("reasons") == 0, "accept").when(F.array_contains("reasons", "no_text") | F.array_contains("reasons", "rejected") | F.array_contains("reasons", "empty_interval"), "l0_only").otherwise("pending_verification")
    return out.select("id", decision.alias("decision"), F.array_join("reasons", ",").alias("reasons"))


def slot_projection(spark: SparkSession, d: str) -> DataFrame:
    """Each slot's base claim on the first of June: the latest that began, if it still holds, else unknown."""
    rows = one_per_id(counted_intervals(table(spark, d, "claims"), micros("created_at").alias("created_us"), "version"), "created_us")
    begun = rows.filter(F.col("from_us") <= _AT_US).groupBy(*SLOT).agg(F.max(F.struct("from_us", "created_us", "id", "to_us")).alias("b"))
    later = rows.filter(F.col("from_us") > _AT_US).groupBy(*SLOT).agg(F.min("from_us").alias("next_us"))
    out = begun.join(later.select(*(F.col(k).alias(f"_{k}") for k in SLOT), "next_us"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in SLOT], "left")
    holds = F.col("b.to_us") > _AT_US
    return out.select(*SLOT, F.when(holds, F.col("b.id")).alias("claim_id"), F.when(holds, F.least("next_us", F.when(F.col("b.to_us") < NO_END, F.col("b.to_us")))).alias("until_us"))


def override_compose(spark: SparkSession, d: str) -> DataFrame:
    """Customers' state from the domains of their orders, urgent over open over the rest."""
    orders = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    domain = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").when(F.col("o_orderstatus") == "O", "open").otherwise("rest")
    applies = F.when(F.col("o_totalprice") > 400000, F.lit(None).cast("boolean")).otherwise(F.col("o_totalprice") > 20000)
    return rules.composed(orders.select("o_custkey", domain.alias("domain"), applies.alias("applies"), F.col("o_orderstatus").alias("value")), ["o_custkey"], ["rest", "open", "urgent"])


def claim_consolidation_ops(spark: SparkSession, d: str) -> DataFrame:
    rows = counted_intervals(table(spark, d, "claims"), micros("created_at").alias("created"), "version", F.floor(F.col("confidence") * 5).cast("int").alias("trust"), F.col("value_json").alias("value"))
    once = one_per_id(rows, "created").withColumnRenamed("from_us", "valid_from").filter("partition_key IS NOT NULL AND claim_key IS NOT NULL")
    old = once.filter(F.col("created") <= _AT_US).groupBy(*SLOT).agg(F.max(F.struct("valid_from", "trust", "id", "value")).alias("c")).select(*SLOT, "c.*")
    return rules.consolidation(once.filter(F.col("created") > _AT_US), old, list(SLOT))


def trust_rank_case(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "memory_events", "id", "actor", "event_type").distinct()
    return events.groupBy(rules.trust("actor", "event_type").alias("trust")).agg(F.count("*").alias("n"))


def producer_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Numbers missing from each user's sequence of orders, and up to where it is complete."""
    lines = table(spark, d, "lineitem", F.col("l_suppkey").alias("producer"), F.col("l_linenumber").alias("n"))
    cursor = versions.contiguous_prefix(lines, ["producer"], "n")
    missing = versions.gaps_in_sequence(lines, ["producer"], "n").groupBy("producer").agg(F.sum(F.col("last_missing") - F.col("first_missing") + 1).alias("missing"))
    return cursor.join(missing, "producer", "left").select("producer", "cursor", F.coalesce("missing", F.lit(0)).alias("missing"))


def archive_beyond_last(spark: SparkSession, d: str) -> DataFrame:
    """Versions of each slot beyond its last three."""
    rows = _claims(spark, d, *SLOT, "created_at").distinct().withColumn("claim_key", plain_key("claim_key"))
    return scope.keep_last(rows, list(SLOT), [F.desc("created_at"), F.desc("id")], 3).select("id", micros("created_at").alias("created_us"))


NAMES = (scope_visible_rows, scope_ancestor_keys, scope_level_chain, idempotent_dedup, keyset_page, bitemporal_as_of, bitemporal_grid, latest_version_known_at, interval_materialize, interval_union, interval_intersect, scd2_claims, state_delta_feed, evidence_live_artifacts, events_exist, guard_reject_reasons, kleene_applicability, admission_decisions, slot_projection, override_compose, claim_consolidation_ops, trust_rank_case, producer_gaps, archive_beyond_last)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def _key_sql(cols: list[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in cols) + ")"


def oracle_sql() -> dict[str, str]:
    from annalist.queries.histories import _COUNTED

    L = scope.LEVELS
    kept = " UNION ".join("SELECT tenant_id, namespace, " + ", ".join(f"{c if m >> i & 1 else 'NULL'} AS {c}" for i, c in enumerate(L)) + " FROM s" for m in range(16))
    levels = " UNION ALL ".join("SELECT DISTINCT tenant_id, namespace, user_id, agent_id, workspace_id, session_id, " + ", ".join(f"{c if i < n else 'CAST(NULL AS VARCHAR)'} AS seen_{c}" for i, c in enumerate(L)) + " FROM s" for n in range(5))
    corrected = "(SELECT min(o.created) FROM counted o WHERE o.supersedes = c.id AND o.id <> c.id AND o.partition_key = c.partition_key AND o.claim_key = c.claim_key AND o.f = c.f)"
    known = f"k AS (SELECT c.*, {corrected} AS gone FROM counted c)"
    months = "m AS (SELECT unnest([" + ", ".join(str(_AT_US + 86_400_000_000 * k) for k in (-92, -61, -31, 0, 30, 61)) + "]) AS m)"
    scd = """o AS (SELECT *, lag(event_type) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM o),
g AS (SELECT user_id, CAST(version AS BIGINT) AS version, min(event_type) AS event_type, min(ts) AS valid_from, count(*) - 1 AS corroborations FROM v GROUP BY user_id, version)"""
    return {
        "scope_visible_rows": """WITH r AS (SELECT DISTINCT tenant_id, namespace, user_id, workspace_id FROM memory_events), c AS (SELECT DISTINCT id, tenant_id, namespace, user_id, workspace_id FROM claims WHERE id IS NOT NULL)
SELECT r.tenant_id, r.namespace, r.user_id, r.workspace_id, count(c.id) AS visible FROM r LEFT JOIN c ON r.tenant_id = c.tenant_id AND r.namespace = c.namespace AND (c.user_id IS NULL OR c.user_id = r.user_id) AND (c.workspace_id IS NULL OR c.workspace_id = r.workspace_id) GROUP BY ALL""",
        "scope_ancestor_keys": f"WITH s AS (SELECT DISTINCT tenant_id, namespace, {', '.join(L)} FROM memory_events), a AS ({kept}) SELECT {_key_sql(['tenant_id', 'namespace', *L])} AS key, tenant_id FROM a",
        "scope_level_chain": f"WITH s AS (SELECT DISTINCT tenant_id, namespace, {', '.join(L)} FROM memory_events), a AS (SELECT DISTINCT * FROM ({levels})) SELECT tenant_id, namespace, {', '.join(f'seen_{c} AS {c}' for c in L)}, count(*) AS below FROM a GROUP BY tenant_id, namespace, {', '.join(f'seen_{c}' for c in L)}",
        "idempotent_dedup": """SELECT partition_key, idempotency_key, id, epoch_us(ingested_at) AS ingested_us FROM (SELECT *, row_number() OVER (PARTITION BY partition_key, idempotency_key ORDER BY ingested_at, id) AS rn FROM memory_events)
WHERE rn = 1 OR idempotency_key IS NULL OR partition_key IS NULL""",
        "keyset_page": f"SELECT id, epoch_us(occurred_at) AS at_us FROM (SELECT DISTINCT id, occurred_at FROM memory_events) WHERE (occurred_at, id) < (TIMESTAMP '{_AT}', '') ORDER BY occurred_at DESC, id DESC LIMIT 100",
        "bitemporal_as_of": f"""WITH {_COUNTED}, {known} SELECT partition_key, claim_key, id AS claim_id FROM (SELECT *, row_number() OVER (PARTITION BY partition_key, claim_key ORDER BY f DESC, version DESC, id DESC) AS rn FROM k
WHERE created <= {_AT_US} AND (gone IS NULL OR gone > {_AT_US}) AND f <= {_AT_US} AND t > {_AT_US}) WHERE rn = 1""",
        "bitemporal_grid": f"""WITH {_COUNTED}, {known}, {months} SELECT v.m AS valid_us, r.m AS known_us, count(DISTINCT (partition_key, claim_key)) AS slots FROM k, m v, m r
WHERE created <= r.m AND (gone IS NULL OR gone > r.m) AND f <= v.m AND t > v.m GROUP BY 1, 2""",
        "latest_version_known_at": f"""WITH c AS (SELECT id, partition_key, lower(trim(claim_key)) AS claim_key, epoch_us(created_at) AS created_us, version FROM claims),
n AS (SELECT partition_key, claim_key, min(created_us) AS next_known FROM c WHERE created_us > {_AT_US} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY partition_key, claim_key ORDER BY created_us DESC, version DESC, id DESC) AS rn FROM c WHERE created_us <= {_AT_US})
SELECT r.partition_key, r.claim_key, created_us, version, id, next_known FROM r LEFT JOIN n USING (partition_key, claim_key) WHERE rn = 1""",
        "interval_materialize": f"""WITH {_COUNTED},
left_over AS (SELECT c.* FROM counted c WHERE {corrected} IS NULL),
edges AS (SELECT partition_key, claim_key, f AS e FROM left_over UNION SELECT partition_key, claim_key, t FROM left_over),
parts AS (SELECT *, lead(e) OVER (PARTITION BY partition_key, claim_key ORDER BY e) AS until FROM edges),
held AS (SELECT p.*, c.id, row_number() OVER (PARTITION BY p.partition_key, p.claim_key, p.e ORDER BY c.f DESC, c.version DESC, c.id DESC) AS rn FROM parts p JOIN left_over c ON c.partition_key = p.partition_key AND c.claim_key = p.claim_key AND c.f <= p.e AND p.e < c.t WHERE until IS NOT NULL),
runs AS (SELECT *, CASE WHEN lag(until) OVER w = e AND lag(id) OVER w = id THEN 0 ELSE 1 END AS fresh FROM held WHERE rn = 1 WINDOW w AS (PARTITION BY partition_key, claim_key ORDER BY e)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY partition_key, claim_key ORDER BY e) AS run FROM runs)
SELECT partition_key, claim_key, min(id) AS claim_id, min(e) AS from_us, max(until) AS to_us FROM n GROUP BY partition_key, claim_key, run""",
        "interval_union": """WITH s AS (SELECT o_custkey, epoch_us(o_orderdate) AS f, epoch_us(u) AS t FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS u FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderdate < u),
r AS (SELECT *, max(t) OVER (PARTITION BY o_custkey ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s), m AS (SELECT *, sum(CASE WHEN r IS NULL OR f > r THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY f, t) AS i FROM r),
p AS (SELECT o_custkey, min(f) AS f, max(t) AS t FROM m GROUP BY o_custkey, i)
SELECT o_custkey, 'period' AS kind, f AS from_us, t AS to_us FROM p UNION ALL SELECT * FROM (SELECT o_custkey, 'gap', t, lead(f) OVER (PARTITION BY o_custkey ORDER BY f) AS n FROM p) WHERE n IS NOT NULL""",
        "interval_intersect": """SELECT l_orderkey AS k, l_linenumber, greatest(epoch_us(l_shipdate), epoch_us(o_orderdate)) AS start, least(epoch_us(l_shipdate) + 864000000000, epoch_us(o_orderdate) + 2592000000000) AS "end"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE greatest(epoch_us(l_shipdate), epoch_us(o_orderdate)) < least(epoch_us(l_shipdate) + 864000000000, epoch_us(o_orderdate) + 2592000000000)""",
        "scd2_claims": f"WITH {scd} SELECT user_id, version, event_type, epoch_us(valid_from) AS from_us, epoch_us(lead(valid_from) OVER w) AS to_us, lag(version) OVER w AS supersedes, corroborations FROM g WINDOW w AS (PARTITION BY user_id ORDER BY version)",
        "state_delta_feed": f"""WITH {scd} SELECT user_id, epoch_us(valid_from) AS at_us, CASE WHEN version = 1 THEN 'add' ELSE 'replace' END AS operation, lag(event_type) OVER (PARTITION BY user_id ORDER BY version) AS "before", event_type AS "after" FROM g""",
        "evidence_live_artifacts": """WITH c AS (SELECT DISTINCT id FROM claims WHERE id IS NOT NULL), l AS (SELECT DISTINCT claim_id, event_id FROM claim_sources), a AS (SELECT DISTINCT id FROM memory_events WHERE archived_at IS NULL),
s AS (SELECT claim_id, count(*) AS sources, count(a.id) AS alive FROM l LEFT JOIN a ON l.event_id = a.id GROUP BY 1)
SELECT c.id, coalesce(sources, 0) AS sources, coalesce(alive, 0) AS alive, coalesce(sources, 0) > 0 AND sources = alive AS live FROM c LEFT JOIN s ON c.id = claim_id""",
        "events_exist": "SELECT DISTINCT claim_id, event_id FROM claim_sources WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT id FROM memory_events)",
        "guard_reject_reasons": f"""SELECT id, CASE WHEN lower(trim(status)) = 'rejected' THEN 'deleted' WHEN archived_at <= TIMESTAMP '{_AT}' THEN 'archived' WHEN confidence < 0.3 THEN 'untrusted'
WHEN coalesce(json_array_length(CASE WHEN json_valid(provenance_json) THEN json_extract(provenance_json, '$.source_event_ids') END), 0) <= 0 THEN 'missing_provenance'
WHEN valid_from > TIMESTAMP '{_AT}' THEN 'not_yet_valid' WHEN valid_to <= TIMESTAMP '{_AT}' THEN 'expired' END AS reason
FROM (SELECT DISTINCT id, status, archived_at, provenance_json, valid_from, valid_to, confidence FROM claims)""",
        "kleene_applicability": """SELECT o_orderkey, (o_orderstatus = 'F' OR o_totalprice > 150000) AND (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN true END) AND isodow(o_orderdate) - 1 IN (0, 1, 2, 3, 4) AND NOT (o_totalprice < 5000) AS applies, CAST(NULL AS BOOLEAN) AS strict FROM orders""",
        "admission_decisions": """WITH r AS (SELECT DISTINCT id, text, confidence, importance, value_json, valid_from, valid_to, status FROM claims WHERE id IS NOT NULL),
w AS (SELECT id, list_filter([CASE WHEN coalesce(length(text), 0) = 0 THEN 'no_text' END, CASE WHEN confidence < 0.4 THEN 'low_confidence' END, CASE WHEN value_json IS NULL THEN 'no_value' END, CASE WHEN valid_to <= valid_from THEN 'empty_interval' END, CASE WHEN lower(trim(status)) = 'rejected' THEN 'rejected' END], lambda x: x IS NOT NULL) AS a FROM r)
SELECT id, CASE WHEN len(a) = 0 THEN 'accept' WHEN list_has_any(a, ['no_text', 'rejected', 'empty_interval']) THEN 'l0_only' ELSE 'pending_verification' END AS decision, array_to_string(a, ',') AS reasons FROM w""",
        "slot_projection": f"""WITH {_COUNTED}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY partition_key, claim_key ORDER BY f DESC, created DESC, id DESC) AS rn FROM counted WHERE f <= {_AT_US}) WHERE rn = 1),
n AS (SELECT partition_key, claim_key, min(f) AS next_us FROM counted WHERE f > {_AT_US} GROUP BY ALL)
SELECT b.partition_key, b.claim_key, CASE WHEN t > {_AT_US} THEN id END AS claim_id, CASE WHEN t > {_AT_US} THEN least(next_us, CASE WHEN t < 9223372036854775807 THEN t END) END AS until_us FROM b LEFT JOIN n USING (partition_key, claim_key)""",
        "override_compose": """WITH i AS (SELECT o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS r, CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice > 20000 END AS a, o_orderstatus AS v FROM orders),
k AS (SELECT * FROM i WHERE a IS NULL OR a), s AS (SELECT o_custkey, max(r) FILTER (a) AS top FROM k GROUP BY 1), l AS (SELECT k.* FROM k JOIN s USING (o_custkey) WHERE top IS NULL OR r >= top)
SELECT o_custkey, CASE WHEN bool_or(a IS NULL) THEN 'unknown' WHEN count(DISTINCT v) > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN NOT bool_or(a IS NULL) AND count(DISTINCT v) = 1 THEN min(v) END AS value FROM l GROUP BY o_custkey""",
        "claim_consolidation_ops": f"""WITH {_COUNTED}, x AS (SELECT c.*, CAST(floor(k.confidence * 5) AS INT) AS trust FROM counted c JOIN (SELECT id, min(confidence) AS confidence FROM claims GROUP BY id) k USING (id)),
n AS (SELECT * FROM x WHERE created > {_AT_US}), l AS (SELECT *, row_number() OVER (PARTITION BY partition_key, claim_key ORDER BY trust DESC, f DESC, created DESC, id DESC) AS rn FROM n),
v AS (SELECT partition_key, claim_key, trust, f, count(DISTINCT value_json) AS vs FROM n GROUP BY ALL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY partition_key, claim_key ORDER BY f DESC, trust DESC, id DESC) AS rn FROM x WHERE created <= {_AT_US}) WHERE rn = 1)
SELECT l.partition_key, l.claim_key, l.id, l.value_json AS value, CASE WHEN v.vs > 1 THEN 'CONFLICT' WHEN o.id IS NULL THEN 'UPSERT' WHEN o.value_json IS NOT DISTINCT FROM l.value_json THEN 'MERGE' WHEN l.f < o.f OR l.trust < o.trust OR (l.f = o.f AND l.trust = o.trust) THEN 'CONFLICT' ELSE 'SUPERSEDE' END AS operation
FROM l JOIN v ON v.partition_key = l.partition_key AND v.claim_key = l.claim_key AND v.trust = l.trust AND v.f = l.f LEFT JOIN o ON o.partition_key = l.partition_key AND o.claim_key = l.claim_key WHERE l.rn = 1""",
        "trust_rank_case": """SELECT CASE WHEN event_type = 'memory.proposal.accepted' THEN 4 WHEN actor = 'user' THEN 3 WHEN actor = 'tool' THEN 2 WHEN actor IN ('assistant', 'agent') THEN 1 ELSE 0 END AS trust, count(*) AS n FROM (SELECT DISTINCT id, actor, event_type FROM memory_events) GROUP BY 1""",
        "producer_gaps": """WITH n AS (SELECT DISTINCT l_suppkey AS producer, l_linenumber AS n FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY n) AS rn, lag(n) OVER (PARTITION BY producer ORDER BY n) AS b FROM n)
SELECT producer, coalesce(max(n) FILTER (n = rn), 0) AS cursor, coalesce(CAST(sum(n - b - 1) AS BIGINT), 0) AS missing FROM r GROUP BY producer""",
        "archive_beyond_last": """SELECT id, epoch_us(created_at) AS created_us FROM (SELECT *, row_number() OVER (PARTITION BY partition_key, lower(trim(claim_key)) ORDER BY created_at DESC, id DESC) AS rn FROM (SELECT DISTINCT id, partition_key, claim_key, created_at FROM claims WHERE id IS NOT NULL)) WHERE rn > 3""",
    }
