"""Problems 1, 3, 4 and 5: histories, late events, coverage and as-known attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.time import DAY_US, HOUR_US, NO_END, micros
from annalist.operators.asof import as_known
from annalist.operators.counted import counted_intervals, one_per_id, plain_key
from annalist.operators.coverage import coverage
from annalist.operators.ledger import SLOT, ledger, value_periods
from annalist.operators.panes import deliveries, pane_counts, pane_revisions, slice_panes, windows_of_panes
from annalist.operators.timeshards import find_cuts
from annalist.sources.tables import table


def _ended(column: str) -> F.Column:
    return F.when(F.col(column) == NO_END, F.lit(-1)).otherwise(F.col(column)).alias(column)


def _ledger_of(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claims")
    rows = counted_intervals(claims, micros("created_at").alias("created_us"), "version", "supersedes", "value_json")
    cuts = find_cuts(counted_intervals(claims), SLOT, ["from_us", "to_us"])
    return ledger(one_per_id(rows, "created_us"), cuts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each slot's history as the ledger has it now: one row per longest period of one value."""
    return value_periods(_ledger_of(spark, d)).select(*SLOT, "claim_id", "from_us", _ended("to_us"))


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The whole bitemporal ledger, with what was believed earlier."""
    made = _ledger_of(spark, d)
    return made.select(*SLOT, "claim_id", "from_us", _ended("to_us"), "recorded_us", _ended("replaced_us"))


def _panes(spark: SparkSession, d: str) -> DataFrame:
    return slice_panes(deliveries(table(spark, d, "memory_events", "id", "ingested_at", "occurred_at", "event_type")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The events that came late, and whether they still counted."""
    return _panes(spark, d).filter(F.col("outcome") != "on_time").select(F.col("id").alias("event_id"), "outcome")


def p3_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Counts per UTC hour and event_type: on time, corrected by late events, dropped as too late."""
    counts = pane_counts(_panes(spark, d))
    return counts.select(F.col("pane_us").alias("hour_us"), F.col("key").alias("event_type"), "on_time", "corrected", "dropped", (F.col("on_time") + F.col("corrected")).alias("counted"))


def p3_daily_emissions(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day that slide by six hours: every emission of each, recomposed from the panes that changed."""
    out = windows_of_panes(pane_revisions(_panes(spark, d), every_us=6 * HOUR_US), DAY_US, 6 * HOUR_US)
    return out.withColumnRenamed("key", "event_type")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods each slot's claims cover, and the gaps between them."""
    rows = counted_intervals(table(spark, d, "claims", "id", *SLOT, "status", "valid_from", "valid_to"))
    return coverage(rows, SLOT, "from_us", "to_us").select(*SLOT, "kind", "from_us", _ended("to_us"))


READER = ("tenant_id", "namespace", "user_id", "claim_key")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The claim each context read saw: the strongest valid and already known at its instant."""
    events = table(spark, d, "memory_events", "id", "tenant_id", "namespace", "user_id", "event_type", "metadata_json", "occurred_at")
    key = F.try_variant_get(F.try_parse_json("metadata_json"), "$.claim_key", "string")
    reads = events.filter(F.col("event_type") == "memory.context.read")
    reads = reads.select("id", micros("occurred_at").alias("at_us"), "tenant_id", "namespace", "user_id", plain_key(key).alias("claim_key"))
    reads = one_per_id(reads, "at_us").withColumnRenamed("id", "event_id")
    rows = counted_intervals(table(spark, d, "claims"), micros("created_at").alias("created_us"), "version", "tenant_id", "namespace", "user_id", F.col("workspace_id").isNull().alias("_own"))
    rows = rows.filter(F.col("_own") & F.col("user_id").isNotNull()).drop("_own", "partition_key")
    versions = one_per_id(rows, "created_us").withColumn("strong_1", F.col("from_us")).withColumnRenamed("version", "strong_2")
    return as_known(reads, versions, READER).select("event_id", F.col("id").alias("claim_id"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_ledger, p3_found, p3_hourly, p3_daily_emissions, p4_found, p5_found)}


_COUNTED = """
counted AS (
  SELECT id, partition_key, lower(trim(claim_key)) AS claim_key, tenant_id, namespace, user_id, workspace_id, value_json,
         epoch_us(valid_from) AS f, CASE WHEN valid_to IS NULL OR year(valid_to) = 2199 THEN 9223372036854775807 ELSE epoch_us(valid_to) END AS t,
         coalesce(version, -1) AS version, supersedes, epoch_us(created_at) AS created
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM claims)
  WHERE rn = 1 AND lower(trim(status)) IN ('active', 'superseded', 'archived')
    AND (valid_to IS NULL OR year(valid_to) = 2199 OR valid_from < valid_to)
)"""

_NUMBER = "CASE WHEN json_type({0}) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN '#' || CAST(CAST({0} AS DOUBLE) AS VARCHAR) WHEN json_type({0}) = 'VARCHAR' THEN '$' || json_extract_string({0}, '$') ELSE trim(CAST({0} AS VARCHAR)) END"
_VALUE = (
    "CASE WHEN value_json IS NULL THEN '!' WHEN NOT json_valid(value_json) THEN '?' || trim(value_json) WHEN json_type(value_json::JSON) = 'OBJECT' THEN array_to_string(list_sort(list_transform(json_keys(value_json::JSON), lambda k: k || '=' || "
    + _NUMBER.format("json_extract(value_json::JSON, '/' || k)")
    + ")), ';') ELSE "
    + _NUMBER.format("(value_json::JSON)")
    + " END"
)

_LATE = """
WITH first AS (SELECT id, min(ingested_at) AS arrived, min_by(occurred_at, ingested_at) AS moment, min_by(event_type, ingested_at) AS event_type FROM memory_events GROUP BY id),
late AS (SELECT id, event_type, date_trunc('hour', moment) AS h, CASE WHEN arrived < date_trunc('hour', moment) + INTERVAL 1 HOUR THEN 'on_time'
  WHEN arrived <= date_trunc('hour', moment) + INTERVAL 49 HOUR THEN 'corrected' ELSE 'dropped' END AS outcome, arrived FROM first)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_COUNTED},
left_over AS (SELECT c.*, {_VALUE} AS v FROM counted c WHERE NOT EXISTS (SELECT 1 FROM counted o WHERE o.supersedes = c.id AND o.id <> c.id AND o.partition_key = c.partition_key AND o.claim_key = c.claim_key AND o.f = c.f)),
edges AS (SELECT partition_key, claim_key, f AS moment FROM left_over UNION SELECT partition_key, claim_key, t FROM left_over),
parts AS (SELECT *, lead(moment) OVER (PARTITION BY partition_key, claim_key ORDER BY moment) AS until FROM edges),
held AS (SELECT p.partition_key, p.claim_key, p.moment, p.until, c.id, c.v, row_number() OVER (PARTITION BY p.partition_key, p.claim_key, p.moment ORDER BY c.f DESC, c.version DESC, c.id DESC) AS rn
  FROM parts p JOIN left_over c ON c.partition_key = p.partition_key AND c.claim_key = p.claim_key AND c.f <= p.moment AND p.moment < c.t WHERE p.until IS NOT NULL),
runs AS (SELECT *, CASE WHEN lag(until) OVER w = moment AND lag(v) OVER w = v THEN 0 ELSE 1 END AS fresh FROM held WHERE rn = 1 WINDOW w AS (PARTITION BY partition_key, claim_key ORDER BY moment)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY partition_key, claim_key ORDER BY moment) AS run FROM runs)
SELECT partition_key, claim_key, min_by(id, moment) AS claim_id, min(moment) AS from_us, CASE WHEN max(until) = 9223372036854775807 THEN -1 ELSE max(until) END AS to_us FROM numbered GROUP BY partition_key, claim_key, run""",
        "p1_ledger": f"""WITH {_COUNTED},
lives AS (SELECT c.partition_key, c.claim_key, c.id, c.f, c.t, c.version, c.created, coalesce((SELECT min(o.created) FROM counted o WHERE o.supersedes = c.id AND o.id <> c.id AND o.partition_key = c.partition_key AND o.claim_key = c.claim_key AND o.f = c.f), 9223372036854775807) AS dies FROM counted c),
ticks AS (SELECT *, lead(tick) OVER (PARTITION BY partition_key, claim_key ORDER BY tick) AS tock, row_number() OVER (PARTITION BY partition_key, claim_key ORDER BY tick) AS k
  FROM (SELECT partition_key, claim_key, created AS tick FROM lives UNION SELECT partition_key, claim_key, dies FROM lives WHERE dies < 9223372036854775807)),
parts AS (SELECT *, lead(moment) OVER (PARTITION BY partition_key, claim_key ORDER BY moment) AS until FROM (SELECT partition_key, claim_key, f AS moment FROM lives UNION SELECT partition_key, claim_key, t FROM lives)),
held AS (SELECT p.partition_key, p.claim_key, k, tick, tock, moment, until, arg_max(id, (f, version, id)) AS id FROM ticks JOIN parts p USING (partition_key, claim_key) JOIN lives c ON c.partition_key = p.partition_key AND c.claim_key = p.claim_key
  AND c.created <= tick AND tick < c.dies AND c.f <= moment AND moment < c.t WHERE until IS NOT NULL GROUP BY ALL),
marked AS (SELECT *, CASE WHEN lag(until) OVER w = moment AND lag(id) OVER w = id THEN 0 ELSE 1 END AS fresh FROM held WINDOW w AS (PARTITION BY partition_key, claim_key, k ORDER BY moment)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY partition_key, claim_key, k ORDER BY moment) AS run FROM marked),
stretches AS (SELECT partition_key, claim_key, k, tick, tock, id, min(moment) AS f, max(until) AS t FROM numbered GROUP BY partition_key, claim_key, k, tick, tock, id, run),
again AS (SELECT *, k - row_number() OVER (PARTITION BY partition_key, claim_key, id, f, t ORDER BY k) AS island FROM stretches)
SELECT partition_key, claim_key, id AS claim_id, f AS from_us, CASE WHEN t = 9223372036854775807 THEN -1 ELSE t END AS to_us, min(tick) AS recorded_us, CASE WHEN bool_or(tock IS NULL) THEN -1 ELSE max(tock) END AS replaced_us
FROM again GROUP BY partition_key, claim_key, id, f, t, island""",
        "p3_found": _LATE + "SELECT id AS event_id, outcome FROM late WHERE outcome <> 'on_time'",
        "p3_hourly": _LATE
        + """SELECT epoch_us(h) AS hour_us, event_type, count(*) FILTER (outcome = 'on_time') AS on_time, count(*) FILTER (outcome = 'corrected') AS corrected,
count(*) FILTER (outcome = 'dropped') AS dropped, count(*) FILTER (outcome <> 'dropped') AS counted FROM late GROUP BY h, event_type""",
        "p3_daily_emissions": _LATE
        + """, revised AS (SELECT epoch_us(h) AS pane, event_type, CASE WHEN outcome = 'on_time' THEN epoch_us(h) + 3600000000 ELSE greatest((epoch_us(arrived) // 21600000000 + 1) * 21600000000, epoch_us(h) + 3600000000) END AS rev FROM late WHERE outcome <> 'dropped'),
covering AS (SELECT (pane // 21600000000 - k) * 21600000000 AS window_us, event_type, rev FROM revised, range(4) r(k)),
emitted AS (SELECT window_us, event_type, greatest(rev, window_us + 86400000000) AS revised_us, count(*) AS change FROM covering GROUP BY ALL)
SELECT window_us, event_type, revised_us, CAST(sum(change) OVER w AS BIGINT) AS n, row_number() OVER w - 1 AS revision FROM emitted WINDOW w AS (PARTITION BY window_us, event_type ORDER BY revised_us)""",
        "p4_found": f"""WITH {_COUNTED},
reach AS (SELECT partition_key, claim_key, f, t, max(t) OVER (PARTITION BY partition_key, claim_key ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM counted),
marked AS (SELECT *, sum(CASE WHEN r IS NULL OR f > r THEN 1 ELSE 0 END) OVER (PARTITION BY partition_key, claim_key ORDER BY f, t) AS island FROM reach),
periods AS (SELECT partition_key, claim_key, min(f) AS f, max(t) AS t FROM marked GROUP BY partition_key, claim_key, island)
SELECT partition_key, claim_key, 'period' AS kind, f AS from_us, CASE WHEN t = 9223372036854775807 THEN -1 ELSE t END AS to_us FROM periods
UNION ALL SELECT * FROM (SELECT partition_key, claim_key, 'gap', t, lead(f) OVER (PARTITION BY partition_key, claim_key ORDER BY f) AS n FROM periods) WHERE n IS NOT NULL""",
        "p5_found": f"""WITH {_COUNTED},
reads AS (SELECT id, min(epoch_us(occurred_at)) AS moment, min(tenant_id) AS tenant_id, min(namespace) AS namespace, min(user_id) AS user_id,
  min(CASE WHEN json_valid(metadata_json) THEN lower(trim(json_extract_string(metadata_json, '$.claim_key'))) END) AS claim_key FROM memory_events WHERE event_type = 'memory.context.read' GROUP BY id)
SELECT event_id, claim_id FROM (SELECT r.id AS event_id, c.id AS claim_id, row_number() OVER (PARTITION BY r.id ORDER BY c.f DESC, c.version DESC, c.id DESC) AS rn
FROM reads r JOIN counted c ON c.tenant_id = r.tenant_id AND c.namespace = r.namespace AND c.user_id = r.user_id AND c.claim_key = r.claim_key AND c.workspace_id IS NULL
WHERE c.created <= r.moment AND c.f <= r.moment AND r.moment < c.t) WHERE rn = 1""",
    }
