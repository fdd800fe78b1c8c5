"""Streams, snapshots, standing questions, plugins: the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.time import DAY_US, HOUR_US, micros
from annalist.operators.vectors import nearest, normalised, usable
from annalist.plans.standing import Question, StandingQuestions
from annalist.plugins import Manifest, Registry
from annalist.session import scratch
from annalist.sources import snapshots
from annalist.sources.tables import table
from annalist.streaming import pipelines


def _stream(spark: SparkSession, rows: DataFrame, order: str, slices: int = 4) -> DataFrame:
    """The rows as a stream of several batches, in order of a timestamp: they are written slice by slice and read so."""
    at = scratch(spark, "arrivals")
    us = micros(order)
    n, *cuts = rows.agg(F.count("*"), F.percentile_approx(us, [k / slices for k in range(1, slices)], 10_000)).first()
    edges = [None, *(cuts[0] or []), None]
    each = max(1, -(-n // slices // 1_000_000))
    for lo, hi in zip(edges, edges[1:]):
        part = rows if lo is None else rows.filter(us >= lo)
        part = part if hi is None else part.filter((us < hi) if lo is not None else us.isNull() | (us < hi))
        part.repartition(each).write.mode("append").parquet(at)
    return pipelines.files(spark, at, rows.schema, each)


def stream_ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events taken in once each from a stream that delivers some again, in later batches too."""
    at = scratch(spark, "ingest")
    rows = table(spark, d, "memory_events", "id", "event_type", "ingested_at").filter("id IS NOT NULL")
    rows = _stream(spark, rows, "ingested_at").select("id", "event_type", F.col("ingested_at").cast("timestamp").alias("seen"))
    pipelines.ingest(rows, ["id"], "seen", "400 days", f"{at}/out", f"{at}/log")
    return spark.read.parquet(f"{at}/out").select("id", "event_type")


def _pane_store(spark: SparkSession, d: str) -> pipelines.PaneStore:
    at = scratch(spark, "panes")
    store = pipelines.PaneStore(spark, f"{at}/store")
    rows = table(spark, d, "memory_events", "id", "ingested_at", "occurred_at", "event_type")
    pipelines.pane_stream(_stream(spark, rows, "ingested_at"), store, f"{at}/log")
    return store


def stream_panes(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts kept by a stream of several batches that correct one another, as its last emissions have them."""
    return _pane_store(spark, d).panes().select(F.col("pane_us").alias("hour_us"), F.col("key").alias("event_type"), "on_time", "corrected", "dropped")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day that slide by six hours, recomposed by the stream wherever a batch changed a pane."""
    return _pane_store(spark, d).windows().select("window_us", F.col("key").alias("event_type"), "n", "dropped")


def stream_session_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of events per user that a pause of six hours ends, updated batch by batch."""
    at = scratch(spark, "sessions")
    rows = _stream(spark, table(spark, d, "events", "user_id", "ts"), "ts").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    pipelines.sessions(rows, "user_id", "ts", 6 * HOUR_US, "2 days", f"{at}/out", f"{at}/log")
    return pipelines.latest_sessions(spark, f"{at}/out", "user_id")


def stream_late_parents(spark: SparkSession, d: str) -> DataFrame:
    """Claims accepted once the claim they supersede has come, if it does within ninety days; else they expire or still wait."""
    at = scratch(spark, "parents")
    claims = table(spark, d, "claims", "id", "supersedes", "created_at").filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("created_at", "supersedes")).alias("c")).select("id", "c.*")
    claims = _stream(spark, claims, "created_at").withColumn("at", F.col("created_at").cast("timestamp"))
    own = claims.select(F.col("id").alias("key"), "id", F.lit(True).alias("is_parent"), "at")
    child = claims.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("key"), "id", F.lit(False).alias("is_parent"), "at")
    pipelines.late_parents(own.unionByName(child), f"{at}/out", f"{at}/log", 90 * DAY_US)
    rows = spark.read.schema("parent string, id string, state string").parquet(f"{at}/out/*")
    return rows.filter("state = 'accepted'").select("parent", "id").distinct()


def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Claims exported as JSON lines with a manifest, read back and checked, without those rejected since."""
    at = scratch(spark, "snapshot")
    rows = table(spark, d, "claims", "id", "tenant_id", "claim_key", "value_json", "confidence", "version")
    columns = ["id", "claim_key", "value_json", "version"]
    snapshots.export(rows, at, "tenant_id", columns)
    back = snapshots.load(spark, at, "id string, tenant_id string, claim_key string, value_json string, confidence double, version int", "tenant_id", columns)
    gone = table(spark, d, "claims", "id", "status").filter(F.lower(F.trim("status")) == "rejected")
    return snapshots.replayed(back, gone, "id").select(*rows.columns)


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings after an upsert of every fifth."""
    old = table(spark, d, "embeddings", "vec_id", "label").withColumn("at", F.lit(1))
    new = old.filter("vec_id % 5 = 0").withColumn("label", F.col("label") + 100).withColumn("at", F.lit(2))
    return snapshots.merged(old, new, ["vec_id"], "at")


def standing_question_read(spark: SparkSession, d: str) -> DataFrame:
    """A question over another question, read twice and made once."""
    store = StandingQuestions(spark, scratch(spark, "questions"), {"orders": table(spark, d, "orders"), "customer": table(spark, d, "customer")})
    store.register(Question("spent", ("orders",), lambda o: o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent")), ("spending",)))
    store.register(Question("segments", ("spent", "customer"), lambda s, c: s.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("spent"), 2).alias("spent"))))
    store.read("segments")
    return store.read("segments")


def retriever_plugins(spark: SparkSession, d: str) -> DataFrame:
    """Two registered retrievers asked together, by label and by nearness; a third, optional one fails and is left out."""
    registry = Registry()
    vec = table(spark, d, "embeddings", "vec_id", "label", "embedding").filter(usable("embedding"))
    unit = vec.select("vec_id", normalised("embedding").alias("v"))
    same = lambda q: q.join(vec.select("label", F.col("vec_id").alias("id")), "label").filter("id <> query_id").select("query_id", "id")
    near = lambda q: nearest(q.select("query_id").join(unit, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("v").alias("q")), unit, 5).select("query_id", F.col("vec_id").alias("id"))

    def broken(q: DataFrame) -> DataFrame:
        raise RuntimeError("no such service")

    registry.register(Manifest("same_label", "retriever", 1, ("query_id", "id")), same)
    registry.register(Manifest("near", "retriever", 1, ("query_id", "id")), near)
    registry.register(Manifest("remote", "retriever", 1, ("query_id", "id"), required=False), broken)
    found, failed = registry.candidates(vec.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label"))
    return found.select("query_id", "id", "method").withColumn("failed", F.lit(",".join(failed)))


def versioned_promotion(spark: SparkSession, d: str) -> DataFrame:
    """A table built beside the one that is read, checked, and promoted."""
    store = snapshots.VersionedTable(spark, scratch(spark, "versions"))
    rows = table(spark, d, "claims", "id", "created_at").filter("id IS NOT NULL").select("id", micros("created_at").alias("created_us"))
    store.promote(store.stage(rows.limit(0)))
    fresh = store.stage(rows.groupBy("id").agg(F.min("created_us").alias("created_us")))
    if store.read(fresh).count() == rows.select("id").distinct().count():
        store.promote(fresh)
    return store.read().agg(F.count("*").alias("n"), F.min("created_us").alias("least")).withColumn("version", F.lit(store.current()))


NAMES = (stream_ingest_dedup, stream_panes, stream_windows, stream_session_dirty, stream_late_parents, snapshot_roundtrip, upsert_latest, standing_question_read, retriever_plugins, versioned_promotion)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    from annalist.queries.histories import _LATE

    return {
        "stream_ingest_dedup": "SELECT DISTINCT id, event_type FROM memory_events WHERE id IS NOT NULL",
        "stream_panes": _LATE + "SELECT epoch_us(h) AS hour_us, event_type, count(*) FILTER (outcome = 'on_time') AS on_time, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'dropped') AS dropped FROM late GROUP BY h, event_type",
        "stream_windows": _LATE
        + """, panes AS (SELECT epoch_us(h) AS pane, event_type, count(*) FILTER (outcome <> 'dropped') AS n, count(*) FILTER (outcome = 'dropped') AS dropped FROM late GROUP BY ALL),
covering AS (SELECT (pane // 21600000000 - k) * 21600000000 AS window_us, event_type, n, dropped FROM panes, range(4) r(k)) SELECT window_us, event_type, CAST(sum(n) AS BIGINT) AS n, CAST(sum(dropped) AS BIGINT) AS dropped FROM covering GROUP BY ALL""",
        "stream_session_dirty": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS n FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM b GROUP BY user_id, b""",
        "stream_late_parents": """WITH o AS (SELECT id, min(created_at) AS t, min_by(supersedes, (created_at, supersedes)) AS s FROM claims WHERE id IS NOT NULL GROUP BY id) SELECT s AS parent, a.id FROM o a JOIN (SELECT id, t AS pt FROM o) b ON b.id = a.s""",
        "snapshot_roundtrip": "SELECT id, tenant_id, claim_key, value_json, confidence, version FROM claims WHERE id NOT IN (SELECT id FROM claims WHERE lower(trim(status)) = 'rejected' AND id IS NOT NULL)",
        "upsert_latest": "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS at FROM embeddings",
        "standing_question_read": "SELECT c_mktsegment, count(*) AS customers, round(sum(s), 2) AS spent FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "retriever_plugins": """WITH q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0),
n AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) DESC, vec_id) AS r FROM q, embeddings e WHERE e.vec_id <> query_id)
SELECT query_id, vec_id AS id, 'same_label' AS method, 'remote' AS failed FROM q JOIN embeddings e USING (label) WHERE e.vec_id <> query_id UNION ALL SELECT query_id, id, 'near', 'remote' FROM n WHERE r <= 5""",
        "versioned_promotion": "SELECT count(DISTINCT id) AS n, min(epoch_us(created_at)) AS least, 2 AS version FROM claims WHERE id IS NOT NULL",
    }
