"""Queries of the problems on text, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.conversations import ROLES, conversations, pilot_turns
from annalist.llm.mixing import mix_documents, shares
from annalist.llm.packing import pack
from annalist.llm.pii import find_mentions, lexicon_terms, mask_mentions
from annalist.llm.splitting import split_texts
from annalist.llm.tokens import with_tokens
from annalist.session import written
from annalist.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the conversations that are whole, in order."""
    messages = table(spark, d, "unified_memory_pilot_v2", "event_id", "role", "content", "occurred_at")
    events = table(spark, d, "memory_events", "id", "session_id", "event_type")
    return conversations(pilot_turns(messages, events)).select("session_id", "turn_no", "event_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "memory_events", "id", "content").select(F.lit("event").alias("src"), "id", F.col("content").alias("text"))
    claims = table(spark, d, "claims", "id", "text").select(F.lit("claim").alias("src"), "id", "text")
    return events.unionByName(claims).filter("id IS NOT NULL")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of personal information in the events and claims."""
    terms = lexicon_terms(table(spark, d, "person_lexicon"))
    texts = _texts(spark, d).select(F.struct("src", "id").alias("key"), "text")
    found = find_mentions(texts, terms, "key").select("key.src", "key.id", "kind", "nth")
    return found.groupBy("src", "id", "kind", "nth").agg(F.lit(1).alias("_n")).drop("_n")


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the events and claims with typed placeholders, each id once."""
    terms = lexicon_terms(table(spark, d, "person_lexicon"))
    once = _texts(spark, d).groupBy("src", "id").agg(F.min("text").alias("text"))
    return mask_mentions(once, terms)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, for each container spec."""
    sizes = written(with_tokens(table(spark, d, "documents", "doc_id", "text"), keep=("doc_id",)), "sizes")
    return pack(sizes.withColumnRenamed("doc_id", "item_id"), table(spark, d, "container_specs")).withColumnRenamed("item_id", "doc_id")


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in each mix."""
    return mix_documents(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets")).uses


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted against actual and expected share of each source in each mix."""
    return shares(mix_documents(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets")))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each document that is too long for a container spec."""
    return split_texts(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "container_specs"))


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Per container spec, how many overlaps there are, how many are exact, and the fewest tokens shared.

    The others are those that no beginning between two characters makes exact, or whose piece before is shorter.
    """
    specs = table(spark, d, "container_specs", "spec", F.least("overlap_tokens", F.floor(F.col("capacity_tokens") / 2)).cast("bigint").alias("overlap_tokens"))
    own = p9_pieces(spark, d).filter("piece_no > 1").join(F.broadcast(specs), "spec")
    exact = F.col("shared_tokens") == F.col("overlap_tokens")
    return own.groupBy("spec", "overlap_tokens").agg(F.count("*").alias("overlaps"), F.count_if(exact).alias("exact"), F.min("shared_tokens").alias("least_tokens"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p6_found, p6_masked, p7_containers, p8_uses, p8_shares, p9_pieces, p9_overlaps)}


def _role_sql() -> str:
    rank = {"system": 0, "user": 1, "tool": 2, "assistant": 3}
    whens = " ".join(f"WHEN r IN ({', '.join(repr(w) for w in words.split())}) THEN {rank[role]}" for role, words in ROLES.items())
    return f"CASE {whens} END"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""WITH said AS (SELECT event_id, occurred_at AS ts, lower(trim(role, ' ' || chr(9) || chr(10))) AS r,
    coalesce(trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203)), '') <> '' AS seen,
    row_number() OVER (PARTITION BY event_id ORDER BY occurred_at) AS rn FROM unified_memory_pilot_v2),
one AS (SELECT event_id, ts, {_role_sql()} AS rank, seen FROM said WHERE rn = 1),
ev AS (SELECT DISTINCT id, session_id, event_type FROM memory_events WHERE session_id IS NOT NULL),
incomplete AS (SELECT DISTINCT session_id FROM ev WHERE event_type IN ('user.message', 'agent.model.completed') AND id NOT IN (SELECT event_id FROM one)),
turns AS (SELECT session_id, event_id, ts, rank, row_number() OVER (PARTITION BY session_id ORDER BY ts, rank, event_id) AS turn_no FROM one JOIN ev ON id = event_id WHERE seen),
unread AS (SELECT DISTINCT session_id FROM turns WHERE rank IS NULL),
talk AS (SELECT session_id, rank, turn_no, lag(rank) OVER (PARTITION BY session_id ORDER BY turn_no) AS prev FROM turns WHERE rank IN (1, 3)),
good AS (SELECT session_id FROM talk GROUP BY session_id HAVING min_by(rank, turn_no) = 1 AND max_by(rank, turn_no) = 3 AND count(*) FILTER (rank = 1 AND prev = 1) = 0)
SELECT session_id, turn_no, event_id FROM turns WHERE session_id IN (SELECT session_id FROM good) AND session_id NOT IN (SELECT session_id FROM unread) AND session_id NOT IN (SELECT session_id FROM incomplete)""",
    }
