"""A durable queue as a log: every step of a job is a row that is added, and what a job has come to is folded from them.

Producers and workers only append, so a writer that fails leaves nothing half done and one that runs again adds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.questions import backoff, fair_order

#: Columns of a log: until_us is the end of a lease, and null for other steps.
LOG = "job string, seq bigint, action string, at_us bigint, until_us bigint, tenant string, priority int"
MOST_ATTEMPTS = 5


def folded(log: DataFrame, now_us: int, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """What each job has come to at an instant: job, tenant, priority, status, attempts, due_us.

    Steps are enqueue, claim, ack, fail and cancel; copies of a step (job, seq) count once and steps after the instant not at all. A job is
    done or cancelled once it was acknowledged or cancelled; else it is leased while its last claim runs; else it is dead after
    most_attempts failures or lapsed leases, and otherwise pending, due at once, or after a failure when its pause is over. Jobs that were
    never enqueued are left out. Aggregates only, so a job of many steps is no list.
    """
    steps = log.filter((F.col("at_us") <= now_us) & F.col("job").isNotNull()).groupBy("job", "seq").agg(F.min(F.struct("action", "at_us", "until_us", "tenant", "priority")).alias("s")).select("job", "seq", "s.*")
    of = lambda *a: F.col("action").isin(*a)
    out = steps.groupBy("job").agg(
        F.min(F.when(of("enqueue"), F.struct("seq", "at_us", "tenant", "priority"))).alias("e"),
        F.max(F.when(of("claim", "fail"), F.struct("seq", "action", "at_us", "until_us"))).alias("l"),
        F.count_if(of("claim")).alias("attempts"), F.max(of("ack")).alias("done"), F.max(of("cancel")).alias("cancelled"),
    ).filter("e IS NOT NULL")
    leased = (F.col("l.action") == "claim") & (F.col("l.until_us") > now_us)
    status = F.when(F.col("done"), "done").when(F.col("cancelled"), "cancelled").when(F.coalesce(leased, F.lit(False)), "leased").when(F.col("attempts") >= most_attempts, "dead").otherwise("pending")
    pause = (backoff(F.col("attempts")) * 1_000_000).cast("bigint")
    due = F.when(F.col("l.action") == "fail", F.col("l.at_us") + pause).when(F.col("l.action") == "claim", F.col("l.until_us")).otherwise(F.col("e.at_us"))
    return out.select("job", F.col("e.tenant").alias("tenant"), F.col("e.priority").alias("priority"), status.alias("status"), "attempts", F.when(status == "pending", due).alias("due_us"))


def leases(log: DataFrame, now_us: int, capacity: int, lease_us: int, per_tenant: int | None = None) -> DataFrame:
    """The claims a worker of some capacity appends: due jobs in fair rounds over tenants, the most urgent first.

    What tenants have leased already counts against per_tenant. The same log and instant give the same claims.
    """
    now = folded(log, now_us)
    due = now.filter((F.col("status") == "pending") & (F.col("due_us") <= now_us))
    ranked = fair_order(due, "tenant", F.col("priority"), [F.col("due_us"), F.col("job")])
    if per_tenant is not None:
        busy = now.filter("status = 'leased'").groupBy(F.col("tenant").alias("_t")).agg(F.count("*").alias("_busy"))
        ranked = ranked.join(busy, F.col("tenant").eqNullSafe(F.col("_t")), "left").filter(F.col("tenant_rank") + F.coalesce("_busy", F.lit(0)) <= per_tenant)
    first = ranked.orderBy("tenant_rank", F.desc("priority"), "due_us", "job").limit(capacity)
    last = log.groupBy("job").agg(F.max("seq").alias("_seq"))
    return first.join(last, "job").select("job", (F.col("_seq") + 1).alias("seq"), F.lit("claim").alias("action"), F.lit(now_us).alias("at_us"), F.lit(now_us + lease_us).alias("until_us"), "tenant", "priority")


def fenced(log: DataFrame) -> DataFrame:
    """The results that count: of the acknowledgements of a job only one that answers its latest claim before it, and the first such.

    A worker whose lease was given to another one in the meantime comes too late: its acknowledgement has an older claim's until_us.
    """
    w = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = log.withColumn("_lease", F.last(F.when(F.col("action") == "claim", F.col("until_us")), True).over(w))
    good = at.filter((F.col("action") == "ack") & (F.col("until_us") == F.col("_lease")))
    return good.groupBy("job").agg(F.min("seq").alias("seq"))
