"""Episodes, procedures, chains of feedback: what many events amount to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.ranks import carried


def episodes(events: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """Events gathered by the first key that isn't null: episode, n, first and last instant, last kind, kinds seen.

    Aggregates only, so an episode of very many events is no list in one task.
    """
    key = F.coalesce(*(F.concat(F.lit(f"{k}:"), F.col(k)) for k in keys))
    rows = events.withColumn("episode", key).filter("episode IS NOT NULL")
    return rows.groupBy("episode").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.max_by(kind, F.struct(*order)).alias("outcome"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


def latest_parent(rows: DataFrame, keys: list[str], order: list[str], is_parent: Column, ident: str, **hot: int) -> DataFrame:
    """Each row with the last parent row before it of its keys (an as-of join as one pass; null if there is none)."""
    return carried(rows, keys, order, F.when(is_parent, F.col(ident)), "parent", **hot)


def procedures(runs: DataFrame, action: str, success: str, quality: str, ident: str, least_support: int) -> DataFrame:
    """Actions with the support they have: counted successes and counter-examples, the best run, and why it's refused."""
    out = runs.groupBy(action).agg(F.count_if(F.col(success)).alias("support"), F.count_if(~F.col(success)).alias("against"), F.max_by(ident, F.when(F.col(success), F.struct(quality, ident))).alias("best"))
    why = F.when(F.col("support") < least_support, "too_little_support").when(F.col("against") > F.col("support"), "mostly_fails")
    return out.withColumn("refused", why)


def step_sequences(steps: DataFrame, run: str, order: list[str], action: str, most_steps: int | None = None) -> DataFrame:
    """Each run's actions in order as one string, for runs of two steps or more; with most_steps longer ones are left out."""
    short = steps.groupBy(run).agg(F.count("*").alias("steps")).filter("steps >= 2")
    if most_steps is not None:
        short = short.filter(F.col("steps") <= most_steps)
    kept = steps.join(short, run)
    return kept.groupBy(run, "steps").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, action))), lambda x: x[action]), ">").alias("sequence"))


def attached(runs: DataFrame, decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What belongs to each run: scope, run, kind ('decision' or 'outcome'), id.

    runs: scope, run; decisions: scope, id, run; outcomes: scope, id, run, decision_id, corrects, active. A decision belongs to the run it
    names; an outcome to the run it names or to that of its decision; either, if it names no run, to the only run of its scope if there is just
    one. Outcomes that aren't active, or that an active one corrects, belong to none. The three ways are equi-joins whose
    rows are united, not one join with an "or".
    """
    runs = runs.select("scope", "run").filter("run IS NOT NULL").distinct()
    only = runs.groupBy("scope").agg(F.min("run").alias("run"), F.count("*").alias("_n")).filter("_n = 1").select("scope", "run")
    made = decisions.join(runs, ["scope", "run"]).select("scope", "run", "id")
    made = made.unionByName(decisions.filter("run IS NULL").drop("run").join(only, "scope").select("scope", "run", "id")).distinct()
    live = outcomes.filter(F.coalesce("active", F.lit(False)))
    live = live.join(live.filter("corrects IS NOT NULL").select(F.col("corrects").alias("id")).distinct(), "id", "left_anti")
    named = live.join(runs, ["scope", "run"]).select("scope", "run", "id")
    by_decision = live.drop("run").join(made.select("scope", "run", F.col("id").alias("decision_id")), ["scope", "decision_id"]).select("scope", "run", "id")
    alone = live.filter("run IS NULL").drop("run").join(only, "scope").select("scope", "run", "id")
    found = named.unionByName(by_decision).unionByName(alone).distinct()
    return made.select("scope", "run", F.lit("decision").alias("kind"), "id").unionByName(found.select("scope", "run", F.lit("outcome").alias("kind"), "id"))


def reward_keys(episodes: DataFrame, rewards: DataFrame) -> DataFrame:
    """By which measure the episodes of a scope can be compared: scope, episodes, status and key.

    episodes: scope, run, outcome_id (one row an outcome, null for a run without any); rewards: outcome_id, definition, version. Each episode must
    have exactly one reward among its outcomes, else the scope is incomplete; all must be of one definition and version, else it is incompatible.
    """
    one = episodes.select("scope", "run", "outcome_id").distinct().join(rewards.select("outcome_id", F.struct("definition", "version").alias("_k")).distinct(), "outcome_id", "left")
    per = one.groupBy("scope", "run").agg(F.count("_k").alias("_n"), F.min("_k").alias("_k"))
    out = per.groupBy("scope").agg(F.count("*").alias("episodes"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"), F.min("_k").alias("_a"), F.max("_k").alias("_b"))
    status = F.when((F.col("_lo") != 1) | (F.col("_hi") != 1), "incomplete").when(F.col("_a") != F.col("_b"), "incompatible").otherwise("comparable")
    return out.select("scope", "episodes", status.alias("status"), F.when(status == "comparable", F.concat_ws("/", "_a.definition", "_a.version")).alias("key"))


#: Steps a run may have to count as an example of a procedure (fixed value); longer runs are counted by themselves.
MOST_STEPS = 32


def common_sequences(steps: DataFrame, scope: str, run: str, order: list[str], action: str, failed: Column, source: str, least_runs: int = 3, most_steps: int = MOST_STEPS) -> DataFrame:
    """Whether the successful runs of a scope have one sequence of actions in common: scope, runs, successful, against, too_long, status, sequence.

    A run of two to most_steps steps with distinct instants is successful if no step failed, else it is a counter-example; shorter runs, and those
    whose order isn't clear, count for nothing. The sequence is a candidate if at least least_runs successful runs have it, no successful run
    has another one and no source stands behind two of them. Longer runs are counted and never made into a list.
    """
    size = steps.groupBy(scope, run).agg(F.count("*").alias("_n"), F.count_distinct(order[0]).alias("_t"), F.max(failed).alias("_f"))
    size = size.withColumn("_ok", (F.col("_n") >= 2) & (F.col("_n") <= most_steps) & (F.col("_t") == F.col("_n")))
    good = steps.join(size.filter(F.col("_ok") & ~F.col("_f")).select(scope, run), [scope, run])
    sequences = good.groupBy(scope, run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, action))), lambda x: x[action]), ">").alias("_s"))
    per = sequences.groupBy(scope).agg(F.count("*").alias("successful"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    shared = good.select(scope, run, source).distinct().groupBy(scope, source).agg(F.count("*").alias("_n")).groupBy(scope).agg(F.max("_n").alias("_shared"))
    out = size.groupBy(scope).agg(F.count("*").alias("runs"), F.count_if(F.col("_ok") & F.col("_f")).alias("against"), F.count_if(F.col("_n") > most_steps).alias("too_long"))
    out = out.join(per, scope, "left").join(shared, scope, "left").withColumn("successful", F.coalesce("successful", F.lit(0)))
    status = F.when(F.col("successful") < least_runs, "too_few").when(F.col("_lo") != F.col("_hi"), "conflicting").when(F.col("_shared") > 1, "shared_sources").otherwise("candidate")
    return out.select(scope, "runs", "successful", "against", "too_long", status.alias("status"), F.when(status == "candidate", F.col("_lo")).alias("sequence"))
