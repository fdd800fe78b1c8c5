"""Standing questions over facts: folds with three values, increments that equal the full answer, scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.ranks import numbered


def folded_field(facts: DataFrame, group: list[str], value: str, incomplete: Column | None = None) -> DataFrame:
    """Per group one field's status and value: contested with several values, unknown with none or if incomplete."""
    inc = F.max(incomplete if incomplete is not None else F.lit(False))
    out = facts.groupBy(*group).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"), inc.alias("_i"))
    status = F.when(F.col("_n") > 1, "contested").when((F.col("_n") == 0) | F.col("_i"), "unknown").otherwise("resolved")
    return out.select(*group, status.alias("status"), F.when((F.col("_n") == 1) & ~F.col("_i"), F.col("_v")).alias("value"))


def folded_status(matches: DataFrame, group: list[str], match: str, complete: Column | None = None) -> DataFrame:
    """Per group the status of a question from its rows' three-valued matches: incomplete, unknown, resolved or empty."""
    done = F.min(complete if complete is not None else F.lit(True))
    out = matches.groupBy(*group).agg(F.count_if(F.col(match)).alias("true"), F.count_if(F.col(match).isNull()).alias("unknown"), done.alias("_c"))
    status = F.when(~F.col("_c"), "incomplete").when(F.col("unknown") > 0, "unknown").when(F.col("true") > 0, "resolved").otherwise("empty")
    return out.select(*group, status.alias("status"), "true", "unknown")


def keyed_aggregate(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, known, missing, distinct, sum, least and greatest of a value per key; sums that retract exactly."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("known"), F.count_if(F.col(value).isNull()).alias("missing"), F.count_distinct(value).alias("distinct"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def signatures(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """A fingerprint of each group's rows that does not depend on their order; aggregated before the shuffle."""
    one = F.xxhash64(*columns)
    return rows.groupBy(*group).agg(F.count("*").alias("_rows"), F.bit_xor(one).alias("_xor"), F.sum(F.pmod(one, F.lit(2**31 - 1))).alias("_sum"))


def refreshed(old_rows: DataFrame, new_rows: DataFrame, old_answer: DataFrame, group: list[str], columns: list[str], answer: object) -> DataFrame:
    """The answer over new_rows, made from the old answer: only groups whose rows changed are computed again."""
    a, b = signatures(old_rows, group, columns), signatures(new_rows, group, columns)
    same = a.join(b, [*group, "_rows", "_xor", "_sum"]).select(*group)
    changed = new_rows.join(same, group, "left_anti")
    return old_answer.join(same, group, "left_semi").unionByName(answer(changed))


def due(last: Column, first: Column, debounce_us: int, most_wait_us: int, *boundaries: Column) -> Column:
    """When something dirty is refreshed: after a pause, but no later than a longest wait or a boundary."""
    return F.least(last + debounce_us, first + most_wait_us, *boundaries)


def fair_order(jobs: DataFrame, tenant: str, priority: Column, tie: list[Column]) -> DataFrame:
    """Jobs in rounds over tenants: each tenant's most urgent first; tenant_rank says in which round a job comes."""
    return numbered(jobs, [tenant], [priority.desc(), *tie], "tenant_rank")


def backoff(attempts: Column, most: int = 300) -> Column:
    """Seconds until the next attempt: 1, 2, 4, ... up to most."""
    return F.least(F.lit(float(most)), F.pow(F.lit(2.0), F.least(F.lit(9), F.greatest(F.lit(0), attempts - 1))))


def changed_groups(old: DataFrame, new: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """What a change of rows does to each group that an answer is made of: group and effect (added, removed, changed or same).

    Compares fingerprints that are aggregated before they move, so no row is joined with another.
    """
    a, b = signatures(old, group, columns), signatures(new, group, columns)
    right = b.select(*(F.col(g).alias(f"_g_{g}") for g in group), *(F.col(c).alias(f"_n{c}") for c in ("_rows", "_xor", "_sum")))
    both = a.join(right, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group], "full_outer")
    same = F.lit(True)
    for c in ("_rows", "_xor", "_sum"):
        same = same & F.col(c).eqNullSafe(F.col(f"_n{c}"))
    effect = F.when(F.col("_rows").isNull(), "added").when(F.col("_n_rows").isNull(), "removed").when(same, "same").otherwise("changed")
    return both.select(*(F.coalesce(g, f"_g_{g}").alias(g) for g in group), effect.alias("effect"))
