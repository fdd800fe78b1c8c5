"""Three-valued rules: conditions, applicability, admission, overriding, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def condition(tree: dict, types: dict[str, str], zone: str = "UTC") -> Column:
    """A condition tree as a column: true, false or null for unknown.

    Nodes: {"op": "and" | "or", "of": [...]}, {"op": "not", "of": node}, {"op": "eq" | "ne" | "lt" | "le" | "gt" | "ge",
    "attr": a, "value": v}, {"op": "in", "attr": a, "value": [...]}, {"op": "weekday", "attr": a, "value": [0-6, Monday
    0]}. An attribute that is missing or of another type than the value is unknown: 1 is not true, and "1" not 1.
    """
    op = tree["op"]
    if op in ("and", "or"):
        out = None
        for node in tree["of"]:
            c = condition(node, types, zone)
            out = c if out is None else out & c if op == "and" else out | c
        return F.lit(op == "and") if out is None else out
    if op == "not":
        return ~condition(tree["of"], types, zone)
    unknown = F.lit(None).cast("boolean")
    kind = types.get(tree["attr"])
    if kind is None:
        return unknown
    attr, value = F.col(tree["attr"]), tree["value"]
    if op == "weekday":
        local = F.from_utc_timestamp(attr.cast("timestamp"), zone)
        return F.weekday(local).isin(*value) if kind.startswith("timestamp") else unknown

    def fits(v: object) -> bool:
        if isinstance(v, bool):
            return kind == "boolean"
        if isinstance(v, (int, float)):
            return kind in NUMBERS
        return isinstance(v, str) and kind == "string"

    if op == "in":
        same = [v for v in value if fits(v)]
        inside = attr.isin(*same) if same else F.when(attr.isNotNull(), F.lit(False))
        return inside if len(same) == len(value) else F.when(inside, F.lit(True))
    if not fits(value):
        return unknown
    v = F.lit(value)
    return {"eq": attr == v, "ne": attr != v, "lt": attr < v, "le": attr <= v, "gt": attr > v, "ge": attr >= v}[op]


def applicable(conditions: list[Column], exceptions: list[Column]) -> Column:
    """False if a condition is false or an exception true, else unknown if any is unknown, else true."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    for e in exceptions:
        out = out & ~e
    return out


def reasons(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in rules)))


def composed(items: DataFrame, group: list[str], domains: list[str]) -> DataFrame:
    """Ordered overriding: items (group, domain, applies, value) of a group as one status, and the value if it is resolved.

    domains are in rising order of precedence. What doesn't apply is dropped, then what a higher domain that definitely
    applies dominates; then none is unknown, any uncertain one unknown, several values ambiguous, one resolved.
    """
    rank = F.lit(-1)
    for i, name in enumerate(domains):
        rank = F.when(F.col("domain") == name, i).otherwise(rank)
    ranked = items.withColumn("_rank", rank).filter(F.coalesce("applies", F.lit(True)))
    top = ranked.groupBy(*group, "_rank", "applies", "value").agg(F.count("*").alias("_n"))
    sure = top.groupBy(*group).agg(F.max(F.when(F.col("applies"), F.col("_rank"))).alias("_top"))
    left = top.join(sure, group).filter(F.col("_top").isNull() | (F.col("_rank") >= F.col("_top")))
    out = left.groupBy(*group).agg(F.max(F.col("applies").isNull()).alias("_u"), F.count_distinct("value").alias("_v"), F.min("value").alias("_value"))
    status = F.when(F.col("_u"), "unknown").when(F.col("_v") > 1, "ambiguous").otherwise("resolved")
    return out.select(*group, status.alias("status"), F.when(~F.col("_u") & (F.col("_v") == 1), F.col("_value")).alias("value"))


def trust(actor: str | Column, kind: str | Column) -> Column:
    """How far a source is trusted, 0 to 4, by who spoke and how (fixed values)."""
    actor, kind = (F.col(c) if isinstance(c, str) else c for c in (actor, kind))
    return F.when(kind == "memory.proposal.accepted", 4).when(actor == "user", 3).when(actor == "tool", 2).when(actor.isin("assistant", "agent"), 1).otherwise(0)


def consolidation(candidates: DataFrame, current: DataFrame, slot: list[str]) -> DataFrame:
    """What becomes of the candidates of each slot: MERGE, UPSERT, SUPERSEDE or CONFLICT, with the candidate that leads.

    candidates: slot, id, value, trust, valid_from, created; current: slot, value, trust, valid_from (one row a slot). The
    leader has the highest trust, then valid_from, created, id. Leaders of equal trust and valid_from with several values
    conflict; so does a leader that is not later, or less trusted, than a differing current value.
    """
    by_rank = candidates.groupBy(*slot, "trust", "valid_from").agg(F.count_distinct("value").alias("values"), F.max(F.struct("created", "id", "value")).alias("_l"))
    best = by_rank.groupBy(*slot).agg(F.max(F.struct("trust", "valid_from", "values", "_l")).alias("b")).select(*slot, "b.trust", "b.valid_from", "b.values", F.col("b._l.id").alias("id"), F.col("b._l.value").alias("value"))
    now = current.select(*slot, F.col("value").alias("_cv"), F.col("trust").alias("_ct"), F.col("valid_from").alias("_cf"))
    both = best.join(now, slot, "left")
    op = (
        F.when(F.col("values") > 1, "CONFLICT").when(F.col("_cf").isNull(), "UPSERT").when(F.col("_cv").eqNullSafe(F.col("value")), "MERGE")
        .when((F.col("valid_from") < F.col("_cf")) | (F.col("trust") < F.col("_ct")), "CONFLICT")
        .when((F.col("valid_from") == F.col("_cf")) & (F.col("trust") == F.col("_ct")), "CONFLICT").otherwise("SUPERSEDE")
    )
    return both.select(*slot, "id", "value", op.alias("operation"))
