"""Scopes: who sees which rows, and rows that are there only once."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.ranks import carried

from annalist.functions.text import digest

#: The coordinates of a scope below tenant and namespace, each narrower than the one before (fixed value).
LEVELS = ("user_id", "agent_id", "workspace_id", "session_id")


def visible(scope: dict[str, str | None]) -> Column:
    """Rows a scope sees: same tenant and namespace, and no coordinate that is another than the scope's own."""
    out = (F.col("tenant_id") == scope["tenant_id"]) & (F.col("namespace") == scope["namespace"])
    for c in LEVELS:
        out &= F.col(c).isNull() | (F.col(c) == F.lit(scope[c])) if scope.get(c) is not None else F.col(c).isNull()
    return out


def scope_key(prefix: str = "") -> Column:
    """The digest that names a scope, over its six coordinates (nulls included)."""
    return digest("tenant_id", "namespace", *(f"{prefix}{c}" for c in LEVELS))


def ancestors(scopes: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Each scope with every scope whose rows it sees: each coordinate kept or left open, up to 2 ** levels of them.

    The further coordinates are named seen_<level>. With it visibility is an equi-join instead of a theta join.
    """
    out = scopes
    options = [F.struct(*((F.col(c) if keep else F.lit(None).cast("string")).alias(f"seen_{c}") for c, keep in zip(levels, kept, strict=True))) for kept in product((True, False), repeat=len(levels))]
    out = out.withColumn("_s", F.explode(F.array_distinct(F.array(*options))))
    return out.select(*scopes.columns, "_s.*")


def chain(scopes: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Each scope with the scopes above it in the order of levels only, itself included, at most one a level more."""
    options = []
    for depth in range(len(levels) + 1):
        options.append(F.struct(*((F.col(c) if i < depth else F.lit(None).cast("string")).alias(f"seen_{c}") for i, c in enumerate(levels))))
    return scopes.withColumn("_s", F.explode(F.array_distinct(F.array(*options)))).select(*scopes.columns, "_s.*")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, as a map-side aggregate; rows with a null key are all kept."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    whole = None
    for k in keys:
        whole = F.col(k).isNotNull() if whole is None else whole & F.col(k).isNotNull()
    best = rows.filter(whole).groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*")
    return best.select(*rows.columns).unionByName(rows.filter(~whole))


def page_after(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next page of rows by falling order columns, after the row with these values (None: the first page)."""
    key = F.struct(*order)
    if after is not None:
        types = dict(rows.dtypes)
        rows = rows.filter(key < F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, after, strict=True))))
    return rows.orderBy(*(F.desc(c) for c in order)).limit(size)


def fully_supported(owners: DataFrame, links: DataFrame, alive: DataFrame, owner: str, source: str) -> DataFrame:
    """Owners with at least one source and none that isn't alive (relational division), as counts and a flag."""
    there = alive.select(source).distinct().withColumn("_alive", F.lit(1))
    state = links.select(owner, source).distinct().join(there, source, "left").groupBy(owner).agg(F.count("*").alias("sources"), F.count("_alive").alias("alive"))
    out = owners.select(owner).distinct().join(state, owner, "left").fillna(0, ["sources", "alive"])
    return out.withColumn("live", (F.col("sources") > 0) & (F.col("sources") == F.col("alive")))


def keep_last(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows of each key that are not among its last n: what an archive may take."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") > n).drop("_n")


def granted(reads: DataFrame, grants: DataFrame, keys: list[str]) -> DataFrame:
    """The reads that a grant covers: of the grants of their keys the last one before the read decides, and whether it still runs.

    reads: keys, id, at_us; grants: keys, at_us, until_us (null: no end; not after at_us: a withdrawal). Found in one ordered pass over both, so a
    reader with very many grants makes no pairs. At equal instants the grant counts.
    """
    given = grants.select(*keys, "at_us", F.lit(0).alias("_read"), F.lit(None).cast(dict(reads.dtypes)["id"]).alias("id"), F.struct(F.coalesce("until_us", F.lit(2**62)).alias("u")).alias("_g"))
    given = given.groupBy(*keys, "at_us", "_read", "id").agg(F.min("_g").alias("_g"))
    asked = reads.select(*keys, "at_us", F.lit(1).alias("_read"), "id", F.lit(None).cast("struct<u: bigint>").alias("_g"))
    both = carried(given.unionByName(asked), keys, ["at_us", "_read", "id"], F.col("_g"), "_until")
    return both.filter((F.col("_read") == 1) & (F.col("_until.u") > F.col("at_us"))).select(*keys, "id", "at_us", F.when(F.col("_until.u") < 2**62, F.col("_until.u")).alias("until_us"))
