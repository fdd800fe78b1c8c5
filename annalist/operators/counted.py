"""Which recorded claims count, as intervals of their slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.time import NO_END, micros

#: The status of claims that count, and the year that means no end.
COUNTED_STATUS = ("active", "superseded", "archived")
NO_END_YEAR = 2199


def plain_key(column: str | Column) -> Column:
    """A key in lower case without outer blanks."""
    return F.lower(F.trim(column))


def counted_intervals(claims: DataFrame, *keep: str) -> DataFrame:
    """The counted rows of claims: their slot, from_us, to_us (no end: NO_END) and the columns of keep.

    A row counts if its status is a counted one in any letter case and outer blanks, it has an id and valid_from, and
    its end is after its start. Copies of an id all remain. A null partition_key or claim_key is a slot of its own.
    """
    end = F.when(F.col("valid_to").isNull() | (F.year("valid_to") == NO_END_YEAR), F.lit(NO_END)).otherwise(micros("valid_to"))
    rows = claims.filter(plain_key("status").isin(*COUNTED_STATUS) & F.col("id").isNotNull())
    rows = rows.select("id", "partition_key", plain_key("claim_key").alias("claim_key"), micros("valid_from").alias("from_us"), end.alias("to_us"), *keep)
    return rows.filter(F.col("from_us") < F.col("to_us"))


def one_per_id(rows: DataFrame, first: str, *rest: str) -> DataFrame:
    """One row per id: the one with the least ``first``, of equals the one with the least rest (nulls first).

    A map-side aggregate, so copies of one id, however many, are reduced before they move.
    """
    others = list(rest) or [c for c in rows.columns if c not in ("id", first)]
    best = rows.groupBy("id").agg(F.min(F.struct(first, *others)).alias("_r"))
    return best.select("id", F.col(f"_r.{first}").alias(first), *(F.col(f"_r.{c}").alias(c) for c in others))
