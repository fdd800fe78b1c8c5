"""Versions of slowly changing values: change detection, feeds, points in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds_at(start: str | Column, end: str | Column, at: object) -> Column:
    """Half-open: start <= at < end, where a null end is none."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (start <= at) & (end.isNull() | (F.lit(at) < end if not isinstance(at, Column) else at < end))


def scd2(observations: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Versions from observations: keys, version (from 1), value, valid_from, valid_to, supersedes, corroborations.

    A repeated value corroborates the version it repeats. valid_from is the first order column. The window is over keys;
    a key of very many observations is better cut first (see operators.ledger for late and overlapping versions).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = observations.withColumn("_new", (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value)))
    marked = marked.withColumn("version", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "version").agg(F.min_by(value, F.struct(*order)).alias(value), F.min(order[0]).alias("valid_from"), (F.count("*") - 1).alias("corroborations"))
    v = Window.partitionBy(*keys).orderBy("version")
    return out.withColumn("valid_to", F.lead("valid_from").over(v)).withColumn("supersedes", F.lag("version").over(v))


def delta_feed(versions: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The change log of versions: keys, at, operation (add or replace), before, after."""
    w = Window.partitionBy(*keys).orderBy("version")
    before = F.lag(value).over(w)
    return versions.select(*keys, F.col("valid_from").alias("at"), F.when(F.col("version") == 1, "add").otherwise("replace").alias("operation"), before.alias("before"), F.col(value).alias("after"))


def latest_known(versions: DataFrame, keys: list[str], recorded: str, known_at: object, value: list[str]) -> DataFrame:
    """Per key the last version recorded by known_at, and when the next one comes to be known (null: never)."""
    known = F.col(recorded) <= F.lit(known_at)
    out = versions.groupBy(*keys).agg(F.max(F.when(known, F.struct(recorded, *value))).alias("_v"), F.min(F.when(~known, F.col(recorded))).alias("next_known"))
    return out.filter("_v IS NOT NULL").select(*keys, "_v.*", "next_known")


def intersections(a: DataFrame, b: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """The common part of each interval of a with each of b of the same key, where there is one (null end: none)."""
    right = b.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    both = a.join(right, keys)
    start, end = F.greatest(lo, "_lo"), F.least(hi, "_hi")
    return both.withColumn("start", start).withColumn("end", end).filter(F.col("end").isNull() | (F.col("start") < F.col("end"))).drop("_lo", "_hi")


def gaps_in_sequence(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Missing runs of a sequence of numbers per key: first_missing, last_missing."""
    w = Window.partitionBy(*keys).orderBy(number)
    nums = rows.select(*keys, number).distinct().withColumn("_b", F.lag(number).over(w))
    return nums.filter(F.col(number) > F.col("_b") + 1).select(*keys, (F.col("_b") + 1).alias("first_missing"), (F.col(number) - 1).alias("last_missing"))


def contiguous_prefix(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Up to which number each key's sequence, which begins at 1, is without gap (0 if it lacks 1)."""
    w = Window.partitionBy(*keys).orderBy(number)
    nums = rows.select(*keys, number).filter(F.col(number) >= 1).distinct().withColumn("_rn", F.row_number().over(w))
    return nums.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(number) == F.col("_rn"), F.col(number))), F.lit(0)).alias("cursor"))
