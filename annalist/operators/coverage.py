"""Merging overlapping intervals into periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.timeshards import Cuts, find_cuts, pieces


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the merged intervals in order, each with the end of the one before it (null for the first)."""
    at = Window.partitionBy(*keys).orderBy("lo")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.max("hi").over(before))
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.when(F.col("_new") == 1, F.col("_reach"))).alias("before"))
    return out.drop("_island")


def coverage(intervals: DataFrame, keys: tuple[str, ...], lo: str, hi: str, cuts: Cuts | None = None, **hot: int) -> DataFrame:
    """Continuous periods and gaps of half-open intervals: keys, kind ('period' or 'gap'), from_us, to_us.

    Two levels: the intervals of a huge key are clipped into time shards and merged there; then only the periods that
    touch a shard's edge are stitched, at most two a shard. Touching intervals are one period; a gap is any hole
    between two periods. Rows with a null bound or an end not after the start are left out; null keys are keys.
    Copies and ties change nothing; an empty table gives an empty result. Columns of other names are ignored.
    """
    names = list(keys)
    rows = intervals.select(*names, F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi")).filter(F.col("lo") < F.col("hi"))
    cuts = cuts or find_cuts(rows, keys, ["lo", "hi"], **hot)
    # equal starts: only the longest matters, and copies are gone before anything moves
    parts = pieces(rows, cuts, "lo", "hi").groupBy(*names, "shard", "lo").agg(F.max("hi").alias("hi"))
    local = _merged(parts, [*names, "shard"])

    def stacked(df: DataFrame, *kinds: F.Column) -> DataFrame:
        return df.select(*names, F.explode(F.array(*kinds)).alias("_k")).filter("_k.lo is not null").select(*names, "_k.kind", F.col("_k.lo").alias("from_us"), F.col("_k.hi").alias("to_us"))

    period = F.struct(F.lit("period").alias("kind"), F.col("lo"), F.col("hi"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("before").alias("lo"), F.when(F.col("before").isNotNull(), F.col("lo")).alias("hi"))
    if cuts.hot is None:
        return stacked(local, period, gap)
    local = cuts.attach(local)
    edge = F.col("_cuts").isNotNull() & ((F.col("lo") == F.get("_cuts", F.col("shard") - 1)) | (F.col("hi") == F.get("_cuts", F.col("shard"))))
    local = local.withColumn("_edge", F.coalesce(edge, F.lit(False)))
    whole = stacked(local.filter(~F.col("_edge")), period).unionByName(stacked(local, gap))
    stitched = stacked(_merged(local.filter("_edge").select(*names, "lo", "hi"), names), period)
    reach = local.filter(F.col("_cuts").isNotNull()).groupBy(*names, "shard").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    reach = reach.withColumn("before", F.lag("hi").over(Window.partitionBy(*names).orderBy("shard")))
    between = stacked(reach.filter(F.col("before") < F.col("lo")), gap)
    return whole.unionByName(stitched).unionByName(between)
