"""Cutting the time line of keys that hold very many rows.

A key with few rows is one shard. A hot key is cut at quantiles of its own instants into as many shards as its rows
call for, so that no task gets all of it, however many keys are hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.session import written

#: Rows from which a key is hot, which are about the rows of a shard too.
HOT_ROWS = 50_000
#: A key has at most so many shards; beyond so many times HOT_ROWS rows, its shards grow.
MOST_SHARDS = 65_536
#: The cut points of all hot keys are broadcast if they are at most so many numbers (8 MB); else they are joined.
BROADCAST_POINTS = 1_000_000
#: Into how many parts a hot key is spread where cut points are joined.
SALTS = 64


@dataclass(frozen=True)
class Cuts:
    """The hot keys of a table with their cut points (ascending, distinct); ``hot`` is None if no key is hot."""

    keys: tuple[str, ...]
    hot: DataFrame | None
    small: bool = True

    def attach(self, df: DataFrame) -> DataFrame:
        """df with ``_cuts``: null for keys that are not hot."""
        if self.hot is None:
            return df.withColumn("_cuts", F.lit(None).cast("array<bigint>"))
        return _beside(df, self.hot, self.keys, self.small, "left")


def _beside(df: DataFrame, hot: DataFrame, keys: tuple[str, ...], small: bool, how: str) -> DataFrame:
    """df joined with the rows of its hot keys: broadcast while they are few, else with hot keys spread over SALTS parts."""
    right = hot.select(*(F.col(k).alias(f"_h_{k}") for k in keys), *(c for c in hot.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    if small:
        return df.join(F.broadcast(right), same, how).drop(*(f"_h_{k}" for k in keys))
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    right = right.withColumn("_h_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("bigint"))
    return left.join(right, [*same, F.col("_salt") == F.col("_h_salt")], how).drop("_salt", "_h_salt", *(f"_h_{k}" for k in keys))


def find_cuts(df: DataFrame, keys: tuple[str, ...], instants: list[str], hot_rows: int = HOT_ROWS, shards: int | None = None) -> Cuts:
    """Which keys of df are hot, and where to cut them: at quantiles of all their instants (nulls and no-ends aside).

    A key of n rows is cut into n / hot_rows shards, rounded up to a power of two (with ``shards``, into that many).
    Neither hot keys nor cut points come to the driver.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    of_all = counts.agg(F.count("*").alias("keys"), F.max("_n").alias("most"), F.sum("_n").alias("rows")).collect()[0]
    if not of_all["keys"]:
        return Cuts(keys, None)
    most = shards or min(MOST_SHARDS, 1 << (-(-of_all["most"] // hot_rows) - 1).bit_length())
    small = of_all["keys"] * (shards or 1) + 2 * of_all["rows"] // hot_rows <= BROADCAST_POINTS
    every = F.lit(1) if shards else F.greatest(F.lit(1), F.floor(most / F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.col("_n") / hot_rows))))))
    hot = written(counts.select(*keys, every.cast("int").alias("_every")), "hot")
    rows = _beside(df.select(*keys, *dict.fromkeys(instants)), hot, keys, small, "inner")
    rows = rows.select(*keys, "_every", F.explode(F.array(*(F.col(c).cast("bigint") for c in instants))).alias("_t"))
    rows = rows.filter(F.col("_t").isNotNull() & (F.col("_t") < 2**62))
    points = F.percentile_approx("_t", [i / most for i in range(1, most)], max(10_000, 20 * most))
    cut = rows.groupBy(*keys, "_every").agg(points.alias("_p"))
    kept = F.filter("_p", lambda x, i: (i + 1) % F.col("_every") == 0)
    return Cuts(keys, written(cut.select(*keys, F.array_sort(F.array_distinct(kept)).alias("_cuts")), "cuts"), small)


def shard_of(instant: Column) -> Column:
    """The number of cuts at or before the instant; 0 for keys that are not hot. Needs ``_cuts``."""
    return F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c <= instant)))


def pieces(df: DataFrame, cuts: Cuts, lo: str, hi: str) -> DataFrame:
    """The half-open intervals [lo, hi) of df, cut at the edges of the shards of their keys: keys, shard, lo, hi.

    An interval leaves one piece in the shard it starts in and one in the shard it ends in. Which whole shards lie under
    intervals is counted with one mark where an interval begins to cover shards and one where it stops, summed per
    shard before they move, so it costs no more for long intervals than for short ones.
    """
    keys = list(cuts.keys)
    if cuts.hot is None:
        return df.select(*keys, F.lit(0).alias("shard"), lo, hi)
    at = cuts.attach(df.select(*keys, lo, hi)).withColumn("_a", shard_of(F.col(lo))).withColumn("_b", shard_of(F.col(hi) - 1))
    first = F.struct(F.col("_a").alias("shard"), F.col(lo).alias("lo"), F.when(F.col("_a") == F.col("_b"), F.col(hi)).otherwise(F.get("_cuts", F.col("_a"))).alias("hi"))
    last = F.struct(F.col("_b").alias("shard"), F.get("_cuts", F.col("_b") - 1).alias("lo"), F.col(hi).alias("hi"))
    ends = at.withColumn("_p", F.explode(F.when(F.col("_a") == F.col("_b"), F.array(first)).otherwise(F.array(first, last))))
    ends = ends.select(*keys, F.col("_p.shard").alias("shard"), F.col("_p.lo").alias(lo), F.col("_p.hi").alias(hi))
    mark = lambda s, n: F.struct(s.alias("shard"), F.lit(n).alias("n"))
    marks = at.filter(F.col("_b") > F.col("_a") + 1).select(*keys, F.explode(F.array(mark(F.col("_a") + 1, 1), mark(F.col("_b"), -1))).alias("_m"))
    marks = marks.groupBy(*keys, F.col("_m.shard").alias("shard")).agg(F.sum("_m.n").alias("n"))
    along = Window.partitionBy(*keys).orderBy("shard")
    runs = marks.select(*keys, "shard", F.sum("n").over(along).alias("open"), F.lead("shard").over(along).alias("stop")).filter("open > 0")
    wide = cuts.attach(runs.select(*keys, F.explode(F.sequence("shard", F.col("stop") - 1)).alias("shard")))
    return ends.unionByName(wide.select(*keys, "shard", F.get("_cuts", F.col("shard") - 1).alias(lo), F.get("_cuts", F.col("shard")).alias(hi)))
