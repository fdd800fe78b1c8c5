"""Numbers and values along the rows of groups that may be huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.timeshards import HOT_ROWS
from annalist.session import written


def largest_group(df: DataFrame, group: list[str]) -> int:
    """How many rows the largest group has; counted before anything moves."""
    return df.groupBy(*group).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0


def in_ranges(df: DataFrame, group: list[str], order: list[Column | str], most: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with ``_part``: cut by ranges of group and order, so that a huge group lies in several parts, in their order.

    Equal rows never lie in two parts. The rows are written, so a part is the same whenever it is read.
    """
    cut = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // hot_rows))
    return written(df.repartitionByRange(cut, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _with_parts(local: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    right = parts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g_{g}") for g in group), *(c for c in parts.columns if c != "_part" and c not in group))
    return local.join(right, [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group)])


def numbered(df: DataFrame, group: list[str], order: list[Column | str], name: str, ties: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with the position of each row in its group by order, from 1; with ``ties`` equal rows share the first of their positions.

    Where no group has more than hot_rows rows that is a window. Else the table is cut by ranges of group and order; each part is
    numbered by itself, and one row per part and group tells where it begins. Without ties the order must be total, or equal
    rows are numbered as they come. Null keys are a group.
    """
    function = F.rank() if ties else F.row_number()
    most = largest_group(df, group)
    if most <= hot_rows and group:
        return df.withColumn(name, function.over(Window.partitionBy(*group).orderBy(*order)))
    rows = in_ranges(df, group, order, most, hot_rows)
    local = rows.withColumn(name, function.over(Window.partitionBy("_part", *group).orderBy(*order)))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part", *group).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return _with_parts(local, sizes, group).withColumn(name, (F.col(name) + F.col("_base")).cast("int")).select(*df.columns, name)


def carried(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with the last value that isn't null of the rows before each in its group, by order; null if there is none.

    An as-of join as one pass: a window where no group is huge, else parts that each take over the last value of those before.
    """
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    most = largest_group(df, group)
    if most <= hot_rows:
        return df.withColumn(name, F.last(value, True).over(before))
    rows = in_ranges(df.withColumn("_v", value), group, order, most, hot_rows)
    local = rows.withColumn(name, F.last("_v", True).over(Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy("_part", *group).agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(*order, "_v"))).alias("_e"))
    ends = ends.withColumn("_base", F.last("_e._v", True).over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return _with_parts(local, ends, group).withColumn(name, F.coalesce(name, "_base")).select(*df.columns, name)
