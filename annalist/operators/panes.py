"""Event-time windows from panes: counts that late events correct, up to a cut-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.time import HOUR_US, micros

ON_TIME, CORRECTED, DROPPED = "on_time", "corrected", "dropped"
LATENESS_US = 48 * HOUR_US


def deliveries(events: DataFrame, key: str = "event_type") -> DataFrame:
    """One row per id: its earliest ingested_at with the occurred_at and key of that row (ties: the least of them).

    Ids, occurred_at and ingested_at that are null have no place in time and are left out.
    """
    rows = events.select("id", micros("ingested_at").alias("arrived_us"), micros("occurred_at").alias("at_us"), F.col(key).alias("key"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("arrived_us").isNotNull() & F.col("at_us").isNotNull())
    first = rows.groupBy("id").agg(F.min(F.struct("arrived_us", "at_us", "key")).alias("_f"))
    return first.select("id", "_f.arrived_us", "_f.at_us", "_f.key")


def _floor(instant: Column, width_us: int) -> Column:
    return instant - F.pmod(instant, F.lit(width_us))


def slice_panes(delivered: DataFrame, pane_us: int = HOUR_US, lateness_us: int = LATENESS_US) -> DataFrame:
    """Each delivered event with its pane and what its arrival does to it.

    Panes are the non-overlapping slices between window boundaries. An event that arrives before its pane ends is
    on_time; from the end up to and including lateness_us after it, it corrects the pane; later it is dropped.
    An event before it happened (arrived_us < at_us) is on time like any other.
    """
    start = _floor(F.col("at_us"), pane_us)
    end = start + pane_us
    outcome = F.when(F.col("arrived_us") < end, ON_TIME).when(F.col("arrived_us") <= end + lateness_us, CORRECTED).otherwise(DROPPED)
    return delivered.withColumn("pane_us", start).withColumn("outcome", outcome)


def pane_counts(sliced: DataFrame) -> DataFrame:
    """Per pane and key: events on time, correcting and dropped. Aggregated before the shuffle, so no pane is hot."""
    of = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return sliced.groupBy("pane_us", "key").agg(of(ON_TIME), of(CORRECTED), of(DROPPED))


def pane_revisions(sliced: DataFrame, pane_us: int = HOUR_US, every_us: int = HOUR_US) -> DataFrame:
    """The change log of the panes: pane, key, the revision (arrivals up to which instant), and by how much it counts.

    On-time events make the first revision at the end of the pane; a correction belongs to the revision that ends the
    period of every_us it arrived in. Dropped events make none.
    """
    end = F.col("pane_us") + pane_us
    arrived = _floor(F.col("arrived_us"), every_us) + every_us
    revised = F.when(F.col("outcome") == ON_TIME, end).otherwise(F.greatest(arrived, end))
    return sliced.filter(F.col("outcome") != DROPPED).groupBy("pane_us", "key", revised.alias("revised_us")).agg(F.count("*").alias("change"))


def windows_of_panes(revisions: DataFrame, window_us: int, slide_us: int) -> DataFrame:
    """Sliding windows recomposed from panes: one row per window, key and revision, with the count as of then.

    A changed pane touches only the window_us / slide_us windows that cover it; each is emitted again with its sum so
    far. Works on pane revisions, which are far fewer than events.
    """
    from pyspark.sql import Window

    first = _floor(F.col("pane_us") - window_us, slide_us) + slide_us
    covering = revisions.withColumn("window_us", F.explode(F.sequence(first, _floor(F.col("pane_us"), slide_us), F.lit(slide_us))))
    # a window is not emitted before it ends
    at = F.greatest("revised_us", F.col("window_us") + window_us)
    changes = covering.groupBy("window_us", "key", at.alias("revised_us")).agg(F.sum("change").alias("change"))
    so_far = Window.partitionBy("window_us", "key").orderBy("revised_us").rowsBetween(Window.unboundedPreceding, 0)
    return changes.select("window_us", "key", "revised_us", F.sum("change").over(so_far).alias("n"), (F.row_number().over(Window.partitionBy("window_us", "key").orderBy("revised_us")) - 1).alias("revision"))
