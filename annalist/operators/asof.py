"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.time import DAY_US
from annalist.operators.ranks import carried
from annalist.operators.sweep import by_group, strongest_at
from annalist.operators.timeshards import HOT_ROWS, Cuts, find_cuts, shard_of
from annalist.session import written

PERIOD_US = 14 * DAY_US
_BEGIN = -(2**62)


def _in_periods(df: DataFrame, cuts: Cuts, period_us: int, **instants: str) -> DataFrame:
    """df with the period of each instant: a calendar period, and within it the shard of a hot key. An end belongs to the period before it."""
    df = cuts.attach(df)
    for name, c in instants.items():
        inside = F.col(c) - (1 if c == "hi" else 0)
        calendar = F.floor(inside / period_us).cast("bigint")
        if c == "hi":
            calendar = F.when(F.col(c) >= 2**62, F.lit(2**40)).otherwise(calendar)
        df = df.withColumn(name, calendar * 2**20 + shard_of(inside))
    return df.drop("_cuts")


@dataclass(frozen=True)
class Known:
    """What was known of each key, materialised: a snapshot at the start of each period in which something changed, and the changes in it.

    snapshot and log: keys, period, at, hi, strong_1, strong_2, id. A snapshot holds what was known and valid at the period's start and can still
    matter: the versions that end within the period, and the single strongest of those that outlast it. So all snapshots together have no
    more rows than there are versions and periods with changes. periods: keys, period.
    """

    keys: tuple[str, ...]
    period_us: int
    cuts: Cuts
    snapshot: DataFrame
    log: DataFrame
    periods: DataFrame

    @staticmethod
    def of(versions: DataFrame, keys: tuple[str, ...], period_us: int = PERIOD_US, cuts: Cuts | None = None, **hot: int) -> Known:
        """From versions: keys, id (unique), from_us, to_us, created_us, strong_1, strong_2 (the stronger has the greater strong_1, then
        strong_2, then id). A version can be seen from the later of from_us and created_us on, until to_us. Tables are written, and can be
        read by any number of calls of at(). Rows with a null key, id or instant are never seen.
        """
        names = list(keys)
        spans = versions.select(*names, "id", F.coalesce("strong_1", F.lit(_BEGIN)).cast("bigint").alias("strong_1"), F.coalesce("strong_2", F.lit(-1)).cast("bigint").alias("strong_2"), F.greatest("from_us", "created_us").alias("at"), F.col("to_us").alias("hi"))
        for cond in [*(F.col(k).isNotNull() for k in names), F.col("id").isNotNull(), F.col("at") < F.col("hi")]:
            spans = spans.filter(cond)
        spans = written(spans, "spans")
        cuts = cuts or find_cuts(spans.select(*names, "at", "hi"), keys, ["at", "hi"], **hot)
        spans = _in_periods(spans, cuts, period_us, _p0="at", _p1="hi")
        ends = F.when(F.col("hi") < 2**62, F.array("_p0", "_p1")).otherwise(F.array("_p0"))
        periods = written(spans.select(*names, F.explode(ends).alias("period")).distinct(), "periods")

        # which version outlasts a whole period: the same sweep over periods, of the strongest per first and last period
        strong = F.struct("strong_1", "strong_2", "id")
        spanning = spans.filter(F.col("_p1") > F.col("_p0") + 1)
        wide = spanning.groupBy(*names, "_p0", "_p1").agg(F.max(strong).alias("_s"))
        wide = wide.select(*names, (F.col("_p0") + 1).alias("at"), F.lit(False).alias("is_probe"), F.col("_p1").alias("hi"), "_s.strong_1", "_s.strong_2", F.col("_s.id").alias("id"))
        none = F.lit(None).cast("bigint")
        asked = periods.select(*names, F.col("period").alias("at"), F.lit(True).alias("is_probe"), none.alias("hi"), none.alias("strong_1"), none.alias("strong_2"), F.to_json(F.struct(*names, "period")).alias("id"))
        outlasting = strongest_at(by_group(wide.unionByName(asked), names, ["at", "is_probe"]), names)
        covers = outlasting.select(F.from_json("probe_id", periods.schema).alias("_k"), "id").select("_k.*", "id")
        covers = covers.join(spanning.select("id", "strong_1", "strong_2", "hi"), "id").select(*names, "period", F.lit(_BEGIN).alias("at"), "hi", "strong_1", "strong_2", "id")
        ending = spans.filter(F.col("_p1") > F.col("_p0")).groupBy(*names, F.col("_p1").alias("period"), "hi").agg(F.max(strong).alias("_s"))
        ending = ending.filter(F.col("hi") < 2**62).select(*names, "period", F.lit(_BEGIN).alias("at"), "hi", "_s.strong_1", "_s.strong_2", F.col("_s.id").alias("id"))
        log = spans.select(*names, F.col("_p0").alias("period"), "at", "hi", "strong_1", "strong_2", "id")
        return Known(tuple(names), period_us, cuts, written(covers.unionByName(ending), "snapshot"), log, periods)

    def at(self, events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
        """For each event (keys, at_us, event_id) the strongest version valid and already known at its instant: event_id, id.

        An event is answered from the last period with changes up to its own: the snapshot of that period and its log are replayed
        in order of time with a heap, so no pair that doesn't answer an event is made. A period that very many events fall to is replayed by
        several tasks, each for a part of them. Events without such a version give no row.
        """
        names = list(self.keys)
        asked = events.select(*names, F.col("at_us").alias("at"), F.col("event_id").alias("id"))
        for cond in [*(F.col(k).isNotNull() for k in names), F.col("id").isNotNull(), F.col("at").isNotNull()]:
            asked = asked.filter(cond)
        asked = _in_periods(written(asked, "asked"), self.cuts, self.period_us, period="at").withColumn("_event", F.lit(1))
        kind = dict(asked.dtypes)["id"]
        starts = self.periods.join(asked.select(*names).distinct(), names, "left_semi").select(*names, F.lit(None).cast("bigint").alias("at"), F.lit(None).cast(kind).alias("id"), "period", F.lit(0).alias("_event"))
        own = F.when(F.col("_event") == 0, F.col("period"))
        asked = carried(starts.unionByName(asked), names, ["period", "_event", "at", "id"], own, "_own", hot_rows).filter("_event = 1 AND _own IS NOT NULL")
        asked = asked.select(*names, F.col("_own").alias("period"), "at", "id")
        parts = asked.groupBy(*names, "period").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("_parts"))
        rows = self.snapshot.unionByName(self.log).join(parts, [*names, "period"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        rows = rows.drop("_parts").withColumn("is_probe", F.lit(False))
        none = F.lit(None).cast("bigint")
        probes = asked.join(parts, [*names, "period"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
        probes = probes.select(*names, "period", "at", none.alias("hi"), none.alias("strong_1"), none.alias("strong_2"), "id", "_part", F.lit(True).alias("is_probe"))
        group = [*names, "period", "_part"]
        out = strongest_at(by_group(rows.unionByName(probes), group, ["at", "is_probe"]), group)
        return out.select(F.col("probe_id").alias("event_id"), "id")


def as_known(events: DataFrame, versions: DataFrame, keys: tuple[str, ...], period_us: int = PERIOD_US, cuts: Cuts | None = None, hot_rows: int = HOT_ROWS, **hot: int) -> DataFrame:
    """For each event the strongest version valid and already known at its instant: event_id, id. See Known for what goes in.

    Never a version that became known later. An empty table gives an empty result; other columns are ignored.
    """
    return Known.of(versions, keys, period_us, cuts, hot_rows=hot_rows, **hot).at(events, hot_rows)
