"""Streams of events: ingestion that is exactly-once, panes and windows corrected by late events, sessions, late parents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.time import DAY_US, HOUR_US
from annalist.operators.panes import LATENESS_US, deliveries, pane_counts, slice_panes


def files(spark: SparkSession, path: str, schema: str, per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a table (a folder or a single file), a bounded number a batch."""
    head, last = path[:-1], path[-1]  # as a pattern, since a stream takes a plain path for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{head}[{last}]")


def run(query: object) -> None:
    """Runs a stream over all there is now, and raises what it raised."""
    started = query.trigger(availableNow=True).start()
    started.awaitTermination()
    if started.exception():
        raise started.exception()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders prefix=number in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}="))


def ingest(stream: DataFrame, key: list[str], at: str, lateness: str, target: str, checkpoint: str) -> None:
    """Appends each key's first row to target, once: copies within the lateness are dropped, and a batch that is run again
    replaces what it wrote before.
    """
    once = stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    run(once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


_STORED = "id string, arrived_us bigint, at_us bigint, key string, pane_us bigint, outcome string, day int, batch int"
_COUNTS = "pane_us bigint, key string, on_time bigint, corrected bigint, dropped bigint, day int, batch int"


class PaneStore:
    """Panes kept by a stream, in folders by day of event time, so that a batch reads only the days it touches.

    deliveries/day=D/batch=N holds what batch N brought, counts/day=D/batch=N the panes it changed as they were then,
    windows/batch=N the windows that cover those panes, seen/batch=N how far arrivals had come. Everything of a batch is in
    folders of its number, so one that is run again replaces what it wrote. A day that is past the lateness by ``keep_us``
    is evicted: its deliveries go and its counts stay; what still comes for it is counted on top, as dropped.
    """

    def __init__(self, spark: SparkSession, path: str, pane_us: int = HOUR_US, lateness_us: int = LATENESS_US, window_us: int = DAY_US, slide_us: int = 6 * HOUR_US, keep_us: int = 7 * DAY_US) -> None:
        self.spark, self.path, self.pane_us, self.lateness_us = spark, path, pane_us, lateness_us
        self.window_us, self.slide_us, self.keep_us = window_us, slide_us, keep_us

    def _of(self, what: str, schema: str, days: list[int]) -> DataFrame:
        """The rows of some days; only their folders are listed and read."""
        there = set(_names(self.spark, f"{self.path}/{what}", "day"))
        paths = [f"{self.path}/{what}/day={d}" for d in days if d in there]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*paths)

    def _latest(self, days: list[int], upto: Column) -> DataFrame:
        rows = self._of("counts", _COUNTS, days).filter(upto)
        last = rows.groupBy("day", "pane_us", "key").agg(F.max(F.struct("batch", "on_time", "corrected", "dropped")).alias("r"))
        return last.select("day", "pane_us", "key", "r.on_time", "r.corrected", "r.dropped")

    def _evicted(self, n: int) -> list[int]:
        """Days whose deliveries are no longer kept, as of the batch before; deletes those that were still there."""
        seen = [b for b in _names(self.spark, f"{self.path}/seen", "batch") if b < n]
        if not seen:
            return []
        upto = self.spark.read.schema("arrived_us bigint").parquet(f"{self.path}/seen/batch={seen[-1]}").first().arrived_us
        if upto is None:
            return []
        horizon = upto - self.lateness_us - self.keep_us
        days = _names(self.spark, f"{self.path}/counts", "day")
        gone = [d for d in days if (d + 1) * DAY_US <= horizon]
        for d in set(gone) & set(_names(self.spark, f"{self.path}/deliveries", "day")):
            _delete(self.spark, f"{self.path}/deliveries/day={d}")
        return gone

    def take(self, batch: DataFrame, n: int) -> None:
        """Takes in a batch of deliveries (id, ingested_at, occurred_at, event_type)."""
        day = F.floor(F.col("pane_us") / DAY_US).cast("int")
        new = slice_panes(deliveries(batch), self.pane_us, self.lateness_us).withColumn("day", day).persist()
        try:
            gone = self._evicted(n)
            arrived = new.agg(F.max("arrived_us").alias("arrived_us"))
            batches = _names(self.spark, f"{self.path}/seen", "batch")
            before = [b for b in batches if b < n]
            if before:
                arrived = arrived.unionByName(self.spark.read.schema("arrived_us bigint").parquet(f"{self.path}/seen/batch={before[-1]}")).agg(F.max("arrived_us").alias("arrived_us"))
            arrived.write.mode("overwrite").parquet(f"{self.path}/seen/batch={n}")
            days = [r.day for r in new.select("day").distinct().collect()]  # at most one number a day
            live = [d for d in days if d not in set(gone)]
            touched = new.select("pane_us").distinct()
            stored = self._of("deliveries", _STORED, live).filter(F.col("batch") < n).join(touched, "pane_us", "left_semi")
            rows = stored.drop("batch").unionByName(new.filter(F.col("day").isin(live)).select(*(f.split()[0] for f in _STORED.split(", ")[:-1])))
            first = rows.groupBy("id").agg(F.min(F.struct("arrived_us", "at_us", "key", "pane_us", "outcome")).alias("r")).select("id", "r.*")
            counts = pane_counts(first)
            if set(days) - set(live):  # on top of what is known of evicted days
                late = pane_counts(new.filter(~F.col("day").isin(live)))
                known = self._latest([d for d in days if d not in live], F.col("batch") < n).drop("day").join(touched, "pane_us", "left_semi")
                both = late.unionByName(known).groupBy("pane_us", "key")
                counts = counts.unionByName(both.agg(*(F.sum(c).alias(c) for c in ("on_time", "corrected", "dropped"))))
            for d in days if n in batches else ():  # what an earlier run of this batch left behind
                for what in ("deliveries", "counts"):
                    _delete(self.spark, f"{self.path}/{what}/day={d}/batch={n}")
            new.filter(F.col("day").isin(live)).withColumn("batch", F.lit(n)).repartition("day").write.mode("append").partitionBy("day", "batch").parquet(f"{self.path}/deliveries")
            counts.withColumn("day", day).withColumn("batch", F.lit(n)).repartition("day").write.mode("append").partitionBy("day", "batch").parquet(f"{self.path}/counts")
            self._windows(touched, days, n).write.mode("overwrite").parquet(f"{self.path}/windows/batch={n}")
        finally:
            new.unpersist()

    def _windows(self, touched: DataFrame, days: list[int], n: int) -> DataFrame:
        """The windows that cover a touched pane, put together again from the panes as they are now."""
        slide, width = self.slide_us, self.window_us
        covering = lambda c: F.explode(F.sequence(c - F.pmod(c - width, F.lit(slide)) - width + slide, c - F.pmod(c, F.lit(slide)), F.lit(slide)))
        reach = -(-width // DAY_US)
        near = sorted({d + k for d in days for k in range(-reach, reach + 1)})
        windows = touched.select(covering(F.col("pane_us")).alias("window_us")).distinct()
        panes = self._latest(near, F.col("batch") <= n).withColumn("window_us", covering(F.col("pane_us")))
        whole = panes.join(windows, "window_us", "left_semi").groupBy("window_us", "key")
        return whole.agg(F.sum(F.col("on_time") + F.col("corrected")).alias("n"), F.sum("dropped").alias("dropped"))

    def panes(self) -> DataFrame:
        """The last emission of each pane."""
        return self._latest(_names(self.spark, f"{self.path}/counts", "day"), F.lit(True)).drop("day")

    def windows(self) -> DataFrame:
        """The last emission of each window, and how often it was emitted."""
        rows = self.spark.read.schema("window_us bigint, key string, n bigint, dropped bigint, batch int").option("basePath", f"{self.path}/windows").parquet(f"{self.path}/windows")
        last = rows.groupBy("window_us", "key").agg(F.max(F.struct("batch", "n", "dropped")).alias("r"), F.count("*").alias("emissions"))
        return last.select("window_us", "key", "r.n", "r.dropped", "emissions")


def pane_stream(stream: DataFrame, store: PaneStore, checkpoint: str) -> None:
    """Keeps the panes of deliveries; a batch emits exactly the panes it changed and the windows that cover them."""
    run(stream.writeStream.foreachBatch(store.take).option("checkpointLocation", checkpoint))


def sessions(stream: DataFrame, key: str, at: str, pause_us: int, lateness: str, target: str, checkpoint: str) -> None:
    """Sessions of each key that a pause ends; each batch emits those it changed: key, start_us, end_us, n.

    State is the sessions of a key that late events can still change; those that ended a pause before the watermark leave it.
    An event that joins two sessions makes them one: the later one is emitted once more with n = 0. The last
    emission of a start counts (latest_sessions). Events behind the watermark, and null keys and times, are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = dict(stream.dtypes)[key]

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        mark = state.getCurrentWatermarkMs() * 1000
        if state.hasTimedOut:
            held = [s for s in held if s[1] > mark]
        changed: dict[int, tuple[int, int]] = {}
        times = sorted(t for frame in frames for t in frame["at_us"] if t >= mark)
        for t in times:
            near = [s for s in held if s[0] - pause_us < t < s[1]]
            merged = [min([t, *(s[0] for s in near)]), max([t + pause_us, *(s[1] for s in near)]), 1 + sum(s[2] for s in near)]
            held = [s for s in held if s not in near] + [merged]
            for s in near:
                changed[s[0]] = (s[1], 0)
            changed[merged[0]] = (merged[1], merged[2])
        held = [s for s in held if s[1] > mark]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(min(s[1] for s in held) // 1000, mark // 1000) + 1)
        elif state.exists:
            state.remove()
        if changed:
            rows = [(name[0], a, b, n) for a, (b, n) in changed.items()]
            yield pd.DataFrame(rows, columns=[key, "start_us", "end_us", "n"])

    rows = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, lateness)
    rows = rows.select(key, at, F.unix_micros(at).alias("at_us"))
    out = rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, start_us bigint, end_us bigint, n bigint", "held string", "update", GroupStateTimeout.EventTimeTimeout)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    run(out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint))


def latest_sessions(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The sessions as last emitted."""
    rows = spark.read.option("basePath", target).parquet(target)
    last = rows.groupBy(key, "start_us").agg(F.max(F.struct("batch", "end_us", "n")).alias("r"))
    return last.select(key, "start_us", "r.end_us", "r.n").filter("n > 0")


#: How many children may wait for one parent (fixed value of the store this reads from).
MOST_PENDING = 1000


def late_parents(stream: DataFrame, target: str, checkpoint: str, wait_us: int = DAY_US, lateness: str = "0 seconds", most_pending: int = MOST_PENDING) -> None:
    """Children (id, parent) are accepted when their parent has come, before or after them; until then they are pending.

    stream: key (the parent's id for a child, its own id for a parent), id, is_parent, at (timestamp). Emits parent, id and
    what became of the child: accepted, expired (no parent within wait_us of the child's time, by the watermark) or refused
    (most_pending others wait for the parent already). So nothing is lost without a row. State is one flag and the
    pending children of a key, which leave it when they are accepted or expire.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        there, text = state.get if state.exists else (False, "{}")
        waiting: dict[str, int] = json.loads(text)
        mark = state.getCurrentWatermarkMs() * 1000
        out = [(name, "expired") for name, until in waiting.items() if until < mark]
        waiting = {name: until for name, until in waiting.items() if until >= mark}
        for frame in frames:
            there = there or bool(frame["is_parent"].any())
            for name, at in sorted(zip(frame.loc[~frame["is_parent"], "id"], frame.loc[~frame["is_parent"], "at_us"])):
                if there or name in waiting or len(waiting) < most_pending:
                    waiting[name] = min(int(at) + wait_us, waiting.get(name, 2**62))
                else:
                    out.append((name, "refused"))
        if there:
            out += [(name, "accepted") for name in waiting]
            waiting = {}
        if there or waiting:
            state.update((there, json.dumps(waiting)))
            if waiting:
                state.setTimeoutTimestamp(max(min(waiting.values()) // 1000, mark // 1000) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame([(key[0], *x) for x in sorted(out)], columns=["parent", "id", "state"])

    rows = stream.withWatermark("at", lateness).select("key", "id", "is_parent", "at", F.unix_micros("at").alias("at_us"))
    settled = rows.groupBy("key").applyInPandasWithState(step, "parent string, id string, state string", "there boolean, waiting string", "append", GroupStateTimeout.EventTimeTimeout)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    run(settled.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint))
