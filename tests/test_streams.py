"""Streams of several batches: out of order, replayed, evicted; against what one batch gives."""

import random
from datetime import datetime as dt
from datetime import timedelta

from pyspark.sql import functions as F

from annalist.functions.time import DAY_US, HOUR_US
from annalist.operators.panes import deliveries, pane_counts, slice_panes
from annalist.streaming import pipelines

BEGIN = dt(2026, 3, 1)
EVENT = "id string, occurred_at timestamp_ntz, ingested_at timestamp_ntz, event_type string"


def some_events(seed: int, n: int = 300) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = BEGIN + timedelta(minutes=r.randrange(60 * 24 * 6))
        late = timedelta(minutes=r.choice([0, 1, 30, 300, 60 * 30, 60 * 60, 60 * 100]))
        out.append((f"e{i}", at, at + late, r.choice("xy")))
        if r.random() < 0.2:
            out.append((f"e{i}", at, at + late + timedelta(minutes=r.randrange(500)), out[-1][3]))
    return sorted(out, key=lambda e: e[2])


def counted(df):
    return sorted(map(tuple, df.select("pane_us", "key", "on_time", "corrected", "dropped").collect()), key=repr)


def windows_by_hand(panes: list[tuple]) -> dict:
    out: dict = {}
    for pane, key, on_time, corrected, dropped in panes:
        start = (pane // (6 * HOUR_US)) * 6 * HOUR_US
        for k in range(4):
            n = out.setdefault((start - k * 6 * HOUR_US, key), [0, 0])
            n[0] += on_time + corrected
            n[1] += dropped
    return {k: tuple(v) for k, v in out.items()}


def test_panes_of_batches_are_those_of_the_whole(spark, tmp_path):
    events = some_events(1)
    parts = [events[:120], events[200:], events[120:200]]  # the second and third in the wrong order
    store = pipelines.PaneStore(spark, str(tmp_path / "store"), keep_us=1000 * DAY_US)
    for n, part in enumerate(parts):
        store.take(spark.createDataFrame(part, EVENT), n)
    want = counted(pane_counts(slice_panes(deliveries(spark.createDataFrame(events, EVENT)))))
    assert counted(store.panes()) == want
    got = {(r.window_us, r.key): (r.n, r.dropped) for r in store.windows().collect()}
    assert got == windows_by_hand(want)
    store.take(spark.createDataFrame(parts[2], EVENT), 2)  # the last batch again
    assert counted(store.panes()) == want and {(r.window_us, r.key): (r.n, r.dropped) for r in store.windows().collect()} == got


def test_a_late_batch_emits_only_what_it_changes(spark, tmp_path):
    store = pipelines.PaneStore(spark, str(tmp_path / "store"))
    on_time = [(f"a{h}", BEGIN + timedelta(hours=h), BEGIN + timedelta(hours=h), "x") for h in range(72)]
    store.take(spark.createDataFrame(on_time, EVENT), 0)
    store.take(spark.createDataFrame([("late", BEGIN + timedelta(hours=30), BEGIN + timedelta(hours=40), "x"), ("a5", BEGIN + timedelta(hours=5), BEGIN + timedelta(hours=41), "x")], EVENT), 1)
    changed = [r for r in spark.read.parquet(f"{tmp_path}/store/counts").filter("batch = 1").collect()]
    assert sorted((r.on_time, r.corrected) for r in changed) == [(1, 0), (1, 1)]
    base = int(BEGIN.timestamp()) * 1_000_000
    out = {(r.window_us - base) // HOUR_US: r.n for r in spark.read.parquet(f"{tmp_path}/store/windows/batch=1").collect()}
    assert out == {-18: 6, -12: 12, -6: 18, 0: 24, 12: 25, 18: 25, 24: 25, 30: 25}  # those that cover the fifth or the thirtieth hour


def test_days_past_the_lateness_are_evicted(spark, tmp_path):
    store = pipelines.PaneStore(spark, str(tmp_path / "store"), keep_us=0)
    first = [(f"a{i}", BEGIN + timedelta(hours=i), BEGIN + timedelta(hours=i), "x") for i in range(5)]
    store.take(spark.createDataFrame(first, EVENT), 0)
    far = BEGIN + timedelta(days=20)
    store.take(spark.createDataFrame([("b", far, far, "x")], EVENT), 1)
    store.take(spark.createDataFrame([("c", BEGIN + timedelta(hours=1), far + timedelta(hours=1), "x")], EVENT), 2)
    day = int(BEGIN.timestamp()) // 86400
    assert day not in pipelines._names(spark, f"{tmp_path}/store/deliveries", "day")
    got = {(r.pane_us // HOUR_US - day * 24): (r.on_time, r.corrected, r.dropped) for r in store.panes().collect()}
    assert got[1] == (1, 0, 1) and got[0] == (1, 0, 0)
    store.take(spark.createDataFrame([("c", BEGIN + timedelta(hours=1), far + timedelta(hours=1), "x")], EVENT), 2)
    assert {(r.pane_us // HOUR_US - day * 24): (r.on_time, r.corrected, r.dropped) for r in store.panes().collect()} == got


def as_stream(spark, path, batches, schema):
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return pipelines.files(spark, path, schema, 1)


def test_sessions_over_batches(spark, tmp_path):
    r = random.Random(4)
    times = [("u1" if r.random() < 0.6 else "u2", BEGIN + timedelta(minutes=r.randrange(4000))) for _ in range(90)] + [(None, BEGIN), ("u1", None)]
    early, rest = times[::3], times[1::3] + times[2::3]
    stream = as_stream(spark, str(tmp_path / "in"), [rest[:30], early, rest[30:]], "user string, ts timestamp")
    pipelines.sessions(stream, "user", "ts", 60 * 60 * 1_000_000, "10 days", str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted((x.user, x.start_us, x.end_us, x.n) for x in pipelines.latest_sessions(spark, str(tmp_path / "out"), "user").collect())
    want, hour = [], 3_600_000_000
    for u in ("u1", "u2"):
        runs: list[list[int]] = []
        for t in sorted(int(t.timestamp() * 1_000_000) for w, t in times if w == u and t):
            if runs and t < runs[-1][1]:
                runs[-1][1:] = [t + hour, runs[-1][2] + 1]
            else:
                runs.append([t, t + hour, 1])
        want += [(u, *x) for x in runs]
    assert got == sorted(want)


def test_parents_come_late_or_never(spark, tmp_path):
    at = lambda h: BEGIN + timedelta(hours=h)
    batches = [
        [("p1", "c1", False, at(0)), ("p2", "c2", False, at(0)), ("p3", "p3", True, at(1)), ("q", "q1", False, at(1)), ("q", "q2", False, at(1)), ("q", "q3", False, at(1))],
        [("p1", "p1", True, at(5)), ("p3", "c3", False, at(6))],
        [("z", "z", True, at(60))],
        [("p2", "p2", True, at(61)), ("p2", "c4", False, at(62))],
        [("z", "y", False, at(63))],
    ]
    stream = as_stream(spark, str(tmp_path / "in"), batches, "key string, id string, is_parent boolean, at timestamp")
    pipelines.late_parents(stream, str(tmp_path / "out"), str(tmp_path / "log"), most_pending=2)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/*").select("parent", "id", "state").collect()))
    assert got == [("p1", "c1", "accepted"), ("p2", "c2", "expired"), ("p2", "c4", "accepted"), ("p3", "c3", "accepted"), ("q", "q1", "expired"), ("q", "q2", "expired"), ("q", "q3", "refused"), ("z", "y", "accepted")]


def test_ingest_once_over_batches(spark, tmp_path):
    batches = [[("a", dt(2026, 3, 1)), ("b", dt(2026, 3, 1))], [("a", dt(2026, 3, 2)), ("c", dt(2026, 3, 2))], [("b", dt(2026, 3, 2)), ("d", dt(2026, 3, 3))]]
    stream = as_stream(spark, str(tmp_path / "in"), batches, "id string, seen timestamp")
    for _ in range(2):  # the second run finds nothing new
        pipelines.ingest(stream, ["id"], "seen", "30 days", str(tmp_path / "out"), str(tmp_path / "log"))
    rows = spark.read.parquet(f"{tmp_path}/out/*")
    assert sorted(r.id for r in rows.collect()) == ["a", "b", "c", "d"] and rows.agg(F.max("seen")).first()[0] == dt(2026, 3, 3)
