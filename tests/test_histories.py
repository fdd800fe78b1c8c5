"""The temporal operators against brute force, with and without hot keys, and their edge cases."""

import random

import pytest

from annalist.functions.json_values import canonical_json
from annalist.functions.time import NO_END
from annalist.operators.asof import as_known
from annalist.operators.coverage import coverage
from annalist.operators.ledger import ledger, value_periods
from annalist.operators.panes import deliveries, pane_counts, pane_revisions, slice_panes, windows_of_panes

CLAIM = "id string, partition_key string, claim_key string, value_json string, from_us bigint, to_us bigint, version int, created_us bigint, supersedes string, shard string"


def some_claims(seed: int, n: int = 160) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        lo = r.randrange(60)
        hi = NO_END if r.random() < 0.2 else lo + r.randrange(1, 40)
        out.append((f"c{i:03}", r.choice(["a", "a", "a", "b", None]), r.choice(["k", None]), r.choice(["1", "1.0", '"x"', None, "no json", '{"a":1,"b":2}', '{"b": 2.0, "a": 1}']), lo, hi, r.choice([None, 1, 2, 2]), r.randrange(50), f"c{r.randrange(n):03}" if r.random() < 0.5 else None, "extra"))
    return out


def corrections(claims: list[tuple], now: int | None) -> dict[str, int]:
    at: dict[str, int] = {}
    for c in claims:
        for x in claims:
            if c[8] == x[0] and c[0] != x[0] and c[1:3] == x[1:3] and c[4] == x[4]:
                at[x[0]] = min(at.get(x[0], NO_END), c[7])
    return at


def believed(claims: list[tuple], moment: int, recorded: int) -> dict[tuple, tuple]:
    """Per slot the strongest claim at a moment as known at an instant."""
    at = corrections(claims, recorded)
    out: dict[tuple, tuple] = {}
    for c in claims:
        if c[7] <= recorded and at.get(c[0], NO_END) > recorded and c[4] <= moment < c[5]:
            slot, rank = c[1:3], (c[4], -1 if c[6] is None else c[6], c[0])
            if slot not in out or rank > out[slot][0]:
                out[slot] = (rank, c)
    return {k: v[1] for k, v in out.items()}


@pytest.mark.parametrize(("seed", "hot"), [(1, 10**6), (2, 10**6), (3, 10), (4, 10), (5, 10)])
def test_ledger_is_what_was_believed(spark, seed, hot):
    claims = some_claims(seed)
    rows = ledger(spark.createDataFrame(claims, CLAIM), hot_rows=hot, shards=5).collect()
    for recorded in range(-1, 52, 3):
        for moment in range(0, 110, 7):
            want = {k: c[0] for k, c in believed(claims, moment, recorded).items()}
            holds = [r for r in rows if r.recorded_us <= recorded < r.replaced_us and r.from_us <= moment < r.to_us]
            assert len(holds) == len({(r.partition_key, r.claim_key) for r in holds})
            assert {(r.partition_key, r.claim_key): r.claim_id for r in holds} == want


def longest_rows(claims: list[tuple]) -> list[tuple]:
    """The ledger by brute force over every recorded instant: (slot, claim, from, to, recorded, replaced)."""
    at = corrections(claims, None)
    ticks = sorted({c[7] for c in claims} | set(at.values()))
    rows, open_rows = [], {}
    for tick in ticks:
        held = {}
        for slot in {c[1:3] for c in claims}:
            stretch = None
            for m in range(111):
                c = max((c for c in claims if c[1:3] == slot and c[7] <= tick < at.get(c[0], NO_END) and c[4] <= m < c[5]), key=lambda c: (c[4], -1 if c[6] is None else c[6], c[0]), default=None)
                if stretch and (c is None or stretch[0] != c[0]):
                    held[(*slot, stretch[0], stretch[1], m)] = tick
                    stretch = None
                if c and not stretch:
                    stretch = (c[0], m)
            if stretch:
                held[(*slot, stretch[0], stretch[1], NO_END)] = tick
        rows += [(*k, since, tick) for k, since in open_rows.items() if k not in held]
        open_rows = {k: open_rows.get(k, tick) for k in held}
    return rows + [(*k, since, NO_END) for k, since in open_rows.items()]


@pytest.mark.parametrize("seed", [1, 4, 8])
def test_ledger_rows_do_not_depend_on_tiles(spark, seed):
    claims = some_claims(seed, 90)
    want = sorted(map(repr, longest_rows(claims)))
    columns = ["partition_key", "claim_key", "claim_id", "from_us", "to_us", "recorded_us", "replaced_us"]
    runs = []
    for how in ({"hot_rows": 10**6}, {"hot_rows": 3}, {"hot_rows": 8}, {"hot_rows": 10, "shards": 30}):
        rows = ledger(spark.createDataFrame(claims, CLAIM), **how)
        got = [tuple(r) for r in rows.select(*columns, "run_from_us", "run_to_us").collect()]
        assert sorted(repr(r[:7]) for r in got) == want, how
        runs.append(sorted(map(repr, got)))
    assert all(r == runs[0] for r in runs)


@pytest.mark.parametrize("seed", range(8))
def test_timeline_in_steps(monkeypatch, seed):
    """A timeline that passes over segments two at a time, and holds claims in blocks of two, against brute force."""
    from annalist.operators import ledger as module

    monkeypatch.setattr(module, "SKIP", 2)
    monkeypatch.setattr(module, "BLOCK", 2)
    r = random.Random(seed)
    claims = [((lo := r.randrange(60), r.randrange(3), f"c{i:03}"), lo, r.choice([NO_END, lo + r.randrange(1, 12)]), "v", r.choice([None, None, 1])) for i in range(70)]
    line, live = module.Timeline(None, None), []
    for n, c in enumerate(claims):
        line.move(n)
        line.insert((*c[:4], c[4]))
        live.append(c)
        if r.random() < 0.2:
            gone = live.pop(r.randrange(len(live)))
            line.withdraw(gone[0], gone[1], gone[2])
        line.move(n + 0.5)
        for m in range(75):
            want = max((x for x in live if x[1] <= m < x[2]), default=None)
            got = [s[2][0] for s in line.segments if s[0] <= m < s[1]]
            assert got == ([want[0]] if want else [])
        assert line.starts == [s[0] for s in line.segments] and line.holders == [s[2][0][0] for s in line.segments]
        assert line.gaps[1:] == [b[0] - a[1] for a, b in zip(line.segments, line.segments[1:])]
        assert all(a[1] < b[0] or a[2] is not b[2] for a, b in zip(line.segments, line.segments[1:]))


@pytest.mark.parametrize(("seed", "hot"), [(1, 10**6), (2, 10**6), (3, 10), (6, 10), (7, 20)])
def test_value_periods(spark, seed, hot):
    claims = some_claims(seed)
    want = []
    by_moment = [believed(claims, m, NO_END - 1) for m in range(111)]
    for slot in {c[1:3] for c in claims}:
        held = [by[slot] if slot in by else None for by in by_moment]
        value = [None if c is None else canonical_json(c[3]) for c in held]
        start = 0
        for m in range(1, 111):
            if value[m] != value[m - 1]:
                if value[m - 1] is not None:
                    want.append((*slot, held[start][0], start, m))
                start = m
        if value[110] is not None:
            want.append((*slot, held[start][0], start, NO_END))
    got = value_periods(ledger(spark.createDataFrame(claims, CLAIM), hot_rows=hot, shards=5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize(("seed", "hot"), [(1, 10**6), (2, 10), (3, 10), (4, 3)])
def test_coverage(spark, seed, hot):
    claims = [c for c in some_claims(seed, 60 if seed < 4 else 25)] + [("z", "a", "k", None, None, 5, 1, 0, None, ""), ("y", "a", "k", None, 5, 5, 1, 0, None, "")]
    got = coverage(spark.createDataFrame(claims, CLAIM), ("partition_key", "claim_key"), "from_us", "to_us", hot_rows=hot, shards=6).collect()
    want = []
    for slot in {c[1:3] for c in claims}:
        runs: list[list[int]] = []
        for lo, hi in sorted(c[4:6] for c in claims if c[1:3] == slot and c[4] is not None and c[4] < c[5]):
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], hi)
            else:
                runs.append([lo, hi])
        want += [(*slot, "period", *r) for r in runs] + [(*slot, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize(("seed", "hot", "period"), [(1, 10**6, 10), (2, 10**6, 1000), (3, 10, 7), (4, 10, 25)])
def test_as_known(spark, seed, hot, period):
    claims = [c for c in some_claims(seed) if c[0] != "c007"] + [("c007", "a", "k", "1", 3, 90, 1, None, None, "")]
    r = random.Random(seed)
    events = [(f"e{i}", r.choice(["a", "b", None]), r.choice(["k", "none"]), r.choice([None, *range(120)])) for i in range(150)]
    versions = spark.createDataFrame(claims, CLAIM).selectExpr("*", "from_us AS strong_1", "version AS strong_2")
    asked = spark.createDataFrame(events, "event_id string, partition_key string, claim_key string, at_us bigint")
    got = as_known(asked, versions, ("partition_key", "claim_key"), period, hot_rows=hot, shards=4).collect()
    want = []
    for e, p, k, at in events:
        seen = [c for c in claims if p is not None and at is not None and c[1:3] == (p, k) and (c[7] is None or c[7] <= at) and c[4] <= at < c[5]]
        if seen:
            want.append((e, max(seen, key=lambda c: (c[4], -1 if c[6] is None else c[6], c[0]))[0]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], CLAIM)
    keys = ("partition_key", "claim_key")
    assert ledger(none).count() == coverage(none, keys, "from_us", "to_us").count() == 0
    versions = none.selectExpr("*", "from_us AS strong_1", "version AS strong_2")
    events = spark.createDataFrame([], "event_id string, partition_key string, claim_key string, at_us bigint")
    assert as_known(events, versions, keys).count() == 0


def test_late_events(spark):
    from datetime import datetime as dt

    rows = [
        ("a", dt(2026, 3, 1, 10, 30), dt(2026, 3, 1, 10, 59, 59, 999999), "x"),
        ("a", dt(2026, 3, 1, 10, 30), dt(2026, 3, 1, 12), "x"),  # delivered again
        ("b", dt(2026, 3, 1, 10, 30), dt(2026, 3, 1, 11), "x"),
        ("c", dt(2026, 3, 1, 10, 0), dt(2026, 3, 3, 11), "x"),  # 48 hours after the end still counts
        ("d", dt(2026, 3, 1, 10, 0), dt(2026, 3, 3, 11, 0, 0, 1), None),
        ("e", dt(2026, 3, 1, 12), dt(2026, 3, 1, 9), "x"),  # before it happened
        (None, dt(2026, 3, 1, 12), dt(2026, 3, 1, 9), "x"),
        ("f", None, dt(2026, 3, 1, 9), "x"),
    ]
    events = spark.createDataFrame(rows, "id string, occurred_at timestamp_ntz, ingested_at timestamp_ntz, event_type string")
    sliced = slice_panes(deliveries(events))
    assert {r.id: r.outcome for r in sliced.collect()} == {"a": "on_time", "b": "corrected", "c": "corrected", "d": "dropped", "e": "on_time"}
    counts = {(r.pane_us // 3_600_000_000 % 24, r.key): (r.on_time, r.corrected, r.dropped) for r in pane_counts(sliced).collect()}
    assert counts == {(10, "x"): (1, 2, 0), (10, None): (0, 0, 1), (12, "x"): (1, 0, 0)}
    out = windows_of_panes(pane_revisions(sliced), 2 * 3_600_000_000, 3_600_000_000).collect()
    at_ten = sorted((r.revision, r.n) for r in out if r.window_us // 3_600_000_000 % 24 == 10 and r.key == "x")
    assert at_ten == [(0, 2), (1, 3)]  # the window ends at 12: b came before that


def test_json_values():
    same = [["7200", "7200.00", "72e2", " 7.2E+3 "], ['{"a":1,"b":[true,null]}', '{"b": [true, null], "a": 1.0}'], ['"\\u9701"', '"霁"'], ["0", "-0.0"], ["null"], [None], ["nonsense"], ['"7200"'], ["true"], ["1"], ["NaN"], ["[" * 5000]]
    keys = [{canonical_json(x) for x in group} for group in same]
    assert all(len(k) == 1 for k in keys) and len(set.union(*keys)) == len(same)
