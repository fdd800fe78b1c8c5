"""The bitemporal ledger: which value each slot had when, and when that was believed."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.json_values import canonical_json
from annalist.functions.time import NO_END
from annalist.operators.sweep import by_group, sized, stream_groups
from annalist.operators.timeshards import Cuts, find_cuts, shard_of

SLOT = ("partition_key", "claim_key")
_FIELDS = [("partition_key", "string"), ("claim_key", "string"), ("claim_id", "string"), ("from_us", "bigint"), ("to_us", "bigint"), ("recorded_us", "bigint"), ("replaced_us", "bigint"), ("value", "string"), ("run_from_us", "bigint"), ("run_to_us", "bigint")]
LEDGER = ", ".join(f"{n} {t}" for n, t in _FIELDS)
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in _FIELDS])
_EDGES = [("at_edge", "boolean"), ("run_at_edge", "boolean")]
_LOCAL = pa.schema([(n, _TYPES[t]) for n, t in _FIELDS + _EDGES])
#: Claims that are searched together for what was uncovered.
BLOCK = 256
#: Segments of stronger claims that a claim which can't be seen there passes over together.
SKIP = 256


class Held:
    """The claims known now, by rank, in blocks that know their latest end: finds the strongest below a rank that reaches far enough."""

    def __init__(self) -> None:
        self.blocks: list[list[tuple]] = []
        self.firsts: list[tuple] = []
        self.reach: list[int] = []

    def _block(self, rank: tuple) -> int:
        return max(0, bisect_right(self.firsts, rank) - 1)

    def add(self, claim: tuple) -> None:
        if not self.blocks:
            self.blocks, self.firsts, self.reach = [[claim]], [claim[0]], [claim[2]]
            return
        k = self._block(claim[0])
        block = self.blocks[k]
        insort(block, claim)
        self.firsts[k], self.reach[k] = block[0][0], max(self.reach[k], claim[2])
        if len(block) > 2 * BLOCK:
            halves = [block[:BLOCK], block[BLOCK:]]
            self.blocks[k : k + 1] = halves
            self.firsts[k : k + 1] = [h[0][0] for h in halves]
            self.reach[k : k + 1] = [max(c[2] for c in h) for h in halves]

    def remove(self, rank: tuple) -> None:
        if not self.blocks:
            return
        k = self._block(rank)
        block = self.blocks[k]
        i = bisect_left(block, (rank,))
        if i < len(block) and block[i][0] == rank:
            del block[i]
            if block:
                self.firsts[k], self.reach[k] = block[0][0], max(c[2] for c in block)
            else:
                del self.blocks[k], self.firsts[k], self.reach[k]

    def above(self, rank: tuple) -> Held:
        """Those stronger than rank."""
        out = Held()
        for c in (c for block in self.blocks for c in block if c[0] > rank):
            out.add(c)
        return out

    def below(self, rank: tuple, instant: int) -> tuple | None:
        """The strongest claim weaker than rank that ends after the instant."""
        if not self.blocks:
            return None
        k = self._block(rank)
        for c in reversed(self.blocks[k][: bisect_left(self.blocks[k], (rank,))]):
            if c[2] > instant:
                return c
        for k in range(k - 1, -1, -1):
            if self.reach[k] > instant:
                return next(c for c in reversed(self.blocks[k]) if c[2] > instant)
        return None


class Timeline:
    """What one tile of a slot is believed to hold: disjoint segments in order, changed by inserting and withdrawing claims.

    A claim is (rank, lo, hi, value, dies) with the rank (from_us, version, id); a segment is (start, end, claim, since), the
    longest stretch that its claim holds. A claim that arrives late splits the segments of weaker claims it overlaps. Each segment that
    changes is closed at the instant of the change and what remains of it is opened anew, so no ledger row is ever
    overwritten. What is closed and opened again the same within one instant has not changed.
    """

    def __init__(self, tile_lo: int | None, tile_hi: int | None) -> None:
        self.tile = tile_lo, tile_hi
        self.starts: list[int] = []
        self.segments: list[tuple[int, int, tuple, int]] = []
        self.holders: list[int] = []  # when the claim of each segment starts
        self.gaps: list[int] = []  # between each segment and the one before it
        self.closing: dict[tuple, tuple] = {}
        self.closed: list[tuple] = []
        self.held = Held()
        self.floor: tuple | None = None  # the strongest claim that covers the whole tile and is never withdrawn
        self.now: int | None = None

    def _replace(self, i: int, j: int, fresh: list[tuple]) -> None:
        self.segments[i:j] = fresh
        self.starts[i:j] = [s[0] for s in fresh]
        self.holders[i:j] = [s[2][0][0] for s in fresh]
        end = self.segments[i - 1][1] if i else None
        gaps = []
        for s in fresh:
            gaps.append(0 if end is None else s[0] - end)
            end = s[1]
        self.gaps[i:j] = gaps
        after = i + len(fresh)
        if after < len(self.segments):
            self.gaps[after] = self.starts[after] - end if end is not None else 0

    def _close(self, segment: tuple) -> None:
        if self.now > segment[3]:
            self.closing[segment[2][0], segment[0], segment[1]] = segment

    def _touched(self, lo: int, hi: int) -> tuple[int, int]:
        i = bisect_right(self.starts, lo) - 1
        if i < 0 or self.segments[i][1] <= lo:
            i += 1
        return i, bisect_left(self.starts, hi)

    def move(self, at: int | None) -> None:
        """Time goes on to another instant: what was closed in the last one is settled."""
        if at == self.now:
            return
        for (rank, a, b), segment in self.closing.items():
            i = bisect_left(self.starts, a)
            if i < len(self.starts) and self.starts[i] == a and self.segments[i][1] == b and self.segments[i][2][0] == rank:
                self.segments[i] = segment
            else:
                self.closed.append((*segment, self.now))
        self.closing.clear()
        self.now = at

    def insert(self, claim: tuple) -> None:
        rank, lo, hi, _, dies = claim
        if self.floor is not None and rank < self.floor:
            return  # it will never be seen
        if dies is None and (lo, hi) == self.tile:
            self.floor, self.held = rank, self.held.above(rank)
        i, j = self._touched(lo, hi)
        at = self.now
        k = j  # from k on all segments are of stronger claims, without a gap
        while k - SKIP > i and min(self.holders[k - SKIP : k]) > rank[0] and max(self.gaps[k - SKIP + 1 : min(k + 1, j)], default=0) == 0:
            k -= SKIP
        if k < j:
            end = self.segments[j - 1][1]
            if end < hi:
                self._replace(j, j, [(end, hi, claim, at)])
            j, hi = k, self.starts[k]
        fresh: list[tuple] = []
        reach = lo  # up to here [lo, hi) is settled

        def take(a: int, b: int) -> None:
            if a < b:
                if fresh and fresh[-1][2] is claim and fresh[-1][1] == a:
                    fresh[-1] = (fresh[-1][0], b, claim, at)
                else:
                    fresh.append((a, b, claim, at))

        for segment in self.segments[i:j]:
            start, end, other, _ = segment
            a, b = max(start, lo), min(end, hi)
            take(reach, a)
            if rank > other[0]:
                self._close(segment)
                if start < a:
                    fresh.append((start, a, other, at))
                take(a, b)
                if b < end:
                    fresh.append((b, end, other, at))
            else:
                fresh.append(segment)
            reach = b
        take(reach, hi)
        self._replace(i, j, fresh)
        self.held.add(claim)

    def withdraw(self, rank: tuple, lo: int, hi: int) -> None:
        """The claim was corrected: what it held falls to the strongest claims left, all of which began no later than it."""
        if self.floor is not None and rank < self.floor:
            return
        self.held.remove(rank)
        i, j = self._touched(lo, hi)
        fresh: list[tuple] = []
        for segment in self.segments[i:j]:
            if segment[2][0] != rank:
                fresh.append(segment)
                continue
            self._close(segment)
            x, y = segment[:2]
            while x < y and (other := self.held.below(rank, x)) is not None:
                fresh.append((max(x, other[1]), min(other[2], y), other, self.now))
                x = fresh[-1][1]
        first, last = max(0, i - 1), min(len(self.segments), j + 1)  # neighbours may go on in what was uncovered
        whole: list[tuple] = []
        for s in [*self.segments[first:i], *fresh, *self.segments[j:last]]:
            if whole and whole[-1][2][0] == s[2][0] and whole[-1][1] == s[0]:
                self._close(whole[-1])
                self._close(s)
                whole[-1] = (whole[-1][0], s[1], s[2], self.now)
            else:
                whole.append(s)
        self._replace(first, last, whole)


def _tile_rows(line: Timeline, end: int | None, value: object) -> Iterator[tuple]:
    """The rows that are open when a tile ends: with the runs of equal values if it ends with what is believed now."""
    lo, hi = line.tile
    segments = line.segments
    if end is not None:
        for a, b, claim, since in segments:
            if since < end:
                yield claim[0][2], a, b, since, end, value(claim[3]), None, None, a == lo or b == hi, False
        return
    values = [value(s[2][3]) for s in segments]
    i = 0
    while i < len(segments):
        j = i + 1
        while j < len(segments) and values[j] == values[i] and segments[j][0] == segments[j - 1][1]:
            j += 1
        run = segments[i][0], segments[j - 1][1]
        at_edge = lo is not None and run[0] == lo or hi is not None and run[1] == hi
        for a, b, claim, since in segments[i:j]:
            yield claim[0][2], a, b, since, NO_END, values[i], *run, a == lo or b == hi, at_edge
        i = j


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ledger rows of tiles: each tile's arrivals and withdrawals come in order of recorded time and are forgotten once they can't be seen again."""
    value = lru_cache(50_000)(canonical_json)
    out: list[tuple] = []
    for (partition, name, _, lo, hi, end), steps in stream_groups(batches, 6):
        line = Timeline(lo, hi)
        for step in steps:
            at, adds, rank, a, b = step[6], step[7], step[8:11], step[11], step[12]
            line.move(at)
            if adds:
                line.insert((rank, a, b, step[13], step[14]))
            else:
                line.withdraw(rank, a, b)
            if len(line.closed) > 10_000:
                out += [(partition, name, c[0][2], x, y, since, t, value(c[3]), None, None, x == lo or y == hi, False) for x, y, c, since, t in line.closed]
                line.closed = []
                yield from sized(out, _LOCAL)
                out = []
        line.move(None)
        out += [(partition, name, c[0][2], x, y, since, t, value(c[3]), None, None, x == lo or y == hi, False) for x, y, c, since, t in line.closed]
        out += [(partition, name, *r) for r in _tile_rows(line, end, value)]
        if len(out) >= 20_000:
            yield from sized(out, _LOCAL)
            out = []
    yield from sized(out, _LOCAL)


def ledger(claims: DataFrame, cuts: Cuts | None = None, **hot: int) -> DataFrame:
    """The bitemporal ledger of claims.

    claims has one row per id: id, partition_key, claim_key (the slot), value_json, from_us, to_us (NO_END: none),
    version, created_us (when it became known), supersedes; others are ignored. Gives claim_id, [from_us, to_us) in
    valid time, [recorded_us, replaced_us) in recorded time and the value; replaced_us NO_END marks what is believed now.

    At any recorded instant each moment belongs to the strongest claim known then: latest from_us, then version (null lowest),
    then id. A claim is withdrawn from the instant on at which a claim of its slot with the same from_us that names it in
    supersedes is known. A row is a longest stretch of valid time that one claim holds, for the longest recorded period in which that very
    stretch is held: rows do not depend on how slots are cut for processing. Rows believed now also carry the longest
    unbroken run of one JSON value they belong to, as run_from_us and run_to_us.

    cuts may come from find_cuts over any rows of the same slots. Hot slots are swept in tiles of valid and recorded time,
    see _tiles; rows that touch a tile's edge are stitched. Null slot keys are keys, null values a value, created_us null
    counts as known from the start, ties cannot occur as ids are unique, and an empty table gives an empty ledger.
    """
    rows = claims.select("id", *SLOT, "value_json", "from_us", "to_us", F.coalesce("version", F.lit(-1)).cast("bigint").alias("version"), F.coalesce("created_us", F.lit(-(2**62))).alias("born"), "supersedes")
    named = rows.filter(F.col("supersedes").isNotNull() & (F.col("supersedes") != F.col("id")))
    named = named.groupBy(*(F.col(k).alias(f"_{k}") for k in SLOT), F.col("from_us").alias("_from"), F.col("supersedes").alias("_id")).agg(F.min("born").alias("dies"))
    same = [F.col("id") == F.col("_id"), F.col("from_us") == F.col("_from"), *_equal(SLOT, "_")]
    rows = rows.join(named, same, "left").drop("_id", "_from", *(f"_{k}" for k in SLOT), "supersedes")
    rows = rows.filter("dies IS NULL OR dies > born").withColumn("start_us", F.col("from_us"))
    cuts = cuts or find_cuts(claims, SLOT, ["from_us", "to_us"], **hot)
    tiled = _tiles(rows, cuts)
    step = lambda at, adds: F.struct(F.col(at).alias("at"), F.lit(adds).alias("adds"))
    steps = tiled.withColumn("_s", F.explode(F.when(F.col("dies").isNull(), F.array(step("born", 1))).otherwise(F.array(step("born", 1), step("dies", 0)))))
    keys = [*SLOT, "tile", "tile_lo", "tile_hi", "tile_end"]
    steps = steps.select(*keys, F.col("_s.at").alias("at"), F.col("_s.adds").alias("adds"), "start_us", "version", "id", "from_us", "to_us", "value_json", "dies")
    steps = steps.repartition(*SLOT, "tile").sortWithinPartitions(*keys, "at", "adds")
    made = steps.mapInArrow(_swept, f"{LEDGER}, {', '.join(f'{n} {t}' for n, t in _EDGES)}")
    return made.drop("at_edge", "run_at_edge") if cuts.hot is None else _stitched(_runs_stitched(made))


def _equal(keys: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]


def _tiles(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """rows in tiles: tile, tile_lo, tile_hi (its edges in valid time, null: none), tile_end (in recorded time, null: none).

    A slot that isn't hot is one tile. Of a hot one the shards are put into about as many groups as a group has shards. A group
    through which claims only pass is the same all over; while it is (till the first claim that begins or ends in it
    is known) it is one tile. From then on its shards are tiles of their own, with the claims that begin or end in
    the group, and of those that pass through it just the ones that can still be seen: no weaker than the strongest that
    passed when the group came apart and is never withdrawn. So a claim of n shards is laid out about 2 * sqrt(n) times.
    """
    plain = ["start_us", "version", "id", "value_json"]
    none = F.lit(None).cast("bigint")

    def whole(df: DataFrame) -> DataFrame:
        return df.select(*SLOT, F.lit(0).alias("tile"), none.alias("tile_lo"), none.alias("tile_hi"), none.alias("tile_end"), "from_us", "to_us", "born", "dies", *plain)

    if cuts.hot is None:
        return whole(rows)
    at = cuts.attach(rows).withColumn("_a", shard_of(F.col("from_us"))).withColumn("_b", shard_of(F.col("to_us") - 1))
    hot = at.filter("_cuts IS NOT NULL").withColumn("_g", F.ceil(F.sqrt(F.size("_cuts") + 1)).cast("int"))
    g, cut = F.col("_g"), lambda k: F.get("_cuts", k)
    hot = hot.withColumn("_ua", F.floor(F.col("_a") / g).cast("int")).withColumn("_ub", F.floor(F.col("_b") / g).cast("int"))
    ua, ub = F.col("_ua"), F.col("_ub")

    # when each group comes apart
    apart = hot.select(*(F.col(k).alias(f"_t_{k}") for k in SLOT), F.explode(F.array_distinct(F.array(ua, ub))).alias("_t_u"), "born")
    apart = apart.groupBy(*(f"_t_{k}" for k in SLOT), "_t_u").agg(F.min("born").alias("_apart"))
    passing = hot.filter(ub > ua + 1).withColumn("_u", F.explode(F.sequence(ua + 1, ub - 1)))
    passing = passing.join(apart, [*_equal(SLOT, "_t_"), F.col("_u") == F.col("_t_u")], "left").drop("_t_u", *(f"_t_{k}" for k in SLOT))
    u, end = F.col("_u"), F.col("_apart")
    coarse = passing.filter(end.isNull() | (F.col("born") < end))
    dies = F.when(end.isNull() | (F.col("dies") < end), F.col("dies"))
    edges = [cut(u * g - 1), cut((u + 1) * g - 1)]
    coarse = coarse.select(*SLOT, (-1 - u).alias("tile"), edges[0].alias("tile_lo"), edges[1].alias("tile_hi"), end.alias("tile_end"), edges[0].alias("from_us"), edges[1].alias("to_us"), "born", dies.alias("dies"), *plain)

    strength = F.struct("start_us", "version", "id")
    least = passing.filter(end.isNotNull() & (F.col("born") < end) & F.col("dies").isNull())
    least = least.groupBy(*(F.col(k).alias(f"_t_{k}") for k in SLOT), u.alias("_t_u")).agg(F.max(strength).alias("_least"))
    seen = passing.filter(end.isNotNull() & (F.col("dies").isNull() | (F.col("dies") > end)))
    seen = seen.join(least, [*_equal(SLOT, "_t_"), u == F.col("_t_u")], "left").filter(F.col("_least").isNull() | (strength >= F.col("_least")))
    seen = seen.withColumn("born", F.greatest("born", "_apart")).withColumn("_s", F.explode(F.sequence(u * g, (u + 1) * g - 1)))

    own = F.when(ua == ub, F.sequence("_a", "_b")).otherwise(F.concat(F.sequence(F.col("_a"), (ua + 1) * g - 1), F.sequence(ub * g, F.col("_b"))))
    fine = hot.withColumn("_s", F.explode(own))

    def in_shards(df: DataFrame) -> DataFrame:
        s = F.col("_s")
        lo = F.when(s > F.col("_a"), cut(s - 1)).otherwise(F.col("from_us"))
        hi = F.when(s < F.col("_b"), cut(s)).otherwise(F.col("to_us"))
        return df.select(*SLOT, s.alias("tile"), cut(s - 1).alias("tile_lo"), cut(s).alias("tile_hi"), none.alias("tile_end"), lo.alias("from_us"), hi.alias("to_us"), "born", "dies", *plain)

    return whole(at.filter("_cuts IS NULL")).unionByName(coarse).unionByName(in_shards(fine)).unionByName(in_shards(seen))


def _runs_stitched(made: DataFrame) -> DataFrame:
    """Runs of one value carried over the edges of tiles; only runs that touch an edge move, two a tile at most."""
    runs = made.filter("run_at_edge").groupBy(*SLOT, "run_from_us", "run_to_us").agg(F.min("value").alias("_v"))
    w = Window.partitionBy(*SLOT).orderBy("run_from_us")
    new = (F.lag("run_to_us").over(w) != F.col("run_from_us")) | (F.lag("_v").over(w) != F.col("_v"))
    runs = runs.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy(*SLOT, "_run")
    runs = runs.select(*(F.col(k).alias(f"_{k}") for k in SLOT), F.col("run_from_us").alias("_f"), F.min("run_from_us").over(g).alias("_rf"), F.max("run_to_us").over(g).alias("_rt"))
    both = made.join(runs, [F.col("run_at_edge"), F.col("run_from_us") == F.col("_f"), *_equal(SLOT, "_")], "left")
    return both.withColumn("run_from_us", F.coalesce("_rf", "run_from_us")).withColumn("run_to_us", F.coalesce("_rt", "run_to_us")).select(*made.columns)


def _stitched(made: DataFrame) -> DataFrame:
    """Rows that touch the edges of tiles, put together again: one pass over each claim's openings and closings.

    Of a claim only the stretches it holds at one instant are kept, so a claim seen in very many rows needs no more memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, steps in stream_groups(batches, 3):
            starts: list[int] = []
            held: dict[int, tuple[int, int]] = {}  # start: end, since
            lasting: dict[int, tuple[int, int]] = {}
            closing: dict[tuple[int, int], int] = {}
            now = value = None

            def drop(start: int) -> int:
                end, since = held.pop(start)  # noqa: B023
                starts.pop(bisect_left(starts, start))  # noqa: B023
                if since < now:  # noqa: B023
                    closing[start, end] = since  # noqa: B023
                return end

            def hold(start: int, end: int) -> None:
                insort(starts, start)  # noqa: B023
                held[start] = end, now  # noqa: B023

            def settle() -> None:
                for (a, b), since in closing.items():  # noqa: B023
                    if held.get(a, (None,))[0] == b:  # noqa: B023
                        held[a] = b, since  # noqa: B023
                    else:
                        out.append((*key, a, b, since, now, value, None, None))  # noqa: B023
                closing.clear()  # noqa: B023

            for at, opens, a, b, v, lasts, rf, rt in (s[3:] for s in steps):
                if at != now:
                    settle()
                    now, value = at, v
                if not opens:
                    start = starts[bisect_right(starts, a) - 1]
                    end = drop(start)
                    if start < a:
                        hold(start, a)
                    if b < end:
                        hold(b, end)
                    continue
                if lasts:
                    lasting[a] = rf, rt
                i = bisect_left(starts, a)
                if i and held[starts[i - 1]][0] == a:
                    a = starts[i - 1]
                    drop(a)
                if b in held:
                    b = drop(b)
                hold(a, b)
                if len(out) >= 20_000:
                    yield from sized(out, _ARROW)
                    out = []
            settle()
            out += [(*key, a, b, since, NO_END, value, *lasting[a]) for a, (b, since) in held.items()]
            if len(out) >= 20_000:
                yield from sized(out, _ARROW)
                out = []
        yield from sized(out, _ARROW)

    keys = [*SLOT, "claim_id"]
    lasts = F.col("replaced_us") == NO_END
    step = lambda at, opens: F.struct(F.col(at).alias("at"), F.lit(opens).alias("opens"))
    steps = made.filter("at_edge").withColumn("_s", F.explode(F.when(lasts, F.array(step("recorded_us", 1))).otherwise(F.array(step("recorded_us", 1), step("replaced_us", 0)))))
    steps = steps.select(*keys, "_s.at", "_s.opens", "from_us", "to_us", "value", lasts.alias("lasts"), "run_from_us", "run_to_us")
    whole = by_group(steps, keys, ["at", "opens", "from_us"]).mapInArrow(run, LEDGER)
    return made.filter("NOT coalesce(at_edge, false)").drop("at_edge", "run_at_edge").unionByName(whole)


def value_periods(made: DataFrame) -> DataFrame:
    """Of a ledger, one row for each longest period of one value believed now: claim_id is the claim at its start."""
    return made.filter((F.col("replaced_us") == NO_END) & (F.col("from_us") == F.col("run_from_us"))).select(*SLOT, "claim_id", "from_us", F.col("run_to_us").alias("to_us"))
