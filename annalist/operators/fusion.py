"""Combining ranked candidates: rank fusion, interleaving, quotas and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.ranks import numbered
from annalist.operators.sweep import by_group, stream_groups

# The constant of reciprocal rank fusion, and the weights of a lexical and a semantic rank.
RRF_K = 60
LEXICAL, SEMANTIC = 0.35, 0.65
# How many items of a kind, of one source and in all a selection may have.
KIND_QUOTA = {"event": 4, "claim": 4, "block": 4, "episode": 3, "procedure": 2, "latent": 1}
SOURCE_QUOTA, MOST_ITEMS = 2, 8


def reciprocal_ranks(ranked: DataFrame, group: list[str], item: str, rank: str = "rank", k: int = RRF_K) -> DataFrame:
    """Sum over branches of 1 / (k + rank) for each item of a group."""
    return ranked.groupBy(*group, item).agg(F.sum(1 / (k + F.col(rank))).alias("score"), F.count("*").alias("branches"))


def fuse(candidates: DataFrame, group: list[str], item: str, agree: list[str], k: int = RRF_K) -> DataFrame:
    """Fusion of candidates (group, item, method, rank, evidence array, agree columns) that excludes contradictions.

    Of one method the best rank counts; an item whose rows disagree in any agree column is left out; evidence is united.
    """
    per_method = candidates.groupBy(*group, item, "method").agg(F.min("rank").alias("rank"), F.min(F.struct(*agree)).alias("_lo"), F.max(F.struct(*agree)).alias("_hi"), F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("evidence"))
    out = per_method.groupBy(*group, item).agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count("*").alias("methods"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return out.filter(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*group, item, "score", "methods", "evidence", *(F.col(f"_lo.{c}").alias(c) for c in agree))


def weighted_rank_score(lexical_rank: Column, semantic_rank: Column, k: int = RRF_K) -> Column:
    """Two competition ranks as one score."""
    return (LEXICAL / (k + lexical_rank) + SEMANTIC / (k + semantic_rank)) / (LEXICAL + SEMANTIC)


def interleaved(candidates: DataFrame, group: list[str], kind: str, order: list[Column], limit: int | None = None, **hot: int) -> DataFrame:
    """Candidates in turns of their kinds: the best of each kind, then the second of each, ...; score 1 / (60 + turn)."""
    out = numbered(candidates, [*group, kind], order, "turn", **hot)
    out = numbered(out, group, ["turn", kind], "position", **hot)
    out = out.withColumn("score", 1 / (RRF_K + F.col("turn")))
    return out if limit is None else out.filter(F.col("position") <= limit)


def source_rounds(candidates: DataFrame, source: str, order: list[Column], tie: list[Column], **hot: int) -> DataFrame:
    """Rounds over sources: the best row of each source, sources by their best, then the second of each, ..."""
    ranked = numbered(candidates, [source], order, "round", **hot)
    best = numbered(ranked.filter("round = 1"), [], [*order, *tie], "source_rank", **hot).select(F.col(source).alias("_s"), "source_rank")
    return ranked.join(best, F.col(source) == F.col("_s")).drop("_s")


def greedy(items: DataFrame, group: list[str], columns: list[str], schema: str, choose: object) -> DataFrame:
    """Order-dependent selection per group: choose gets a group's rows (tuples of columns) and gives the rows kept.

    For selections in which a refused row uses up nothing, so that no window frame can express them. columns must
    contain id and score; rows come by falling score, then id, sorted by Spark, and are streamed, so a choice that keeps
    only what it has chosen needs no more memory for a huge group than for a small one.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in stream_groups(batches, len(group)):
            kept = [(*key, *r) for r in choose(r[len(group) :] for r in rows)]
            if kept:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in kept], schema=_arrow(schema))

    return by_group(items.select(*group, *columns), group, [F.desc("score"), F.col("id")]).mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")])


def diverse(rows: Iterator[tuple]) -> list[tuple]:
    """(id, kind, score, source) kept in order while total, kind and source have room."""
    out, kinds, sources = [], {}, {}
    for r in rows:
        if len(out) == MOST_ITEMS:
            break
        if kinds.get(r[1], 0) < KIND_QUOTA.get(r[1], MOST_ITEMS) and sources.get(r[3], 0) < SOURCE_QUOTA:
            kinds[r[1]] = kinds.get(r[1], 0) + 1
            sources[r[3]] = sources.get(r[3], 0) + 1
            out.append((r[0], len(out) + 1))
    return out


def within_budget(budget: int) -> object:
    """(id, score, size) kept in order if they still fit; one that doesn't fit uses up nothing."""

    def choose(rows: Iterator[tuple]) -> list[tuple]:
        out, used = [], 0
        for name, _, size in rows:
            if used + size <= budget:
                used += size
                out.append((name, len(out) + 1, used))
        return out

    return choose


# What coverage, novelty, a missing topic, a repeated topic, a new source, an overlap and tokens weigh in packing, and how far
# below the most relevant item one may be to compete with it.
COVERAGE, NOVELTY, TOPIC, REPETITION, NEW_SOURCE, OVERLAP, COST, FRONTIER = 0.01, 0.01, 0.08, 0.08, 0.005, 0.03, 0.10, 0.12


def uncovered(span: tuple[int, int], chosen: list[tuple[int, int]]) -> int:
    """How many characters of a span no chosen span has; 0 if it lies within their union."""
    left, at = 0, span[0]
    for a, b in sorted(chosen):
        if b <= at:
            continue
        if a >= span[1]:
            break
        left += max(0, min(a, span[1]) - at)
        at = max(at, b)
    return left + max(0, span[1] - at)


def evidence_pack(budget: int, most: int = MOST_ITEMS) -> object:
    """(id, score, size, owner, lo, hi, source, terms, needs): the evidence that fits a budget of tokens, for one query.

    terms are the query's terms the item has (a blank-separated string), [lo, hi) is the part of its owner's text it shows, needs
    is an item that must come along, or null. Step by step, of the items whose relevance (score, from 0 to 1) is within
    FRONTIER of the best left, the one is taken that gains the most: relevance, and a little for the terms it has, for
    those that are new, for its share of the query's terms still missing and for a new source; less for terms
    that one chosen item has already, for text that is shown already, and, where not all of the leading items
    fit, for its tokens against what is left per place. An item comes together with what it needs, as one
    unit, and not at all if they don't fit or what it needs isn't there. What the union of chosen parts of its owner shows already
    is left out. Gives id, position and the tokens used up to there. Nothing is cut off before it is weighed.
    """

    def choose(stream: Iterator[tuple]) -> list[tuple]:
        rows: dict[str, tuple] = {}
        for r in stream:
            rows.setdefault(r[0], (*r[:7], frozenset(r[7].split()), r[8]))
        if not rows:
            return []
        low = min(0.0, *(r[1] for r in rows.values()))
        span = max(r[1] for r in rows.values()) - low or 1.0
        asked = frozenset().union(*(r[7] for r in rows.values()))
        order = sorted(rows.values(), key=lambda r: (-r[1], r[0]))
        tight = sum(r[2] for r in order[:most]) > budget
        seen: set[str] = set()
        sources: set[str] = set()
        shown: dict[str, list[tuple[int, int]]] = {}
        chosen: list[tuple] = []
        taken: set[str] = set()
        used = 0

        def gain(r: tuple) -> float:
            share = (budget - used) / max(1, most - len(chosen))
            fresh = len(r[7] - seen)
            repeated = max((len(r[7] & c[7]) / max(1, len(r[7])) for c in chosen), default=0.0)
            width = max(1, r[5] - r[4])
            overlap = 1 - uncovered((r[4], r[5]), shown.get(r[3], [])) / width
            return (
                (r[1] - low) / span + COVERAGE * len(r[7]) / max(1, len(asked)) + NOVELTY * fresh / max(1, len(asked)) + TOPIC * fresh / max(1, len(asked - seen))
                - REPETITION * repeated + NEW_SOURCE * (r[6] not in sources) - OVERLAP * overlap - (COST * min(1.0, r[2] / max(1.0, share)) if tight else 0.0)
            )

        def unit(r: tuple) -> list[tuple] | None:
            """The item and what it needs, in that order, without what is chosen; None if something is missing or needs itself."""
            out, at = [], r
            while at[0] not in taken:
                if at in out:
                    return None
                out.append(at)
                if at[8] is None:
                    break
                at = rows.get(at[8])
                if at is None:
                    return None
            return [x for x in out if uncovered((x[4], x[5]), shown.get(x[3], []))]

        waiting = list(order)
        while waiting and len(chosen) < most:
            best, best_key, units = None, None, {}
            top = None
            for r in waiting:
                if top is not None and (r[1] - low) / span < top - FRONTIER:
                    break
                members = unit(r)
                if not members or len(chosen) + len(members) > most or used + sum(x[2] for x in members) > budget:
                    continue
                if top is None:
                    top = (r[1] - low) / span
                key = (-gain(r), r[0])
                if best_key is None or key < best_key:
                    best, best_key, units = r, key, members
            if best is None:
                break
            for x in units:
                used += x[2]
                chosen.append(x)
                taken.add(x[0])
                seen |= x[7]
                sources.add(x[6])
                shown.setdefault(x[3], []).append((x[4], x[5]))
            waiting = [r for r in waiting if r[0] not in taken]
        total, out = 0, []
        for n, x in enumerate(chosen, 1):
            total += x[2]
            out.append((x[0], n, total))
        return out

    return choose


def merged_routes(shares: dict[str, int], limit: int) -> object:
    """(id, score, route): items of several routes in turns of shares (as 3 literal, 1 probe), each id once.

    A route that has run out lends its turns to the others; rows come by falling score, so each route is in its own order.
    """

    def choose(rows: Iterator[tuple]) -> list[tuple]:
        queues: dict[str, list[str]] = {r: [] for r in shares}
        for name, _, route in rows:
            if route in queues and len(queues[route]) < 2 * limit:  # repeats of the other routes may take as many
                queues[route].append(name)
        for q in queues.values():
            q.reverse()
        seen: set[str] = set()
        out: list[tuple] = []
        while len(out) < limit and any(queues.values()):
            for route, share in shares.items():
                taken = 0
                while queues[route] and taken < share and len(out) < limit:
                    name = queues[route].pop()
                    if name not in seen:
                        seen.add(name)
                        out.append((name, len(out) + 1, route))
                        taken += 1
        return out

    return choose


def contained(spans: DataFrame, keys: list[str], lo: str, hi: str, ident: str) -> DataFrame:
    """Spans that lie within another span of their keys (of equal ones all but the least ident), as one running maximum."""
    w = Window.partitionBy(*keys).orderBy(F.col(lo), F.desc(hi), F.col(ident)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max(hi).over(w)).filter(F.col(hi) <= F.col("_reach")).drop("_reach")


def covered_by_union(targets: DataFrame, shown: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Targets every part of which lies in the union of the shown spans of their keys; touching spans are one.

    The shown spans are merged first; then the merged span that begins last at or before a target decides, found in one
    ordered pass over both. Spans and targets with a null bound or no length are left out.
    """
    from annalist.operators.coverage import coverage

    merged = coverage(shown, tuple(keys), lo, hi).filter("kind = 'period'").select(*keys, F.col("from_us").alias("_at"), F.col("to_us").alias("_end"), F.lit(0).alias("_target"), *(F.lit(None).cast(t).alias(c) for c, t in targets.dtypes if c not in keys))
    asked = targets.filter(F.col(lo) < F.col(hi)).withColumn("_at", F.col(lo).cast("bigint")).withColumn("_end", F.lit(None).cast("bigint")).withColumn("_target", F.lit(1))
    w = Window.partitionBy(*keys).orderBy("_at", "_target").rowsBetween(Window.unboundedPreceding, 0)
    both = merged.unionByName(asked).withColumn("_reach", F.last("_end", True).over(w))
    return both.filter((F.col("_target") == 1) & (F.col(hi) <= F.col("_reach"))).select(*targets.columns)


def complete_groups(members: DataFrame, alive: DataFrame, group: str, item: str) -> DataFrame:
    """Groups all of whose items are alive, where an item also dies with any of its groups, until nothing more dies."""
    from annalist.session import written

    links = members.select(group, item).distinct()
    living = links.select(item).distinct().join(alive.select(item).distinct(), item, "left_semi")
    before = -1
    while True:
        broken = links.join(living, item, "left_anti").select(group).distinct()
        dead = links.join(broken, group, "left_semi").select(item).distinct()
        living = written(living.join(dead, item, "left_anti"), "living")
        n = living.count()
        if n == before:
            break
        before = n
    return links.select(group).distinct().join(links.join(living, item, "left_anti").select(group).distinct(), group, "left_anti")


def halvings(length: Column, least: int = 64, most: int = 13) -> Column:
    """Widths of the variants of a text: its length, half of it, a quarter, ... as long as they are at least ``least``."""
    widths = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(length / F.pow(F.lit(2.0), i)).cast("int"))
    return F.filter(widths, lambda x: x >= F.least(F.lit(least), length))
