"""Graphs as edge tables: expansion, closure, inference, components, validity. No round collects more than a count."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.ranks import in_ranges, largest_group
from annalist.operators.sweep import by_group, sized, stream_groups
from annalist.operators.timeshards import HOT_ROWS
from annalist.session import written


def neighbours(edges: DataFrame, frontier: DataFrame, direction: str = "both") -> DataFrame:
    """One hop from each node of the frontier (node): node, predicate, neighbour, direction."""
    out = frontier.join(edges, F.col("node") == F.col("subject")).select("node", "predicate", F.col("object").alias("neighbour"), F.lit("out").alias("direction"))
    into = frontier.join(edges, F.col("node") == F.col("object")).select("node", "predicate", F.col("subject").alias("neighbour"), F.lit("in").alias("direction"))
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def reachable(edges: DataFrame, roots: DataFrame, most_depth: int | None = None, cut_every: int = 2) -> DataFrame:
    """root, node, depth: every node that follows from a root along src -> dst, at its least depth (the root itself at 0).

    Breadth first, one join a round; nodes seen before do not go on, so cycles end. Ends when a round finds nothing, or
    at most_depth if the caller wants no deeper nodes.
    """
    seen = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0))
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).distinct()
    if most_depth is None:
        step = written(step, "step")
    frontier, depth = seen, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        found = frontier.join(step, "node").select("root", F.col("_next").alias("node")).distinct()
        frontier = found.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if depth % cut_every == 0 or depth == most_depth:
            frontier = written(frontier, "frontier")
            seen = written(seen.unionByName(frontier), "seen")
            if frontier.limit(1).count() == 0:
                break
        else:
            seen = seen.unionByName(frontier)
    return seen


def closure(edges: DataFrame, roots: DataFrame, cut_every: int = 16) -> DataFrame:
    """node, depth: every node that follows from any of the roots (node) along src -> dst, at its least depth, until nothing new is found.

    One search from all roots at once, so a node is kept once, however many roots it follows from. Nodes seen before do
    not go on, so cycles end; null nodes and edges with a null end lead nowhere. A round joins only what the last one found.
    """
    step = written(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("node"), F.col("dst").alias("_next")).distinct(), "step")
    frontier = seen = written(roots.select("node").filter("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "frontier")
    depth = 0
    while True:
        depth += 1
        found = frontier.join(step, "node").select(F.col("_next").alias("node")).distinct()
        frontier = written(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % cut_every == 0:
            seen = written(seen, "seen")


def paths(edges: DataFrame, roots: DataFrame, most_depth: int, most_nodes: int | None = None) -> DataFrame:
    """root, node, depth, path: a shortest path from each root to each node within most_depth steps of it.

    edges: src, predicate, dst. A path alternates nodes and predicates; of the shortest ones it is the one with the least
    last edge, then the least before it. With most_nodes only so many nodes of a root are kept, nearest first, then by
    name: the budget of a traversal, taken as its result grows, a feature of the caller's question and not a bound on the data.
    """
    step = edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("node"), "predicate", F.col("dst").alias("_next")).distinct()
    seen = roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)).withColumn("path", F.array("node"))
    frontier = seen
    for depth in range(1, most_depth + 1):
        found = frontier.join(step, "node").select("root", F.col("_next").alias("_n"), F.struct("node", "predicate", "path").alias("_last"))
        found = found.groupBy("root", F.col("_n").alias("node")).agg(F.min("_last").alias("_last"))
        found = found.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = found.select("root", "node", F.lit(depth).alias("depth"), F.concat("_last.path", F.array("_last.predicate", "node")).alias("path"))
        frontier = written(frontier, "frontier")
        seen = seen.unionByName(frontier)
        if frontier.limit(1).count() == 0:
            break
    if most_nodes is None:
        return seen
    nearest = Window.partitionBy("root").orderBy("depth", "node")
    return seen.withColumn("_k", F.row_number().over(nearest)).filter(F.col("_k") <= most_nodes).drop("_k")


def chain_rule(facts: DataFrame, left: str, right: str, head: str) -> DataFrame:
    """left(a, b) and right(b, c) give head(a, c), until nothing new follows; facts: subject, predicate, object, confidence,
    valid_from, valid_to. A derived fact holds where both do, with the lesser confidence; of several derivations of one
    fact the one that is surest counts, of equals the earliest. A head that is left or right itself goes on deriving; only
    facts that are new in a round are joined in the next.
    """
    fact = ["subject", "predicate", "object"]
    known = written(facts.select(*fact, "confidence", "valid_from", "valid_to"), "known")
    derived, fresh = None, known
    while True:
        made = None
        for lefts, rights in ((fresh, known), (known, fresh)) if derived is not None else ((known, known),):
            a, b = lefts.filter(F.col("predicate") == left).alias("l"), rights.filter(F.col("predicate") == right).alias("r")
            both = a.join(b, F.col("l.object") == F.col("r.subject"))
            start, end = F.greatest("l.valid_from", "r.valid_from"), F.least("l.valid_to", "r.valid_to")
            both = both.select("l.subject", F.lit(head).alias("predicate"), F.col("r.object").alias("object"), F.least("l.confidence", "r.confidence").alias("confidence"), start.alias("valid_from"), end.alias("valid_to"))
            made = both if made is None else made.unionByName(both)
        made = made.filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
        best = made.groupBy(*fact).agg(F.min(F.struct((-F.col("confidence")).alias("s"), "valid_from", "valid_to", "confidence")).alias("b"))
        best = best.select(*fact, "b.confidence", "b.valid_from", "b.valid_to")
        fresh = written(best.join(known.select(*fact), fact, "left_anti"), "derived")
        if fresh.limit(1).count() == 0:
            break
        derived = fresh if derived is None else derived.unionByName(fresh)
        if head not in (left, right):
            break  # nothing derived can be a side again
        known = written(known.unionByName(fresh), "known")
    return derived if derived is not None else known.limit(0)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of an undirected graph of a and b, by alternating large and small stars.

    Each round links every node's greater neighbours to its least neighbour, then its lesser ones, until a round changes
    nothing; the number of rounds grows with the logarithm of the graph. A node of very many neighbours is one group of an
    aggregate, not a list. Rounds in which no link was changed are told by their count and an order-free digest.
    """
    links = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node IS NOT NULL").distinct()
    links = written(links, "links")

    def stars(links: DataFrame) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        return large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()

    before = None
    while True:
        links = written(stars(stars(links)), "links")  # lineage is cut every second round
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("v", "u"))).collect()[0])
        if now == before:
            break
        before = now
    return alone.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def valid_from_roots(nodes: DataFrame, needs: DataFrame, cut_every: int = 3) -> DataFrame:
    """id, valid: valid if all it needs is (needs: id, parent); what needs a missing node or is on a cycle never becomes so.

    Lines of nodes with one need each are halved by pointer jumping, in rounds that grow with the logarithm of their
    length. Then the least fixpoint, from nodes without needs on, until a count shows that nothing was added.
    """
    links = needs.select("id", "parent").distinct().join(nodes.select("id").distinct(), "id", "left_semi")
    links = written(links.withColumn("_all", F.count("*").over(Window.partitionBy("id"))), "needs")
    line = links.filter("_all = 1").select("id", "parent")
    before = -1
    while True:
        further = line.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        line = written(line.join(further, "parent", "left").select("id", F.coalesce("_next", "parent").alias("parent")), "lines")
        n = line.join(line.select(F.col("id").alias("parent")), "parent", "left_semi").count()
        if n in (0, before):
            break  # what is left is on cycles or leads to one
        before = n
    ends = line.select(F.col("id").alias("parent"), F.col("parent").alias("_end"))
    many = links.filter("_all > 1").join(ends, "parent", "left").select("id", F.coalesce("_end", "parent").alias("parent"))
    links = written(line.unionByName(many).distinct(), "needs")
    total = links.groupBy("id").agg(F.count("*").alias("_all"))
    state = written(nodes.select("id").distinct().join(total, "id", "left").fillna(0, ["_all"]), "needs")
    good = state.filter("_all = 0").select("id")
    before, k = -1, 0
    while True:
        met = links.join(good.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy("id").agg(F.count("*").alias("_met"))
        good = state.join(met, "id", "left").filter("_all = 0 OR _all = _met").select("id")
        k += 1
        if k % cut_every == 0:
            good = written(good, "valid")
            n = good.count()
            if n == before:
                break
            before = n
    return state.select("id").join(good.withColumn("valid", F.lit(True)), "id", "left").fillna(False, ["valid"])


def contradictions(facts: DataFrame, keys: list[str], value: str, lo: str, hi: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Facts of one key whose closed intervals touch while their values differ: keys and name of each such fact.

    Two passes over sorted groups, by start and by falling start, that keep the two furthest ends (nearest starts) of
    different values: no pair is made, and a huge group needs no more memory than a small one. A key of more than hot_rows facts is
    cut into ranges that are swept side by side; each begins with the two furthest ends of those before it.
    """
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    types = dict(facts.dtypes)
    found = pa.schema([*((k, kinds[types[k]]) for k in keys), (name, kinds[types[name]])])
    summary = pa.schema([("_part", pa.int32()), *((k, kinds[types[k]]) for k in keys), ("_end", pa.int64()), ("_value", kinds[types[value]])])
    ddl = lambda schema: ", ".join(f"`{f.name}` {next(k for k, v in kinds.items() if v == f.type)}" for f in schema)
    n = len(keys) + 1

    def swept(emit: bool) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = found if emit else summary
            out: list[tuple] = []
            for key, rows in stream_groups(batches, n):
                best: list[tuple[int, object]] = []  # at most two, of different values, furthest first
                for near, far, v, who in (r[n : n + 4] for r in rows):
                    if emit and near is not None:
                        other = next((e for e, w in best if w != v), None)
                        if other is not None and other >= near:
                            out.append((*key[1:], who))
                    ends = {w: e for e, w in best}
                    ends[v] = max(far, ends.get(v, far))
                    best = sorted(((e, w) for w, e in ends.items()), key=lambda x: -x[0])[:2]
                if not emit:
                    out += [(*key, e, w) for e, w in best]
                if len(out) > 20_000:
                    yield from sized(out, schema)
                    out = []
            yield from sized(out, schema)

        return run

    most = largest_group(facts, keys)

    def against(at: Column, near: Column, far: Column, tie: Column) -> DataFrame:
        rows = facts.select(*keys, at.cast("bigint").alias("_at"), near.cast("bigint").alias("_near"), far.cast("bigint").alias("_far"), F.col(value).alias("_value"), F.col(name).alias("_who"))
        columns = ["_part", *keys, "_near", "_far", "_value", "_who", "_at"]
        rows = rows.withColumn("_part", F.lit(0)) if most <= hot_rows else in_ranges(rows, keys, ["_at", tie], most, hot_rows)
        rows = rows.select(*columns)
        if most > hot_rows:
            ends = by_group(rows, ["_part", *keys], ["_at", tie]).mapInArrow(swept(False), ddl(summary))
            later = rows.select(F.col("_part").alias("_to"), *(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
            same = [F.col("_part") < F.col("_to"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)]
            before = ends.join(later, same).groupBy("_to", *keys, "_value").agg(F.max("_end").alias("_far"))  # two rows a part and key at most
            w = Window.partitionBy("_to", *keys).orderBy(F.desc("_far"), "_value")
            before = before.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
            none = F.lit(None)
            rows = rows.unionByName(before.select(F.col("_to").alias("_part"), *keys, none.cast("bigint").alias("_near"), "_far", "_value", none.cast(types[name]).alias("_who"), none.cast("bigint").alias("_at")))
        return by_group(rows, ["_part", *keys], [F.asc_nulls_first("_at"), tie]).mapInArrow(swept(True), ddl(found))

    ahead = against(F.col(lo), F.col(lo), F.col(hi), F.asc("_who"))
    back = against(-F.col(lo), -F.col(hi), -F.col(lo), F.desc("_who"))
    return ahead.unionByName(back).distinct()


def supported_after(links: DataFrame, erased: DataFrame, owner: str, source: str) -> DataFrame:
    """What is left of each owner's sources after some are erased: owner, before, after, dropped (nothing left)."""
    gone = erased.select(source).distinct().withColumn("_gone", F.lit(1))
    out = links.select(owner, source).distinct().join(gone, source, "left").groupBy(owner).agg(F.count("*").alias("before"), F.count_if(F.col("_gone").isNull()).alias("after"))
    return out.withColumn("dropped", F.col("after") == 0)
