"""Vectors: checked, normalised, searched exactly or through an index of lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.search import top
from annalist.operators.sweep import by_group
from annalist.session import written

#: Queries that a task compares side by side.
QUERY_BLOCK = 4096
#: Lists of an index: at most so many, and so many vectors of the sample for each.
MOST_LISTS, PER_LIST = 4096, 40
#: Vectors of one list that a task searches; a longer list is dealt to several.
LIST_ROWS = 200_000
#: Queries that are answered exactly to find how many lists to probe.
CALIBRATE = 64


def usable(vector: str | Column, dimension: int | None = None) -> Column:
    """Whether a vector has the dimension, only finite numbers and not only zeros."""
    v = F.col(vector) if isinstance(vector, str) else vector
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dimension) if dimension else ok, F.lit(False))


def _let(value: Column, then: object) -> Column:
    """then(value) with the value computed once a row: within a lambda it would be computed for every element."""
    return F.transform(F.array(value), then)[0]


def normalised(vector: str | Column) -> Column:
    """The vector at length 1, safe for very large and small numbers; doubles."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def at_length_one(scaled: Column) -> Column:
        length = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x))
        return _let(length, lambda n: F.transform(scaled, lambda x: x / n))

    def scaled_down(d: Column) -> Column:
        largest = F.array_max(F.transform(d, lambda x: F.abs(x)))
        return _let(_let(largest, lambda m: F.transform(d, lambda x: x / m)), at_length_one)

    return _let(F.transform(v, lambda x: x.cast("double")), scaled_down)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


_FOUND = "query_id bigint, vec_id bigint, similarity double"


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64) if len(values) else np.zeros((0, 0))


def _best(names: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, vector, similarity) rows the k best of each query; equal similarities by the lesser id."""
    order = np.lexsort((ids, -np.round(sims, 12), names))
    names, ids, sims = names[order], ids[order], sims[order]
    starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, dtype=int)
    rank = np.arange(len(names)) - np.repeat(starts, np.diff(np.r_[starts, len(names)]))
    return names[rank < k], ids[rank < k], sims[rank < k]


def _compared(cells: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity: of each cell's vectors the k nearest to each of its queries.

    cells: _cell, _vector (false for queries, which come first), id, v. A task holds the queries of one cell and k rows for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, matrix = None, [], None
        found: list[tuple] = []

        def closed() -> Iterator[pa.RecordBatch]:
            if found:
                q, o, s = _best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)  # noqa: B023
                yield pa.record_batch({"query_id": pa.array(q), "vec_id": pa.array(o), "similarity": pa.array(s)})

        for batch in batches:
            at, is_vector, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cell", "_vector", "id"))
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (is_vector[1:] != is_vector[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if lo == hi:
                    continue
                if at[lo] != cell:
                    yield from closed()
                    cell, asked, matrix, found = at[lo], [], None, []
                part = batch.slice(lo, hi - lo)
                if not is_vector[lo]:
                    asked.append((ids[lo:hi], _rows(part, "v")))
                    continue
                if not asked:
                    continue
                if matrix is None:
                    names, matrix = np.concatenate([a for a, _ in asked]), np.concatenate([m for _, m in asked])
                v, own = _rows(part, "v"), ids[lo:hi]
                step = max(1, 2_000_000 // len(names))
                for i in range(0, len(own), step):
                    sims = np.clip(matrix @ v[i : i + step].T, -1, 1)
                    there = own[i : i + step]
                    most = min(k + 1, len(there))  # one more, as a query may be among its own nearest
                    floor = np.partition(sims, -most, axis=1)[:, -most] - 1e-11
                    q, o = np.nonzero(sims >= floor[:, None])
                    keep = names[q] != there[o]  # not itself
                    q, o = q[keep], o[keep]
                    found.append((names[q], there[o], sims[q, o]))
                    if sum(len(f[0]) for f in found) > 8 * k * len(names):
                        found = [_best(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]
        yield from closed()

    return by_group(cells.select("_cell", "_vector", F.col("id").cast("bigint").alias("id"), "v"), ["_cell"], ["_vector"]).mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return top(found, ["query_id"], [F.round("similarity", 12).desc(), F.col("vec_id")], k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Exactly the k nearest vectors of each query by cosine: query_id, vec_id, similarity, rank.

    queries: query_id, q; vectors: vec_id, v (unit length); ids are bigint and unique. Queries are dealt to blocks and vectors to
    shards, and each block is compared with each shard in one pass that keeps k rows a query; nothing comes to the driver
    and no pair is written out. A query does not find itself.
    """
    shards = 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b"), every(shards).alias("_s"))
    held = vectors.select(F.col("vec_id").alias("id"), "v", every(blocks).alias("_b"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("_s"))
    cell = (F.col("_b") * shards + F.col("_s")).cast("bigint")
    both = asked.select(cell.alias("_cell"), F.lit(False).alias("_vector"), "id", "v").unionByName(held.select(cell.alias("_cell"), F.lit(True).alias("_vector"), "id", "v"))
    return _ranked(_compared(both, k), k)


def fit_lists(vectors: DataFrame, lists: int, rounds: int = 12) -> np.ndarray:
    """The centres of the lists: spherical k-means on a sample of at most PER_LIST vectors a list, chosen by a hash of vec_id."""
    n = vectors.count()
    share = min(1.0, 1.1 * PER_LIST * lists / max(1, n))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("lists")), F.lit(1_000_003)) / 1_000_003 < share
    rows = sorted((r.vec_id, r.v) for r in vectors.filter(drawn).select("vec_id", "v").limit(2 * PER_LIST * lists).collect())
    if not rows:
        return np.zeros((1, 1))
    x = np.asarray([v for _, v in rows], dtype=np.float64)
    centres = x[np.random.default_rng(0).permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


class ListIndex:
    """An inverted file: every vector is in the list of its nearest centre; a search looks at the nearest lists of a query.

    Centres are fitted on a bounded sample, all vectors are indexed. A long list is dealt to several tasks, so a list of a
    third of all vectors is no task of its own. With as many probes as lists the search is exact.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None) -> None:
        n = vectors.count()
        self.centres = fit_lists(vectors, min(MOST_LISTS, lists or max(1, int(n**0.5))))
        self.rows = written(self._listed(vectors.select(F.col("vec_id").alias("id"), "v"), 1), "lists")
        sizes = self.rows.groupBy("_list").agg(F.count("*").alias("_n"))
        self.parts = sizes.select("_list", F.ceil(F.col("_n") / LIST_ROWS).cast("int").alias("_parts"))  # at most MOST_LISTS rows

    def _listed(self, df: DataFrame, probes: int) -> DataFrame:
        centres = self.centres
        probes = min(probes, len(centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                sims = _rows(batch, "v") @ centres.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                yield pa.record_batch([pa.array(near.ravel().astype(np.int32)), batch.column("id").take(at), batch.column("v").take(at)], names=["_list", "id", "v"])

        return df.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "_list int, id bigint, v array<double>")

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """How many lists have to be probed for this recall, as measured: up to CALIBRATE queries are answered exactly.

        Where vectors have no structure that is a good part of all lists; where they have, it is few.
        """
        some = written(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATE), "some")
        vectors = self.rows.select(F.col("id").alias("vec_id"), "v")
        found = nearest(some, vectors, k).join(self.rows.select(F.col("id").alias("vec_id"), "_list"), "vec_id").select("query_id", "_list").collect()
        order = {r.query_id: np.argsort(-(self.centres @ np.asarray(r.q, dtype=np.float64)), kind="stable") for r in some.collect()}
        needed = sorted(int(np.flatnonzero(order[r.query_id] == r._list)[0]) + 1 for r in found)
        return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """About the k nearest vectors of each query: query_id, vec_id, similarity, rank."""
        parts = F.broadcast(self.parts)
        asked = self._listed(queries.select(F.col("query_id").alias("id"), F.col("q").alias("v")), probes).join(parts, "_list")
        asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        held = self.rows.join(parts, "_list").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
        cell = (F.col("_list") * F.lit(2**31) + F.col("_part")).cast("bigint")
        both = asked.select(cell.alias("_cell"), F.lit(False).alias("_vector"), "id", "v").unionByName(held.select(cell.alias("_cell"), F.lit(True).alias("_vector"), "id", "v"))
        return _ranked(_compared(both, k), k)


def visible_nearest(index: ListIndex, queries: DataFrame, allowed: DataFrame, k: int, probes: int, more: int = 3) -> DataFrame:
    """The k nearest vectors a query may see: more * k are fetched, and of those that allowed has (query_id, vec_id) the k best stay."""
    fetched = index.search(queries, more * k, probes).drop("rank").join(allowed.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi")
    return _ranked(fetched, k)
