"""Sweeps over sorted partitions: state is kept for one group at a time and only for what is open."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame


def stream_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows with equal first n_keys columns; each group's rows must be consumed before the next."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    yield from groupby(rows(), key=lambda r: r[:n_keys])


class Below:
    """A string that sorts before every lesser one, for heaps that give the greatest first."""

    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        self.text = text

    def __lt__(self, other: Below) -> bool:
        return self.text > other.text


def strongest_at(sorted_rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each probe the strongest interval that contains its instant.

    sorted_rows must be partitioned by keys and sorted by keys, at, is_probe. Interval rows have at (start), hi,
    strong_1, strong_2 (bigint), id; probe rows have at, id, is_probe true. Gives probe_id, id. One pass with a heap
    of the open intervals; those that ended are dropped when they come to its top.
    """
    cols = ["at", "is_probe", "hi", "strong_1", "strong_2", "id"]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes: list[str] = []
        found: list[str] = []
        for _, rows in stream_groups(batches, n):
            heap: list[tuple] = []
            for r in rows:
                at, is_probe, hi, s1, s2, name = r[n:]
                if not is_probe:
                    heappush(heap, (-s1, -s2, Below(name), hi))
                    continue
                while heap and heap[0][3] <= at:
                    heappop(heap)
                if heap:
                    probes.append(name)
                    found.append(heap[0][2].text)
                    if len(probes) >= 20_000:
                        yield pa.record_batch({"probe_id": pa.array(probes, pa.string()), "id": pa.array(found, pa.string())})
                        probes, found = [], []
        if probes:
            yield pa.record_batch({"probe_id": pa.array(probes, pa.string()), "id": pa.array(found, pa.string())})

    return sorted_rows.select(*keys, *cols).mapInArrow(run, "probe_id string, id string")


def by_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with each group of keys in one partition, sorted by keys and order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def sized(rows: list[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """rows as record batches of at most ``most`` rows."""
    for i in range(0, len(rows), most):
        part = list(zip(*rows[i : i + most], strict=True))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(part, schema, strict=True)], schema=schema)


