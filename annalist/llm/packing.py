"""Filling containers of permitted sizes with items, best fit first."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.sweep import sized, stream_groups

#: Items that are packed together by one task. Each group leaves less than one container of every size part empty, so
#: the larger the group the less is lost; the number of groups follows from the number of items.
GROUP_ITEMS = 20_000


def pack_group(items: list[tuple[int, object]], sizes: list[int]) -> list[tuple[object, int, int]]:
    """(item, bin, bin's size) for each (size, item); no item may be larger than the largest permitted size.

    Items go by falling size into the open bin they leave the least room in. If none has room, a bin is opened of the
    size that costs the least per token it will hold, as far as the items still to come that fit its rest can fill it; of
    equal costs the larger. In the end each bin is made as small as its contents permit.
    """
    items = sorted(items, key=lambda x: (-x[0], str(x[1])))
    falling = [-s for s, _ in items]
    after = [0]  # tokens of the items from here to the end, filled from the back
    for s, _ in reversed(items):
        after.append(after[-1] + s)
    after.reverse()
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    filled: list[int] = []
    out = []
    for i, (size, item) in enumerate(items):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:

            def cost(s: int) -> tuple[float, int]:
                rest = s - size  # what later items, none larger than the rest, can fill of it
                return s / max(1, size + min(rest, after[max(i + 1, bisect_left(falling, -rest))])), -s

            free = min(sizes[bisect_left(sizes, size) :], key=cost)
            b = len(filled)
            filled.append(0)
        filled[b] += size
        if free - size > 0:
            insort(room, (free - size, b))
        out.append((item, b))
    small = [sizes[bisect_left(sizes, f)] for f in filled]
    return [(item, b, small[b]) for item, b in out]


_ARROW = pa.schema([("spec", pa.string()), ("bucket", pa.int64()), ("item_id", pa.int64()), ("part", pa.int64()), ("tokens", pa.int64()), ("bin", pa.int64()), ("container_tokens", pa.int64())])


def pack(items: DataFrame, specs: DataFrame, n_items: int | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The container of each item of each spec: spec, item_id, part, tokens, container, container_tokens.

    items: item_id (bigint, unique), tokens (bigint). specs: spec, capacity_tokens; it must be small (it is collected,
    at most 1,000 rows). For a spec the permitted container sizes are all capacities up to its own, and they are used
    jointly. An item that alone exceeds the capacity is cut into full containers of its own (part 1, 2, ...) and a
    rest that is packed like any item; every other item is whole (part 1). Items of no tokens take no room and go
    with the others of their group, null tokens count as 0. Specs without a positive capacity are left out; a
    repeated spec counts once, with its largest capacity.

    Items are spread over groups by a hash of their id; a group is packed by one task and is of bounded size whatever
    the data, since its number follows the number of items. A container's name is spec, group and number in it.
    """
    at = specs.filter("capacity_tokens > 0 AND spec IS NOT NULL").groupBy("spec").agg(F.max("capacity_tokens").cast("bigint").alias("cap")).limit(1001).collect()
    if len(at) > 1000:
        raise ValueError("at most 1,000 container specs")
    capacity = {r.spec: r.cap for r in at}
    rows = items.select("item_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")).filter("item_id IS NOT NULL")
    if n_items is None:
        n_items = rows.count()
    groups = max(1, -(-n_items // group_items))
    caps = F.array(*(F.struct(F.lit(s).alias("spec"), F.lit(c).cast("bigint").alias("cap")) for s, c in sorted(capacity.items())))
    each = rows.withColumn("_c", F.explode(caps)).select("item_id", "tokens", "_c.*").withColumn("full", F.floor((F.greatest("tokens", F.lit(1)) - 1) / F.col("cap")).cast("bigint"))
    each = each.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    whole = each.filter("full > 0").withColumn("part", F.explode(F.sequence(F.lit(1).cast("bigint"), "full")))
    whole = whole.select("spec", "item_id", "part", F.col("cap").alias("tokens"), F.concat_ws("-", "spec", "item_id", "part").alias("container"), F.col("cap").alias("container_tokens"))
    rest = each.select("spec", "bucket", "item_id", (F.col("full") + 1).alias("part"), (F.col("tokens") - F.col("full") * F.col("cap")).alias("tokens"))
    permitted = {s: sorted({c for c in capacity.values() if c <= capacity[s]}) for s in capacity}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (spec, bucket), group in stream_groups(batches, 2):
            members = [(r[4], (r[2], r[3])) for r in group]
            size = {m[1]: m[0] for m in members}
            yield from sized([(spec, bucket, *item, size[item], b, s) for item, b, s in pack_group(members, permitted[spec])], _ARROW)

    ddl = "spec string, bucket bigint, item_id bigint, part bigint, tokens bigint, bin bigint, container_tokens bigint"
    packed = rest.repartition("spec", "bucket").sortWithinPartitions("spec", "bucket").mapInArrow(run, ddl)
    packed = packed.select("spec", "item_id", "part", "tokens", F.concat_ws("-", "spec", F.lit("g"), "bucket", "bin").alias("container"), "container_tokens")
    return whole.unionByName(packed)
