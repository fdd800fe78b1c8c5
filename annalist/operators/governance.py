"""Secrets, integrity, gates, ledgers of spending, batches: looking after the store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.sweep import by_group, stream_groups

# Our own patterns for what must not be stored in the open: name, severity, pattern, what replaces it.
PATTERNS = (
    ("private_key", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "[KEY]"),
    ("cloud_key", "critical", r"(?:AKIA|ASIA)[0-9A-Z]{16}", "[KEY]"),
    ("api_secret", "critical", r"sk-[A-Za-z0-9_-]{20,}", "[KEY]"),
    ("forge_token", "high", r"(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{20,255}", "[TOKEN]"),
    ("assigned_key", "high", r"(?i)(?:api|secret|access)[_-]?(?:secret|token|key) *[:=] *[\"']?[A-Za-z0-9_-]{16,}", "[SECRET]"),
    ("bearer", "critical", r"(?i)\bbearer [A-Za-z0-9._-]{16,}", "[BEARER]"),
    ("secret_field", "high", r"(?i)\b(?:password|passwd|secret|api_key|token) ?[=:] ?[^ ,;]{6,}", "[SECRET]"),
    ("url_login", "high", r"://[^/ :@]+:[^/ @]+@", "://[LOGIN]@"),
    ("email", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}", "[EMAIL]"),
    ("mobile_number", "low", r"\b1[3-9][0-9]{9}\b", "[PHONE]"),
    ("long_number", "low", r"[0-9]{12,19}", "[NUMBER]"),
)


def scanned(rows: DataFrame, text: str) -> DataFrame:
    """How many rows each pattern is found in, and how often; one pass over the texts."""
    counts = [F.count_if(F.col(text).rlike(p)).alias(f"r_{n}") for n, _, p, _ in PATTERNS] + [F.sum(F.size(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).cast("bigint")).alias(f"m_{n}") for n, _, p, _ in PATTERNS]
    one = rows.filter(F.col(text).isNotNull()).agg(*counts)
    stack = F.array(*(F.struct(F.lit(n).alias("pattern"), F.lit(s).alias("severity"), F.col(f"r_{n}").alias("rows"), F.coalesce(F.col(f"m_{n}"), F.lit(0)).alias("matches")) for n, s, _, _ in PATTERNS))
    return one.select(F.explode(stack).alias("x")).select("x.*")


def leaks(rows: DataFrame, key: str, text: str, allowed: DataFrame | None = None) -> DataFrame:
    """What the patterns find, by fingerprint: pattern, severity, fingerprint (SHA-256 of pattern and match), rows, and the least key as a sample.

    The matches themselves are not given. Fingerprints in allowed (fingerprint) are known and left out. Aggregated before anything moves, so a
    secret that stands in very many rows is one group.
    """
    found = F.flatten(F.array(*(_hits(text, n, s, p) for n, s, p, _ in PATTERNS)))
    out = rows.filter(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(found)).alias("f"))
    mark = F.sha2(F.concat_ws(":", "f.pattern", "f.m"), 256)
    out = out.groupBy("f.pattern", "f.severity", mark.alias("fingerprint")).agg(F.count("*").alias("rows"), F.min(key).alias("sample"))
    return out if allowed is None else out.join(allowed.select("fingerprint").distinct(), "fingerprint", "left_anti").select(*out.columns)


def _hits(text: str, name: str, severity: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"), m.alias("m")))


def redacted(text: str | Column) -> Column:
    """The text with every pattern's matches replaced, in the order of the patterns."""
    out = F.col(text) if isinstance(text, str) else text
    for _, _, p, r in PATTERNS:
        out = F.regexp_replace(out, p, r)
    return out


def finding(code: str, severity: str, rows: DataFrame, key: str) -> DataFrame:
    """One integrity check's result: code, severity, how many, and the least key as a sample."""
    return rows.agg(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.count("*").alias("n"), F.min(key).alias("sample"))


def gates(limits: dict[str, tuple[float | None, float | None]]) -> Column:
    """Reasons why a row doesn't pass: for each measure (least, most), null counts as unmeasured."""
    out = []
    for name, (least, most) in limits.items():
        c = F.col(name)
        low = c < least if least is not None else F.lit(False)
        high = c > most if most is not None else F.lit(False)
        out.append(F.when(c.isNull(), f"{name}_unmeasured").when(low, f"{name}_low").when(high, f"{name}_high"))
    return F.array_join(F.array_compact(F.array(*out)), ",")


def running_balance(entries: DataFrame, account: str, order: list[str], amount: str, limit: float) -> DataFrame:
    """Each account's balance after each entry, and whether the entry is still within the limit."""
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("balance", F.sum(amount).over(w)).withColumn("within", F.col("balance") <= limit)


def batches_of_slots(rows: DataFrame, group: str, slot: str, order: str, size: int) -> DataFrame:
    """Batches of at most size rows in which all rows of a slot stay together: group, slot, members, batch (from 1).

    Slots come in the order of their first row. A slot larger than size is a batch of its own. The fill is sequential, so it
    runs once per group over one row a slot, streamed in order.
    """
    slots = rows.groupBy(group, slot).agg(F.min(order).alias("_first"), F.count("*").alias("members"))
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    types = dict(slots.dtypes)
    schema = pa.schema([(group, kinds[types[group]]), (slot, kinds[types[slot]]), ("members", pa.int64()), ("batch", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, members in stream_groups(stream, 1):
            out, batch, used = [], 1, 0
            for r in members:
                if used and used + r[2] > size:
                    batch, used = batch + 1, 0
                used += r[2]
                out.append((key[0], r[1], r[2], batch))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ddl = f"{group} {types[group]}, {slot} {types[slot]}, members bigint, batch bigint"
    return by_group(slots.select(group, slot, "members", "_first"), [group], [F.col("_first"), F.col(slot)]).mapInArrow(run, ddl)


def readiness(targets: DataFrame, group: list[str], state: str) -> DataFrame:
    """What a frozen set of targets has come to: failed, blocked, reached or processing, and the counts behind it."""
    c = lambda *v: F.count_if(F.col(state).isin(*v))
    out = targets.groupBy(*group).agg(F.count("*").alias("n"), c("dead", "conflict").alias("failed"), c("needs_resolution", "superseded", "cancelled").alias("blocked"), c("completed").alias("completed"))
    stage = F.when(F.col("failed") > 0, "failed").when(F.col("blocked") > 0, "blocked").when(F.col("completed") == F.col("n"), "reached").otherwise("processing")
    return out.withColumn("stage", stage)


def kept_within(rows: DataFrame, key: str, tie: str, size: str, most: int, slices: int = 256) -> DataFrame:
    """The rows that fit a cache of most bytes, greatest key first: an exact running sum without one big sort.

    Quantiles of the key cut the rows into slices; the totals of the slices above give each slice where its sum begins.
    """
    at = sorted(set(rows.approxQuantile(key, [i / slices for i in range(1, slices)], 0.001)), reverse=True)
    slice_ = F.size(F.filter(F.array(*(F.lit(c) for c in at)) if at else F.array().cast("array<double>"), lambda c: c > F.col(key)))
    cut = rows.withColumn("_s", slice_)
    totals = cut.groupBy("_s").agg(F.sum(size).alias("_t"))
    above = totals.withColumn("_base", F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_s", "_base")
    w = Window.partitionBy("_s").orderBy(F.desc(key), tie).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_used", F.sum(size).over(w)).join(F.broadcast(above), "_s").filter(F.col("_used") + F.col("_base") <= most).drop("_s", "_used", "_base")
