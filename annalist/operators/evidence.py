"""What a body of evidence proves: alternatives that must be there together, independent sources, common validity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.time import NO_END

#: More combinations of alternatives than this are not tried (fixed value); such a case says so.
MOST_PROOFS = 256
_OUT = "case string, status string, proofs int, from_us bigint, to_us bigint"


def proofs(alternatives: DataFrame, links: DataFrame, independent: bool = False, one_revision: bool = False) -> DataFrame:
    """Per case whether it is proved, by how many proofs, and for which periods: case, status, proofs, from_us, to_us.

    alternatives: case, field, alternative, evidence – each field needs all evidence of one of its alternatives. links: case,
    evidence, source, family, revision, lo, hi – what is available, and the half-open period it supports. A proof takes one
    alternative of each field. With ``independent`` the evidence of an alternative must come from at least two families and as
    many families as sources; so must that of the whole proof. With ``one_revision`` all of a proof's evidence is of one
    revision. A proof holds where all its evidence does; the periods of all proofs are merged, one row each. A case without a
    proof has one row without periods: unsupported, or over_budget if it has more than MOST_PROOFS combinations.

    A case is one row of bounded size in one task: what a case has is stated evidence, not a group of the data.
    """
    link = links.groupBy("case", "evidence").agg(F.min(F.struct("source", "family", "revision", "lo", "hi")).alias("l"))
    used = alternatives.select("case", "field", "alternative", "evidence").distinct().join(link, ["case", "evidence"], "left")
    cases = used.groupBy("case", "field", "alternative").agg(F.array_sort(F.collect_list(F.struct("evidence", "l"))).alias("e"))
    cases = cases.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("field", "alternative", "e"))).alias("a"))

    def apart(group: list[dict]) -> bool:
        families = {x["l"]["family"] for x in group}
        return None not in families and len(families) >= 2 and len(families) == len({x["l"]["source"] for x in group})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for case, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fields: dict[str, list] = {}
                for r in rows:
                    whole = all(x["l"] is not None for x in r["e"])
                    fields.setdefault(r["field"], []).extend([r["e"]] if whole and (not independent or apart(r["e"])) else [])
                n = 1
                for options in fields.values():
                    n *= len(options)
                if n > MOST_PROOFS:
                    out.append((case, "over_budget", 0, None, None))
                    continue
                spans = []
                for chosen in product(*fields.values()):
                    group = list({x["evidence"]: x for g in chosen for x in g}.values())
                    revisions = {x["l"]["revision"] for x in group}
                    if one_revision and (None in revisions or len(revisions) != 1) or independent and not apart(group):
                        continue
                    lo, hi = max(x["l"]["lo"] for x in group), min(NO_END if x["l"]["hi"] is None else x["l"]["hi"] for x in group)
                    if lo < hi:
                        spans.append((lo, hi))
                merged: list[list[int]] = []
                for lo, hi in sorted(spans):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                out += [(case, "supported", len(spans), *m) for m in merged] or [(case, "unsupported", 0, None, None)]
            if out:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])

    return cases.mapInArrow(run, _OUT)


def best_branch(branches: DataFrame, observed: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per case the recall of its best alternative and what was seen that must not be: case, recall, complete, forbidden.

    branches: case, branch, evidence; observed and eligible: case, evidence. Only branches all of whose evidence is eligible count; seen
    evidence of the case that isn't eligible is forbidden. A case without an eligible branch has no recall.
    """
    seen = observed.select("case", "evidence").distinct().withColumn("_s", F.lit(1))
    fine = eligible.select("case", "evidence").distinct().withColumn("_e", F.lit(1))
    rows = branches.select("case", "branch", "evidence").distinct().join(seen, ["case", "evidence"], "left").join(fine, ["case", "evidence"], "left")
    per = rows.groupBy("case", "branch").agg(F.count("*").alias("n"), F.count("_s").alias("hit"), (F.count("_e") == F.count("*")).alias("ok"))
    recall = per.groupBy("case").agg(F.max(F.when(F.col("ok"), F.col("hit") / F.col("n"))).alias("recall"))
    bad = rows.filter("_s IS NOT NULL AND _e IS NULL").groupBy("case").agg(F.count_distinct("evidence").alias("forbidden"))
    return recall.join(bad, "case", "left").select("case", "recall", F.coalesce(F.col("recall") == 1, F.lit(False)).alias("complete"), F.coalesce("forbidden", F.lit(0)).alias("forbidden"))
