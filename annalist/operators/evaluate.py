"""Measuring results: retrieval metrics, intervals, percentiles, costs, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def micro(hits: Column, total: Column) -> Column:
    """A ratio of sums; null over nothing."""
    return F.sum(hits) / F.nullif(F.sum(total), F.lit(0))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The bounds of Wilson's interval at 95 per cent; null over nothing."""
    n = F.nullif(n, F.lit(0))
    p = successes / n
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def cluster_interval(rows: DataFrame, group: list[str], cluster: str, value: str) -> DataFrame:
    """Mean with a cluster-robust normal interval: group, n, clusters, mean, margin (null with one cluster).

    Clusters are summed first, so what the second step sees is one row a cluster.
    """
    sums = rows.groupBy(*group, cluster).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    whole = sums.groupBy(*group).agg(F.sum("_n").alias("n"), F.count("*").alias("clusters"), (F.sum("_s") / F.sum("_n")).alias("mean"))
    off = sums.join(whole, group).groupBy(*group).agg(F.sum(F.pow(F.col("_s") - F.col("_n") * F.col("mean"), 2)).alias("_q"))
    g = F.col("clusters")
    margin = F.when(g > 1, Z * F.sqrt(g / (g - 1) * F.col("_q")) / F.col("n"))
    return whole.join(off, group).select(*group, "n", "clusters", "mean", margin.alias("margin"))


def exact_percentiles(rows: DataFrame, group: list[str], value: str, at: list[float], buckets: int = 64) -> DataFrame:
    """Nearest-rank percentiles, exactly: group, p, value. Nulls are left out.

    Approximate quantiles cut each group into buckets, which are counted; only the buckets a rank falls into are sorted.
    So no task sorts a whole huge group.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*group, value)
    grid = known.groupBy(*group).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1000))).alias("_g"))
    placed = known.join(grid, group).withColumn("_b", F.size(F.filter("_g", lambda c: c < F.col(value)))).drop("_g")
    counts = placed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("_b")
    counts = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    ranks = counts.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in at)))).withColumn("_r", F.greatest(F.lit(1), F.ceil(F.round(F.col("_all") * F.col("p"), 9))).cast("bigint"))
    hit = ranks.filter((F.col("_r") <= F.col("_upto")) & (F.col("_r") > F.col("_upto") - F.col("_n"))).select(*group, "_b", "p", (F.col("_r") - F.col("_upto") + F.col("_n")).alias("_k"))
    needed = placed.join(hit.select(*group, "_b").distinct(), [*group, "_b"], "left_semi")
    sorted_ = needed.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(value)))
    return sorted_.join(hit, [*group, "_b", "_k"]).select(*group, "p", value)


def bootstrap(diffs: DataFrame, group: list[str], cluster: str, diff: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Cluster bootstrap of a mean difference: group, mean, low and high (2.5 and 97.5 per cent, linear interpolation).

    Each cluster gets in each round a Poisson(1) number of copies from a hash of seed, round and cluster, so rounds are
    drawn where the clusters lie and the result is the same on every run.
    """
    sums = diffs.groupBy(*group, cluster).agg(F.sum(diff).alias("_s"), F.count(diff).alias("_n"))
    u = F.pmod(F.xxhash64(F.lit(seed), "_round", cluster), F.lit(2**40)) / float(2**40)
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    copies = sum(((u >= s).cast("int") for s in steps[1:]), (u >= steps[0]).cast("int"))
    drawn = sums.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_c", copies)
    means = drawn.groupBy(*group, "_round").agg((F.sum(F.col("_c") * F.col("_s")) / F.nullif(F.sum(F.col("_c") * F.col("_n")), F.lit(0))).alias("_m"))
    ends = means.groupBy(*group).agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return sums.groupBy(*group).agg((F.sum("_s") / F.sum("_n")).alias("mean")).join(ends, group)


def order_score(ranked: DataFrame, group: list[str], expected: str, actual: str) -> DataFrame:
    """The share of pairs of a group that come in the expected order (1 with fewer than two); ranks must be distinct.

    Counted as inversions against the sorted order by windows over rank blocks; groups are the short lists of one case.
    """
    listed = ranked.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(expected, actual))), lambda x: x[actual]).alias("_l"))
    n = F.size("_l")
    right = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.size(F.filter(F.slice(F.col("_l"), i + 1, n), lambda x: x > F.get("_l", i))))
    return listed.select(*group, n.alias("items"), F.when(n < 2, 1.0).otherwise(right / (n * (n - 1) / 2)).alias("order_score"))


def allocated(costs: DataFrame, requests: DataFrame) -> DataFrame:
    """Costs split over their requests: request_id, known and total (null if any part is unknown).

    costs: entry_id, request_ids (array, empty: all requests), value (null: unknown). requests: request_id. Costs of all
    requests are summed before they are shared out, so entries and requests are never paired.
    """
    own = costs.filter(F.size("request_ids") > 0).select((F.col("value") / F.size("request_ids")).alias("v"), F.explode("request_ids").alias("request_id"))
    own = own.groupBy("request_id").agg(F.sum("v").alias("_own"), F.max(F.col("v").isNull()).alias("_unknown"))
    total, unknown = costs.filter(F.size("request_ids") <= 0).agg(F.sum("value"), F.coalesce(F.max(F.col("value").isNull()), F.lit(False))).collect()[0]
    each = (total or 0) / max(1, requests.count())
    out = requests.join(own, "request_id", "left").withColumn("known", F.coalesce("_own", F.lit(0)) + F.lit(each))
    return out.select("request_id", "known", F.when(~F.coalesce("_unknown", F.lit(False)) & ~F.lit(unknown), F.col("known")).alias("total"))


def reconciled(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two sides of an index: keys and problem (missing, unexpected, mismatch) where they differ."""
    e = expected.select(*keys, F.col(value).alias("_e"), F.lit(1).alias("_he"))
    a = actual.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ha"))
    both = e.join(a, keys, "full_outer")
    problem = F.when(F.col("_ha").isNull(), "missing").when(F.col("_he").isNull(), "unexpected").when(~F.col("_e").eqNullSafe(F.col("_a")), "mismatch")
    return both.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")


def run_arms(items: DataFrame, key: str, arms: dict[str, object], score: object) -> DataFrame:
    """Every arm on every item: arm, key, status (completed, empty or failed), score (null unless completed).

    An arm is a function of the items; an arm that raises has failed on all of them, and an item it gives nothing for is empty. score(items, found)
    gives key and score. Items are repeated once per arm as rows of a plan; arms are few and named by the caller.
    """
    out = None
    for name, call in arms.items():
        status, made = "empty", None
        try:
            made = score(items, call(items)).select(key, "score")
        except Exception:  # noqa: BLE001
            status = "failed"
        plan = items.select(key).withColumn("arm", F.lit(name))
        plan = plan.withColumn("score", F.lit(None).cast("double")) if made is None else plan.join(made, key, "left")
        plan = plan.select("arm", key, F.when(F.col("score").isNotNull(), "completed").otherwise(status).alias("status"), F.col("score").cast("double").alias("score"))
        out = plan if out is None else out.unionByName(plan)
    return out


def arm_means(results: DataFrame) -> DataFrame:
    """Per arm how many runs were planned and completed, and the mean score over both: a run that wasn't completed counts as 0 of the planned."""
    per = results.groupBy("arm").agg(F.count("*").alias("planned"), F.count("score").alias("completed"), F.avg(F.coalesce("score", F.lit(0.0))).alias("a"), F.avg("score").alias("b"))
    return per.select("arm", "planned", "completed", F.round("a", 6).alias("planned_mean"), F.round("b", 6).alias("completed_mean"))


def compared(baseline: DataFrame, candidate: DataFrame, group: list[str], score: str, cost: str, latency: str, tolerance: float = 0.02, most_cost: float = 1.1, most_latency: float = 1.1) -> DataFrame:
    """Per group a candidate against its baseline: means of the score, ratios of mean cost and of the 95th percentile of latency, and a verdict.

    regression if the mean score falls by more than tolerance, too_costly or too_slow if a ratio is over its limit, incomplete if one side has no rows, else accepted. The
    percentile is exact: the least value that at least 95 of 100 rows don't exceed.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        means = df.groupBy(*group).agg(F.count("*").alias(f"{name}_n"), F.avg(score).alias(f"{name}_score"), F.avg(cost).alias(f"{name}_cost"))
        p95 = exact_percentiles(df, group, latency, [0.95]).select(*group, F.col(latency).alias(f"{name}_p95"))
        return means.join(p95, group, "left")

    both = side(baseline, "old").join(side(candidate, "new"), group, "full_outer")
    ratio = lambda c: F.col(f"new_{c}") / F.nullif(F.col(f"old_{c}"), F.lit(0))
    both = both.withColumn("score_change", F.col("new_score") - F.col("old_score")).withColumn("cost_ratio", ratio("cost")).withColumn("p95_ratio", ratio("p95"))
    verdict = (
        F.when(F.col("old_n").isNull() | F.col("new_n").isNull(), "incomplete").when(F.col("score_change") < -tolerance, "regression")
        .when(F.col("cost_ratio") > most_cost, "too_costly").when(F.col("p95_ratio") > most_latency, "too_slow").otherwise("accepted")
    )
    return both.select(*group, "score_change", "cost_ratio", "p95_ratio", verdict.alias("verdict"))
