"""Graphs and standing questions: the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions.text import alias_key, terms
from annalist.functions.time import DAY_US, HOUR_US, NO_END, micros
from annalist.operators import graph, questions
from annalist.operators.counted import counted_intervals, one_per_id, plain_key
from annalist.sources.tables import table

_AT_US = 1_780_272_000_000_000


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers located in nations, nations part of regions, parts supplied by suppliers."""
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))

    def of(t: str, a: str, p: str, b: str, q: str, verb: str) -> DataFrame:
        return table(spark, d, t, a, b).select(name(p, F.col(a)).alias("subject"), F.lit(verb).alias("predicate"), name(q, F.col(b)).alias("object"))

    out = of("customer", "c_custkey", "c", "c_nationkey", "n", "located_in")
    out = out.unionByName(of("supplier", "s_suppkey", "s", "s_nationkey", "n", "located_in"))
    out = out.unionByName(of("nation", "n_nationkey", "n", "n_regionkey", "r", "part_of"))
    return out.unionByName(of("lineitem", "l_partkey", "p", "l_suppkey", "s", "supplied_by").distinct())


def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "supplier", "s_suppkey").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.neighbours(_edges(spark, d), nodes)


def graph_bfs_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths to what lies within three steps of each region, against the direction of the edges: the nearest 200 of each."""
    edges = _edges(spark, d).select(F.col("object").alias("src"), "predicate", F.col("subject").alias("dst"))
    roots = table(spark, d, "region", "r_regionkey").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.paths(edges, roots, 3, 200).select("root", "node", "depth", F.array_join("path", " ").alias("path"))


def graph_reachable_nodes(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).filter("predicate <> 'supplied_by'").select(F.col("subject").alias("src"), F.col("object").alias("dst"))
    roots = table(spark, d, "customer", "c_custkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.reachable(edges, roots, 3)


def chain_rule_inference(spark: SparkSession, d: str) -> DataFrame:
    facts = _edges(spark, d).withColumn("confidence", F.when(F.col("predicate") == "part_of", 0.9).otherwise(0.8)).withColumn("valid_from", F.length("subject").cast("bigint")).withColumn("valid_to", F.lit(None).cast("bigint"))
    return graph.chain_rule(facts, "located_in", "part_of", "located_in_region").select("subject", "object", "confidence", "valid_from")


def class_closure_is_a(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of part with all kinds above it: STEEL is-a ... by the words of its type."""
    kinds = table(spark, d, "part", "p_type", "p_brand").distinct()
    edges = kinds.select(F.col("p_type").alias("src"), F.col("p_brand").alias("dst")).unionByName(kinds.select(F.col("p_brand").alias("src"), F.substring("p_brand", 1, 7).alias("dst"))).distinct()
    roots = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.reachable(edges, roots, 4).select(F.col("root").alias("child"), F.col("node").alias("parent"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    rows = counted_intervals(table(spark, d, "claims"), micros("created_at").alias("created_us"), "version", "value_json")
    return one_per_id(rows, "created_us").filter("partition_key IS NOT NULL AND claim_key IS NOT NULL").withColumn("value", F.coalesce(F.trim("value_json"), F.lit("")))


def functional_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a slot that differ in value while their closed intervals touch."""
    return graph.contradictions(_values(spark, d), ["partition_key", "claim_key"], "value", "from_us", "to_us", "id")


def conflict_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Of the claims in conflict the strongest of a slot stays active, the others are superseded by it."""
    rows = _values(spark, d).join(functional_conflicts(spark, d).select("id"), "id", "left_semi")
    best = F.max(F.struct("from_us", "version", "id")).over(Window.partitionBy("partition_key", "claim_key"))
    out = rows.withColumn("_b", best)
    return out.select("id", F.when(F.col("id") == F.col("_b.id"), "active").otherwise("superseded").alias("status"), F.when(F.col("id") != F.col("_b.id"), F.col("_b.id")).alias("superseded_by"))


def entity_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Entities by any spelling of their name; found more than once means ambiguous."""
    nations = table(spark, d, "nation", "n_nationkey", "n_name").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("entity"), F.explode(F.array(F.col("n_name"), F.lower("n_name"), F.concat(F.lit("  "), F.initcap("n_name")))).alias("alias"))
    regions = table(spark, d, "region", "r_regionkey", "r_name").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("entity"), F.col("r_name").alias("alias"))
    return nations.unionByName(regions).groupBy(alias_key("alias").alias("alias")).agg(F.count_distinct("entity").alias("entities"), F.min("entity").alias("entity"))


def ontology_text_search(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by words of the question of each nation, with the labels of both ends of the edge."""
    nation = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    supplier = table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    facts = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    label = F.concat_ws(" ", "s_name", "n_name", "r_name")
    words = F.array_distinct(terms(F.concat_ws(" ", "n_name", F.lit("supplier"))))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(label), w)))
    return facts.select("s_suppkey", F.round(F.least(F.lit(1.0), 0.75 * hits / F.size(words) + 0.25 * 0.8), 6).alias("score"))


def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """How the keys that claims use changed on the first of June: added, removed, changed (by kind of value)."""
    rows = table(spark, d, "claims", "claim_key", "value_json", "created_at").select(F.element_at(F.split(plain_key("claim_key"), r"\."), -1).alias("key"), F.substring(F.trim("value_json"), 1, 1).alias("c"), micros("created_at").alias("t")).filter("key IS NOT NULL")
    kind = F.when(F.col("c") == "{", "object").when(F.col("c") == '"', "string").when(F.col("c").isin("t", "f"), "boolean").otherwise("other")
    side = lambda cond, name: rows.filter(cond).groupBy("key").agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias(name))
    both = side(F.col("t") < _AT_US, "old_kinds").join(side(F.col("t") >= _AT_US, "new_kinds"), "key", "full_outer")
    change = F.when(F.col("old_kinds").isNull(), "added").when(F.col("new_kinds").isNull(), "removed").when(F.col("old_kinds") != F.col("new_kinds"), "changed").otherwise("same")
    return both.select("key", "old_kinds", "new_kinds", change.alias("change"))


def delta_components(spark: SparkSession, d: str) -> DataFrame:
    """Claims that hang together through the events they come from."""
    links = table(spark, d, "claim_sources").filter("claim_id IS NOT NULL AND event_id IS NOT NULL")
    found = graph.components(links.select(F.concat(F.lit("c:"), "claim_id").alias("a"), F.concat(F.lit("e:"), "event_id").alias("b")))
    return found.filter("node LIKE 'c:%'").select(F.expr("substring(node, 3)").alias("claim_id"), F.expr("substring(component, 3)").alias("component"))


def invalidation_closure(spark: SparkSession, d: str) -> DataFrame:
    """What an archived event takes with it: the claims from it, and the claims that supersede one of those."""
    claims = table(spark, d, "claims", "id", "supersedes").filter("id IS NOT NULL AND supersedes IS NOT NULL").distinct()
    gone = table(spark, d, "memory_events", "id", "archived_at").filter("archived_at IS NOT NULL").select(F.col("id").alias("event_id")).distinct()
    roots = table(spark, d, "claim_sources").join(gone, "event_id", "left_semi").select(F.col("claim_id").alias("node")).distinct()
    out = graph.closure(claims.select(F.col("supersedes").alias("src"), F.col("id").alias("dst")), roots)
    return out.select(F.col("node").alias("claim_id"), "depth")


def erase_support_counting(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "memory_events", "id", "archived_at").filter("archived_at IS NOT NULL").select(F.col("id").alias("event_id"))
    return graph.supported_after(table(spark, d, "claim_sources").filter("claim_id IS NOT NULL AND event_id IS NOT NULL"), gone, "claim_id", "event_id")


def artifact_validity_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose whole line of superseded claims is there."""
    claims = table(spark, d, "claims", "id", "supersedes").filter("id IS NOT NULL").distinct()
    return graph.valid_from_roots(claims, claims.filter("supersedes IS NOT NULL").select("id", F.col("supersedes").alias("parent")))


def _projects(spark: SparkSession, d: str) -> DataFrame:
    shipped = table(spark, d, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("done"))
    orders = table(spark, d, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.withColumn("deadline_us", micros("o_orderdate") + 30 * DAY_US).withColumn("done_us", micros("done"))


def question_owner(spark: SparkSession, d: str) -> DataFrame:
    """Who each customer's orders belong to by priority: one answer, contested, or unknown."""
    return questions.folded_field(table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus").filter("o_orderstatus = 'O'"), ["o_custkey"], "o_orderpriority")


def question_status(spark: SparkSession, d: str) -> DataFrame:
    return questions.folded_field(table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], "o_orderstatus", F.col("o_totalprice") > 490000)


def question_commitments(spark: SparkSession, d: str) -> DataFrame:
    """Orders promised and not done, as three values: an order without lines is unknown."""
    rows = _projects(spark, d).withColumn("open", F.when(F.col("done_us").isNull(), F.lit(None).cast("boolean")).otherwise(F.col("done_us") > F.col("deadline_us")))
    return questions.folded_status(rows, ["o_custkey"], "open")


def question_overdue(spark: SparkSession, d: str) -> DataFrame:
    rows = _projects(spark, d).filter(F.col("done_us") > F.col("deadline_us"))
    return rows.select("o_orderkey", (F.col("done_us") - F.col("deadline_us")).alias("late_us"))


def question_risks(spark: SparkSession, d: str) -> DataFrame:
    """Customers with urgent orders of high value, as a status."""
    rows = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice").withColumn("risk", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 200000))
    return questions.folded_status(rows, ["o_custkey"], "risk", F.col("o_totalprice") > 900)


def dependency_risk_lag(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines ship later than the last line of their customer's first order."""
    rows = _projects(spark, d)
    first = rows.groupBy("o_custkey").agg(F.min_by("done_us", F.struct("o_orderdate", "o_orderkey")).alias("launch_us"))
    lag = F.col("done_us") - F.col("launch_us")
    return rows.join(first, "o_custkey").select("o_orderkey", lag.alias("lag_us"), (lag > 0).alias("at_risk"))


def next_transition(spark: SparkSession, d: str) -> DataFrame:
    """When the state of each slot changes next after the first of June."""
    rows = counted_intervals(table(spark, d, "claims")).filter("partition_key IS NOT NULL AND claim_key IS NOT NULL")
    after = lambda c: F.when((F.col(c) > _AT_US) & (F.col(c) < NO_END), F.col(c))
    return rows.groupBy("partition_key", "claim_key").agg(F.least(F.min(after("from_us")), F.min(after("to_us"))).alias("next_us"))


def keyed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_suppkey", "l_quantity")
    return questions.keyed_aggregate(rows.withColumn("q", F.when(F.col("l_quantity") > 2, F.col("l_quantity"))), ["l_suppkey"], "q")


def delta_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """Totals per customer after some orders changed, from the totals before."""
    new = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    old = new.withColumn("o_totalprice", F.when(F.col("o_custkey") % 10 == 0, F.col("o_totalprice") / 2).otherwise(F.col("o_totalprice")))
    answer = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return questions.refreshed(old, new, answer(old), ["o_custkey"], ["o_orderkey", "o_totalprice"], answer)


def log_continuity(spark: SparkSession, d: str) -> DataFrame:
    """Per slot whether its versions are without gap from the first to the last."""
    rows = table(spark, d, "claims", "partition_key", "claim_key", "version").filter("version IS NOT NULL").withColumn("claim_key", plain_key("claim_key"))
    out = rows.groupBy("partition_key", "claim_key").agg(F.min("version").alias("first"), F.max("version").alias("last"), F.count_distinct("version").alias("present"))
    return out.withColumn("missing", F.col("last") - F.col("first") + 1 - F.col("present"))


def round_robin_due(spark: SparkSession, d: str) -> DataFrame:
    """Pending work of each tenant in fair rounds: older and more important claims first."""
    rows = table(spark, d, "claims", "id", "tenant_id", "importance", "created_at", "status").filter(plain_key("status") == "candidate").distinct()
    age = F.floor((F.lit(_AT_US) - micros("created_at")) / (30 * DAY_US))
    out = questions.fair_order(rows.filter("id IS NOT NULL"), "tenant_id", F.floor(F.col("importance") * 10) + age, [F.col("created_at"), F.col("id")])
    return out.select("id", "tenant_id", "tenant_rank")


def debounce_due(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of changes per user (a pause of six hours ends one), and when each is due."""
    rows = table(spark, d, "events", "user_id", "ts").select("user_id", micros("ts").alias("t"))
    w = Window.partitionBy("user_id").orderBy("t")
    burst = rows.withColumn("_b", F.sum(F.coalesce((F.col("t") - F.lag("t").over(w) > 6 * HOUR_US).cast("int"), F.lit(0))).over(w))
    out = burst.groupBy("user_id", "_b").agg(F.count("*").alias("changes"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))
    return out.select("user_id", "first_us", "changes", questions.due(F.col("last_us"), F.col("first_us"), 6 * HOUR_US, 24 * HOUR_US).alias("due_us"))


def hotness_window(spark: SparkSession, d: str) -> DataFrame:
    """Events per user and day with the day before, and whether the user became hot, cold or stayed."""
    rows = table(spark, d, "events", "user_id", "ts").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    before = F.when(F.datediff("day", F.lag("day").over(w)) == 1, F.lag("n").over(w)).otherwise(0)
    out = rows.withColumn("before", F.coalesce(before, F.lit(0)))
    mode = F.when(F.col("n") >= 4, "hot").when((F.col("n") >= 2) & (F.col("before") >= 4), "hot").otherwise("cold")
    return out.select("user_id", F.col("day").cast("string").alias("day"), "n", "before", mode.alias("mode"))


def capacity_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_events", "tenant_id", "event_type", "archived_at")
    return rows.rollup("tenant_id", "event_type").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_if(F.col("archived_at").isNull()).alias("live"))


def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memory_events", "id").filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("attempts"))
    return rows.groupBy("attempts").agg(F.count("*").alias("n"), F.max(questions.backoff(F.col("attempts"))).alias("delay_s"))


NAMES = (graph_neighbors, graph_bfs_paths, graph_reachable_nodes, chain_rule_inference, class_closure_is_a, functional_conflicts, conflict_resolution, entity_alias_lookup, ontology_text_search, schema_diff, delta_components, invalidation_closure, erase_support_counting, artifact_validity_fixpoint, question_owner, question_status, question_commitments, question_overdue, question_risks, dependency_risk_lag, next_transition, keyed_aggregate, delta_equals_full, log_continuity, round_robin_due, debounce_due, hotness_window, capacity_rollup, retry_backoff)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def oracle_sql() -> dict[str, str]:
    from annalist.queries.histories import _COUNTED
    from annalist.queries.retrieval import sql_terms

    edges = """e AS (SELECT 'c' || c_custkey AS subject, 'located_in' AS predicate, 'n' || c_nationkey AS object FROM customer UNION ALL SELECT 's' || s_suppkey, 'located_in', 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation UNION ALL SELECT DISTINCT 'p' || l_partkey, 'supplied_by', 's' || l_suppkey FROM lineitem)"""
    project = "p AS (SELECT o.*, epoch_us(o_orderdate) + 2592000000000 AS deadline_us, epoch_us(d) AS done_us FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
    conflict = f"{_COUNTED}, v AS (SELECT *, coalesce(trim(value_json), '') AS v FROM counted), x AS (SELECT DISTINCT a.partition_key, a.claim_key, a.id, a.f, a.version FROM v a JOIN v b ON a.partition_key = b.partition_key AND a.claim_key = b.claim_key AND a.v <> b.v AND a.f <= b.t AND b.f <= a.t)"
    return {
        "graph_neighbors": f"WITH {edges}, n AS (SELECT 's' || s_suppkey AS node FROM supplier) SELECT node, predicate, object AS neighbour, 'out' AS direction FROM n JOIN e ON node = subject UNION ALL SELECT node, predicate, subject, 'in' FROM n JOIN e ON node = object",
        "graph_bfs_paths": f"""WITH {edges}, h AS (SELECT DISTINCT object AS src, predicate, subject AS dst FROM e), l0 AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth, ['r' || r_regionkey] AS path FROM region),
l1 AS (SELECT root, dst AS node, 1 AS depth, min((l0.node, predicate, path)) AS k FROM l0 JOIN h ON src = l0.node GROUP BY root, dst), p1 AS (SELECT root, node, depth, list_concat(k[3], [k[2], node]) AS path FROM l1 WHERE (root, node) NOT IN (SELECT (root, node) FROM l0)),
s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM p1),
l2 AS (SELECT root, dst AS node, 2 AS depth, min((p1.node, predicate, path)) AS k FROM p1 JOIN h ON src = p1.node GROUP BY root, dst), p2 AS (SELECT root, node, depth, list_concat(k[3], [k[2], node]) AS path FROM l2 WHERE (root, node) NOT IN (SELECT (root, node) FROM s1)),
s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM p2),
l3 AS (SELECT root, dst AS node, 3 AS depth, min((p2.node, predicate, path)) AS k FROM p2 JOIN h ON src = p2.node GROUP BY root, dst), p3 AS (SELECT root, node, depth, list_concat(k[3], [k[2], node]) AS path FROM l3 WHERE (root, node) NOT IN (SELECT (root, node) FROM s2)),
s3 AS (SELECT * FROM s2 UNION ALL SELECT * FROM p3)
SELECT root, node, depth, array_to_string(path, ' ') AS path FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS k FROM s3) WHERE k <= 200""",
        "graph_reachable_nodes": f"""WITH RECURSIVE {edges}, g(root, node, depth) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION SELECT root, object, depth + 1 FROM g JOIN e ON node = subject WHERE depth < 3 AND predicate <> 'supplied_by') SELECT root, node, min(depth) AS depth FROM g GROUP BY ALL""",
        "chain_rule_inference": f"WITH {edges} SELECT l.subject, r.object, 0.8 AS confidence, CAST(greatest(length(l.subject), length(r.subject)) AS BIGINT) AS valid_from FROM e l JOIN e r ON l.object = r.subject WHERE l.predicate = 'located_in' AND r.predicate = 'part_of'",
        "class_closure_is_a": """WITH RECURSIVE e AS (SELECT DISTINCT p_type AS s, p_brand AS o FROM part UNION SELECT DISTINCT p_brand, substr(p_brand, 1, 7) FROM part), g(child, parent) AS (SELECT s, s FROM e UNION SELECT o, o FROM e UNION SELECT child, o FROM g JOIN e ON parent = s) SELECT child, parent FROM g""",
        "functional_conflicts": f"WITH {conflict} SELECT partition_key, claim_key, id FROM x",
        "conflict_resolution": f"WITH {conflict}, w AS (SELECT id, first_value(id) OVER (PARTITION BY partition_key, claim_key ORDER BY f DESC, version DESC, id DESC) AS best FROM x) SELECT id, CASE WHEN id = best THEN 'active' ELSE 'superseded' END AS status, CASE WHEN id <> best THEN best END AS superseded_by FROM w",
        "entity_alias_lookup": """WITH a AS (SELECT 'n' || n_nationkey AS entity, lower(n_name) AS alias FROM nation UNION SELECT 'r' || r_regionkey, lower(r_name) FROM region) SELECT alias, count(DISTINCT entity) AS entities, min(entity) AS entity FROM a GROUP BY alias""",
        "ontology_text_search": f"""WITH f AS (SELECT s_suppkey, lower(s_name || ' ' || n_name || ' ' || r_name) AS label, list_distinct({sql_terms("n_name || ' supplier'")}) AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT s_suppkey, round(least(1, 0.75 * len(list_filter(w, lambda x: contains(label, x))) / len(w) + 0.2), 6) AS score FROM f""",
        "schema_diff": f"""WITH r AS (SELECT string_split(lower(trim(claim_key)), '.')[-1] AS key, substr(trim(value_json), 1, 1) AS c, epoch_us(created_at) AS t FROM claims WHERE claim_key IS NOT NULL),
k AS (SELECT key, t, CASE WHEN c = '{{' THEN 'object' WHEN c = '"' THEN 'string' WHEN c IN ('t', 'f') THEN 'boolean' ELSE 'other' END AS kind FROM r),
o AS (SELECT key, array_to_string(list_sort(list_distinct(list(kind))), ',') AS old_kinds FROM k WHERE t < {_AT_US} GROUP BY 1), n AS (SELECT key, array_to_string(list_sort(list_distinct(list(kind))), ',') AS new_kinds FROM k WHERE t >= {_AT_US} GROUP BY 1)
SELECT key, old_kinds, new_kinds, CASE WHEN old_kinds IS NULL THEN 'added' WHEN new_kinds IS NULL THEN 'removed' WHEN old_kinds <> new_kinds THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n USING (key)""",
        "delta_components": """WITH RECURSIVE l AS (SELECT DISTINCT a.claim_id AS a, b.claim_id AS b FROM claim_sources a JOIN claim_sources b USING (event_id)), g(claim_id, component) AS (SELECT a, a FROM l UNION SELECT claim_id, b FROM g JOIN l ON component = a)
SELECT claim_id, min(component) AS component FROM g GROUP BY claim_id""",
        "invalidation_closure": """WITH RECURSIVE s AS (SELECT DISTINCT id, supersedes FROM claims WHERE supersedes IS NOT NULL), g(claim_id, depth) AS (SELECT DISTINCT claim_id, 0 FROM claim_sources WHERE event_id IN (SELECT id FROM memory_events WHERE archived_at IS NOT NULL)
UNION SELECT s.id, depth + 1 FROM g JOIN s ON s.supersedes = g.claim_id) SELECT claim_id, min(depth) AS depth FROM g GROUP BY claim_id""",
        "erase_support_counting": """WITH l AS (SELECT DISTINCT claim_id, event_id FROM claim_sources), g AS (SELECT DISTINCT id FROM memory_events WHERE archived_at IS NOT NULL)
SELECT claim_id, count(*) AS "before", count(*) FILTER (g.id IS NULL) AS "after", count(*) FILTER (g.id IS NULL) = 0 AS dropped FROM l LEFT JOIN g ON event_id = g.id GROUP BY claim_id""",
        "artifact_validity_fixpoint": """WITH RECURSIVE c AS (SELECT DISTINCT id, supersedes FROM claims WHERE id IS NOT NULL), g(id) AS (SELECT id FROM c WHERE supersedes IS NULL UNION SELECT c.id FROM g JOIN c ON c.supersedes = g.id) SELECT id, id IN (SELECT id FROM g) AS valid FROM c""",
        "question_owner": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'contested' ELSE 'resolved' END AS status, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
        "question_status": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'contested' WHEN bool_or(o_totalprice > 490000) THEN 'unknown' ELSE 'resolved' END AS status, CASE WHEN count(DISTINCT o_orderstatus) = 1 AND NOT bool_or(o_totalprice > 490000) THEN min(o_orderstatus) END AS value FROM orders GROUP BY 1",
        "question_commitments": f"""WITH {project}, m AS (SELECT o_custkey, done_us > deadline_us AS o FROM p) SELECT o_custkey, CASE WHEN count(*) FILTER (o IS NULL) > 0 THEN 'unknown' WHEN count(*) FILTER (o) > 0 THEN 'resolved' ELSE 'empty' END AS status, count(*) FILTER (o) AS "true", count(*) FILTER (o IS NULL) AS "unknown" FROM m GROUP BY 1""",
        "question_overdue": f"WITH {project} SELECT o_orderkey, done_us - deadline_us AS late_us FROM p WHERE done_us > deadline_us",
        "question_risks": """WITH m AS (SELECT o_custkey, o_orderpriority = '1-URGENT' AND o_totalprice > 200000 AS r, o_totalprice > 900 AS c FROM orders) SELECT o_custkey, CASE WHEN NOT bool_and(c) THEN 'incomplete' WHEN bool_or(r) THEN 'resolved' ELSE 'empty' END AS status, count(*) FILTER (r) AS "true", count(*) FILTER (r IS NULL) AS "unknown" FROM m GROUP BY 1""",
        "dependency_risk_lag": f"WITH {project}, f AS (SELECT DISTINCT o_custkey, first_value(done_us) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS launch FROM p) SELECT o_orderkey, done_us - launch AS lag_us, done_us - launch > 0 AS at_risk FROM p JOIN f USING (o_custkey)",
        "next_transition": f"WITH {_COUNTED} SELECT partition_key, claim_key, least(min(f) FILTER (f > {_AT_US}), min(t) FILTER (t > {_AT_US} AND t < 9223372036854775807)) AS next_us FROM counted GROUP BY ALL",
        "keyed_aggregate": 'SELECT l_suppkey, count(*) AS n, count(q) AS known, count(*) - count(q) AS missing, count(DISTINCT q) AS "distinct", sum(q) AS total, min(q) AS least, max(q) AS greatest FROM (SELECT l_suppkey, CASE WHEN l_quantity > 2 THEN l_quantity END AS q FROM lineitem) GROUP BY 1',
        "delta_equals_full": "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
        "log_continuity": "SELECT partition_key, lower(trim(claim_key)) AS claim_key, min(version) AS first, max(version) AS last, count(DISTINCT version) AS present, max(version) - min(version) + 1 - count(DISTINCT version) AS missing FROM claims WHERE version IS NOT NULL GROUP BY 1, 2",
        "round_robin_due": f"""WITH c AS (SELECT DISTINCT id, tenant_id, importance, created_at FROM claims WHERE lower(trim(status)) = 'candidate') SELECT id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY floor(importance * 10) + floor(({_AT_US} - epoch_us(created_at)) / 2592000000000) DESC NULLS LAST, created_at, id) AS tenant_rank FROM c""",
        "debounce_due": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 21600000000 THEN 1 ELSE 0 END AS n FROM events), b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, min(t) AS first_us, count(*) AS changes, least(max(t) + 21600000000, min(t) + 86400000000) AS due_us FROM b GROUP BY user_id, b""",
        "hotness_window": """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, lag(day) OVER w AS pd, lag(n) OVER w AS pn FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day)), q AS (SELECT user_id, day, n, CASE WHEN day - pd = 1 THEN pn ELSE 0 END AS b FROM p)
SELECT user_id, CAST(day AS VARCHAR) AS day, n, b AS "before", CASE WHEN n >= 4 OR (n >= 2 AND b >= 4) THEN 'hot' ELSE 'cold' END AS mode FROM q""",
        "capacity_rollup": "SELECT tenant_id, event_type, CAST(grouping(tenant_id, event_type) AS INT) AS level, count(*) AS n, count(*) FILTER (archived_at IS NULL) AS live FROM memory_events GROUP BY ROLLUP (tenant_id, event_type)",
        "retry_backoff": "WITH a AS (SELECT id, count(*) AS attempts FROM memory_events GROUP BY id) SELECT attempts, count(*) AS n, least(300.0, pow(2.0, least(9, greatest(0, attempts - 1)))) AS delay_s FROM a GROUP BY attempts",
    }
