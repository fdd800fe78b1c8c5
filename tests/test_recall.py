"""Questions, evidence, episodes, queues and experiments by brute force and at their edges."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from annalist.functions import questions
from annalist.functions.text import anchors
from annalist.functions.time import NO_END
from annalist.operators import consolidate, evaluate, evidence, ontology
from annalist.sources import queue


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clauses(spark):
    texts = ['budget and "salt and pepper" (a, b), deadline', "预算、期限以及“甲与乙”与地点", "android versus ios; band", "", None, "alone.", "and , and"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(questions.clauses("t").alias("c")).collect()]
    assert got == [["budget", '"salt and pepper" (a, b)', "deadline"], ["预算", "期限", "“甲与乙”", "地点"], ["android", "ios", "band"], [], None, ["alone"], []]


def test_facets(spark):
    texts = ["Can you recommend hotels for me?", "How many books did I buy last week?", "How many did I buy last week?", "How many cities got visited in total", "Is there any advice", "recommend my parties", None, ""]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(questions.facet("t").alias("f")).collect()]
    assert [f and f.name for f in got] == ["personal_context", "acquisition", None, "attendance", None, "personal_context", None, None]
    assert "hotel" in got[0].terms and "hotels" in got[0].terms and got[0].groups == [list(questions.PREFERENCES)]
    assert set(got[1].groups[1]) == {"books", "book"} and "cities" in got[3].groups[1] and "city" in got[3].groups[1] and "party" in got[5].terms


def test_quoted_words_are_anchors(spark):
    texts = ['who sang "The Who" never', 'the "a" list', "not 2026 plan", "“不是”的 plan"]
    got = [r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").select(anchors("t").alias("a")).collect()]
    assert got[0] == ["who", "sang"] and got[1] == ["a", "list"] and got[2] == ["plan"] and "不" in got[3]


@pytest.mark.parametrize(("independent", "one_revision"), [(False, False), (True, False), (False, True), (True, True)])
def test_proofs_by_brute_force(spark, independent, one_revision):
    r = random.Random(7)
    alternatives = [(f"c{c}", f"f{f}", f"a{a}", f"e{r.randrange(6)}") for c in range(12) for f in range(r.randrange(1, 3)) for a in range(r.randrange(1, 4)) for _ in range(r.randrange(1, 3))]
    links = [(f"c{c}", f"e{e}", f"s{r.randrange(4)}", r.choice(["x", "y", "z", None]), r.choice(["1", "1", "2", None]), lo := r.randrange(30), r.choice([None, lo + r.randrange(20)])) for c in range(12) for e in range(6) if r.random() < 0.85]
    got = evidence.proofs(spark.createDataFrame(alternatives, "case string, field string, alternative string, evidence string"), spark.createDataFrame(links, "case string, evidence string, source string, family string, revision string, lo bigint, hi bigint"), independent, one_revision)
    want = []
    for c in sorted({a[0] for a in alternatives}):
        link = {x[1]: x for x in links if x[0] == c}
        fields = {}
        for _, f, a, e in (x for x in alternatives if x[0] == c):
            fields.setdefault(f, {}).setdefault(a, set()).add(e)

        def apart(es):
            families = {link[e][3] for e in es}
            return None not in families and len(families) >= 2 and len(families) == len({link[e][2] for e in es})

        spans = []
        for chosen in product(*(list(f.values()) for f in fields.values())):
            es = set().union(*chosen)
            if not all(e in link for e in es) or independent and not (apart(es) and all(map(apart, chosen))):
                continue
            if one_revision and (len({link[e][4] for e in es}) != 1 or None in {link[e][4] for e in es}):
                continue
            lo, hi = max(link[e][5] for e in es), min(NO_END if link[e][6] is None else link[e][6] for e in es)
            if lo < hi:
                spans.append((lo, hi))
        merged = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        want += [(c, "supported", len(spans), *m) for m in merged] or [(c, "unsupported", 0, None, None)]
    assert rows(got) == sorted(want, key=repr)


def test_too_many_proofs_are_told(spark):
    alternatives = [("c", f"f{f}", f"a{a}", "e") for f in range(3) for a in range(7)]
    links = spark.createDataFrame([("c", "e", "s", "x", "1", 0, 9)], "case string, evidence string, source string, family string, revision string, lo bigint, hi bigint")
    df = spark.createDataFrame(alternatives, "case string, field string, alternative string, evidence string")
    assert rows(evidence.proofs(df, links)) == [("c", "over_budget", 0, None, None)]
    assert evidence.proofs(df.limit(0), links).count() == 0


def test_best_branch(spark):
    df = lambda data: spark.createDataFrame(data, "case string, evidence string")
    branches = spark.createDataFrame([("a", "1", "x"), ("a", "1", "y"), ("a", "2", "z"), ("b", "1", "x"), ("a", "1", "x")], "case string, branch string, evidence string")
    got = evidence.best_branch(branches, df([("a", "x"), ("a", "z"), ("b", "x")]), df([("a", "x"), ("a", "y")]))
    assert rows(got) == [("a", 0.5, False, 1), ("b", None, False, 1)]


def test_attached_in_three_ways(spark):
    runs = spark.createDataFrame([("u", "r1"), ("u", "r2"), ("v", "r3"), ("v", None)], "scope string, run string")
    decisions = spark.createDataFrame([("u", "d1", "r1"), ("v", "d2", None), ("u", "d3", None)], "scope string, id string, run string")
    outcomes = spark.createDataFrame([("u", "o1", "r2", "d1", None, True), ("u", "o2", None, None, None, True), ("v", "o3", None, None, None, True), ("v", "o4", None, None, "o3", False), ("v", "o5", "gone", "d2", None, True), ("u", "o6", "r1", None, None, True), ("u", "o7", "r1", None, "o6", True)], "scope string, id string, run string, decision_id string, corrects string, active boolean")
    assert rows(consolidate.attached(runs, decisions, outcomes)) == [("u", "r1", "decision", "d1"), ("u", "r1", "outcome", "o1"), ("u", "r1", "outcome", "o7"), ("u", "r2", "outcome", "o1"), ("v", "r3", "decision", "d2"), ("v", "r3", "outcome", "o3"), ("v", "r3", "outcome", "o5")]


def test_reward_keys(spark):
    episodes = spark.createDataFrame([("a", "1", "o1"), ("a", "2", "o2"), ("b", "1", "o1"), ("b", "2", "o3"), ("c", "1", None), ("d", "1", "o1"), ("d", "1", "o2")], "scope string, run string, outcome_id string")
    rewards = spark.createDataFrame([("o1", "x", "1"), ("o2", "x", "1"), ("o3", "x", "2")], "outcome_id string, definition string, version string")
    assert rows(consolidate.reward_keys(episodes, rewards)) == [("a", 2, "comparable", "x/1"), ("b", 2, "incompatible", None), ("c", 1, "incomplete", None), ("d", 1, "incomplete", None)]


def test_common_sequences(spark):
    def run(scope, name, actions, source, fail=False):
        return [(scope, name, i, a, fail and i == 1, f"{source}{i}") for i, a in enumerate(actions)]

    data = [*run("a", "1", "xy", "p"), *run("a", "2", "xy", "q"), *run("a", "3", "xz", "r", True), *run("a", "4", "x" * 40, "s"), *run("b", "1", "xy", "p"), *run("b", "2", "xz", "q"), *run("c", "1", "xy", "p"), *run("c", "2", "xy", "p"), *run("d", "1", "xy", "p"), ("d", "2", 5, "x", False, "u"), ("d", "2", 5, "y", False, "w")]
    df = spark.createDataFrame(data, "scope string, run string, at int, action string, failed boolean, source string")
    got = consolidate.common_sequences(df, "scope", "run", ["at"], "action", F.col("failed"), "source", 2)
    assert rows(got) == [("a", 4, 2, 1, 1, "candidate", "x>y"), ("b", 2, 2, 0, 0, "conflicting", None), ("c", 2, 2, 0, 0, "shared_sources", None), ("d", 2, 1, 0, 0, "too_few", None)]


def test_projection_problems(spark):
    data = [("1", '{"$ontology": {"subject": {"id": "s", "class": "dog"}, "predicate": "owns", "object": {"id": "o", "class": "toy"}}}'), ("2", "no json"), ("3", None), ("4", '{"other": 1}'), ("5", '{"$ontology": {"predicate": "owns"}}'), ("6", '{"$ontology": {"subject": {"id": "s", "class": "dog"}, "predicate": "age", "object": {"id": "o", "class": "toy"}}}'), ("7", '{"$ontology": {"subject": {"id": "s", "class": "dog"}, "predicate": "owns", "object": {"id": "o", "class": "dog"}}}')]
    claims = spark.createDataFrame([(i, "p", "active", v, 0) for i, v in data] + [("8", "p", "archived", data[0][1], 0)], "id string, partition_key string, status string, value_json string, from_us bigint")
    properties = spark.createDataFrame([("owns", "animal", "thing"), ("age", "animal", None)], "predicate string, domain_class string, range_class string")
    below = spark.createDataFrame([("dog", "animal"), ("dog", "dog"), ("toy", "thing")], "child string, parent string")
    got = {r.id: (r.problem, r.assertion_id is not None) for r in ontology.projected(claims, properties, below).collect()}
    assert got == {"1": (None, True), "5": ("incomplete", False), "6": ("needs_literal", False), "7": ("outside_range", False)}


def test_queue_of_steps(spark):
    second = 1_000_000
    data = [
        ("a", 0, "enqueue", 0, None, "t", 1), ("a", 1, "claim", 1 * second, 5 * second, None, None), ("a", 2, "ack", 2 * second, 5 * second, None, None),
        ("b", 0, "enqueue", 0, None, "t", 2), ("b", 1, "claim", 1 * second, 5 * second, None, None), ("b", 1, "claim", 1 * second, 5 * second, None, None),
        ("c", 0, "enqueue", 0, None, "t", 3), ("c", 1, "claim", 1 * second, 5 * second, None, None), ("c", 2, "fail", 3 * second, None, None, None),
        ("d", 0, "enqueue", 0, None, "u", 0), ("d", 1, "cancel", 1 * second, None, None, None), ("e", 1, "claim", 0, 9 * second, None, None), ("f", 0, "enqueue", 9 * second, None, "u", 9),
        ("g", 0, "enqueue", 0, None, "u", 1),
    ]
    log = spark.createDataFrame(data, queue.LOG)
    at = lambda t: {r.job: (r.status, r.attempts, r.due_us) for r in queue.folded(log, t * second).collect()}
    assert at(3) == {"a": ("done", 1, None), "b": ("leased", 1, None), "c": ("pending", 1, 4 * second), "d": ("cancelled", 0, None), "g": ("pending", 0, 0)}
    assert at(6)["b"] == ("pending", 1, 5 * second)
    taken = queue.leases(log, 6 * second, 2, 10 * second)
    assert [(r.job, r.seq) for r in taken.orderBy("job").collect()] == [("c", 3), ("g", 1)]
    after = log.unionByName(taken)
    assert {r.job: r.status for r in queue.folded(after, 7 * second).collect()}["c"] == "leased" and {r.job for r in queue.leases(after, 7 * second, 9, second).collect()} == {"b"}
    late = spark.createDataFrame([("x", 0, "enqueue", 0, None, "t", 1), ("x", 1, "claim", 0, 5, None, None), ("x", 2, "claim", 6, 9, None, None), ("x", 3, "ack", 7, 5, None, None), ("x", 4, "ack", 8, 9, None, None)], queue.LOG)
    assert rows(queue.fenced(late)) == [("x", 4)]
    assert queue.folded(log.limit(0), 1).count() == 0


def test_arms(spark):
    items = spark.createDataFrame([(1,), (2,)], "q int")

    def good(asked):
        return asked.filter("q = 1")

    def bad(asked):
        raise ValueError

    out = evaluate.run_arms(items, "q", {"good": good, "bad": bad}, lambda asked, found: found.withColumn("score", F.lit(0.5)))
    assert rows(out) == [("bad", 1, "failed", None), ("bad", 2, "failed", None), ("good", 1, "completed", 0.5), ("good", 2, "empty", None)]
    assert rows(evaluate.arm_means(out)) == [("bad", 2, 0, 0.0, None), ("good", 2, 1, 0.25, 0.5)]


def test_kept_until_its_files_change(spark, tmp_path):
    from annalist.session import kept

    made = []

    def make():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "t")).groupBy().count()

    spark.range(3).write.parquet(str(tmp_path / "t"))
    first = [kept(spark, "x", [str(tmp_path / "t")], make).first()[0] for _ in range(2)]
    spark.range(4).write.mode("append").parquet(str(tmp_path / "t"))
    assert first == [3, 3] and kept(spark, "x", [str(tmp_path / "t")], make).first()[0] == 7 and len(made) == 2


def test_changes_by_group_and_comparisons(spark):
    from annalist.operators import questions as standing

    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), (None, 5)], "g string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 2), ("d", 1), (None, 5)], "g string, v int")
    assert rows(standing.changed_groups(old, new, ["g"], ["v"])) == sorted([("a", "same"), ("b", "changed"), ("c", "removed"), ("d", "added"), (None, "same")], key=repr)
    schema = "g string, score double, cost double, late bigint"
    before = spark.createDataFrame([("a", 1.0, 10.0, 5), ("b", 1.0, 10.0, 5), ("c", 1.0, 1.0, 1), ("d", 0.0, 0.0, 0)], schema)
    after = spark.createDataFrame([("a", 0.5, 10.0, 5), ("b", 1.0, 12.0, 5), ("d", 0.0, 5.0, 3), ("e", 1.0, 1.0, 1)], schema)
    got = {r.g: (r.verdict, r.cost_ratio) for r in evaluate.compared(before, after, ["g"], "score", "cost", "late").collect()}
    assert got == {"a": ("regression", 1.0), "b": ("too_costly", 1.2), "c": ("incomplete", None), "d": ("accepted", None), "e": ("incomplete", None)}
