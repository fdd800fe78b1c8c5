"""The operators of the store: edge cases, hot keys, and what SQL can't show."""

import random
import re
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist.functions import calc, text
from annalist.operators import consolidate, evaluate, fusion, governance, graph, questions, rules, scope, search, vectors, versions
from annalist.plans.standing import Ambiguous, Question, StandingQuestions, patched
from annalist.plugins import Manifest, Registry
from annalist.sources import blobs, snapshots


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms_and_anchors(spark):
    df = spark.createDataFrame([("Straße 中文字 a1-b2", ), ("", ), (None, )], "t string")
    got = [sorted(r.x) if r.x is not None else None for r in df.select(text.terms("t").alias("x")).collect()]
    assert got == [sorted(["strasse", "中", "文", "字", "中文", "文字", "a1", "b2"]), [], None]
    assert [r.x for r in df.select(text.token_estimate("t").alias("x")).collect()] == [7, 1, 1]
    assert spark.range(1).select(text.anchors(F.lit("What is the plan of 2026 for Plan B")).alias("x")).collect()[0].x == ["plan", "b"]


def test_chunks_reach_the_end(spark):
    docs = [(i, "x" * n, "clash") for i, n in enumerate([0, 1, 1024, 1025, 1920, 1921, 5000])] + [(9, None, "clash")]
    got = search.chunks(spark.createDataFrame(docs, "doc_id int, text string, chunk string"), "doc_id", "text").collect()
    for i, t, _ in docs:
        own = sorted((r.span_start, r.span_end) for r in got if r.doc_id == i)
        if not t:
            assert own == []
            continue
        assert own[0][0] == 0 and own[-1][1] == len(t) and all(b[0] - a[0] == 896 for a, b in zip(own, own[1:])) and all(e < len(t) for _, e in own[:-1])


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta"), (3, ""), (4, None), (4, None)], "doc_id int, text string")
    posted = search.postings(docs, ["doc_id"], "text")
    n, mean = search.statistics(posted, docs)
    asked = spark.createDataFrame([(7, "alpha"), (7, "gone"), (8, "none")], "query_id int, term string")
    got = search.bm25(posted, "doc_id", asked, n, mean).collect()
    assert [(r.query_id, r.doc_id, r.hits) for r in got] == [(7, 1, 1)] and got[0].score > 0
    empty = docs.limit(0)
    assert search.statistics(search.postings(empty, ["doc_id"], "text"), empty) == (0, 1.0)


def test_bm25_asks_with_every_anchor(spark, tmp_path):
    import math

    from annalist.queries import retrieval

    r = random.Random(5)
    words = [f"w{i:02}" for i in range(30)]
    texts = {i: r.choices(words, [1 / (k + 1) for k in range(30)], k=r.randrange(30, 60)) for i in range(150)}
    spark.createDataFrame([(i, " ".join(t), "s", "en") for i, t in texts.items()], "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    mean, df = sum(map(len, texts.values())) / 150, {w: sum(w in t for t in texts.values()) for w in words}
    want = {}
    for q in (0, 50, 100):
        asked = set(texts[q])
        assert len(asked) > 6
        for i, t in texts.items():
            if both := asked & set(t):
                score = sum(math.log(1 + (150 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in both)
                want[q, i] = (score, len(both), len(both) / len(asked))
    top = {(x.query_id, x.rank): x for x in retrieval.bm25_topk(spark, str(tmp_path)).collect()}
    for q in (0, 50, 100):
        best = sorted((-round(s, 6), i) for (k, i), (s, _, _) in want.items() if k == q)[:20]
        assert [(top[q, n + 1].doc_id, round(top[q, n + 1].score, 5)) for n in range(20)] == [(i, round(-s, 5)) for s, i in best]
    assert rows(retrieval.query_coverage(spark, str(tmp_path))) == sorted(((q, i, round(c, 6)) for (q, i), (_, _, c) in want.items()), key=repr)
    assert {(x.query_id, x.doc_id) for x in retrieval.bm25_gated_groups(spark, str(tmp_path)).collect()} == {k for k, (_, _, c) in want.items() if c == 1}
    routes = [(q, f"{i}", -round(s, 6), x) for (q, i), (s, _, c) in want.items() for x in ["literal"] * (2 * c >= 1) + ["probe"]]
    merged = fusion.merged_routes({"literal": 3, "probe": 1}, 12)
    assert rows(retrieval.route_merge(spark, str(tmp_path))) == sorted(((k, *x) for k in (0, 50, 100) for x in merged((i, s, x) for q, i, s, x in sorted(routes, key=lambda r: (r[2], r[1])) if q == k)), key=repr)
    rarest = {(x.query_id, x.term) for x in retrieval.rarest_anchor(spark, str(tmp_path)).collect()}
    assert rarest == {(q, w) for q in (0, 50, 100) for w in set(texts[q]) if df[w] == min(df[v] for v in texts[q])}


def test_fusion_leaves_out_contradictions(spark):
    df = spark.createDataFrame([("q", "a", "m1", 1, ["x"], "t"), ("q", "a", "m2", 2, ["y"], "t"), ("q", "a", "m2", 5, ["y"], "t"), ("q", "b", "m1", 2, ["x"], "t"), ("q", "b", "m2", 1, ["x"], "other"), ("q", "c", "m1", 3, ["z"], None)], "g string, id string, method string, rank int, evidence array<string>, said string")
    got = {r.id: r for r in fusion.fuse(df, ["g"], "id", ["said"]).collect()}
    assert set(got) == {"a", "c"} and got["a"].evidence == ["x", "y"] and abs(got["a"].score - (1 / 61 + 1 / 62)) < 1e-12


def test_greedy_selections(spark):
    r = random.Random(3)
    items = [(r.choice("ab"), f"i{i}", r.choice(["event", "claim", "latent"]), r.random(), r.choice("xyz"), r.randrange(1, 9)) for i in range(80)]
    df = spark.createDataFrame(items, "g string, id string, kind string, score double, source string, size int")
    got = rows(fusion.greedy(df, ["g"], ["id", "score", "size"], "g string, id string, position int, used int", fusion.within_budget(30)))
    want = []
    for g in "ab":
        used = k = 0
        for _, i, _, s, _, n in sorted((x for x in items if x[0] == g), key=lambda x: (-x[3], x[1])):
            if used + n <= 30:
                used, k = used + n, k + 1
                want.append((g, i, k, used))
    assert got == sorted(want, key=repr)
    kept = fusion.greedy(df, ["g"], ["id", "kind", "score", "source"], "g string, id string, position int", fusion.diverse).join(df.drop("g"), "id").collect()
    for g in "ab":
        own = [x for x in kept if x.g == g]
        assert len(own) <= 8 and all(sum(x.source == s for x in own) <= 2 for s in "xyz") and sum(x.kind == "latent" for x in own) <= 1
    assert fusion.greedy(df.limit(0), ["g"], ["id", "score", "size"], "g string, id string, position int, used int", fusion.within_budget(3)).count() == 0


def test_vectors(spark):
    bad = [[1.0, float("nan")], [0.0, 0.0], None, [1.0, None], [float("inf"), 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*bad, [3.0, 4.0], [1e200, 0.0]])], "vec_id bigint, embedding array<double>")
    ok = df.filter(vectors.usable("embedding")).select("vec_id", vectors.normalised("embedding").alias("v"))
    assert rows(ok) == [(5, [0.6, 0.8]), (6, [1.0, 0.0])]
    asked = ok.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    assert [(r.query_id, r.vec_id) for r in vectors.nearest(asked, ok, 3, block=1).orderBy("query_id").collect()] == [(5, 6), (6, 5)]
    assert vectors.nearest(asked.limit(0), ok, 3).count() == 0


def test_list_index(spark):
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 16)) * 3
    x = centres[r.integers(0, 20, 1500)] + r.normal(size=(1500, 16))
    x[:500] = centres[0] + 0.3 * r.normal(size=(500, 16))  # a third of all in one list
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    unit = df.select("vec_id", vectors.normalised("embedding").alias("v"))
    asked = unit.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    exact = {(a.query_id, a.vec_id) for a in vectors.nearest(asked, unit, 10).collect()}
    index = vectors.ListIndex(unit)
    probes = index.probes_for(asked, 10)
    found = {(a.query_id, a.vec_id) for a in index.search(asked, 10, probes).collect()}
    assert len(exact) == 300 and len(exact & found) >= 270 and probes < len(index.centres)
    assert {(a.query_id, a.vec_id) for a in index.search(asked, 10, len(index.centres)).collect()} == exact
    even = unit.filter("vec_id % 2 = 0").select("vec_id").crossJoin(asked.select("query_id"))
    got = vectors.visible_nearest(index, asked, even, 3, len(index.centres)).collect()
    assert got and all(a.vec_id % 2 == 0 for a in got)
    assert vectors.ListIndex(unit.limit(0)).search(asked, 3, 1).count() == 0


def test_three_valued_rules(spark):
    df = spark.createDataFrame([(1, "a", True, dt(2026, 6, 1)), (None, None, None, None)], "n int, s string, b boolean, t timestamp")
    types = dict(df.dtypes)

    def value(tree):
        return [r.x for r in df.select(rules.condition(tree, types).alias("x")).collect()]

    assert value({"op": "eq", "attr": "n", "value": 1}) == [True, None]
    assert value({"op": "eq", "attr": "n", "value": True}) == [None, None] and value({"op": "eq", "attr": "n", "value": "1"}) == [None, None]
    assert value({"op": "or", "of": [{"op": "eq", "attr": "n", "value": 1}, {"op": "eq", "attr": "gone", "value": 1}]}) == [True, None]
    assert value({"op": "and", "of": [{"op": "eq", "attr": "n", "value": 2}, {"op": "eq", "attr": "gone", "value": 1}]}) == [False, None]
    assert value({"op": "not", "of": {"op": "in", "attr": "s", "value": ["a", 5]}}) == [False, None]
    assert value({"op": "weekday", "attr": "t", "value": [0]}) == [True, None]
    assert value({"op": "and", "of": []}) == [True, True]
    applies = [r.x for r in df.select(rules.applicable([F.lit(None).cast("boolean")], [F.lit(True)]).alias("x")).collect()]
    assert applies == [False, False]


def test_graph_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("y",)], "node string")
    assert rows(graph.reachable(edges, roots, 8)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("y", "y", 0)]
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).filter("id IS NOT NULL").distinct()
    needs = edges.filter("src IS NOT NULL").select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    assert rows(graph.valid_from_roots(nodes, needs)) == [("a", False), ("b", False), ("c", False), ("d", False), ("x", True), ("y", True)]


def test_closure_has_no_depth(spark, tmp_path):
    from annalist.queries import graphs

    spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(14)] + [("x", "y"), ("y", "x")], "id string, supersedes string").write.parquet(f"{tmp_path}/claims.parquet")
    spark.createDataFrame([("e", dt(2026, 1, 1)), ("f", None)], "id string, archived_at timestamp").write.parquet(f"{tmp_path}/memory_events.parquet")
    spark.createDataFrame([("c0", "e"), ("x", "e"), ("z", "f")], "claim_id string, event_id string").write.parquet(f"{tmp_path}/claim_sources.parquet")
    assert rows(graphs.invalidation_closure(spark, str(tmp_path))) == sorted([(f"c{i}", i) for i in range(14)] + [("x", 0), ("y", 1)], key=repr)


def test_validity_of_long_lines(spark):
    r = random.Random(2)
    needs = [(f"a{i}", f"a{i - 1}") for i in range(1, 90)] + [("x", "y"), ("y", "x"), ("z", "y"), ("lost", "gone"), ("after", "lost"), ("self", "self")]
    needs += [(f"m{i}", r.choice([f"a{r.randrange(90)}", f"m{r.randrange(i)}", "z" if r.random() < 0.1 else "a5"])) for i in range(1, 40) for _ in range(2)] + [("m0", "a89")]
    names = sorted({a for a, _ in needs} | {"a0"})
    good, grown = set(), True
    while grown:
        grown = {x for x in names if x not in good and all(p in good for a, p in needs if a == x)}
        good |= grown
    got = graph.valid_from_roots(spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(needs, "id string, parent string"))
    assert {(x.id, x.valid) for x in got.collect()} == {(x, x in good) for x in names} and "a89" in good and "x" not in good


def test_groups_die_along_long_chains(spark):
    members = [(f"g{i:02}", f"i{j:02}") for i in range(24) for j in (i, i + 1)] + [("h", "k")]
    alive = [(f"i{j:02}",) for j in range(1, 25)] + [("k",)]
    got = fusion.complete_groups(spark.createDataFrame(members, "g string, i string"), spark.createDataFrame(alive, "i string"), "g", "i")
    assert rows(got) == [("h",)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("n1", None)]
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = sorted((x, find(x)) for x in parent)
    got = rows(graph.components(spark.createDataFrame(pairs, "a string, b string")))
    assert got == want


def test_closure_has_no_bound(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("n60", "n50"), ("x", None), (None, "y"), ("m0", "n30")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.depth for r in graph.closure(df, spark.createDataFrame([("n0",), ("m0",), (None,)], "node string"), cut_every=7).collect()}
    want = {f"n{i}": i for i in range(30)} | {f"n{30 + i}": 1 + i for i in range(31)} | {"m0": 0}
    assert got == want
    assert graph.closure(df, df.selectExpr("src AS node").limit(0)).count() == 0


def test_paths_and_budget(spark):
    edges = [("r", "p", "a"), ("r", "q", "a"), ("r", "p", "b"), ("a", "p", "c"), ("b", "p", "c"), ("c", "p", "r"), ("c", "p", "d")]
    df = spark.createDataFrame(edges, "src string, predicate string, dst string")
    root = spark.createDataFrame([("r",)], "node string")
    got = {r.node: (r.depth, " ".join(r.path)) for r in graph.paths(df, root, 3).collect()}
    assert got == {"r": (0, "r"), "a": (1, "r p a"), "b": (1, "r p b"), "c": (2, "r p a p c"), "d": (3, "r p a p c p d")}
    assert sorted(r.node for r in graph.paths(df, root, 3, most_nodes=3).collect()) == ["a", "b", "r"]


def test_chain_rule_goes_on(spark):
    facts = [(f"n{i}", "under", f"n{i + 1}", 0.9, i, None) for i in range(12)]
    df = spark.createDataFrame(facts, "subject string, predicate string, object string, confidence double, valid_from bigint, valid_to bigint")
    got = {(r.subject, r.object): r.valid_from for r in graph.chain_rule(df, "under", "under", "under").collect()}
    assert got == {(f"n{i}", f"n{j}"): j - 1 for i in range(13) for j in range(i + 2, 13)}


def test_contradictions(spark):
    r = random.Random(5)
    facts = [(r.choice("kl"), f"f{i:02}", r.choice("uvw"), a := r.randrange(40), a + r.randrange(0, 9)) for i in range(60)]
    df = spark.createDataFrame(facts, "key string, id string, value string, lo bigint, hi bigint")
    want = sorted({(x[0], x[1]) for x in facts for y in facts if x[0] == y[0] and x[2] != y[2] and x[3] <= y[4] and y[3] <= x[4]})
    assert rows(graph.contradictions(df, ["key"], "value", "lo", "hi", "id")) == want
    assert rows(graph.contradictions(df, ["key"], "value", "lo", "hi", "id", hot_rows=7)) == want
    assert graph.contradictions(df.limit(0), ["key"], "value", "lo", "hi", "id").count() == 0


def test_scopes(spark):
    df = spark.createDataFrame([("t", "n", "u", None, None, None, 1), ("t", "n", None, None, "w", None, 2), ("t", "n", "u", "g", None, None, 3), ("o", "n", None, None, None, None, 4)], "tenant_id string, namespace string, user_id string, agent_id string, workspace_id string, session_id string, k int")
    seen = lambda **s: sorted(r.k for r in df.filter(scope.visible({"tenant_id": "t", "namespace": "n", **s})).collect())
    assert seen(user_id="u") == [1] and seen(user_id="u", agent_id="g", workspace_id="w") == [1, 2, 3] and seen() == []
    first = scope.first_of(spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 1, "z")], "key string, at int, v string"), ["key"], ["at"])
    assert rows(first) == sorted([("a", 1, "y"), (None, 1, "z"), (None, 1, "z")], key=repr)
    page = spark.createDataFrame([(i // 2, i) for i in range(9)], "at int, id int")
    assert [r.id for r in scope.page_after(page, ["at", "id"], (3, 6), 3).collect()] == [5, 4, 3]


def test_versions(spark):
    obs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "y"), (None, 1, "z")], "key string, at int, v string")
    got = versions.scd2(obs, ["key"], ["at"], "v").orderBy("key", "version").collect()
    assert [(r.key, r.v, r.valid_from, r.valid_to, r.supersedes, r.corroborations) for r in got] == [(None, "z", 1, None, None, 0), ("a", "x", 1, 3, None, 1), ("a", None, 3, 5, 1, 1), ("a", "y", 5, None, 2, 0)]
    nums = spark.createDataFrame([("p", n) for n in (1, 2, 2, 5, 8)] + [("q", 3)], "key string, n int")
    assert rows(versions.gaps_in_sequence(nums, ["key"], "n")) == [("p", 3, 4), ("p", 6, 7)] and rows(versions.contiguous_prefix(nums, ["key"], "n")) == [("p", 2), ("q", 0)]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_percentiles(spark, n):
    r = random.Random(n)
    values = [("g", r.choice([r.randrange(50), r.random() * 1000])) for _ in range(n)] + [("g", None), ("empty", None)]
    df = spark.createDataFrame([(g, float(v) if v is not None else None) for g, v in values], "g string, v double")
    own = sorted(float(v) for g, v in values if v is not None)
    got = {x.p: x.v for x in evaluate.exact_percentiles(df, ["g"], "v", [0.0, 0.5, 0.95, 1.0], 8).collect()}
    assert got == {p: own[max(1, -(-int(round(n * p * 1e9)) // 10**9)) - 1] for p in (0.0, 0.5, 0.95, 1.0)}


def test_bootstrap_is_repeatable_and_covers(spark):
    r = random.Random(1)
    df = spark.createDataFrame([("all", i % 40, r.gauss(1, 1)) for i in range(800)], "g string, c int, d double")
    a, b = (evaluate.bootstrap(df, ["g"], "c", "d").collect()[0] for _ in range(2))
    assert a == b and a.low < a.mean < a.high and 0.8 < a.low and a.high < 1.2


def test_allocation_of_unknown_costs(spark):
    costs = spark.createDataFrame([(1, ["a", "b"], 10.0), (2, [], 6.0), (3, ["b"], None)], "entry_id int, request_ids array<string>, value double")
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string")
    assert rows(evaluate.allocated(costs, req)) == [("a", 7.0, 7.0), ("b", 7.0, None), ("c", 2.0, 2.0)]


def test_batches_keep_slots_together(spark):
    r = random.Random(4)
    items = [(r.choice("tu"), f"s{r.randrange(30)}", i) for i in range(200)]
    got = governance.batches_of_slots(spark.createDataFrame(items, "g string, slot string, at bigint"), "g", "slot", "at", 12).collect()
    for g in "tu":
        order = sorted({s: min(i for h, t, i in items if (h, t) == (g, s)) for h, s, _ in items if h == g}.items(), key=lambda x: x[1])
        batch, used, want = 1, 0, {}
        for s, _ in order:
            n = sum((h, t) == (g, s) for h, t, _ in items)
            if used and used + n > 12:
                batch, used = batch + 1, 0
            used += n
            want[s] = (n, batch)
        assert {x.slot: (x.members, x.batch) for x in got if x.g == g} == want


def test_redaction_and_gates(spark):
    df = spark.createDataFrame([("mail a@b.example password=hunter22 http://u:p@h/ 123456789012",), (None,)], "t string")
    assert [r.t for r in df.select(governance.redacted("t").alias("t")).collect()] == ["mail [EMAIL] [SECRET] http://[LOGIN]@h/ [NUMBER]", None]
    g = spark.createDataFrame([(0.5,), (None,), (0.9,)], "x double").select(governance.gates({"x": (0.1, 0.8)}).alias("why")).collect()
    assert [r.why for r in g] == ["", "x_unmeasured", "x_high"]


def test_delta_equals_full_in_random_changes(spark):
    r = random.Random(9)
    old = [(i % 7, i, r.randrange(9)) for i in range(70)]
    new = [(k, i, v + (k == 3)) for k, i, v in old if i != 12] + [(8, 99, 1)]
    a, b = (spark.createDataFrame(x, "k int, i int, v int") for x in (old, new))
    full = lambda x: x.groupBy("k").agg(F.sum("v").alias("s"))
    assert rows(questions.refreshed(a, b, full(a), ["k"], ["i", "v"], full)) == rows(full(b))


def test_standing_questions(spark, tmp_path):
    made = []
    t = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    s = StandingQuestions(spark, str(tmp_path), {"t": t})

    def total(x):
        made.append("total")
        return x.groupBy("k").agg(F.sum("v").alias("v"))

    s.register(Question("total", ("t",), total, ("sum", "all")))
    s.register(Question("count", ("total",), lambda x: x.agg(F.count("*").alias("n")), ("all",)))
    assert s.read("sum").collect()[0].v == 5.0 and s.read("total").count() == 1 and made == ["total"]
    s.tables["t"] = t.limit(1)
    assert s.read("count").collect()[0].n == 1 and made == ["total", "total"] and s.history("total") == [1, 2]
    assert s.affected({"t"}) == ["total", "count"]
    with pytest.raises(Ambiguous):
        s.read("all")
    with pytest.raises(ValueError, match="missing|taken|cannot"):
        s.register(Question("late", ("nowhere",), total))
    assert [b["x"] for b in patched([{"x": 1}], "insert", 0, {"x": 0})] == [0, 1]
    with pytest.raises(ValueError, match="revision"):
        patched([], "append", block={}, revision=2, expected=1)


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", "s1", 1), ("b", "s2", None)], "id string, split string, v int")
    snapshots.export(df, str(tmp_path / "x"), "split", ["id", "v"])
    back = snapshots.load(spark, str(tmp_path / "x"), "id string, v int, split string", "split", ["id", "v"])
    assert rows(back.select("id", "v")) == [("a", 1), ("b", None)]
    spark.createDataFrame([("c", 3)], "id string, v int").write.mode("append").json(str(tmp_path / "x/rows/split=s1"))
    with pytest.raises(ValueError, match="manifest"):
        snapshots.load(spark, str(tmp_path / "x"), "id string, v int, split string", "split", ["id", "v"])
    v = snapshots.VersionedTable(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="promoted"):
        v.read()
    for _ in range(3):
        v.stage(df)
    v.promote(1)
    v.promote(3)
    assert v.current() == 3 and v.collect_garbage(1) == [1, 2] and v.read().count() == 2
    moved = snapshots.moved_home(df, df.withColumn("split", F.lit("s1")), "id", "split")
    assert [r.id for r in moved.collect()] == ["b"]


def test_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, c in (("a", b"one"), ("b", b"one"), ("c", b"two")):
        (tmp_path / "in" / n).write_bytes(c)
    blobs.store(blobs.blobs(spark, str(tmp_path / "in"), "u1"), str(tmp_path / "out"))
    blobs.store(blobs.blobs(spark, str(tmp_path / "in" / "a"), "u2"), str(tmp_path / "out"))
    assert blobs.fetch(spark, str(tmp_path / "out"), "u1").count() == 2 and [bytes(r.content) for r in blobs.fetch(spark, str(tmp_path / "out"), "u2").collect()] == [b"one"]


def test_plugins(spark):
    reg = Registry()
    reg.register(Manifest("shout", "function", 1), lambda s: s.upper(), spark)
    assert spark.sql("SELECT shout('a') AS x").collect()[0].x == "A"
    with pytest.raises(ValueError, match="kind"):
        reg.register(Manifest("x", "unheard", 1), len)
    with pytest.raises(ValueError, match="version"):
        reg.register(Manifest("shout", "function", 1), len)
    with pytest.raises(ValueError, match="lacks"):
        reg.checked(Manifest("r", "retriever", 1, ("id", "score")), spark.range(1))
    with pytest.raises(ValueError, match="more than"):
        reg.checked(Manifest("r", "retriever", 1, ("id",), 2), spark.range(3))


def test_calculations(spark):
    import uuid

    df = spark.createDataFrame([("x", 1, 2, 3, 3), ("é", 3, 3, 3, 3), ("", 1, 5, 2, 3)], "n string, a int, b int, c int, d int")
    got = df.select(calc.named_uuid(F.col("n")).alias("u"), calc.order_of(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("o")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in ("x", "é", "")] and [r.o for r in got] == ["before", "same", None]
    assert [r.x for r in spark.range(0, 12).select(questions.backoff(F.col("id").cast("int")).alias("x")).collect()] == [1, 1, 2, 4, 8, 16, 32, 64, 128, 256, 300, 300]


def test_episodes_and_chains(spark):
    ev = spark.createDataFrame([("s", None, 1, "a"), ("s", "u", 2, "b"), (None, "u", 3, "c"), (None, None, 4, "d")], "session string, user string, at int, kind string")
    got = {r.episode: (r.n, r.outcome) for r in consolidate.episodes(ev, ["session", "user"], ["at"], "kind").collect()}
    assert got == {"session:s": (2, "b"), "user:u": (1, "c")}
    seq = consolidate.step_sequences(spark.createDataFrame([("r", i, x) for i, x in enumerate("abc")] + [("q", 0, "a")], "run string, at int, act string"), "run", ["at"], "act", 4)
    assert [(r.run, r.sequence) for r in seq.collect()] == [("r", "a>b>c")]


def test_long_sessions_are_listed(spark, tmp_path):
    from annalist.queries import measures

    steps = {"a": 7, "b": 7, "c": 40, "d": 2, "e": 1}
    events = [(f"{s}{i:02}", s, f"k{i % 3}", dt(2026, 1, 1, i // 60, i % 60)) for s, n in steps.items() for i in range(n)]
    spark.createDataFrame(events, "id string, session_id string, event_type string, occurred_at timestamp").write.parquet(f"{tmp_path}/memory_events.parquet")
    of = lambda n: ">".join(f"k{i % 3}" for i in range(n))
    assert rows(measures.multi_step_procedures(spark, str(tmp_path))) == sorted([(of(7), 2), (of(40), 1), (of(2), 1)], key=repr)


def test_merged_routes_lend_their_turns():
    rows = [(f"l{i}", 0, "a") for i in range(2)] + [("l0", 0, "b")] + [(f"p{i}", 0, "b") for i in range(9)]
    got = fusion.merged_routes({"a": 3, "b": 1}, 6)(iter(rows))
    assert [r[0] for r in got] == ["l0", "l1", "p0", "p1", "p2", "p3"]
    assert fusion.merged_routes({"a": 3, "b": 1}, 6)(iter([])) == []


def test_evidence_pack_by_brute_force():
    r = random.Random(8)
    for trial in range(6):
        items = [(f"i{n:03}", r.choice([0.5, 0.9, r.random()]), r.randrange(5, 60), f"o{r.randrange(12)}", (lo := r.randrange(50)), lo + r.randrange(1, 50), r.choice("xyz"), " ".join(sorted(set(r.choices("abcdefg", k=r.randrange(4))))), f"i{r.randrange(70):03}" if r.random() < 0.2 else None) for n in range(60)]
        items.sort(key=lambda x: (-x[1], x[0]))
        low, high = min(0.0, *(x[1] for x in items)), max(x[1] for x in items)
        asked = set("".join(x[7] for x in items).replace(" ", ""))
        tight = sum(x[2] for x in items[:8]) > 200
        by_id, chosen, used = {x[0]: x for x in items}, [], 0

        def bare(x):
            return [p for p in range(x[4], x[5]) if not any(c[3] == x[3] and c[4] <= p < c[5] for c in chosen)]

        def unit(x):
            out = []
            while x not in chosen:
                if x in out:
                    return None
                out.append(x)
                if x[8] is None:
                    break
                if x[8] not in by_id:
                    return None
                x = by_id[x[8]]
            return [y for y in out if bare(y)]

        def gain(x):
            mine, seen = set(x[7].split()), set(" ".join(c[7] for c in chosen).split())
            new = len(mine - seen)
            again = max((len(mine & set(c[7].split())) / max(1, len(mine)) for c in chosen), default=0)
            cost = 0.1 * min(1, x[2] / max(1, (200 - used) / (8 - len(chosen)))) if tight else 0
            return (x[1] - low) / (high - low) + 0.02 * 0.5 * (len(mine) + new) / len(asked) + 0.08 * new / max(1, len(asked - seen)) - 0.08 * again + 0.005 * all(c[6] != x[6] for c in chosen) - 0.03 * (1 - len(bare(x)) / (x[5] - x[4])) - cost

        while len(chosen) < 8:
            fits = [x for x in items if x not in chosen and (u := unit(x)) and len(chosen) + len(u) <= 8 and used + sum(y[2] for y in u) <= 200]
            fits = [x for x in fits if (x[1] - low) / (high - low) >= max((y[1] - low) / (high - low) for y in fits) - 0.12]
            if not fits:
                break
            for y in unit(min(fits, key=lambda x: (-round(gain(x), 12), x[0]))):
                used += y[2]
                chosen.append(y)
        assert [x[0] for x in chosen] == [x[0] for x in fusion.evidence_pack(200)(iter(items))], trial
    assert fusion.evidence_pack(200)(iter([])) == []


@pytest.mark.parametrize("hot", [10**6, 7])
def test_numbered(spark, hot):
    from annalist.operators.ranks import numbered

    r = random.Random(6)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(12)]), i) for i in range(150)]
    df = spark.createDataFrame(data, "g string, v int, id int")
    for ties in (False, True):
        got = numbered(df, ["g"], [F.desc("v"), *([] if ties else ["id"])], "n", ties, hot_rows=hot).collect()
        for g, v, i in data:
            key = lambda x: (-(x[1] if x[1] is not None else -1), 0 if ties else x[2])  # noqa: B023, E731
            before = [x for x in data if x[0] == g and key(x) < key((g, v, i))]
            assert [x.n for x in got if x.id == i] == [len(before) + 1]
    assert [x.n for x in numbered(df, [], ["id"], "n", hot_rows=hot).orderBy("id").collect()] == list(range(1, 151))
    assert numbered(df.limit(0), ["g"], ["id"], "n").count() == 0


@pytest.mark.parametrize("hot", [10**6, 7])
def test_carried(spark, hot):
    from annalist.operators.ranks import carried

    r = random.Random(8)
    data = [(r.choice(["a", "a", "a", "b", None]), r.randrange(40), i, r.choice([None, None, f"v{i}"])) for i in range(150)]
    got = carried(spark.createDataFrame(data, "g string, t int, id int, v string"), ["g"], ["t", "id"], F.col("v"), "before", hot_rows=hot).collect()
    for g, t, i, _ in data:
        earlier = [x for x in data if x[0] == g and x[1:3] < (t, i) and x[3] is not None]
        assert [x.before for x in got if x.id == i] == [max(earlier, key=lambda x: x[1:3])[3] if earlier else None]


def test_grants_run_out_or_are_withdrawn(spark):
    reads = spark.createDataFrame([("u", f"r{t}", t) for t in (1, 5, 9, 12, 20, 30)] + [("v", "x", 3)], "u string, id string, at_us bigint")
    grants = spark.createDataFrame([("u", 5, 10), ("u", 11, 11), ("u", 15, None), ("u", 25, 28)], "u string, at_us bigint, until_us bigint")
    assert rows(scope.granted(reads, grants, ["u"])) == [("u", "r20", 20, None), ("u", "r5", 5, 10), ("u", "r9", 9, 10)]


def test_covered_by_union(spark):
    r = random.Random(2)
    spans = [(r.choice("ab"), a, a + r.randrange(0, 12)) for a in (r.randrange(60) for _ in range(40))]
    asked = [(r.choice("ab"), i, a, a + r.randrange(0, 20)) for i, a in enumerate(r.randrange(60) for _ in range(60))]
    got = fusion.covered_by_union(spark.createDataFrame(asked, "k string, id int, lo int, hi int"), spark.createDataFrame([*spans, ("a", None, 3)], "k string, lo int, hi int"), ["k"], "lo", "hi")
    want = [(k, i, a, b) for k, i, a, b in asked if a < b and all(any(s[0] == k and s[1] <= p < s[2] for s in spans) for p in range(a, b))]
    assert rows(got) == sorted(want, key=repr)


def test_excerpts(spark):
    import math

    r = random.Random(1)
    for _ in range(30):
        words = [r.choice(["alpha", "beta", "gamma", "x", "数据", "据"]) for _ in range(60)]
        text, asked, size = " ".join(words), ["alpha", "gamma", "数据", "gone"], 50
        at = sorted({(m.start(), t) for t in asked for m in re.finditer(t, text)})
        starts = sorted({0, *(min(max(0, a - size // 3), len(text) - size) for a, _ in at)})
        inside = [{t for a, t in at if s <= a and a + len(t) <= s + size} for s in starts]
        weight = {t: math.log1p((len(starts) + 0.5) / (sum(t in x for x in inside) + 0.5)) for t in asked}
        best = max(range(len(starts)), key=lambda i: (round(sum(weight[t] for t in inside[i]), 9), -starts[i]))
        assert search.excerpt(text, asked, size) == (starts[best], starts[best] + size)
    df = spark.createDataFrame([(1, "short", ["a"]), (2, None, ["a"]), (3, "", None), (4, "z " * 40 + "Alpha", ["alpha"])], "id int, t string, a array<string>")
    assert rows(search.excerpts(df, ["id"], "t", "a", 20)) == [(1, 0, 5), (4, 65, 85)]
