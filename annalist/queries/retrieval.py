"""Lexical and vector retrieval, fusion, selection: the queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.operators import fusion, search, vectors
from annalist.operators.ranks import numbered
from annalist.session import kept, written
from annalist.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "source")


def _asked(docs: DataFrame) -> DataFrame:
    """The texts that are asked for: of every row whose id is divisible by 50, all its anchors."""
    return docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.explode(T.anchors("text")).alias("term")).distinct()


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, tuple]:
    """The index, made once while the documents are the same, and all that search.bm25_indexed takes before its bounds."""
    docs = _docs(spark, d)
    indexed = kept(spark, "index", [f"{d}/documents.parquet"], lambda: search.index(docs, "doc_id", "text"))
    return indexed, ("doc_id", _asked(docs), *search.index_statistics(indexed))


def _bm25(spark: SparkSession, d: str, best: int | None = None, share: float = 0) -> DataFrame:
    indexed, how = _index(spark, d)
    return search.bm25_indexed(indexed, *how, best, share)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scored = _bm25(spark, d, 20).withColumn("score", F.round("score", 6))
    return search.top(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], 20).select("query_id", "doc_id", "score", "rank")


def bm25_gated_groups(spark: SparkSession, d: str) -> DataFrame:
    """Only texts that have every term of the query."""
    return _bm25(spark, d, share=1).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    posted = search.postings(_docs(spark, d), ["doc_id"], "text")
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def chunk_postings_stats(spark: SparkSession, d: str) -> DataFrame:
    made = search.chunks(_docs(spark, d), "doc_id", "text")
    return made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.size(T.terms("chunk"))).alias("terms"), F.max("span_end").alias("reach"))


def best_chunk_per_owner(spark: SparkSession, d: str) -> DataFrame:
    """The chunk of each document that has most of its words twice or more."""
    made = search.chunks(_docs(spark, d), "doc_id", "text").withColumn("distinct_terms", F.size(F.array_distinct(T.terms("chunk"))))
    return search.top(made, ["doc_id"], [F.desc("distinct_terms"), F.col("span_start")], 1).select("doc_id", "span_start", "distinct_terms")


def parent_window_expand(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    hits = search.chunks(docs, "doc_id", "text").select("doc_id", "span_start")
    out = search.parent_windows(hits, "doc_id", docs.select("doc_id", F.length("text").alias("n_chars")))
    return out.select("doc_id", "span_start", "window_start", "window_end")


def neighbour_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with the ones before and after it."""
    w = Window.partitionBy("doc_id").orderBy("span_start")
    made = search.chunks(_docs(spark, d), "doc_id", "text")
    return made.select("doc_id", "span_start", F.lag("span_start").over(w).alias("before"), F.lead("span_start").over(w).alias("after"))


def content_anchor_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_sort(T.anchors("text")).alias("a")).select("doc_id", F.size("a").alias("anchors"), F.array_join("a", " ").alias("words"))


def token_estimate_by_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "lang", "text")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(T.token_estimate("text").cast("bigint")).alias("tokens"))


def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of a query's terms that each hit has."""
    asked = _asked(_docs(spark, d)).groupBy("query_id").agg(F.count("*").alias("terms"))
    return _bm25(spark, d).join(asked, "query_id").select("query_id", "doc_id", F.round(F.col("hits") / F.col("terms"), 6).alias("coverage"))


def rarest_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's terms the ones found in the fewest texts."""
    df = term_statistics(spark, d).select("term", "df")
    ranked = _asked(_docs(spark, d)).join(df, "term").withColumn("r", F.rank().over(Window.partitionBy("query_id").orderBy("df")))
    return ranked.filter("r = 1").select("query_id", "term", "df")


def _unit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding", "label").filter(vectors.usable("embedding"))
    return rows.select("vec_id", vectors.normalised("embedding").alias("v"), "label")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    unit = _unit(spark, d)
    asked = unit.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return vectors.nearest(asked, unit, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def _ann(spark: SparkSession, d: str) -> tuple[vectors.ListIndex, DataFrame, DataFrame]:
    """An index of all vectors, the vectors, and the queries: every row whose id is divisible by 50."""
    unit = written(_unit(spark, d), "unit")
    return vectors.ListIndex(unit), unit, unit.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("own"))


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """About the ten nearest vectors of each query, from the nearest lists of an index (see ann_recall)."""
    index, _, asked = _ann(spark, d)
    return index.search(asked, 10, index.probes_for(asked, 10)).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """How much of the exact ten nearest the index finds, over all queries."""
    index, unit, asked = _ann(spark, d)
    exact = vectors.nearest(asked, unit, 10).select("query_id", "vec_id")
    found = index.search(asked, 10, index.probes_for(asked, 10)).select("query_id", "vec_id").withColumn("_f", F.lit(1))
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("wanted"), (F.count("_f") >= 0.9 * F.count("*")).alias("recall_reached"))


def ann_visible_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors that a query may see (of its own label or an even one), out of three times as many; here all lists are probed."""
    index, unit, asked = _ann(spark, d)
    allowed = asked.select("query_id", "own").join(unit.select("vec_id", "label"), (F.col("label") == F.col("own")) | (F.col("label") % 2 == 0))
    return vectors.visible_nearest(index, asked, allowed, 5, vectors.MOST_LISTS).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(vectors.usable("embedding")).alias("usable"), F.min(F.size("embedding")).alias("least_dimension"), F.max(F.size("embedding")).alias("most_dimension"))


def _branches(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of documents per workspace and language: by length and by age."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars", "created_at").withColumn("lang", F.coalesce("lang", F.lit("?")))
    by_size = numbered(docs, ["lang"], [F.desc("n_chars"), "doc_id"], "rank").select("lang", "doc_id", F.lit("size").alias("method"), "rank")
    by_age = numbered(docs, ["lang"], ["created_at", "doc_id"], "rank").select("lang", "doc_id", F.lit("age").alias("method"), "rank")
    return by_size.unionByName(by_age)


def rrf_two_branch(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.reciprocal_ranks(_branches(spark, d), ["lang"], "doc_id")
    return out.select("lang", "doc_id", F.round("score", 9).alias("score"), "branches")


def rrf_conflict_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Claims as candidates of two methods; ids whose rows disagree are left out."""
    claims = table(spark, d, "claims", "id", "tenant_id", "text", "status", "confidence", "importance").filter("id IS NOT NULL")
    lex = numbered(claims, ["tenant_id"], [F.desc("confidence")], "rank", ties=True).withColumn("method", F.lit("confidence"))
    sem = numbered(claims, ["tenant_id"], [F.desc("importance")], "rank", ties=True).withColumn("method", F.lit("importance")).withColumn("text", F.when(F.col("status").startswith("arch"), F.upper("text")).otherwise(F.col("text")))
    both = lex.unionByName(sem).withColumn("evidence", F.array("method")).withColumnRenamed("text", "said")
    out = fusion.fuse(both, ["tenant_id"], "id", ["said"])
    return out.select("tenant_id", "id", F.round("score", 9).alias("score"), "methods")


def weighted_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "claims", "id", "tenant_id", "confidence", "importance").filter("id IS NOT NULL").distinct()
    r = numbered(numbered(claims, ["tenant_id"], [F.desc("confidence")], "a", ties=True), ["tenant_id"], [F.desc("importance")], "b", ties=True)
    return r.select("tenant_id", "id", F.round(fusion.weighted_rank_score(F.col("a"), F.col("b")), 9).alias("score"))


def balanced_interleave(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "memory_events", "id", "user_id", "event_type", "occurred_at").filter("user_id IS NOT NULL").distinct()
    once = events.groupBy("id").agg(F.min(F.struct("user_id", "event_type", "occurred_at")).alias("e")).select("id", "e.*")
    return fusion.interleaved(once, ["user_id"], "event_type", [F.desc("occurred_at"), F.desc("id")]).select("user_id", "id", "turn", "position", F.round("score", 9).alias("score"))


def source_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each workspace in rounds over their sources."""
    docs = table(spark, d, "documents", "doc_id", "source", "n_chars").withColumn("source", F.lower(F.trim("source"))).filter("source IS NOT NULL")
    out = fusion.source_rounds(docs, "source", [F.desc("n_chars"), F.col("doc_id")], [])
    return out.select("doc_id", "source", "round", "source_rank")


def linear_claim_score_topk(spark: SparkSession, d: str) -> DataFrame:
    """Per tenant the ten claims that best match its most recent question, by overlap, importance and confidence."""
    claims = table(spark, d, "claims", "id", "tenant_id", "text", "confidence", "importance").filter("id IS NOT NULL").distinct()
    ask = claims.groupBy("tenant_id").agg(F.max_by("text", F.struct("importance", "id")).alias("ask"))
    q, t = F.array_distinct(T.terms("ask")), F.array_distinct(T.terms("text"))
    score = 0.55 * F.size(F.array_intersect(q, t)) / F.greatest(F.lit(1), F.size(q)) + 0.25 * F.coalesce("importance", F.lit(0.0)) + 0.2 * F.coalesce("confidence", F.lit(0.0))
    scored = claims.join(ask, "tenant_id").withColumn("score", F.round(score, 6))
    return search.top(scored, ["tenant_id"], [F.desc("score"), F.col("id")], 10).select("tenant_id", "id", "score", "rank")


#: Kinds of evidence by source; anything else is an event (how the test documents are read).
KIND_OF = {"user_memo": "claim", "claim_digest": "claim", "design_note": "block", "benchmark_report": "block", "legacy_wiki": "block", "support_ticket": "episode", "changelog": "procedure", "field_glossary": "latent"}
#: Items wanted of a search, and the hits that compete for them (fixed rule: four times as many, 32 to 2,400).
WANTED = 12
POOL = min(2400, max(32, 4 * WANTED))


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k best texts of each query: query_id, doc_id, score, rank."""
    scored = _bm25(spark, d, k).withColumn("score", F.round("score", 6))
    return search.top(scored, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each query as evidence: id, kind, score, source, size, and the terms of the query they have."""
    docs = table(spark, d, "documents", "doc_id", "source", "text", "n_chars")
    indexed, how = _index(spark, d)
    asked = how[1].groupBy("query_id").agg(F.collect_list("term").alias("asked"))  # one text's terms
    source = F.lower(F.trim("source"))
    kind = F.lit("event")
    for name, k in KIND_OF.items():
        kind = F.when(source == name, k).otherwise(kind)
    rows = _hits(spark, d, POOL).join(docs, "doc_id").join(indexed.select("doc_id", "terms"), "doc_id").join(asked, "query_id")
    words = F.array_join(F.array_sort(F.array_intersect("terms", "asked")), " ")
    return rows.select("query_id", F.col("doc_id").cast("string").alias("id"), kind.alias("kind"), "score", source.alias("source"), T.token_estimate("text").cast("bigint").alias("size"), F.col("n_chars").cast("bigint").alias("hi"), words.alias("words"))


def diversity_quota(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's hits the best eight, so that no kind and no source has more than its share."""
    return fusion.greedy(_candidates(spark, d), ["query_id"], ["id", "kind", "score", "source"], "query_id bigint, id string, position int", fusion.diverse)


def bundle_pack(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's hits, best first, those that still fit a budget of tokens."""
    return fusion.greedy(_candidates(spark, d), ["query_id"], ["id", "score", "size"], "query_id bigint, id string, position int, used bigint", fusion.within_budget(2048))


def extractive_compress(spark: SparkSession, d: str) -> DataFrame:
    """The newest events of each session that fit 200 tokens together, in order of time."""
    events = table(spark, d, "memory_events", "id", "session_id", "content", "occurred_at").filter("session_id IS NOT NULL AND content IS NOT NULL")
    once = events.groupBy("id").agg(F.min(F.struct("session_id", "occurred_at", "content")).alias("e")).select("id", "e.*")
    rows = once.select("session_id", "id", F.unix_micros(F.col("occurred_at").cast("timestamp")).cast("double").alias("score"), T.token_estimate("content").cast("bigint").alias("size"))
    chosen = fusion.greedy(rows, ["session_id"], ["id", "score", "size"], "session_id string, id string, newest int, used bigint", fusion.within_budget(200))
    return chosen.select("session_id", "id", "newest", "used")


def native_pack_v2(spark: SparkSession, d: str) -> DataFrame:
    """Of each query's hits the evidence that adds the most, step by step, within a budget of tokens; another copy of a text adds none."""
    rows = _candidates(spark, d).withColumn("lo", F.lit(0).cast("bigint")).withColumn("needs", F.lit(None).cast("string"))
    texts = table(spark, d, "documents", F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("owner"))
    return fusion.greedy(rows.join(texts, "id"), ["query_id"], ["id", "score", "size", "owner", "lo", "hi", "source", "words", "needs"], "query_id bigint, id string, position int, used bigint", fusion.evidence_pack(2048))


def best_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """The part of 400 characters of each query's five best texts that holds most of the query's terms, rare ones weighing more."""
    docs = table(spark, d, "documents", "doc_id", "text")
    _, how = _index(spark, d)
    asked = how[1].groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("asked"))
    return search.excerpts(_hits(spark, d, 5).join(docs, "doc_id").join(asked, "query_id"), ["query_id", "doc_id"], "text", "asked", 400)


def covered_spans(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 1,024 characters that lie in the union of some chunks of 512."""
    docs = _docs(spark, d)
    large = search.chunks(docs, "doc_id", "text").select("doc_id", "span_start", "span_end")
    small = search.chunks(docs, "doc_id", "text", 512, 448).filter("span_start % 3 <> 0").select("doc_id", "span_start", "span_end")
    return fusion.covered_by_union(large, small, ["doc_id"], "span_start", "span_end")


def route_merge(spark: SparkSession, d: str) -> DataFrame:
    """Per query three literal hits (half of its terms) to one probe hit (any term), each document once, twelve in all."""
    indexed, how = _index(spark, d)
    route = lambda name, share: search.bm25_indexed(indexed, *how, 24, share).select("query_id", F.col("doc_id").cast("string").alias("id"), F.round("score", 6).alias("score"), F.lit(name).alias("route"))
    both = route("literal", 0.5).unionByName(route("probe", 0))  # merged_routes takes 2 * 12 of a route at most
    return fusion.greedy(both, ["query_id"], ["id", "score", "route"], "query_id bigint, id string, position int, route string", fusion.merged_routes({"literal": 3, "probe": 1}, 12))


def contained_spans(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 512 characters that lie within a chunk of 1,024."""
    docs = _docs(spark, d)
    large = search.chunks(docs, "doc_id", "text").select("doc_id", "span_start", "span_end", F.lit(0).alias("size"))
    small = search.chunks(docs, "doc_id", "text", 512, 448).select("doc_id", "span_start", "span_end", F.lit(1).alias("size"))
    out = fusion.contained(large.unionByName(small), ["doc_id"], "span_start", "span_end", "size")
    return out.filter("size = 1").select("doc_id", "span_start", "span_end")


def complete_evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    """Claims that keep all their sources, where a source is lost with any claim that loses one."""
    links = table(spark, d, "claim_sources").filter("claim_id IS NOT NULL AND event_id IS NOT NULL")
    alive = table(spark, d, "memory_events", "id", "archived_at").filter("archived_at IS NULL").select(F.col("id").alias("event_id"))
    return fusion.complete_groups(links, alive, "claim_id", "event_id")


def event_variants(spark: SparkSession, d: str) -> DataFrame:
    """How many ever shorter variants each document has."""
    return _docs(spark, d).filter("length(text) > 0").select("doc_id", F.size(fusion.halvings(F.length("text"))).alias("variants"))


NAMES = (route_merge, best_excerpt, covered_spans, contained_spans, complete_evidence_groups, event_variants, bm25_topk, bm25_gated_groups, term_statistics, chunk_postings_stats, best_chunk_per_owner, parent_window_expand, neighbour_chunks, content_anchor_filter, token_estimate_by_lang, query_coverage, rarest_anchor, cosine_topk, ann_topk, ann_recall, ann_visible_topk, vector_checks, rrf_two_branch, rrf_conflict_exclusion, weighted_rank_fusion, balanced_interleave, source_rounds, linear_claim_score_topk, diversity_quota, bundle_pack, extractive_compress, native_pack_v2)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


def sql_terms(text: str) -> str:
    """The terms of a text in DuckDB's SQL."""
    return (
        rf"flatten(list_transform(regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[a-z0-9]+|[\x{{3400}}-\x{{9fff}}]+'), lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]') THEN [r] "
        "ELSE list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) END))"
    )


_WORDS = ", ".join(f"'{w}'" for w in (*T.FUNCTION_WORDS, *T.NEGATIONS))


def sql_anchors(text: str) -> str:
    quotes = rf"""regexp_extract_all({text}, '"[^"\n]+"|“[^”\n]+”|‘[^’\n]+’')"""
    inner = sql_terms("qq")
    plain = f"list_filter({inner}, lambda t: t NOT IN ('a', 'an', 'the'))"
    kept_words = f"flatten(list_transform({quotes}, lambda qq: CASE WHEN len({plain}) > 0 THEN {plain} ELSE {inner} END))"
    return f"list_sort(list_filter(list_distinct({sql_terms(text)}), lambda t: t NOT IN ({_WORDS}) AND NOT regexp_matches(t, '^[0-9]+$') OR list_contains({kept_words}, t)))"


_EST = "greatest(1, CAST(ceil((length({0}) - length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g'))) / 4) AS BIGINT) + length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')))".replace(
    "(length({0}) - length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')))", "(length({0}) - length(regexp_replace({0}, '[\\x00-\\x7F]', '', 'g')))"
)
_CHUNKS = """c AS (SELECT doc_id, length(text) AS n, s * 896 AS span_start, least(s * 896 + 1024, length(text)) AS span_end, substr(text, s * 896 + 1, 1024) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1024 THEN 1 ELSE CAST(ceil((length(text) - 1024) / 896) AS BIGINT) + 1 END)) AS s FROM documents WHERE length(text) > 0))"""
_BM25 = f"""t AS (SELECT doc_id, {sql_terms('text')} AS ts, text FROM documents),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM t) GROUP BY ALL),
st AS (SELECT count(*) AS n, greatest(1, avg(coalesce(len(ts), 0))) AS mean FROM t),
q AS (SELECT doc_id AS query_id, unnest({sql_anchors('text')}) AS term FROM documents WHERE doc_id % 50 = 0),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, count(*) AS hits
  FROM q JOIN p USING (term) JOIN f USING (term), st GROUP BY ALL)"""


_KINDS = "CASE lower(trim(source)) " + " ".join(f"WHEN '{s}' THEN '{k}'" for s, k in KIND_OF.items()) + " ELSE 'event' END"
_POOL = f"""{_BM25}, r AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s), pool AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {POOL}),
cand AS (SELECT query_id, id, score, lower(trim(source)) AS source, {_KINDS} AS kind, CAST({_EST.format('text')} AS BIGINT) AS size, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM pool JOIN documents USING (doc_id))"""


def sql_budget(group: str, budget: int) -> str:
    """What fits a budget, in order of cand.k, where a row that doesn't fit uses up nothing (goes on after a WITH RECURSIVE that has cand)."""
    return f"""g AS (SELECT DISTINCT {group} AS grp, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS id, false AS fits FROM cand UNION ALL
SELECT g.grp, c.k, CASE WHEN g.used + c.size <= {budget} THEN g.used + c.size ELSE g.used END, c.id, g.used + c.size <= {budget} FROM g JOIN cand c ON c.{group} = g.grp AND c.k = g.k + 1)"""


def oracle_sql() -> dict[str, str]:
    quota = "CASE c.kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in fusion.KIND_QUOTA.items()) + f" ELSE {fusion.MOST_ITEMS} END"
    return {
        "bundle_pack": f"WITH RECURSIVE {_POOL}, {sql_budget('query_id', 2048)} SELECT grp AS query_id, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY k) AS INT) AS position, used FROM g WHERE fits",
        "diversity_quota": f"""WITH RECURSIVE {_POOL}, g AS (SELECT DISTINCT query_id AS grp, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS kinds, CAST([] AS VARCHAR[]) AS sources, CAST(NULL AS VARCHAR) AS id, false AS fits FROM cand UNION ALL
SELECT grp, ck, CASE WHEN ok THEN list_append(kinds, kind) ELSE kinds END, CASE WHEN ok THEN list_append(sources, source) ELSE sources END, cid, ok FROM (SELECT g.*, c.k AS ck, c.id AS cid, c.kind, c.source,
len(g.kinds) < {fusion.MOST_ITEMS} AND len(list_filter(g.kinds, lambda x: x = c.kind)) < {quota} AND len(list_filter(g.sources, lambda x: x = c.source)) < {fusion.SOURCE_QUOTA} AS ok FROM g JOIN cand c ON c.query_id = g.grp AND c.k = g.k + 1))
SELECT grp AS query_id, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY k) AS INT) AS position FROM g WHERE fits""",
        "extractive_compress": f"""WITH RECURSIVE cand AS (SELECT session_id, id, CAST({_EST.format('content')} AS BIGINT) AS size, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at DESC, id) AS k
FROM (SELECT DISTINCT id, session_id, content, occurred_at FROM memory_events WHERE session_id IS NOT NULL AND content IS NOT NULL)), {sql_budget('session_id', 200)}
SELECT grp AS session_id, id, CAST(row_number() OVER (PARTITION BY grp ORDER BY k) AS INT) AS newest, used FROM g WHERE fits""",
        "covered_spans": """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), l AS (SELECT doc_id, s * 896 AS a, least(s * 896 + 1024, n) AS b FROM (SELECT *, unnest(range(0, CASE WHEN n <= 1024 THEN 1 ELSE CAST(ceil((n - 1024) / 896) AS BIGINT) + 1 END)) AS s FROM d)),
k AS (SELECT doc_id, s * 448 AS a, least(s * 448 + 512, n) AS b FROM (SELECT *, unnest(range(0, CASE WHEN n <= 512 THEN 1 ELSE CAST(ceil((n - 512) / 448) AS BIGINT) + 1 END)) AS s FROM d) WHERE s * 448 % 3 <> 0),
p AS (SELECT *, sum(CASE WHEN a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS island FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k)),
m AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM p GROUP BY doc_id, island) SELECT l.doc_id, l.a AS span_start, l.b AS span_end FROM l JOIN m ON l.doc_id = m.doc_id AND m.a <= l.a AND l.b <= m.b""",
        "contained_spans": """WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0), l AS (SELECT doc_id, s * 896 AS a, least(s * 896 + 1024, n) AS b FROM (SELECT *, unnest(range(0, CASE WHEN n <= 1024 THEN 1 ELSE CAST(ceil((n - 1024) / 896) AS BIGINT) + 1 END)) AS s FROM d)),
k AS (SELECT doc_id, s * 448 AS a, least(s * 448 + 512, n) AS b FROM (SELECT *, unnest(range(0, CASE WHEN n <= 512 THEN 1 ELSE CAST(ceil((n - 512) / 448) AS BIGINT) + 1 END)) AS s FROM d))
SELECT DISTINCT k.doc_id, k.a AS span_start, k.b AS span_end FROM k JOIN l ON k.doc_id = l.doc_id AND l.a <= k.a AND k.b <= l.b""",
        "complete_evidence_groups": """WITH RECURSIVE l AS (SELECT DISTINCT claim_id, event_id FROM claim_sources), dead(event_id) AS (SELECT event_id FROM l WHERE event_id NOT IN (SELECT id FROM memory_events WHERE archived_at IS NULL)
UNION SELECT b.event_id FROM dead JOIN l a USING (event_id) JOIN l b ON a.claim_id = b.claim_id) SELECT DISTINCT claim_id FROM l WHERE claim_id NOT IN (SELECT claim_id FROM l WHERE event_id IN (SELECT event_id FROM dead))""",
        "event_variants": "SELECT doc_id, len(list_filter(list_transform(range(13), lambda i: floor(length(text) / pow(2, i))), lambda x: x >= least(64, length(text)))) AS variants FROM documents WHERE length(text) > 0",
        "bm25_topk": f"WITH {_BM25}, r AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 20",
        "bm25_gated_groups": f"WITH {_BM25}, k AS (SELECT query_id, count(*) AS terms FROM q GROUP BY 1) SELECT query_id, doc_id, round(score, 6) AS score FROM s JOIN k USING (query_id) WHERE hits = terms",
        "term_statistics": f"WITH {_BM25} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term",
        "chunk_postings_stats": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks, CAST(sum(len({sql_terms('chunk')})) AS BIGINT) AS terms, max(span_end) AS reach FROM c GROUP BY doc_id",
        "best_chunk_per_owner": f"WITH {_CHUNKS}, k AS (SELECT doc_id, span_start, len(list_distinct({sql_terms('chunk')})) AS distinct_terms FROM c) SELECT doc_id, span_start, distinct_terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distinct_terms DESC, span_start) AS rn FROM k) WHERE rn = 1",
        "parent_window_expand": f"WITH {_CHUNKS} SELECT doc_id, span_start, greatest(0, span_start - 1792) AS window_start, least(n, greatest(0, span_start - 1792) + 3712) AS window_end FROM c",
        "neighbour_chunks": f'WITH {_CHUNKS} SELECT doc_id, span_start, lag(span_start) OVER w AS "before", lead(span_start) OVER w AS "after" FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY span_start)',
        "content_anchor_filter": f"WITH a AS (SELECT doc_id, {sql_anchors('text')} AS a FROM documents) SELECT doc_id, len(a) AS anchors, array_to_string(a, ' ') AS words FROM a",
        "token_estimate_by_lang": f"SELECT lang, count(*) AS n, CAST(sum({_EST.format('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang",
        "query_coverage": f"WITH {_BM25}, k AS (SELECT query_id, count(*) AS terms FROM q GROUP BY 1) SELECT query_id, doc_id, round(hits / terms, 6) AS coverage FROM s JOIN k USING (query_id)",
        "rarest_anchor": f"WITH {_BM25} SELECT query_id, term, df FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY df) AS r FROM q JOIN f USING (term)) WHERE r = 1",
        "cosine_topk": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM p) WHERE rank <= 10""",
        "ann_recall": "SELECT sum(least(10, n - 1)) AS wanted, true AS recall_reached FROM (SELECT (SELECT count(*) FROM embeddings) AS n FROM embeddings WHERE vec_id % 50 = 0)",
        "ann_visible_topk": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, q.label AS own, e.label, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS r FROM p)
SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM f WHERE r <= 15 AND (label = own OR label % 2 = 0) QUALIFY rank <= 5""",
        "vector_checks": "SELECT label, count(*) AS n, count(*) FILTER (list_sum(list_transform(embedding, lambda x: abs(x))) > 0) AS usable, min(len(embedding)) AS least_dimension, max(len(embedding)) AS most_dimension FROM embeddings GROUP BY label",
        "rrf_two_branch": """WITH b AS (SELECT coalesce(lang, '?') AS lang, doc_id, row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY n_chars DESC, doc_id) AS r1, row_number() OVER (PARTITION BY coalesce(lang, '?') ORDER BY created_at NULLS FIRST, doc_id) AS r2 FROM documents)
SELECT lang, doc_id, round(1 / (60 + r1) + 1 / (60 + r2), 9) AS score, 2 AS branches FROM b""",
        "rrf_conflict_exclusion": """WITH c AS (SELECT *, rank() OVER (PARTITION BY tenant_id ORDER BY confidence DESC) AS a, rank() OVER (PARTITION BY tenant_id ORDER BY importance DESC) AS b FROM claims WHERE id IS NOT NULL)
SELECT tenant_id, id, round(1 / (60 + min(a)) + 1 / (60 + min(b)), 9) AS score, 2 AS methods FROM c GROUP BY tenant_id, id HAVING bool_and(text IS NULL OR NOT starts_with(status, 'arch') OR upper(text) = text) AND count(DISTINCT text) <= 1""",
        "weighted_rank_fusion": """WITH c AS (SELECT DISTINCT id, tenant_id, confidence, importance FROM claims WHERE id IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY tenant_id ORDER BY confidence DESC) AS a, rank() OVER (PARTITION BY tenant_id ORDER BY importance DESC) AS b FROM c)
SELECT tenant_id, id, round(0.35 / (60 + a) + 0.65 / (60 + b), 9) AS score FROM r""",
        "balanced_interleave": """WITH e AS (SELECT DISTINCT id, user_id, event_type, occurred_at FROM memory_events WHERE user_id IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY occurred_at DESC, id DESC) AS turn FROM e)
SELECT user_id, id, turn, row_number() OVER (PARTITION BY user_id ORDER BY turn, event_type) AS position, round(1 / (60 + turn), 9) AS score FROM t""",
        "source_rounds": """WITH x AS (SELECT doc_id, lower(trim(source)) AS source, n_chars FROM documents WHERE source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS round FROM x),
b AS (SELECT source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS source_rank FROM r WHERE round = 1) SELECT doc_id, source, round, source_rank FROM r JOIN b USING (source)""",
        "linear_claim_score_topk": f"""WITH c AS (SELECT DISTINCT id, tenant_id, text, confidence, importance FROM claims WHERE id IS NOT NULL), a AS (SELECT tenant_id, list_distinct({sql_terms('ask')}) AS q FROM (SELECT tenant_id, arg_max(text, (importance, id)) AS ask FROM c GROUP BY 1)),
s AS (SELECT tenant_id, id, round(0.55 * len(list_intersect(q, list_distinct({sql_terms('text')}))) / greatest(1, len(q)) + 0.25 * coalesce(importance, 0) + 0.2 * coalesce(confidence, 0), 6) AS score FROM c JOIN a USING (tenant_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
    }
