"""Lexical retrieval: chunks, postings, BM25 for batches of queries, and the passages around a hit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from annalist.functions.text import terms
from annalist.operators.sweep import by_group
from annalist.session import written

# BM25's constants, the size of chunks and the distance of their starts.
K1, B = 1.2, 0.75
CHUNK, STRIDE = 1024, 896
# Texts that a task scores, and queries that it scores side by side.
SHARD_TEXTS = 20_000
QUERY_BLOCK = 4096
# Terms of a block that are added up as a matrix, at most.
MOST_SHARED = 2048


def chunks(texts: DataFrame, key: str, text: str, size: int = CHUNK, stride: int = STRIDE) -> DataFrame:
    """Overlapping chunks of every text: key, span_start, span_end, chunk; the last is the first that reaches the end.

    Null and empty texts have none. Map-only.
    """
    n = F.length(text)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
    starts = F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * stride))
    out = texts.filter(n > 0).select(key, text, starts.alias("span_start"))
    return out.select(key, "span_start", F.least(F.col("span_start") + size, F.length(text)).alias("span_end"), F.substring(F.col(text), F.col("span_start") + 1, F.lit(size)).alias("chunk"))


def postings(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, term, tf and len (terms in the text); one shuffle, with repeats of a term counted before it."""
    rows = texts.select(*key, terms(text).alias("_t")).withColumn("len", F.size("_t"))
    return rows.select(*key, "len", F.explode("_t").alias("term")).groupBy(*key, "len", "term").agg(F.count("*").alias("tf"))


def statistics(posted: DataFrame, texts: DataFrame) -> tuple[int, float]:
    """Number of texts, those without terms included, and their mean length in terms (at least 1)."""
    n = texts.count()
    return n, max(1.0, (posted.agg(F.sum("tf")).collect()[0][0] or 0) / max(1, n))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tf_weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, len, terms (distinct) and tfs: the postings of each text in one row, map-only. Null texts count as empty; key must be unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lens, coded = lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()
            k = max(1, len(coded.dictionary))
            cells, tfs = np.unique(np.repeat(np.arange(len(lens)), lens) * k + coded.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(len(lens) + 1) * k), pa.int32())
            terms_of, tfs_of = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(cells % k))), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(lens, pa.int32()), terms_of, tfs_of], names=[key, "len", "terms", "tfs"])

    out = StructType([StructField(key, texts.schema[key].dataType), StructField("len", IntegerType()), StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(LongType()))])
    return texts.select(key, F.coalesce(terms(text), F.array().cast("array<string>"))).mapInArrow(run, out)


def index_statistics(indexed: DataFrame) -> tuple[int, float]:
    """As statistics, of an index."""
    n, total = indexed.agg(F.count("*"), F.sum("len")).collect()[0]
    return n, max(1.0, (total or 0) / max(1, n))


def bm25(posted: DataFrame, key: str, queries: DataFrame, n: int, mean: float, best: int | None = None, share: float = 0) -> DataFrame:
    """bm25_indexed, of postings."""
    return bm25_indexed(posted.groupBy(key).agg(F.max("len").alias("len"), F.collect_list("term").alias("terms"), F.collect_list("tf").alias("tfs")), key, queries, n, mean, best, share)


def bm25_indexed(indexed: DataFrame, key: str, queries: DataFrame, n: int, mean: float, best: int | None = None, share: float = 0) -> DataFrame:
    """query_id, key, score and hits (distinct query terms) of every text that has a term of the query.

    queries: query_id, term (distinct). With share only texts that have at least that share of a query's terms; with best
    each task gives of a query's texts only those that can be among its best ones (1e-5 of score to spare, for rounding).
    Texts are dealt to shards and queries to blocks, and each shard is scored against each block in one pass, so no pair
    of posting and query term is a row; a task holds the queries of one block and the scores of a few texts.
    """
    spark = indexed.sparkSession
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_TEXTS))
    df = indexed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    size = queries.groupBy("query_id").agg(F.count("*").alias("size"))  # terms that no text has count too
    asked = queries.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", idf(F.lit(n), F.col("df")).alias("w"))).alias("t")).join(size, "query_id")
    asked = written(asked.select("query_id", "size", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select("_block", every(shards, "_shard"), F.lit(0).alias("_text"), "query_id", F.lit(None).cast(indexed.schema[key].dataType).alias(key), "size", "terms", "weights")
    weights = F.transform("tfs", lambda tf: tf_weight(tf, F.col("len"), F.lit(mean)))
    texts = indexed.select(every(blocks, "_block"), F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("_shard"), F.lit(1).alias("_text"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), key, F.lit(None).cast("bigint").alias("size"), "terms", weights.alias("weights"))
    out = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField(key, indexed.schema[key].dataType), StructField("score", DoubleType()), StructField("hits", LongType())])
    rows = by_group(asked.unionByName(texts), ["_block", "_shard"], ["_text"])
    return rows.mapInArrow(lambda batches: _scored(batches, key, best, share), out)


class _Block:
    """The queries of one block: lists of the queries that ask for each term, and a matrix of the terms that many of them ask for.

    Where many queries share a term, a product of matrices adds up its scores far faster than going through the list would.
    """

    def __init__(self, rows: pa.Table) -> None:
        terms = rows["terms"].combine_chunks()
        coded = terms.flatten().dictionary_encode()
        codes, lens = coded.indices.to_numpy(), terms.value_lengths().to_numpy()
        order = np.argsort(codes, kind="stable")
        self.ids, self.size, self.known = rows["query_id"].combine_chunks(), rows["size"].to_numpy(), coded.dictionary
        self.query = np.repeat(np.arange(len(lens)), lens)[order]
        self.idf = _weights(rows)[order]
        asked = np.bincount(codes, minlength=len(self.known))
        self.at = np.concatenate([[0], np.cumsum(asked)])
        shared = np.argsort(-asked, kind="stable")[:MOST_SHARED]
        shared = shared[asked[shared] >= max(4, len(lens) / 24)]
        self.dense = np.full(len(self.known), -1)  # the row of a shared term in the matrix
        self.dense[shared] = np.arange(len(shared))
        self.matrix = np.zeros((len(shared), len(lens)))
        for row, term in enumerate(shared):
            span = slice(self.at[term], self.at[term + 1])
            self.matrix[row, self.query[span]] = self.idf[span]
        self.asks = (self.matrix > 0).astype(np.float32)


def _weights(rows: pa.Table) -> np.ndarray:
    return rows["weights"].combine_chunks().flatten().to_numpy()


def _scored(batches: Iterator[pa.RecordBatch], key: str, best: int | None, share: float) -> Iterator[pa.RecordBatch]:
    """What bm25 gives, from rows sorted by block and shard, queries before texts."""
    group, waiting, block = None, [], None
    found: list[pa.Table] = []
    least = np.zeros(0)

    def kept(tables: list[pa.Table]) -> pa.Table:
        """Of each query the rows that can be among its best; raises least to what that takes."""
        rows = pa.concat_tables(tables)
        q, s = rows["_q"].to_numpy(), rows["score"].to_numpy()
        order = np.lexsort((-s, q))
        q, s = q[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        nth = starts + best - 1
        full = nth < np.r_[starts[1:], len(q)]
        least[q[starts[full]]] = s[nth[full]] - 1e-5
        return rows.take(order[s >= least[q]])

    def given(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out = pa.table([block.ids.take(rows["_q"].combine_chunks()), rows[key], rows["score"], rows["hits"]], names=["query_id", key, "score", "hits"])
        yield from out.to_batches(max_chunksize=50_000)

    for batch in batches:
        whole = pa.Table.from_batches([batch])
        b, s, t = (whole[c].to_numpy() for c in ("_block", "_shard", "_text"))
        cuts = np.flatnonzero((b[1:] != b[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
            if lo == hi:
                continue
            if group != (b[lo], s[lo]):
                if found:
                    yield from given(kept(found))
                group, waiting, block, found = (b[lo], s[lo]), [], None, []
            part = whole.slice(lo, hi - lo)
            if t[lo] == 0:
                waiting.append(part)
                continue
            if block is None:
                if not waiting:
                    continue
                block = _Block(pa.concat_tables(waiting))
                least = np.full(len(block.ids), -np.inf)
            for rows in _pairs(block, part, key, share, least if best else None):
                if not best:
                    yield from given(rows)
                elif rows.num_rows:
                    found.append(rows)
                    if sum(x.num_rows for x in found) > 30 * best * len(block.ids):
                        found = [kept(found)]
            if found:
                found = [kept(found)]
    if found:
        yield from given(kept(found))


def _pairs(block: _Block, part: pa.Table, key: str, share: float, least: np.ndarray | None) -> Iterator[pa.Table]:
    """_q (number of the query), key, score, hits of the texts of part, a few texts at a time."""
    terms, nq = part["terms"].combine_chunks(), len(block.ids)
    codes = pc.index_in(terms.flatten(), value_set=block.known)
    has = codes.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(part.num_rows), terms.value_lengths().to_numpy())[has]
    weight = _weights(part)[has]
    codes = codes.drop_null().to_numpy()
    step = max(1, 500_000 // nq)
    for first in range(0, part.num_rows, step):
        m = min(step, part.num_rows - first)
        lo, hi = np.searchsorted(row, [first, first + m])
        if lo == hi:
            continue
        c, at_row, w = codes[lo:hi], row[lo:hi] - first, weight[lo:hi]
        column = block.dense[c]
        shared = column >= 0
        c, n = c[~shared], (block.at[c + 1] - block.at[c])[~shared]
        total = int(n.sum())
        where = np.repeat(block.at[c] - np.r_[0, np.cumsum(n)[:-1]][: len(n)], n) + np.arange(total)
        cell = np.repeat(at_row[~shared] * nq, n) + block.query[where]
        score = np.bincount(cell, np.repeat(w[~shared], n) * block.idf[where], m * nq)
        hits = np.bincount(cell, minlength=m * nq)
        if shared.any():
            texts = np.zeros((m, len(block.matrix)))
            texts[at_row[shared], column[shared]] = w[shared]
            score += (texts @ block.matrix).ravel()
            hits = hits + np.rint((texts > 0).astype(np.float32) @ block.asks).astype(np.int64).ravel()
        keep = hits > 0
        if share:
            keep &= hits >= share * np.tile(block.size, m)
        if least is not None:
            keep &= score >= np.tile(least, m)
        at = np.flatnonzero(keep)
        yield pa.table({"_q": pa.array(at % nq), key: part[key].combine_chunks().take(pa.array(at // nq + first)), "score": pa.array(score[at]), "hits": pa.array(hits[at], pa.int64())})


def top(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; each task keeps only k of a group before anything moves."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def parent_windows(hits: DataFrame, key: str, lengths: DataFrame, stride: int = STRIDE, size: int = CHUNK) -> DataFrame:
    """Each hit (key, span_start) with the span of the four chunks around it: window_start and window_end."""
    start = F.greatest(F.lit(0), F.col("span_start") - 2 * stride)
    return hits.join(lengths, key).withColumn("window_start", start).withColumn("window_end", F.least(F.col("n_chars"), F.col("window_start") + 3 * stride + size))


def excerpts(hits: DataFrame, keys: list[str], text: str, asked: str, size: int) -> DataFrame:
    """keys, start and end of the part of size characters of each text that has most of the asked terms, the earliest of equals.

    asked is an array of terms. Parts begin a third of size before a place where a term stands, or at the beginning of the text; all such
    places of the whole text are tried. A term weighs the more the fewer of these parts have it. Texts no longer than
    size are one part; null and empty texts have none. Map-only, one text at a time.
    """
    out = StructType([*(StructField(k, hits.schema[k].dataType) for k in keys), StructField("start", LongType()), StructField("end", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, (t, terms_of) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                if t:
                    a, b = excerpt(t, terms_of or [], size)
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.record_batch([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(keys)]), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*keys, "start", "end"])

    return hits.select(*keys, text, asked).mapInArrow(run, out)


_RUN = re.compile("[a-z0-9]+|[\u3400-\u9fff]+")


def excerpt(text: str, asked: list[str], size: int) -> tuple[int, int]:
    """The best part of one text, see excerpts: one pass over its terms in order, with the parts that are open at each."""
    n = len(text)
    if size >= n:
        return 0, n
    wanted = set(asked)
    lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)  # positions stay
    places: list[tuple[int, int, str]] = []
    for m in _RUN.finditer(lower):
        run, at = m[0], m.start()
        if run[0] < "\u3400":
            if run in wanted:
                places.append((at, m.end(), run))
            continue
        for k in range(len(run)):
            for part in (run[k], run[k : k + 2]):
                if part in wanted and (len(part) == 2 or part == run[k]):
                    places.append((at + k, at + k + len(part), part))
    places = sorted(set(places))
    starts = sorted({0, *(min(max(0, a - size // 3), n - size) for a, _, _ in places)})
    inside: list[set[str]] = []
    first = 0
    for s in starts:
        while first < len(places) and places[first][0] < s:
            first += 1
        found, k = set(), first
        while k < len(places) and places[k][0] < s + size:
            if places[k][1] <= s + size:
                found.add(places[k][2])
            k += 1
        inside.append(found)
    count: dict[str, int] = {}
    for found in inside:
        for t in found:
            count[t] = count.get(t, 0) + 1
    weight = {t: float(np.log1p((len(starts) + 0.5) / (c + 0.5))) for t, c in count.items()}
    best = max(range(len(starts)), key=lambda i: (round(sum(weight[t] for t in sorted(inside[i])), 9), -starts[i]))
    return starts[best], starts[best] + size
