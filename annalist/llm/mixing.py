"""Mixing documents of several sources to target weights, by soft membership of the sources' domains."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.tokens import default_vocabulary, encoder
from annalist.session import written

#: Size of the hashed vector of token counts the classifier sees.
WIDTH = 1024
#: About so many labelled documents of each source train the classifier (the bound of the sample it is fitted on).
PER_SOURCE = 200
#: Of the largest total that no source's limit of repeats stands against, so much is used.
FILL = 0.98
#: How far the totals of the domains, and those of the sources, may give way where not all of them can be met.
YIELD_DOMAIN, YIELD_SOURCE = 1e-5, 1e-6
#: Parts of a step that a pass tries side by side.
STEPS = (1.0, 0.5, 0.25, 0.0625)
#: Documents that one task rounds to whole uses together; the number of such groups follows from that of documents.
GROUP = 100_000
MOST_TARGETS = 10_000
MOST_DOMAINS = 200


def plain_source(column: str) -> Column:
    """A source in lower case without outer blanks."""
    return F.lower(F.trim(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))


@dataclass(frozen=True)
class Targets:
    """What the mixes want: weights[mix, domain] (NaN: no wish) and repeats[mix, domain]."""

    mixes: tuple[str, ...]
    domains: tuple[str, ...]
    weights: np.ndarray
    repeats: np.ndarray

    @staticmethod
    def of(targets: DataFrame) -> Targets:
        """From rows mix, source, target_weight, max_repeats; of repeated rows the largest counts. At most 10,000 rows."""
        rows = targets.select("mix", plain_source("source").alias("source"), "target_weight", "max_repeats").filter("mix IS NOT NULL AND source IS NOT NULL")
        rows = rows.groupBy("mix", "source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r")).limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError(f"at most {MOST_TARGETS} targets")
        if len({r.source for r in rows}) > MOST_DOMAINS:
            raise ValueError(f"at most {MOST_DOMAINS} sources")
        mixes, domains = tuple(sorted({r.mix for r in rows})), tuple(sorted({r.source for r in rows}))
        weights = np.full((len(mixes), len(domains)), np.nan)
        repeats = np.zeros((len(mixes), len(domains)))
        for r in rows:
            at = mixes.index(r.mix), domains.index(r.source)
            weights[at] = np.nan if r.w is None or r.w < 0 else r.w
            repeats[at] = max(0, r.r if r.r is not None else 1)
        return Targets(mixes, domains, weights, repeats)


def features(ids: list[int], text: str) -> np.ndarray:
    """A document as the classifier sees it: damped hashed token counts of unit length, and its shape."""
    counts = np.bincount(np.asarray(ids, dtype=np.int64) % WIDTH, minlength=WIDTH).astype(np.float32)
    x = np.log1p(counts)
    x /= max(1e-6, float(np.linalg.norm(x)))
    n = max(1, len(text))
    shape = [1.0, np.log1p(len(ids)) / 10, text.count("\n") / n * 10, text.count("|") / n * 10, text.count("#") / n * 10]
    return np.concatenate([x, np.asarray(shape, dtype=np.float32)])


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a softmax regression; classes weigh equally. Accelerated gradient descent, deterministic."""
    w = np.zeros((x.shape[1], classes), dtype=np.float32)
    v = w.copy()
    hot = np.eye(classes, dtype=np.float32)[y]
    share = 1 / np.maximum(1, np.bincount(y, minlength=classes))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    step = 2.0 / float((np.square(x).sum(axis=1) * share[:, 0]).sum()) * 4
    for k in range(rounds):
        z = x @ v
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        new = v - step * (x.T @ ((p - hot) * share) + ridge * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def posteriors(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, domains: tuple[str, ...], vocabulary: str, per_source: int = PER_SOURCE) -> tuple[np.ndarray, np.ndarray]:
    """The classifier of the domains, fitted on about per_source labelled documents of each (chosen by a hash of doc_id), and the
    share of documents each has. The classifier holds all domains for equally probable beforehand.
    """
    counts = {r.source: r.n for r in docs.filter(F.col("source").isin(*domains)).groupBy("source").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for s, n in counts.items():
        share = F.when(F.col("source") == s, min(1.0, per_source / n)).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_003)) / 1_000_003 < share
    sample = docs.filter(drawn & F.col("text").isNotNull()).select("source", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            made = [features(encode(t), t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["source", "x"])

    rows = sorted((r.source, bytes(r.x)) for r in sample.mapInArrow(run, "source string, x binary").collect()) if counts else []
    prior = np.asarray([counts.get(s, 0) for s in domains], dtype=np.float64)
    if not rows:
        return np.zeros((WIDTH + 5, len(domains)), dtype=np.float32), prior
    x = np.stack([np.frombuffer(r[1], dtype=np.float16) for r in rows]).astype(np.float32)
    return fit_softmax(x, np.asarray([domains.index(r[0]) for r in rows]), len(domains)), prior / prior.sum()


def memberships(docs: DataFrame, domains: tuple[str, ...], w: np.ndarray, prior: np.ndarray, vocabulary: str) -> DataFrame:
    """doc_id, label, tokens and q: the posterior of each domain by the document's text alone, if all are as probable beforehand.

    label is the position of its source in domains; -1 for a source that isn't there. A document without a source has the
    label of its most probable domain, by the shares the domains have of all documents (prior).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        at = {s: k for k, s in enumerate(domains)}
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            ids = [encode(t) for t in texts]
            q = np.empty((len(texts), len(domains)))
            for a in range(0, len(texts), 512):
                q[a : a + 512] = posteriors(np.stack([features(i, t) for i, t in zip(ids[a : a + 512], texts[a : a + 512], strict=True)]), w)
            sources = batch.column(1).to_pylist()
            labels = np.asarray([at.get(s, -1) for s in sources], dtype=np.int64)
            if domains:
                bare = np.flatnonzero([not s for s in sources])
                labels[bare] = (q[bare] * prior).argmax(axis=1)
            flat = pa.array(q.astype(np.float32).ravel(), pa.float32())
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(domains))
            yield pa.record_batch([batch.column(0), pa.array(labels, pa.int32()), pa.array([len(i) for i in ids], pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "label", "tokens", "q"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, label int, tokens bigint, q array<float>")


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    return batch.column("label").to_numpy(zero_copy_only=False), batch.column("tokens").to_numpy(zero_copy_only=False).astype(np.float64), q


@dataclass(frozen=True)
class Plan:
    """The rates of documents: weights[mix] holds one number per domain for the posteriors and one per source for the label.

    prior[mix] says how probable each domain is beforehand in that mix: by its target share of documents.
    """

    limit: np.ndarray  # mix x domain
    prior: np.ndarray  # mix x domain
    weights: np.ndarray  # mix x 2 domains

    def posterior(self, q: np.ndarray, mix: int) -> np.ndarray:
        p = q * self.prior[mix]
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)

    def pull(self, label: np.ndarray, p: np.ndarray, mix: int) -> tuple[np.ndarray, np.ndarray]:
        """What the rates would be without limits, and the limits above; p are the posteriors in the mix."""
        d = p.shape[1]
        own = label >= 0
        return p @ self.weights[mix][:d] + np.where(own, self.weights[mix][d:][label], 0.0), np.where(own, self.limit[mix][label], 0.0)

    def rates(self, label: np.ndarray, q: np.ndarray, mix: int) -> np.ndarray:
        r, most = self.pull(label, self.posterior(q, mix), mix)
        return np.clip(r, 0, most)


def _summed(members: DataFrame, shape: tuple[int, ...], of: object) -> np.ndarray:
    """The sum over batches of documents of what of(label, tokens, q) gives; each task sends one array."""
    d = shape[-1] // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += of(*_arrays(batch, d))
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k.astype(np.int64)), pa.array(total.ravel()[k])], names=["k", "v"])

    out = np.zeros(shape)
    for r in members.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out.ravel()[r.k] = r.v
    return out


def fit_rates(members: DataFrame, targets: Targets, most_rounds: int = 25, tolerance: float = 1e-5) -> Plan:
    """Projected-gradient least squares: nonnegative rates, at most max_repeats, whose totals match the targets.

    A document's rate is what the gradient of the squared misses pulls it to, projected on [0, limit]. Two sets of totals are
    to match: the tokens expected of each domain by the posteriors, and the tokens of each source by label; so within a source the
    posteriors say which documents are taken. A round is one pass over the memberships. It adds up the totals and the
    Gram matrix of the documents between their limits, by which the next gradient step is scaled, for several
    lengths of the step at once. The total of a mix is the largest that the limits of its sources allow, times FILL.
    """
    m, d = targets.weights.shape
    limit = np.where(np.nan_to_num(targets.weights) > 0, targets.repeats, 0.0)
    held_now = _summed(members, (2 * d,), lambda label, t, q: np.r_[np.bincount(label[label >= 0], t[label >= 0], d), np.bincount(label[label >= 0], minlength=d)])
    there, documents = held_now[:d], held_now[d:]
    weights = np.nan_to_num(targets.weights)
    reach = np.where(there > 0, weights, 0)
    share = reach / np.maximum(reach.sum(axis=1, keepdims=True), 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = FILL * np.min(np.where(share > 0, there * limit / share, np.inf), axis=1, initial=np.inf)
    total = np.where(np.isfinite(total), total, 0)
    wanted = np.concatenate([share, share], axis=1) * total[:, None]
    prior = share * documents / np.maximum(there, 1)
    give = np.r_[np.full(d, YIELD_DOMAIN), np.full(d, YIELD_SOURCE)] * max(1.0, there.sum())
    at = np.concatenate([np.zeros((m, d)), wanted[:, :d] / np.maximum(there, 1)], axis=1)
    tried = at[:, None]
    miss = np.full(m, np.inf)
    held: tuple | None = None
    for _ in range(most_rounds):

        def of(label: np.ndarray, t: np.ndarray, q: np.ndarray, tried: np.ndarray = tried) -> np.ndarray:
            hot = np.where((label >= 0)[:, None], np.eye(d)[label], 0.0)
            out = np.zeros((m, tried.shape[1], 2 * d + 1, 2 * d))
            for i in range(m):
                p = Plan(limit, prior, at).posterior(q, i)
                z = np.concatenate([p, hot], axis=1)
                for j in range(tried.shape[1]):
                    pull, most = Plan(limit, prior, tried[:, j]).pull(label, p, i)
                    out[i, j, 0] = (t * np.clip(pull, 0, most)) @ z
                    free = (pull > 0) & (pull < most)
                    out[i, j, 1:] = (z[free] * t[free, None]).T @ z[free]
            return out

        sums = _summed(members, (m, tried.shape[1], 2 * d + 1, 2 * d), of)
        off = wanted[:, None] - sums[:, :, 0] - give * tried
        misses = np.linalg.norm(off, axis=2)
        best = misses.argmin(axis=1)
        better = misses[np.arange(m), best] < miss
        if held is None:
            held = off[:, 0].copy(), sums[:, 0, 1:].copy(), np.ones(m)
        for i in np.flatnonzero(better):
            at[i], held[0][i], held[1][i], held[2][i], miss[i] = tried[i, best[i]], off[i, best[i]], sums[i, best[i], 1:], 1.0, misses[i, best[i]]
        held[2][~better] /= 16  # a shorter step from where it was
        open_ = (miss > tolerance * np.maximum(total, 1)) & (held[2] > 1e-6)
        if not open_.any():
            break
        step = np.stack([np.linalg.solve(held[1][i] + np.diag(give), held[0][i]) for i in range(m)])
        tried = np.stack([at + s * (held[2] * open_)[:, None] * step for s in STEPS], axis=1)
    return Plan(limit, prior, at)


def uses(members: DataFrame, targets: Targets, plan: Plan) -> DataFrame:
    """mix, doc_id, source, tokens, uses (> 0): whole uses of each document.

    A rate's fraction becomes a whole use or none so that the rounding errors of a source cancel out, from long documents to
    short ones, within groups of about GROUP documents made by a hash of doc_id. So the result depends on the documents alone
    and not on how they lie in files or partitions.
    """
    d, limit = len(targets.domains), plan.limit

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, tokens, q = _arrays(batch, d)
            rates = np.stack([plan.rates(label, q, m) for m in range(len(targets.mixes))], axis=1) if targets.mixes else np.zeros((len(label), 0))
            kept = np.flatnonzero(rates.max(axis=1, initial=0) > 1e-9)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * rates.shape[1]), pa.array(rates[kept].ravel()))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(kept)), pa.array(label[kept].astype(np.int32)), batch.column("tokens").take(pa.array(kept)), flat], names=["doc_id", "label", "tokens", "rates"])

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried = None, np.zeros((len(targets.mixes), d))
        for batch in batches:
            groups = batch.column(0).to_numpy()
            docs, labels, tokens = batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            rates = batch.column(4).flatten().to_numpy().reshape(len(docs), -1)
            out: list[tuple] = []
            for i, doc in enumerate(docs):
                if groups[i] != group:
                    group, carried = groups[i], np.zeros_like(carried)
                k, t = labels[i], int(tokens[i])
                for m in np.flatnonzero(rates[i] > 1e-9):
                    whole = int(rates[i, m] + 1e-9)
                    part = (rates[i, m] - whole) * t
                    if part > 1e-9 and whole < limit[m, k]:
                        carried[m, k] += part
                        if 2 * carried[m, k] >= t:
                            whole += 1
                            carried[m, k] -= t
                    if whole:
                        out.append((targets.mixes[m], doc, targets.domains[k], t, whole))
            if out:
                yield pa.record_batch([pa.array(c, y) for c, y in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["mix", "doc_id", "source", "tokens", "uses"])

    groups = max(1, -(-members.count() // GROUP))
    rows = members.mapInArrow(rated, "doc_id bigint, label int, tokens bigint, rates array<double>")
    rows = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("_g"), "doc_id", "label", "tokens", "rates")
    rows = rows.repartition("_g").sortWithinPartitions("_g", F.desc("tokens"), "doc_id")
    return rows.mapInArrow(rounded, "mix string, doc_id bigint, source string, tokens bigint, uses bigint")


@dataclass(frozen=True)
class Mix:
    """What a mix came to: the uses of documents, all documents with their posteriors, the rates, and the targets as read."""

    uses: DataFrame
    members: DataFrame
    plan: Plan
    targets: Targets


def shares(mix: Mix) -> DataFrame:
    """Per mix and source: wanted_share, actual_share (of tokens, by source), expected_share (by the posteriors), limits kept."""
    used, targets, plan = mix.uses, mix.targets, mix.plan
    spark = used.sparkSession
    weights = np.nan_to_num(targets.weights)
    rows = []
    for m, name in enumerate(targets.mixes):
        for k, s in enumerate(targets.domains):
            stated = not np.isnan(targets.weights[m, k])
            listed = stated or targets.repeats[m, k] > 0
            if listed:
                rows.append((name, s, k, float(weights[m, k] / max(1e-12, weights[m].sum())) if stated else None, int(targets.repeats[m, k])))
    wanted = spark.createDataFrame(rows, "mix string, source string, _k int, wanted_share double, max_repeats int")
    size = F.col("tokens") * F.col("uses")
    got = used.groupBy("mix", "source").agg(F.sum(size).alias("used_tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = np.asarray(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy().astype(np.float64)
            q = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1).astype(np.float64)
            for m, name in enumerate(targets.mixes):
                at = names == name
                total = n[at] @ plan.posterior(q[at], m)
                yield pa.record_batch([pa.array([name] * len(total), pa.string()), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["mix", "_k", "v"])

    soft = used.select("mix", "doc_id", size.alias("n")).join(mix.members.select("doc_id", "q"), "doc_id").select("mix", "n", "q")
    soft = soft.mapInArrow(expected, "mix string, _k int, v double").groupBy("mix", "_k").agg(F.sum("v").alias("_soft"))
    both = wanted.join(got, ["mix", "source"], "left").join(soft, ["mix", "_k"], "left")
    share = lambda c: F.coalesce(F.col(c) / F.sum(c).over(_by_mix()), F.lit(0.0))
    return both.select("mix", "source", "wanted_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "uses", "most_uses", "used_tokens")), share("used_tokens").alias("actual_share"), share("_soft").alias("expected_share"))


def _by_mix():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("mix")


def mix_documents(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None, per_source: int = PER_SOURCE) -> Mix:
    """The uses of documents in each mix.

    docs: doc_id (unique), source, text; other columns are ignored. A document belongs softly to the domains (the sources
    the targets name), by the posteriors of a classifier of its text fitted on labelled documents. Rates are such that both the
    expected totals of the domains and the totals of the sources match the targets. A document whose source is null or blank
    is used as one of its most probable domain; one of a source in no target isn't used. Weights are relative; a null or
    negative weight is no wish and its source is not used; a wanted source without documents is left at nothing and the
    others keep their proportions. Empty and null texts have no tokens and are used as it comes out. Empty tables give no uses.
    """
    path = vocabulary or default_vocabulary()
    read = Targets.of(targets)
    rows = docs.select("doc_id", plain_source("source").alias("source"), "text").filter("doc_id IS NOT NULL")
    w, prior = fit_domains(rows, read.domains, path, per_source)
    members = written(memberships(rows, read.domains, w, prior, path), "members")
    plan = fit_rates(members, read)
    return Mix(uses(members, read, plan), members, plan, read)
