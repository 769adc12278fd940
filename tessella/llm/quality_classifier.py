"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Document evidence is a logistic regression over binned counts of a text and over words, and beginnings of words, significantly more common
in good or in bad documents; it is fitted to at most SAMPLE labelled documents of the corpus, those with the least hash of
their id.
Site evidence covers every document: per path (host and section) the bad outcomes, labels where there are any and the
classifier's probability elsewhere, are summed; the path's rate shrinks to its host's, the host's to the overall rate, by
beta priors whose strengths the scatter of the rates around their parents' gives. A document's odds are its own times the
odds ratio of its path's rate, by the other documents there, to the overall rate: its own evidence counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import drop_stored, stored, strength_around
from tessella.llm.textkernel import Words, chunks, lower_ascii, mix

SAMPLE, MIN_Z, MIN_DOCS, BINS, RIDGE = 20_000, 5.0, 5, 12, 1.0
N_COUNTS, N_FEATURES = 9, 11
STEMS = (4, 5, 6)


def counts_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(N_COUNTS numbers per text, hash and text of its distinct words and beginnings of words)."""
    w = Words(buf, offsets)
    lower_words = Words(lower_ascii(buf), offsets)
    h = lower_words.hashes()
    n_docs, n = len(offsets) - 1, np.diff(w.at)
    size = np.maximum(np.diff(offsets), 1)
    part = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets]) / size
    upper, lower, digit = (buf - np.uint8(65)) < 26, (buf - np.uint8(97)) < 26, (buf - np.uint8(48)) < 10
    space = (buf == 32) | ((buf - np.uint8(9)) < 5)
    order = np.lexsort((h, w.doc))
    d, hs = w.doc[order], h[order]
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (hs[1:] != hs[:-1]))) if len(d) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(d)))
    most = np.zeros(n_docs)
    np.maximum.at(most, d[first], runs)
    longest = np.zeros(n_docs)
    np.maximum.at(longest, w.doc, w.ends - w.starts)
    some = np.maximum(n, 1)
    numbers = np.stack([
        np.log1p(n), np.bincount(w.doc, weights=w.ends - w.starts, minlength=n_docs) / some, np.log1p(longest), part(upper), part(digit),
        part(~(upper | lower | digit | space | (buf >= 128))), part(buf == 10), np.bincount(d[first], minlength=n_docs) / some, most / some,
    ], axis=1)
    # Beginnings catch inflected forms, and words with punctuation behind them; their hashes are set apart from words'.
    all_h, all_d = [hs[first]], [d[first]]
    for k in STEMS:
        long = w.ends - w.starts > k
        all_h.append(mix(lower_words.hashes(k)[long] + np.uint64(k)))
        all_d.append(w.doc[long])
    hs, d = np.concatenate(all_h), np.concatenate(all_d)
    order = np.lexsort((hs, d))
    hs, d = hs[order], d[order]
    new = np.append(True, (d[1:] != d[:-1]) | (hs[1:] != hs[:-1])) if len(d) else np.zeros(0, bool)
    return numbers, hs[new], d[new]


@dataclass
class Model:
    """A lexicon of words that the sample shows to matter, so bounded as it is, and N_FEATURES * BINS weights."""

    prior: float = 0.5
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    edges: np.ndarray | None = None
    weights: np.ndarray | None = None

    def features(self, numbers: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The counts, and the summed log odds of words that speak for bad and for good."""
        said = np.zeros((len(numbers), 2))
        if len(self.words):
            i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            odds = np.where(self.words[i] == h, self.odds[i], 0.0)
            said[:, 0] = np.bincount(doc, weights=np.maximum(odds, 0), minlength=len(numbers))
            said[:, 1] = np.bincount(doc, weights=np.maximum(-odds, 0), minlength=len(numbers))
        return np.concatenate([numbers, said], axis=1)

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), N_FEATURES * BINS + 1))
        out[:, -1] = 1
        for j in range(N_FEATURES):
            out[np.arange(len(x)), j * BINS + np.searchsorted(self.edges[j], x[:, j], "right")] = 1
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Penalised logistic regression by Newton's method."""
        self.edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        z, w = self.binned(x), np.zeros(N_FEATURES * BINS + 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w)), z.T @ (y - p) - RIDGE * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return np.clip(1 / (1 + np.exp(-np.clip(self.binned(x) @ self.weights, -30, 30))), 1e-4, 1 - 1e-4)


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad = batch.column("bad").to_numpy()
        for a, b, buf, offsets in chunks(batch.column("text")):
            _, h, doc = counts_of(buf, offsets)
            word, inverse = np.unique(h, return_inverse=True)
            k = np.bincount(inverse, weights=bad[a:b][doc], minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(inverse, minlength=len(word))), pa.array(k)], ["h", "n", "k"])


def _features(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in chunks(batch.column("text")):
                x = model.features(*counts_of(buf, offsets))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), lists, pa.array(model.probability(x))], [*keep, "x", "p"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs (doc_id, text), labels (doc_id, bad 0 or 1, one row an id)."""
    # Labels of documents that are not here teach nothing; of the others, SAMPLE ids are taken.
    here = stored(labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels-here")
    total = here.agg(F.count("*").alias("n"), F.sum("bad").alias("k")).first()
    model = Model(prior=((total.k or 0) + 0.5) / (total.n + 1))
    # SAMPLE rows of two numbers: of a known size, so they are broadcast and texts stay where they are.
    chosen = here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("bad").cast("int").alias("bad"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = stored(sample.select("bad", "text").repartition(8), "labelled-sample")
    sums = sample.agg(F.count("*").alias("n"), F.sum("bad").alias("k")).first()
    n, k = sums.n, sums.k or 0
    if not 0 < k < n:
        return model
    x = sample.mapInArrow(_sample_words, "h long, n long, k long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= MIN_DOCS)
    bad, good = F.col("k") + 0.5, F.col("n") - F.col("k") + 0.5
    x = x.withColumn("odds", F.log(bad / (k + 1.0)) - F.log(good / (n - k + 1.0)))
    # Signed root of the likelihood ratio; words of which all documents are bad, or none, count in full.
    part = lambda count, share: F.when(count == 0, 0.0).otherwise(count * F.log(count / (F.col("n") * share)))
    ratio = F.greatest(2 * (part(F.col("k"), k / n) + part(F.col("n") - F.col("k"), 1 - k / n)), F.lit(0.0))
    x = x.withColumn("z", F.signum("odds") * F.sqrt(ratio))
    lexicon = x.where(F.abs("z") >= MIN_Z).select("h", "odds").toPandas()
    words = lexicon["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    model.words, model.odds = words[order], np.clip(lexicon["odds"].to_numpy(float)[order], -6, 6)
    rows = sample.mapInArrow(_features(model, ["bad"]), "bad int, x array<double>, p double").select("bad", "x").toPandas()
    model.fit(np.stack(rows["x"].to_numpy()), rows["bad"].to_numpy(float))
    return model


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def site_rates(outcomes: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, n, k, host_n, host_k, host_rate, path_rate of every path; strengths, number and sum of all).

    outcomes: (host, path, bad between 0 and 1). Sites of one document say nothing of how sites scatter.
    """
    paths = stored(outcomes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("bad").alias("k")), "path-outcomes")
    total = paths.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    n, k = total.n or 0, total.k or 0.0
    overall = (k + 0.5) / (n + 1)
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("k").alias("host_k")), "host-outcomes")
    s_host = strength_around(hosts.where("host_n > 1").select(F.col("host_n").alias("n"), F.col("host_k").alias("k"), F.lit(overall).alias("parent")))
    rate = hosts.select(F.col("host").alias("h"), "host_n", "host_k", ((F.col("host_k") + s_host * overall) / (F.col("host_n") + s_host)).alias("host_rate"))
    joined = stored(paths.join(rate, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "path-rates")
    s_path = strength_around(joined.where("n > 1").withColumnRenamed("host_rate", "parent"))
    for x in (paths, hosts):
        drop_stored(x)
    return joined.withColumn("path_rate", (F.col("k") + s_path * F.col("host_rate")) / (F.col("n") + s_path)), {"host": s_host, "path": s_path, "n": n, "k": k}


def rate_of_others(all_: dict[str, float]) -> tuple[Column, Column]:
    """(a document's site's rate, the rate of all) by the other documents alone: its own outcome is in no sum of either.

    The strengths are those of all sites' scatter.
    """
    bad = F.col("bad")
    overall = (all_["k"] - bad + 0.5) / F.lit(max(all_["n"] - 1, 0) + 1.0)
    host = (F.col("host_k") - bad + all_["host"] * overall) / (F.col("host_n") - 1 + all_["host"])
    return (F.col("k") - bad + all_["path"] * host) / (F.col("n") - 1 + all_["path"]), overall


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_doc, host_rate, path_rate, p_bad, kept of every row of docs (doc_id, text, host, path).

    labels: (doc_id, bad). Null and empty texts: judged by counts of nothing. Null doc_id: no label. Null host or path: a
    site of its own. Repeated rows count and are judged each. Several labels of an id: bad if any says so. Labels of one
    kind only, or none, fit no classifier: every document has their rate. An empty table gives no rows; other columns are
    not read.
    """
    known = labels.where("doc_id IS NOT NULL AND bad IS NOT NULL").groupBy("doc_id").agg(F.max("bad").cast("int").alias("bad"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"))
    model = fit(d.select("doc_id", "text"), known)
    scored = d.mapInArrow(_features(model, ["doc_id", "host", "path"]), "doc_id long, host string, path string, x array<double>, p double").drop("x")
    scored = stored(scored, "quality-scores")
    labelled = scored.join(known.withColumnRenamed("doc_id", "l_id"), F.col("doc_id") == F.col("l_id"), "left")
    labelled = stored(labelled.select("doc_id", "host", "path", "p", F.coalesce(F.col("bad").cast("double"), F.col("p")).alias("bad")), "outcomes")
    sites, all_ = site_rates(labelled)
    sites = stored(sites.withColumnsRenamed({"host": "s_host", "path": "s_path"}), "sites")
    others, overall = rate_of_others(all_)
    p_bad = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(others) - _logit(overall))))
    both = labelled.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    return both.select("doc_id", F.col("p").alias("p_doc"), "host_rate", "path_rate", p_bad.alias("p_bad"), (p_bad <= threshold).alias("kept"))
