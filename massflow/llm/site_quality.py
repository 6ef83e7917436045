"""Quality classifier: document evidence under hierarchical empirical-Bayes site priors.

A logistic model on a few text statistics gives each document's evidence.  Its
sums per host and per (host, path) come from grouped aggregates over the whole
table; each host's rate is shrunk toward the global rate and each path's toward
its host's, with strengths estimated from the spread between the groups, so a
sparse site says little.  A document's own evidence is left out of its site's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from massflow.llm import text as T
from massflow.llm.frames import cut, release
from massflow.llm.hashed_lr import labelled_sample, sigmoid

TRAIN_PER_CLASS = 1500
KEEP_AT = 0.15
#: Site tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SITES = 50_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = ~T.NON_LETTER
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of text statistics per document."""
    ph = T.PrefixHash(buf)
    w = T.words(buf, off, prefix=ph)
    r = T.rule_counts(buf, off, ph, w)
    n = np.maximum(r["n_words"], 1)
    letters = np.maximum(T.per_doc(_LETTER[buf], off), 1)
    uniq = np.unique(T.mix64(w.hash ^ T.mix64(w.doc.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(w.doc[uniq], minlength=len(off) - 1)
    echo = np.zeros(len(w.hash), bool)
    echo[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])

    def count(byte: str) -> np.ndarray:
        return T.per_doc(buf == ord(byte), off)

    shares = [r["n_symbols"] / n, r["n_repeat_words"] / n, T.per_doc(echo, w.first) / n, T.per_doc(_UPPER[buf], off) / letters, count("!") / n, count("|") / n, T.per_doc(_PUNCT[buf], off) / n, T.per_doc((buf >= 48) & (buf < 58), off) / n]
    cols = [np.log1p(r["n_words"]), r["word_chars"] / n / 10, r["n_dup_lines"] / (1 + count("\n")), distinct / n, count(".") / n]
    return np.stack([*cols, *shares, *(np.sqrt(np.minimum(s, 4)) for s in shares)], 1)


@dataclass
class Evidence:
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    bias: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return sigmoid(z @ self.coef + self.bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, ridge: float = 1.0) -> Evidence | None:
    """Newton fit on a bounded labelled sample; None when a class is missing."""

    def run(batches):
        for b in batches:
            x = [features(buf, off) for _, _, buf, off in T.slices(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for m in x for v in m], pa.binary())], ["id", "y", "x"])

    got = labelled_sample(docs, labels, "quality", per_class).mapInArrow(run, "id long, y int, x binary").toArrow().sort_by("id")
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in got["x"]])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    pull = np.full(z.shape[1], ridge)
    pull[-1] = 1e-3
    beta = np.zeros(z.shape[1])
    for _ in range(40):
        p = sigmoid(z @ beta)
        s = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(pull), z.T @ (weight * (p - y)) + pull * beta)
        beta -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, beta[:-1], float(beta[-1]))


def _scored(docs: DataFrame, model: Evidence | None, text_col: str, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers
    schema = StructType(list(docs.schema)).add(out, "double")

    def run(batches):
        m = shared.value
        for b in batches:
            p = [m.probabilities(features(buf, off)) if m is not None else np.full(hi - lo, 0.5) for lo, hi, buf, off in T.slices(b.column(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(p) if p else np.zeros(0))], [*b.schema.names, out])
        b = p = None  # noqa: F841  nothing of the last batch is held
        release()

    return docs.mapInArrow(run, schema)


def strength(groups: DataFrame, n: str, total: str, center) -> float:
    """Prior weight in documents, by the method of moments from the groups' spread.

    Sum of n (mean - center)^2 over the groups has (k) v from within and
    (N) t from between; the weight is v / t - 1, kept within 1 and 10,000.
    """
    r = groups.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(total).alias("s"), F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - center, 2)).alias("d")).first()
    if not r["k"] or not r["n"]:
        return 1.0
    rate = min(max(r["s"] / r["n"], 1e-6), 1 - 1e-6)
    within = rate * (1 - rate)
    between = max((r["d"] - r["k"] * within) / r["n"], 1e-12)
    return float(min(max(within / between - 1, 1.0), 10_000.0))


def site_rates(evidence: DataFrame, host: str = "host", path: str = "path", p: str = "p"):
    """(paths table, global rate, host strength, path strength) from all documents."""
    paths = cut(evidence.groupBy(host, path).agg(F.count(F.lit(1)).alias("path_n"), F.sum(p).alias("path_s")))
    hosts = cut(paths.groupBy(host).agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s")))
    t = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    rate = min(max((t[1] or 0.5) / (t[0] or 1), 1e-6), 1 - 1e-6)
    a = strength(hosts, "host_n", "host_s", F.lit(rate))
    both = paths.join(hosts, host)
    b = strength(both, "path_n", "path_s", F.col("host_s") / F.col("host_n"))
    return both, rate, a, b


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", text_col: str = "text", keep_at: float = KEEP_AT, prefix: str = "", again: bool = False) -> DataFrame:
    """docs with evidence, host_rate, site_rate, posterior and kept, names after ``prefix``.

    Null hosts and null paths are groups of their own.  A null or empty text
    has the statistics of an empty text.  Without a model (a class of labels
    missing) the evidence is 0.5 for all, and all are kept.  Repeated rows each
    count.  An empty table gives an empty result.  ``again`` scores the texts a
    second time instead of keeping them beside their scores; else docs should
    be narrow.
    """
    h, p = prefix + "host", prefix + "path"
    e = prefix + "evidence"
    model = fit(docs, labels)
    rows = _scored(docs, model, text_col, e).withColumn(h, F.coalesce(F.concat(F.lit("="), host_col), F.lit(""))).withColumn(p, F.coalesce(F.concat(F.lit("="), path_col), F.lit("")))
    if not again:
        rows = cut(rows.drop(text_col))
    sites, rate, a, b = site_rates(rows.select(F.col(h).alias("host"), F.col(p).alias("path"), F.col(e).alias("p")))
    sites = sites.select(F.col("host").alias(h), F.col("path").alias(p), *(F.col(c).alias(prefix + c) for c in ("path_n", "path_s", "host_n", "host_s")))
    small = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    joined = rows.join(F.broadcast(sites) if small else sites, [h, p])
    ev = F.col(e)
    host_rate = (F.col(prefix + "host_s") - ev + a * rate) / (F.col(prefix + "host_n") - 1 + a)
    site_rate = (F.col(prefix + "path_s") - ev + b * F.col(prefix + "host_rate")) / (F.col(prefix + "path_n") - 1 + b)
    out = joined.withColumn(prefix + "host_rate", host_rate).withColumn(prefix + "site_rate", site_rate)
    z = _logit(ev) + _logit(F.col(prefix + "site_rate")) - float(np.log(rate / (1 - rate)))
    out = out.withColumn(prefix + "posterior", 1 / (1 + F.exp(-z)))
    names = [prefix + c for c in ("evidence", "host_rate", "site_rate", "posterior", "kept")]
    out = out.withColumn(prefix + "kept", F.lit(True) if model is None else F.col(prefix + "posterior") >= keep_at)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if again or c != text_col), *names)


def _logit(c):
    c = F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(c / (1 - c))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, lang with evidence, rates, posterior and verdict."""
    return classify(docs.select("doc_id", "source", "lang", "text"), labels)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns (pipeline stage).

    A null or empty text is judged as an empty text, a null source or lang is a
    site of its own, repeated rows are judged alike and each count for their
    site; ties stay (a posterior at the bound is kept); without labels of both
    classes all stay; an empty table stays empty.  Columns of any names but
    those that begin with ``__site_`` pass through.
    """
    p = "__site_"
    return classify(docs, labels, prefix=p, again=True).where(F.col(p + "kept")).select(*(F.col(f"`{c}`") for c in docs.columns))
