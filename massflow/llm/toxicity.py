"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets a logistic score of its
hashed words and word beginnings; the document's score is their noisy-or,
``1 - prod(1 - q)``.  Only document labels are known in training, and the
gradient of the noisy-or shares the blame among a document's sentences, so the
sentences that carry it are found as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from massflow.llm import text as T
from massflow.llm.frames import release
from massflow.llm.hashed_lr import platt, sigmoid

BITS = 18
#: Bytes of a word's beginning that are features beside the whole word (0).
BEGINNINGS = (0, 4, 5, 6)
#: Labelled rows of each class that the model is fitted on at most.
TRAIN_PER_CLASS = 2500
#: A feature is used if the documents of the sample that hold it are split
#: between the classes this many standard deviations from the sample's split.
LEAST_Z = 4.0
PREDICT_AT = 0.3

_STOP = np.zeros(256, bool)  # bytes that end a sentence
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Bags:
    """Feature occurrences of a slice: feat, their sentence; sentences' document and byte span."""

    feat: np.ndarray
    sent: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bags(buf: np.ndarray, off: np.ndarray) -> Bags:
    low = T.LOWER[buf]
    ph = T.PrefixHash(low)
    w = T.words(low, off, separators=T.NON_LETTER, prefix=ph)
    doc = w.doc
    stops = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_STOP[buf], out=stops[1:])
    new = np.ones(len(doc), bool)  # a sentence ends with a stop byte or its document
    new[1:] = (stops[w.start[1:]] != stops[w.start[:-1]]) | (doc[1:] != doc[:-1])
    sent = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1 if len(head) else head
    found = []
    for k, n in enumerate(BEGINNINGS):
        on = np.flatnonzero(w.end - w.start > n) if n else slice(None)
        h = ph.span(w.start[on], w.start[on] + n) if n else w.hash
        found.append((sent[on] << 22) | (h >> np.uint64(64 - BITS)).astype(np.int64) | (k << BITS))
    key = np.unique(np.concatenate(found))  # once a sentence
    return Bags((key & ((1 << 22) - 1)).astype(np.int32), key >> 22, doc[head], w.start[head], w.end[tail])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def sentences(self, b: Bags) -> np.ndarray:
        return self.bias + np.bincount(b.sent, self.weights[b.feat], len(b.doc))

    def documents(self, b: Bags, z: np.ndarray, n: int) -> np.ndarray:
        """Calibrated noisy-or; a text without words has the score of no evidence."""
        clean = np.bincount(b.doc, -np.logaddexp(0, z), n)  # log prod(1 - q)
        return sigmoid(self.slope * _logit(clean) + self.shift)


def _logit(clean: np.ndarray) -> np.ndarray:
    """log(p / (1 - p)) for p = 1 - exp(clean), bounded."""
    clean = np.minimum(clean, -1e-9)
    return np.clip(np.log(-np.expm1(clean)) - clean, -20, 20)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, epochs: int = 30, rate: float = 0.3, decay: float = 2e-3, seed: int = 5) -> Model | None:
    """Train on a bounded, hash-ordered sample of labelled rows outside the held-out part.

    The driver gets hashed features only.  None when a class is missing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in picked], "id long, y int")  # at most 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def features(batches):
        for b in batches:
            feat, sent = [], []
            for lo, hi, buf, off in T.slices(b.column(2)):
                g = bags(buf, off)
                d = g.doc[g.sent]
                order = np.argsort(d, kind="stable")
                cut = np.searchsorted(d[order], np.arange(hi - lo + 1))
                for k in range(hi - lo):
                    at = order[cut[k] : cut[k + 1]]
                    feat.append(g.feat[at].tobytes())
                    sent.append((g.sent[at] - g.sent[at].min(initial=1 << 40)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(feat, pa.binary()), pa.array(sent, pa.binary())], ["id", "y", "feat", "sent"])

    got = rows.mapInArrow(features, "id long, y int, feat binary, sent binary").toArrow().sort_by("id")
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    docs_ = [(np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.int32)) for f, s in zip(got["feat"], got["sent"])]
    size = len(BEGINNINGS) << BITS
    held_by = np.zeros((2, size))
    for (f, _), k in zip(docs_, y):
        held_by[k, np.unique(f)] += 1
    total = held_by.sum(0)
    share = (y == 1).mean()
    used = np.abs(held_by[1] - total * share) >= LEAST_Z * np.sqrt(np.maximum(total, 1) * share * (1 - share))
    kept = np.flatnonzero(used)
    short = np.zeros(size, np.int32)
    short[kept] = np.arange(len(kept))
    sizes = [int(t.max(initial=-1)) + 1 for _, t in docs_]  # sentences, also those without a used feature
    docs_ = [(short[f[used[f]]], t[used[f]]) for f, t in docs_]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs_))
    held, part = (order[: len(order) // 4], order[len(order) // 4 :]) if len(docs_) >= 40 else (order, order)
    # Rows are sampled by class; these weights give back the labelled table's proportions.
    weight = np.array([counts.get(k, 1) / max(1, (y == k).sum()) for k in (0, 1)])
    weight /= weight.mean()
    model = Model(np.zeros(len(kept), np.float32), -5.0)
    square, bias_square = np.full(len(kept), 1e-6, np.float32), 1e-6

    def stacked(which):
        f = np.concatenate([docs_[i][0] for i in which])
        base = np.cumsum([0, *(sizes[i] for i in which)])
        s = np.concatenate([docs_[i][1] + b for i, b in zip(which, base)]) if len(which) else np.zeros(0, int)
        return Bags(f, s, np.repeat(np.arange(len(which)), np.diff(base)), s, s)

    for _ in range(epochs):
        rng.shuffle(part)
        for k in range(0, len(part), 100):
            which = part[k : k + 100]
            b = stacked(which)
            q = sigmoid(z := model.sentences(b))
            clean = np.bincount(b.doc, -np.logaddexp(0, z), len(which))
            p = -np.expm1(np.minimum(clean, -1e-9))
            up = np.where(y[which] == 1, -np.exp(clean) / p, 1.0) * weight[y[which]]
            g = up[b.doc] * q / len(which)
            grad = np.bincount(b.feat, g[b.sent], len(kept)).astype(np.float32)
            on = np.flatnonzero(grad)
            step = grad[on] + decay / len(part) * model.weights[on]
            square[on] += step * step
            model.weights[on] -= rate * step / np.sqrt(square[on])
            bias_square += g.sum() ** 2
            model.bias -= 0.1 * g.sum() / np.sqrt(bias_square)
    b = stacked(held)
    z = _logit(np.bincount(b.doc, -np.logaddexp(0, model.sentences(b)), len(held)))
    model.slope, model.shift = platt(z, y[held])
    model.shift += np.log(weight[1] / weight[0])
    full = np.zeros(size, np.float32)
    full[kept] = model.weights
    model.weights = full
    del docs_, got, held_by
    release()
    return model


FIELDS = "score double, worst_start long, worst_end long, worst_score double, n_offending long"


def score(docs: DataFrame, model: Model | None, text_col: str = "text", offending_at: float = PREDICT_AT) -> DataFrame:
    """docs with the document score and its worst sentence (code-point span, score).

    A null or empty text has no sentence: its score is that of no evidence,
    the span is null and n_offending 0.  Of sentences that tie, the first is the
    worst.  Without a model (a class of labels missing) every score is 0.
    Repeated rows are scored alike, rows that share an id each by its own text;
    an empty table gives an empty result.  Other columns pass through, but for
    those named like an output, which takes their place.
    """
    docs = docs.drop(*(f.split()[0] for f in FIELDS.split(", ")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the corpus
    schema = StructType(list(docs.schema))
    for f in FIELDS.split(", "):
        schema = schema.add(*f.split())

    def run(batches):
        m = shared.value
        for batch in batches:
            out = [[], [], [], [], []]
            for lo, hi, buf, off in T.slices(batch.column(text_col)):
                n = hi - lo
                g = bags(buf, off)
                z = m.sentences(g) if m is not None else np.full(len(g.doc), -40.0)
                out[0].append(m.documents(g, z, n) if m is not None else np.zeros(n))
                order = np.lexsort((np.arange(len(z)), -z, g.doc))
                head = order[np.unique(g.doc[order], return_index=True)[1]] if len(z) else order
                points = np.zeros(len(buf) + 1, np.int64)
                np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
                span = np.full((3, n), np.nan)
                base = points[off[g.doc[head]]]
                span[0, g.doc[head]] = points[g.start[head]] - base
                span[1, g.doc[head]] = points[g.end[head]] - base
                span[2, g.doc[head]] = sigmoid(z[head])
                for k in range(3):
                    out[1 + k].append(span[k])
                out[4].append(np.bincount(g.doc[sigmoid(z) >= offending_at], minlength=n))
            cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
            kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            made = [pa.array(c if k == 0 or k == 4 else np.nan_to_num(c), mask=None if k in (0, 4) else np.isnan(c)).cast(kinds[k]) for k, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f.split()[0] for f in FIELDS.split(", "))])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence, one row per row of docs."""
    got = score(docs.select("doc_id", "text"), fit(docs, labels))
    return got.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score", "n_offending")
