"""Logistic regression over hashed word and character n-grams.

Word unigrams and bigrams and character 3- and 4-grams are hashed into one table
of ``4 * 2**BITS`` weights.  A document's feature is each n-gram's share of all
its n-grams of that kind, so the score is a sum of four averages and is made
by a gather and a running sum over a whole Arrow batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massflow.llm import text as T
from massflow.llm.frames import release

BITS = 18
SPACE = 1 << BITS


def _ngrams(buf: np.ndarray, off: np.ndarray, w: T.Words):
    """For each of the four kinds: (hash index of each n-gram, from, to per document)."""
    shift = np.uint64(64 - BITS)
    yield (w.hash >> shift).astype(np.int32), w.first[:-1], w.first[1:]
    h, at = T.grams(w, 2)
    lo = np.searchsorted(at, w.first)
    yield (h >> shift).astype(np.int32), lo[:-1], lo[1:]
    chars, first = _characters(buf, off)
    for n in (3, 4):
        m = max(0, len(chars) - n + 1)
        v = np.zeros(m, np.uint32)
        for j in range(n):
            v = v * np.uint32(0x9E3779B1) + chars[j : j + m]
        v = (v ^ (v >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        lo = np.minimum(first[:-1], m)
        yield (v >> np.uint32(32 - BITS)).astype(np.int32), lo, np.maximum(lo, np.minimum(first[1:] - n + 1, m))


def _characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every character as its bytes in one number, and the index of each document's first one."""
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    chars = buf[start].astype(np.uint32)
    size = np.diff(np.append(start, len(buf)))
    for j in range(1, 4):
        long = np.flatnonzero(size > j)
        chars[long] = chars[long] << np.uint32(8) | buf[start[long] + j]
    return chars, np.searchsorted(start, off)


@dataclass
class Model:
    weights: np.ndarray  # float32, 4 * SPACE
    bias: float
    slope: float = 1.0  # calibration: p = sigmoid(slope * score + shift)
    shift: float = 0.0

    def scores(self, buf: np.ndarray, off: np.ndarray, w: T.Words) -> np.ndarray:
        out = np.full(len(off) - 1, self.bias)
        for k, (idx, lo, hi) in enumerate(_ngrams(buf, off, w)):
            c = np.zeros(len(idx) + 1)
            np.cumsum(self.weights[k * SPACE : (k + 1) * SPACE][idx], out=c[1:], dtype=np.float64)
            out += (c[hi] - c[lo]) / np.maximum(hi - lo, 1)
        return out

    def probabilities(self, buf: np.ndarray, off: np.ndarray, w: T.Words) -> np.ndarray:
        return sigmoid(self.slope * self.scores(buf, off, w) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sparse_rows(buf: np.ndarray, off: np.ndarray, w: T.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document's (feature indices, shares)."""
    n = len(off) - 1
    kinds = list(_ngrams(buf, off, w))
    rows = []
    for d in range(n):
        idx, val = [], []
        for k, (h, lo, hi) in enumerate(kinds):
            u, c = np.unique(h[lo[d] : hi[d]], return_counts=True)
            idx.append(u + k * SPACE)
            val.append(c / max(1, hi[d] - lo[d]))
        rows.append((np.concatenate(idx).astype(np.int32), np.concatenate(val).astype(np.float32)))
    return rows


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most per_class labelled documents of each class: (id, y, text).

    The sample is the labelled ids with the least hash, so it is the same in
    any partitioning.  Ids repeated in ``labels`` count once with their least
    label; ids repeated in ``docs`` once with their least text.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("y"))
    picked = []
    for y in (0, 1):
        picked += known.where(F.col("y") == y).orderBy(F.xxhash64(F.col("id"), F.lit(label)), "id").limit(per_class).collect()
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["id"], r["y"]) for r in picked], "id long, y int")  # at most 2 * per_class rows
    hits = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return hits.groupBy("id", "y").agg(F.min("text").alias("text"))


def class_counts(labels: DataFrame, label: str, id_col: str = "doc_id") -> dict[int, int]:
    """Labelled ids of each class; an id that repeats counts once with its least label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).cast("int").alias("y"))
    return {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}


def train(sample: DataFrame, counts: dict[int, int] | None = None, epochs: int = 12, batch: int = 64, rate: float = 0.6, decay: float = 1e-3, seed: int = 7) -> Model | None:
    """Fit on (id, y, text) rows of a bounded sample; a fourth of them calibrates.

    A sample drawn by class has other proportions than the labels; ``counts``,
    the labels' own, are given back to the calibrated odds.  Features are made
    on the executors; the driver holds only their indices and shares.  None
    when a class is missing.
    """

    def features(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).combine_chunks()
            rows = []
            for _, _, buf, off in T.slices(t["text"].combine_chunks() if t.num_rows else t["text"]):
                rows += sparse_rows(buf, off, T.words(buf, off))
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), t["y"].combine_chunks(), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["id", "y", "idx", "val"])

    got = sample.mapInArrow(features, "id long, y int, idx binary, val binary").toArrow().sort_by("id")
    y = got["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    rows = [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for i, v in zip(got["idx"], got["val"])]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = (order[: len(order) // 4], order[len(order) // 4 :]) if len(rows) >= 40 else (order, order)
    share = np.array([(y[fit] != k).mean() for k in (0, 1)]).clip(0.02)  # classes weigh alike
    weights, square = np.zeros(4 * SPACE, np.float32), np.full(4 * SPACE, 1e-8, np.float32)
    bias, bias_square = 0.0, 1e-8
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            part = fit[at : at + batch]
            idx = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] for i in part])
            size = np.array([len(rows[i][0]) for i in part])
            doc = np.repeat(np.arange(len(part)), size)
            z = bias + np.bincount(doc, weights[idx] * val, len(part))
            r = (sigmoid(z) - y[part]) * share[y[part]] / len(part)
            g = np.bincount(idx, r[doc] * val, 4 * SPACE).astype(np.float32)
            on = np.flatnonzero(g)
            g = g[on] + decay * weights[on] / len(fit)
            square[on] += g * g
            weights[on] -= rate * g / np.sqrt(square[on])
            bias_square += r.sum() ** 2
            bias -= rate * r.sum() / np.sqrt(bias_square)
    z = np.array([bias + float(weights[rows[i][0]] @ rows[i][1]) for i in held])
    slope, shift = platt(z, y[held])
    if counts and counts.get(0) and counts.get(1):
        shift += np.log(counts[1] / (y == 1).sum()) - np.log(counts[0] / (y == 0).sum())
    del rows, got
    release()
    return Model(weights, float(bias), slope, shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a calibrating sigmoid (Newton steps, smoothed targets)."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(z).mean()), 1e-6)
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3) / scale, b
