"""Mixing sources to target weights by Pfair scheduling of source blocks.

Every source is a task whose weight w is its share of the mix.  Its k-th block
(from 1) is released at slot floor((k - 1) / w) and due at slot ceil(k / w);
each slot takes the released block with the earliest deadline.  Both are
computed in whole numbers from the weights as they are given, so at every slot
of a phase each source is less than one block away from its share, however
many blocks there are.

When a source runs out, the others' weights are scaled up and a new phase
starts; no document is dropped or repeated.  The driver plans block by block:
it holds eight bytes for each block of ``BLOCK_CHARS`` characters, no document.
"""

from __future__ import annotations

import heapq
import math
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from massflow.llm.frames import cut

#: Characters after which a source's current block is closed.
BLOCK_CHARS = 65_536
#: Documents that one shard of a source is planned for; shards bound every window.
SHARD_DOCS = 4_096
#: Target weight of a source without a given one: its characters to this power.
TEMPERATURE = 0.7
#: Sources are a catalogue: more of them than this is an error, not a cut.
MAX_SOURCES = 10_000


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the weights' proportions; below 0 counts as 0, all 0 as equal."""
    parts = [max(w, 0.0).as_integer_ratio() for w in map(float, weights)]
    unit = max((d for _, d in parts), default=1)  # denominators are powers of 2
    out = [n * (unit // d) for n, d in parts]
    return out if any(out) else [1] * len(out)


def schedule(share: list[int], left: list[int]) -> np.ndarray:
    """The source of each slot, by earliest deadline among released blocks, until a source is used up."""
    if len(share) == 1:
        return np.zeros(left[0], np.int32)
    total = sum(share)
    waiting = [(0, i, 1) for i in range(len(share))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    out = array("i")
    while True:
        while waiting and waiting[0][0] <= len(out):
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * total // share[i]), i, k))
        _, i, k = heapq.heappop(ready)
        out.append(i)
        if k == left[i]:
            return np.frombuffer(out, np.int32)
        heapq.heappush(waiting, (k * total // share[i], i, k + 1))


@dataclass
class Phase:
    first_slot: int
    slots: int
    done: list[int]  # blocks of each source before the phase
    share: list[float]  # target weights of the phase's sources, else 0
    places: list[np.ndarray]  # per source, its slots within the phase


def plan(blocks: list[int], weights: list[float]) -> list[Phase]:
    """Phases until every source is used up; sources of weight 0 come after all others."""
    left, done, phases, slot = list(blocks), [0] * len(blocks), [], 0
    while any(left):
        live = [i for i, n in enumerate(left) if n]
        exact = whole([weights[i] for i in live])
        live, exact = [i for i, w in zip(live, exact) if w], [w for w in exact if w]
        turn = schedule(exact, [left[i] for i in live])
        order, used = np.argsort(turn, kind="stable"), np.bincount(turn, minlength=len(live)).tolist()
        share, places, done_before = [0.0] * len(blocks), [np.zeros(0, np.int64)] * len(blocks), list(done)
        for j, (i, own) in enumerate(zip(live, np.split(order, np.cumsum(used)[:-1]))):
            share[i], places[i] = exact[j] / sum(exact), own
            left[i] -= used[j]
            done[i] += used[j]
        phases.append(Phase(slot, len(turn), done_before, share, places))
        slot += len(turn)
    return phases


def place(phases: list[Phase], source: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The slot of each (source index, block from 0)."""
    out = np.zeros(len(block), np.int64)
    starts = np.array([p.done for p in phases])  # phase x source
    for i in np.unique(source):
        at = np.flatnonzero(source == i)
        which = np.searchsorted(starts[:, i], block[at], "right") - 1
        for f in np.unique(which):
            p, on = phases[f], at[which == f]
            out[on] = p.first_slot + p.places[i][block[on] - p.done[i]]
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, prefix: str = "", source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, block_chars: int = BLOCK_CHARS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """docs with block, slot and part (its place inside the block), names after ``prefix``.

    Sorting by (slot, part) gives the mix.  Weights need not sum to 1; a source
    without one gets its characters to the power 0.7, scaled so that given
    weights keep their shares of what they name.  Null sources are one source
    of their own.  A null text counts as one character, as does an empty one; a
    very long document is a block by itself or ends one.  Order inside a source
    is by shard (a hash of the id) and then id, length and a hash of the text,
    so rows that repeat all of these are interchangeable.  No row is dropped or
    repeated; an empty table gives an empty result.  Columns of docs named like
    an output give way to it; other names pass through, but for those that begin
    with ``__own_``.
    """
    src, shard, size, tie = ("__own_" + n for n in ("src", "shard", "size", "tie"))
    block, slot, part = (prefix + n for n in ("block", "slot", "part"))
    docs = docs.drop(block, slot, part)
    base = docs.withColumn(src, F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))).withColumn(size, F.greatest(F.coalesce(F.col(size_col) if size_col else F.length(text_col), F.lit(0)), F.lit(1)).cast("long")).withColumn(tie, F.xxhash64(id_col, text_col))
    catalogue = base.groupBy(src).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars")).orderBy(src).limit(MAX_SOURCES + 1).collect()
    if len(catalogue) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not catalogue:
        return docs.select("*", *(F.lit(0).cast("long").alias(c) for c in (block, slot, part))).limit(0)
    names = [r[src] for r in catalogue]
    total = sum(r["n"] for r in catalogue)
    shards = max(1, math.ceil(total / shard_docs))
    own = [(weights or {}).get(n[1:] if n else None) for n in names]
    plain = [r["chars"] ** TEMPERATURE for r in catalogue]
    given = sum(w for w in own if w is not None)
    named = sum(p for w, p in zip(own, plain) if w is not None)
    target = [w * named / given if w is not None and given else p for w, p in zip(own, plain)]

    # Blocks are closed inside a shard, and shards hold a bounded number of documents.
    base = base.withColumn(shard, F.pmod(F.xxhash64(id_col, F.lit("shard")), F.lit(shards)))
    inside = Window.partitionBy(src, shard).orderBy(F.col(id_col), F.col(size), F.col(tie))
    local = "__own_local"
    rows = base.withColumn(local, F.floor((F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)) / block_chars)).withColumn(part, F.row_number().over(inside).cast("long"))
    light = base.select(src, shard, size, id_col, tie).withColumn(local, F.floor((F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)) / block_chars))
    # A block number may be skipped by a long document, so blocks are counted, not subtracted.
    made = cut(light.select(src, shard, local).distinct())
    per = made.groupBy(src, shard).agg(F.count(F.lit(1)).alias("n"))
    ahead = cut(per.withColumn("before", F.sum("n").over(Window.partitionBy(src).orderBy(shard).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")))
    counts = {r[src]: r["n"] for r in ahead.groupBy(src).agg(F.sum("n").alias("n")).collect()}
    phases = docs.sparkSession.sparkContext.broadcast(plan([counts[n] for n in names], target))
    index = {n: i for i, n in enumerate(names)}

    @F.pandas_udf(LongType())
    def slot_of(s, b):
        return type(b)(place(phases.value, s.map(index).to_numpy(), b.to_numpy()), dtype="int64")

    at = made.join(ahead.drop("n"), [src, shard]).withColumn(block, F.col("before") + F.row_number().over(Window.partitionBy(src, shard).orderBy(local)) - 1)
    at = cut(at.withColumn(slot, slot_of(src, block)).select(src, shard, local, block, slot))
    return rows.join(at, [src, shard, local]).select(*(F.col(f"`{c}`") for c in docs.columns), block, slot, part)


def mixing(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, block, slot, part and n_chars of every row; no text is shuffled."""
    light = docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.xxhash64("text").alias("text"))
    return mix(light, weights, size_col="n_chars").select("doc_id", "source", "block", "slot", "part", "n_chars")


def in_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs' own rows and columns in the order of the mix (pipeline stage).

    Null sources, null and empty texts, repeated rows and very long texts are
    placed as ``mix`` places them, none is dropped; rows that tie in all of id,
    length and text are interchangeable; an empty table stays empty.  Columns of
    any names but those that begin with ``__mix_`` or ``__own_`` pass through.
    """
    p = "__mix_"
    return mix(docs, weights, prefix=p).orderBy(p + "slot", p + "part").select(*(F.col(f"`{c}`") for c in docs.columns))
