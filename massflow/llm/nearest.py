"""Nearest neighbours by inner product, with a hash-prefix forest.

Each tree gives a vector a string: the signed axis nearest to it after a random
rotation, then the sides of random planes on which it lies, one bit each, as
many as the table needs for small leaves.  A tree is the sorted array of its
strings, and a prefix a contiguous range of it.  A query has, in every tree, the
strings that begin with its ``PROBES`` nearest axes; it descends to their
longest prefixes that rows share, and ascends in all trees together, bit by bit,
until the ranges hold enough rows.  What is enough is fitted on a bounded sample
of queries, whose true neighbours are looked up among all rows: the least number
with which their recall reaches ``RECALL``.  So tables with close neighbours are
searched in short ranges, and directionless ones in as much as the recall takes,
at any size.  Strings are long at any size, and a query goes to the root only
where its axes' ranges would hold as many rows as the table.  Candidates are scored exactly, in double precision; none is
cut.

Trees are dealt out by a short prefix; a dense prefix is dealt over salts, all of
which its queries visit.  Inner products are turned into angles by one more
coordinate per norm band (rows within a factor 2), so rows of very different
length do not spoil each other's strings.  Equal vectors are one row of the
forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massflow.llm.frames import cut

TREES = 10
AXES = 64
#: Bits of a signed axis.
SYMBOL = 7
#: Nearest axes whose strings a query looks up in each tree.
PROBES = 10
#: Rows of a leaf that the strings' length is planned for, and their longest.
LEAF_ROWS = 16
MOST_BITS = 30
#: Bits after the axis that strings have at least, at any size.
LEAST_BITS = 12
#: Rows, and queries, of a dealt part of a tree.
NODE_ROWS = 16_384
#: Queries on which the ascent is fitted, and the recall that it is fitted to.
FIT_QUERIES = 96
RECALL = 0.92
BROADCAST_PARTS = 50_000
SEED = 17


def rotations(dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and planes of each tree; the first planes are the same whatever their number."""
    rng = np.random.default_rng(SEED)
    axes = rng.standard_normal((TREES, AXES, dim + 1)).astype(np.float32)
    return axes, np.stack([rng.standard_normal((TREES, dim + 1)).astype(np.float32) for _ in range(bits)], 1) if bits else np.zeros((TREES, 0, dim + 1), np.float32)


def strings(x: np.ndarray, axes: np.ndarray, plane: np.ndarray, probes: int) -> np.ndarray:
    """rows x (trees * probes): strings as numbers, the nearest axis first and the last bit lowest."""
    out = np.zeros((len(x), len(axes), probes), np.int32)
    for t, (r, p) in enumerate(zip(axes, plane)):
        y = x @ r.T
        size = np.abs(y)
        top = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
        code = 2 * top + (np.take_along_axis(y, top, 1) < 0)
        for side in (x @ p.T > 0).T:
            code = 2 * code + side[:, None]
        out[:, t] = code
    return out.reshape(len(x), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows whose vector is finite and not all zero."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + 0.0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each row whose id is divisible by ``every``.

    Null, zero and non-finite vectors and rows with a null id take no part, nor
    do vectors of another length than most have (of two lengths equally common,
    the longer).  A query's own id is never its answer; rows repeated under one
    id count once (with their greatest score), and as a query with the least of
    their vectors, compared by components.  Ties go to the smaller id.  With
    fewer than k other rows, all are returned; an empty table gives an empty
    result.  Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes["dim"]
    rows = rows.where(F.size("v") == dim)
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max((F.col("id") % every == 0).cast("int")).alias("asked")))
    # A repeated id with another vector could be another class's rep: number classes by vector as well.
    classes = classes.withColumn("c", F.struct("rep", F.xxhash64("v")))
    members = _members(rows, classes, k + 1)

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    flat = classes.select("c", "asked", "v", norm.alias("norm")).withColumn("band", F.floor(F.log2("norm") + 0.5).cast("int"))
    bands = flat.groupBy("band").agg(F.max("norm").alias("m"), F.count(F.lit(1)).alias("n")).collect()  # one row per power of two
    longest, total = {r["band"]: r["m"] for r in bands}, sum(r["n"] for r in bands)
    bits = min(MOST_BITS - SYMBOL, max(LEAST_BITS, math.ceil(math.log2(max(2, total / LEAF_ROWS))) - SYMBOL))
    coded = cut(_coded(flat, dim, bits, longest))

    placed = _ascended(coded, bits, k, dim, total)
    tree = F.expr(f"CAST(at DIV {PROBES} AS INT)").alias("tree")
    low = SYMBOL + bits - min(SYMBOL + bits, max(0, math.ceil(math.log2(max(1, total / NODE_ROWS)))))
    rows_in = coded.select(F.col("c.rep").alias("rep"), F.col("c.h").alias("h"), "bytes", F.posexplode("codes").alias("tree", "code")).withColumn("part", F.shiftright("code", low))
    own = F.expr(f"shiftleft(shiftright(code, {bits + 1} - depth), {bits + 1} - depth)")
    ask_in = placed.select(F.col("c.rep").alias("rep"), F.col("c.h").alias("h"), "bytes", "depth", F.posexplode("q_codes").alias("at", "code")).where("depth > 0 OR at = 0")
    ask_in = ask_in.select("rep", "h", "bytes", tree, F.when(F.col("depth") > 0, own).otherwise(0).alias("lo"), F.when(F.col("depth") > 0, own + F.expr(f"shiftleft(1, {bits + 1} - depth)") - 1).otherwise((1 << (SYMBOL + bits)) - 1).alias("hi"))
    ask_in = ask_in.withColumn("part", F.explode(F.sequence(F.shiftright("lo", low), F.shiftright("hi", low))))
    parts = rows_in.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows")).join(ask_in.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("asks")), ["tree", "part"])
    parts = cut(parts.select("tree", "part", F.ceil(F.col("rows") / NODE_ROWS).cast("int").alias("salts"), F.ceil(F.col("asks") / NODE_ROWS).cast("int").alias("turns")))
    tiles = F.broadcast(parts) if parts.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS else parts
    none = F.lit(None).cast("int")
    rows_in = rows_in.select("tree", "part", "rep", "h", F.lit(False).alias("query"), "code", none.alias("lo"), none.alias("hi"), "bytes", F.lit(None).cast("double").alias("least"))
    ask_in = ask_in.select("tree", "part", "rep", "h", F.lit(True).alias("query"), none.alias("code"), "lo", "hi", "bytes")

    def scored(rows: DataFrame, asks: DataFrame) -> DataFrame:
        both = rows.unionByName(asks.select(*rows.columns)).join(tiles, ["tree", "part"])
        both = both.withColumn("salt", F.explode(_dealt("salts", ~F.col("query")))).withColumn("turn", F.explode(_dealt("turns", F.col("query")))).drop("salts", "turns")
        return both.groupBy("tree", "part", "salt", "turn").applyInArrow(_best(k + 1), "q_rep long, q_h long, rep long, h long, score double")

    # The k + 1 found in the first tree bound a query's answer from below; the other trees report what reaches that.
    begun = cut(scored(rows_in.where("tree = 0"), ask_in.where("tree = 0").withColumn("least", F.lit(None).cast("double"))))
    place = Window.partitionBy("q_rep", "q_h").orderBy(F.desc("score"))
    least = begun.withColumn("r", F.row_number().over(place)).where(F.col("r") == k + 1).select(F.col("q_rep").alias("rep"), F.col("q_h").alias("h"), F.col("score").alias("least"))
    found = begun.unionByName(scored(rows_in.where("tree > 0"), ask_in.where("tree > 0").join(least, ["rep", "h"], "left")))
    found = found.select(F.struct(F.col("q_rep").alias("rep"), F.col("q_h").alias("h")).alias("q"), F.struct("rep", "h").alias("c"), "score")
    best = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("q").orderBy(F.desc("score"), F.col("c.rep"))
    best = best.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1).drop("r")
    # At most (k + 1)^2 ids per asked vector; the k + 1 best serve any of its ids.
    each = best.join(members, "c").select("q", F.explode("ids").alias("id"), "score").groupBy("q", "id").agg(F.max("score").alias("score"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    answer = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("answers"))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).join(classes.where("asked = 1").select("v", "c"), "v").select("id", F.col("c").alias("q"))
    out = queries.join(answer, "q").withColumn("answers", F.slice(F.filter("answers", lambda a: a["id"] != F.col("id")), 1, k))
    return out.select(F.col("id").alias("query_id"), F.posexplode("answers").alias("p", "a")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("a.id").alias("vec_id"), F.col("a.score").alias("score"))


def _dealt(n: str, one: Column) -> Column:
    """The share of n that a row goes to, or all of them."""
    return F.when(one, F.array(F.pmod(F.xxhash64("rep", "h", F.lit(n)), F.col(n)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(n) - 1))


def _members(rows: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(c, ids): the k least ids of each class, taken per salt first."""
    single = classes.where("n = 1").select("c", F.array("rep").alias("ids"))
    many = rows.join(classes.where("n > 1").select("v", "c"), "v").select("c", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = many.withColumn("r", F.row_number().over(Window.partitionBy("c", "salt").orderBy("id"))).where(F.col("r") <= k)
    least = part.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id"))).where(F.col("r") <= k)
    return single.unionByName(least.groupBy("c").agg(F.collect_list("id").alias("ids")))


def _coded(flat: DataFrame, dim: int, bits: int, longest: dict[int, float]) -> DataFrame:
    """(c, asked, bytes, codes, q_codes): each tree's string of a row, and of an asked row the strings that it looks up."""

    def run(batches):
        axes, plane = rotations(dim, bits)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            norm, asked = b.column("norm").to_numpy(), b.column("asked").to_numpy() == 1
            top = np.array([longest[i] for i in b.column("band").to_pylist()])
            extra = np.sqrt(np.maximum(0.0, 1 - (norm / top) ** 2))
            as_row = strings(np.column_stack([x / top[:, None], extra]).astype(np.float32), axes, plane, 1)
            as_query = strings(np.column_stack([x[asked] / norm[asked, None], np.zeros(asked.sum())]).astype(np.float32), axes, plane, PROBES)
            at = np.concatenate([[0], np.cumsum(asked)]) * TREES * PROBES
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * TREES), pa.array(as_row.ravel()))
            wanted = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(as_query.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("asked"), pa.array([r.tobytes() for r in x], pa.binary()), codes, wanted], ["c", "asked", "bytes", "codes", "q_codes"])

    return flat.mapInArrow(run, "c struct<rep:long,h:long>, asked int, bytes binary, codes array<int>, q_codes array<int>")


def _held(coded: DataFrame, bits: int) -> DataFrame:
    """(depth, tree, prefix, rows) of all prefixes from the axis on: leaves are counted first, and their counts added up."""
    leaves = coded.select(F.posexplode("codes").alias("tree", "code")).groupBy("tree", "code").agg(F.count(F.lit(1)).alias("rows"))
    each = leaves.withColumn("depth", F.explode(F.sequence(F.lit(1), F.lit(bits + 1))))
    return each.groupBy("depth", "tree", F.expr(f"shiftright(code, {bits + 1} - depth)").alias("prefix")).agg(F.sum("rows").alias("rows"))


def _ascended(coded: DataFrame, bits: int, k: int, dim: int, total: int) -> DataFrame:
    """The asked rows with the depth at which their ascent ends: 0 is the root, 1 the axis, and every bit one more."""
    asks = coded.where("asked = 1")
    tree = F.expr(f"CAST(at DIV {PROBES} AS INT)").alias("tree")
    seen = asks.select("c", F.posexplode("q_codes").alias("at", "code")).select("c", tree, "code", F.explode(F.sequence(F.lit(1), F.lit(bits + 1))).alias("depth"))
    seen = seen.withColumn("prefix", F.expr(f"shiftright(code, {bits + 1} - depth)")).join(_held(coded, bits), ["depth", "tree", "prefix"])
    seen = cut(seen.groupBy("c", "depth").agg(F.sum("rows").alias("rows")))
    # So many rows in all trees are k + 1 different ones in one of them.
    enough = max(_fitted(coded, seen, bits, k, dim, total), TREES * (k + 1))
    depths = seen.where((F.col("rows") >= enough) & (F.col("rows") < total)).groupBy("c").agg(F.max("depth").alias("depth"))
    return asks.join(depths, "c", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def _fitted(coded: DataFrame, seen: DataFrame, bits: int, k: int, dim: int, total: int) -> int:
    """Rows in all ranges at which an ascent may end, from a sample's true neighbours.

    The sample is the FIT_QUERIES asked vectors of least hash.  A neighbour is
    met at a depth if its string in some tree begins as one of the query's does.
    """
    spark = coded.sparkSession
    some = coded.where("asked = 1").orderBy(F.xxhash64("c", F.lit("fit")), "c").limit(FIT_QUERIES).select("c", "bytes", "q_codes").collect()
    if not some:
        return 0
    asked = spark.sparkContext.broadcast(np.array([np.frombuffer(r["bytes"]) for r in some]))

    def nearest(batches):
        y = asked.value
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(v.as_buffer() for v in b.column("bytes")), np.float64).reshape(-1, dim)
            s = y @ x.T
            keep = min(k + 1, len(x))
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep].ravel()
            who = np.repeat(np.arange(len(y), dtype=np.int32), keep)
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(s[who, top]), b.column("codes").take(pa.array(top))], ["q", "score", "codes"])

    near = coded.select("bytes", "codes").mapInArrow(nearest, "q int, score double, codes array<int>")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "codes"))).where(F.col("r") <= k + 1)
    which = {(r["c"]["rep"], r["c"]["h"]): i for i, r in enumerate(some)}
    rows = np.zeros((len(some), bits + 2), np.int64)
    rows[:, 0] = total
    sample = spark.createDataFrame([(r["c"],) for r in some], seen.select("c").schema)
    for r in seen.join(F.broadcast(sample), "c").collect():  # samples x depths
        rows[which[r["c"]["rep"], r["c"]["h"]], r["depth"]] = min(r["rows"], total)
    met: list[list[int]] = [[] for _ in some]  # the depth to which each neighbour goes with its query in the best tree
    for r in near.collect():  # samples x (k + 1)
        if r["r"] > 1:  # the first is the query itself, or equally near
            ask = some[r["q"]]["q_codes"]
            shared = (bits + 1 - max(0, int(a ^ b).bit_length()) for t, b in enumerate(r["codes"]) for a in ask[t * PROBES : (t + 1) * PROBES])
            met[r["q"]].append(max(0, *shared))

    def recall(enough: int) -> float:
        depth = [max((d for d in range(1, bits + 2) if enough <= own[d] < total), default=0) for own in rows]
        return float(np.mean([np.mean([m >= d for m in ms]) for ms, d in zip(met, depth) if ms] or [1.0]))

    # More rows never find less, so the least number is found by bisection; the root finds all.
    tried = np.unique(rows)
    lo, hi = 0, len(tried) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if recall(int(tried[mid])) >= RECALL else (mid + 1, hi)
    return int(tried[lo])


def _best(k: int):
    def run(g: pa.Table) -> pa.Table:
        """The k best rows of each query in its ranges of the part's sorted strings."""
        kinds = pa.schema([("q_rep", pa.int64()), ("q_h", pa.int64()), ("rep", pa.int64()), ("h", pa.int64()), ("score", pa.float64())])
        rows = g.filter(pa.compute.invert(g["query"])).sort_by("code")
        q = g.filter(g["query"]).sort_by([("lo", "ascending"), ("hi", "ascending")])
        if not rows.num_rows or not q.num_rows:
            return kinds.empty_table()

        def matrix(t: pa.Table) -> np.ndarray:
            return np.frombuffer(b"".join(v.as_buffer() for v in t["bytes"]), np.float64).reshape(t.num_rows, -1)

        code, x, y = rows["code"].to_numpy(), matrix(rows), matrix(q)
        rep, h, q_rep, q_h = (t[n].to_numpy() for t in (rows, q) for n in ("rep", "h"))
        least = np.nan_to_num(q["least"].to_numpy(), nan=-np.inf)
        first, last = np.searchsorted(code, q["lo"].to_numpy(), "left"), np.searchsorted(code, q["hi"].to_numpy(), "right")
        runs = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (last[1:] != last[:-1]), [True]]))
        parts = []
        for lo, hi in ((a, min(a + 256, e)) for r, e in zip(runs, runs[1:]) for a in range(r, e, 256)):
            a, b = first[lo], last[lo]
            if a == b:
                continue
            for j, s in enumerate(y[lo:hi] @ x[a:b].T):
                keep = np.flatnonzero(s >= least[lo + j])
                if len(keep) > k:
                    keep = keep[s[keep] >= np.partition(s[keep], len(keep) - k)[len(keep) - k]]
                parts.append((np.full(len(keep), lo + j), a + keep, s[keep]))
        if not parts:
            return kinds.empty_table()
        qi, ri, s = (np.concatenate(p) for p in zip(*parts))
        # A query's ranges in this part do not overlap; the k best of all of them go on.
        order = np.lexsort((h[ri], rep[ri], -s, q_h[qi], q_rep[qi]))
        qi, ri, s = qi[order], ri[order], s[order]
        new = np.concatenate([[True], (q_rep[qi][1:] != q_rep[qi][:-1]) | (q_h[qi][1:] != q_h[qi][:-1])])
        start = np.flatnonzero(new)
        on = np.arange(len(qi)) - np.repeat(start, np.diff(np.append(start, len(qi)))) < k
        qi, ri, s = qi[on], ri[on], s[on]
        return pa.table([q_rep[qi], q_h[qi], rep[ri], h[ri], s], schema=kinds)

    return run
