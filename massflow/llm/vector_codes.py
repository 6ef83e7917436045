"""Vector code compression: product codes of whole-number vectors.

Components become whole numbers and vectors are cut into equal parts, each with
a codebook of its own.  Every round broadcasts one kd-tree per codebook; a
branch-and-bound search finds each part's nearest entry, and also visits nodes
whose bound equals the best distance, as a lower index may tie there.  Tasks
send whole sums and counts per entry, so entries are exact at any partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from massflow.llm.frames import Scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries of a kd-tree's leaf.
LEAF = 4
#: Sums per label of at most this many labels are broadcast; more are joined by salted keys.
MOST_LABELS = 100_000
SALTS = 32


@dataclass
class Node:
    lo: np.ndarray  # the box of the entries below
    hi: np.ndarray
    members: np.ndarray  # a leaf's entries, ascending
    children: tuple[Node, Node] | None = None

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Least squared distance that an entry below can have."""
        off = np.maximum(np.maximum(self.lo - x, x - self.hi), 0)
        return (off * off).sum(1)


@dataclass
class Tree:
    """A kd-tree over the entries of one codebook."""

    entries: np.ndarray
    root: Node = field(init=False)

    def __post_init__(self):
        self.root = self._node(np.arange(len(self.entries)))

    def _node(self, members: np.ndarray) -> Node:
        own = self.entries[members]
        lo, hi = own.min(0), own.max(0)
        wide = hi - lo
        if len(members) <= LEAF or not (wide > 0).any():
            return Node(lo, hi, np.sort(members))
        order = members[np.argsort(own[:, int(np.argmax(wide))], kind="stable")]
        half = len(order) // 2
        return Node(lo, hi, members, (self._node(order[:half]), self._node(order[half:])))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry, the lowest of those that tie, and its squared distance."""
        best = np.full(len(x), np.iinfo(np.int64).max, np.int64) if x.dtype != object else np.full(len(x), math.inf, object)
        at = np.full(len(x), len(self.entries), np.int64)

        def visit(node: Node, rows: np.ndarray) -> None:
            own = x[rows]
            if node.children is None:
                for i in node.members:
                    off = own - self.entries[i]
                    d = (off * off).sum(1)
                    better = (d < best[rows]) | ((d == best[rows]) & (i < at[rows]))
                    best[rows[better]], at[rows[better]] = d[better], i
                return
            a, b = node.children
            to_a, to_b = a.bound(own), b.bound(own)
            first = to_a <= to_b
            for near, far, mine, to_near, to_far in ((a, b, first, to_a, to_b), (b, a, ~first, to_b, to_a)):
                sub = rows[mine]
                for child, bound in ((near, to_near[mine]), (far, to_far[mine])):
                    open_ = sub[bound <= best[sub]]
                    if len(open_):
                        visit(child, open_)

        if len(x):
            visit(self.root, np.arange(len(x)))
        return at, best


@dataclass
class Codebooks:
    """Entries of each part as lists of whole numbers; width is the vectors' length with padding."""

    books: list[list[list[int]]]
    width: int
    scale: int = SCALE

    @property
    def part(self) -> int:
        return self.width // len(self.books)

    @property
    def largest(self) -> int:
        return max((abs(v) for book in self.books for entry in book for v in entry), default=0)

    def sha256(self) -> str:
        flat = (str(v) for book in self.books for entry in book for v in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def trees(self, kind: type) -> list[Tree]:
        """One per part; none without entries, which only a table without rows gives."""
        return [Tree(np.array(book, kind).reshape(len(book), self.part)) for book in self.books if book]


def taking_part(vector: str | Column) -> Column:
    """A vector without null or non-finite components."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False))), F.lit(False))


def _whole(x: float, scale: int) -> int:
    return math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale


def whole_numbers(column: pa.Array, width: int, scale: int, largest: int) -> np.ndarray:
    """The vectors as rows of floor(scale * x), shorter ones filled with zeros.

    Numbers whose squared distances might leave 64 bits (``largest``: of the
    entries) are Python's own.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    made = np.floor(flat * scale)
    most = max(float(np.abs(made).max(initial=0)), float(largest))
    if (2 * most + 1) ** 2 * max(width, 1) < 2**62 and most * max(len(size), 1) < 2**62:
        values, out = made.astype(np.int64), np.zeros((len(size), width), np.int64)
    else:
        values = np.empty(len(flat), object)
        values[:] = [_whole(x, scale) for x in flat.tolist()]
        out = np.zeros((len(size), width), object)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _limbs(v: int) -> list[int]:
    """v in base 2**32, every digit with v's sign: sums of digits stay in 64 bits."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & 0xFFFFFFFF))
        v >>= 32
    return out


def _each_part(books: Codebooks) -> Callable:
    """A function that gives (part number, part's rows, nearest entries, distances) of a batch's vectors."""
    kept = {kind: books.trees(kind) for kind in (np.int64, object) if kind is object or books.largest < 2**62}
    largest = books.largest

    def parts(column):
        x = whole_numbers(column, books.width, books.scale, largest)
        trees = kept[object if x.dtype == object else np.int64]
        for p, tree in enumerate(trees):
            own = x[:, p * books.part : (p + 1) * books.part]
            yield p, own, *tree.nearest(own)

    return parts


def _updated(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks after one round; vectors: (v).  The driver gets entries x (width + 1) sums."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # entries x width numbers, whatever the corpus

    def sums(batches):
        b = shared.value
        parts, total, count = _each_part(b), {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, own, at, _ in parts(batch.column(0)):
                order = np.argsort(at, kind="stable")
                entry, start, n = np.unique(at[order], return_index=True, return_counts=True)
                added = np.add.reduceat(own[order], start, axis=0) if b.part else np.zeros((len(entry), 0), np.int64)
                for e, s, k in zip(entry.tolist(), added.tolist(), n.tolist()):
                    slot = p * ENTRIES_STRIDE + e
                    count[slot] = count.get(slot, 0) + k
                    total[slot] = [x + y for x, y in zip(total[slot], s)] if slot in total else s
        rows = [(slot, -1, 0, k) for slot, k in count.items()]
        rows += [(slot, pos, limb, v) for slot, s in total.items() for pos, x in enumerate(s) for limb, v in enumerate(_limbs(x))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["slot", "pos", "limb", "v"])

    found = vectors.mapInArrow(sums, "slot long, pos int, limb int, v long").groupBy("slot", "pos", "limb").agg(F.sum("v").alias("v")).collect()
    count = {r["slot"]: r["v"] for r in found if r["pos"] < 0}
    total: dict[tuple[int, int], int] = {}
    for r in found:
        if r["pos"] >= 0:
            total[r["slot"], r["pos"]] = total.get((r["slot"], r["pos"]), 0) + (r["v"] << 32 * r["limb"])
    new = []
    for p, book in enumerate(books.books):
        slots = [p * ENTRIES_STRIDE + e for e in range(len(book))]
        new.append([[total.get((s, i), 0) // count[s] for i in range(books.part)] if s in count else entry for s, entry in zip(slots, book)])
    shared.destroy()
    return Codebooks(new, books.width, books.scale)


#: Slots of one part in a round's sums.
ENTRIES_STRIDE = 1 << 32


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all rows that take part.

    They start as the parts of the rows with the least ids; rows that repeat an
    id come in the order of their vectors, null ids last.  Vectors of several
    lengths, or of one that ``parts`` does not divide, are filled with zeros to
    the next multiple.  No rows: codebooks without entries.
    """
    v = df.where(taking_part(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    longest = v.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = v.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # ``entries`` rows
    start = [[_whole(x, scale) for x in r["v"]] + [0] * (width - len(r["v"])) for r in first]
    part = width // parts
    books = Codebooks([[s[p * part : (p + 1) * part] for s in start] for p in range(parts)], width, scale)
    for _ in range(rounds if start else 0):
        books = _updated(v.select("v"), books)
    return books


def _extended(df: DataFrame, **fields: str) -> StructType:
    return StructType([*df.schema, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in fields.items()))])


def encode(df: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """df's rows that take part, with code (two hex digits a part) and error, the squared distances summed over parts.

    Rows of one vector have one code.  An error that no long holds is null.
    Other columns stay, but for those named like an output, which go.
    """
    if any(len(book) > 256 for book in books.books):
        raise ValueError("two hex digits hold at most 256 entries")
    rest = [k for k in df.columns if k not in ("code", "error")]
    kept = df.where(taking_part(vector_col)).select(*rest, F.col(vector_col).cast("array<double>").alias("__v"))
    out = kept.drop("__v")
    shared = df.sparkSession.sparkContext.broadcast(books)  # entries x width numbers, whatever the corpus

    def run(batches):
        parts = _each_part(shared.value)
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            n = batch.num_rows
            code, error = np.zeros((n, len(shared.value.books)), "<U2"), np.zeros(n, np.int64)
            for p, _, at, d in parts(batch.column(batch.num_columns - 1)) if n else ():
                code[:, p], error = digits[at], error + d
            codes = ["".join(c) for c in code.tolist()]
            errors = [int(e) if e < 2**63 else None for e in error.tolist()]
            made = [pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "code", "error"])

    return kept.mapInArrow(run, _extended(out, code="string", error="long"))


def decode(df: DataFrame, books: Codebooks, code_col: str = "code", out_col: str = "approximation") -> DataFrame:
    """df with the vector that each code stands for, as array<double>; null for a null code."""
    df = df.drop(out_col)
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        b = shared.value
        for batch in batches:
            made = []
            for code in batch.column(code_col).to_pylist():
                at = None if code is None else [int(code[i : i + 2], 16) for i in range(0, len(code), 2)]
                made.append(None if at is None else [v / b.scale for book, i in zip(b.books, at) for v in book[i]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names, out_col])

    return df.mapInArrow(run, _extended(df, **{out_col: "array<double>"}))


def vector_codes(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of the rows of embeddings that take part.

    Null labels are one label.  Repeated rows each count and are returned; an
    empty table, or one without a row that takes part, gives an empty result.
    """
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    books = fit(rows)
    with Scratch(df.sparkSession) as work:
        coded = work.last(encode(rows, books).drop("embedding"))
        # A sum that no long holds is null, as an error is.
        sums = work.last(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    if sums.count() <= MOST_LABELS:
        with_sums = coded.join(F.broadcast(sums), coded["label"].eqNullSafe(sums["label"]))
    else:
        left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        right = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        with_sums = left.join(right, left["label"].eqNullSafe(right["label"]) & (left["salt"] == right["salt"]))
    return with_sums.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same over whole tables by comparing every part with every entry; vectors of one length that 16 divides."""
    ctes = [
        "w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, len(v) // 16 AS n FROM w)",
        "parts AS (SELECT r, s.range AS p, v[s.range * n + 1 : (s.range + 1) * n] AS x FROM k, range(16) s)",
        "books0 AS (SELECT p, r - 1 AS e, x FROM parts WHERE r <= 64)",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"near{k} AS (SELECT r, parts.p, min({{'d': CAST(list_sum(list_transform(range(1, len(parts.x) + 1), lambda i: (parts.x[i] - b.x[i]) * (parts.x[i] - b.x[i]))) AS BIGINT), 'e': e}}) AS m, any_value(parts.x) AS x FROM parts JOIN books{k} b ON b.p = parts.p GROUP BY 1, 2)")
        if k < ROUNDS:
            ctes.append(f"sums{k} AS (SELECT p, m.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM near{k}, (SELECT unnest(range(1, 1 + (SELECT max(n) FROM k))) AS i) GROUP BY 1, 2, 3)")
            ctes.append(f"mean{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM sums{k} GROUP BY 1, 2)")
            ctes.append(f"books{k + 1} AS (SELECT b.p, b.e, coalesce(mean{k}.x, b.x) AS x FROM books{k} b LEFT JOIN mean{k} ON mean{k}.p = b.p AND mean{k}.e = b.e)")
    last = f"near{ROUNDS}"
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM {last} GROUP BY 1)")
    ctes.append(f"hashed AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM books{ROUNDS})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN k USING (r), hashed"


ORACLE = _oracle()
