"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words: a run of spaces with what follows it, pieces between
line ends, and marks that follow a letter in no piece.  No piece of the
vocabulary spans such a cut, so words are encoded independently and each
distinct word once.  A word's substrings of bounded length are exploded and
joined to the piece table; the edges are grouped by word and folded with
Spark's ``aggregate`` over a bit mask of the symbol boundaries that are left:

* ``unigram`` models: Viterbi over end positions, best score first;
* ``bpe`` models: the best-ranked edge that covers exactly two symbols is
  merged, leftmost first, until none is left.  (A Viterbi fold maximises the sum
  of scores, which is not how a BPE model segments.)

Characters outside the vocabulary fall back to byte pieces.  A word longer than
the mask is first cut between characters that stand together in no piece; what
is still longer is folded with a heap, by the same rule.

Documents stay in chunks of neighbouring rows.  A chunk's texts, compressed, and
its part of the dictionary meet in one partition, dictionary first, and the
texts are coded one blob at a time.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.frames import bound_batches, release, with_position

#: Bytes of text that one chunk is planned for.
CHUNK_BYTES = 20 << 20
#: The same where an executor's memory is not shared with other stages of a session: larger chunks repeat fewer words.
LARGE_CHUNK_BYTES, LARGE_LATTICE_BYTES = 36 << 20, 2 << 20
#: Bytes of text in one compressed blob.
BLOB_BYTES = 1 << 20
#: Bytes of text of a chunk that are coded at once.
CODED_BYTES = 2 << 20
#: Dictionary entries that a task packs together, and ids of the documents of one batch.
PACK_ENTRIES, BATCH_IDS = 1 << 18, 1 << 18
#: Words longer than this do not fit the mask of boundaries.
LONG_WORD = 62
#: Neighbouring chunks whose common words are coded once.
CHUNKS_OF_A_WORD = 128
#: Bytes of text whose distinct words make one task's lattices.
LATTICE_BYTES = 1 << 20
MARK = "▁"
_SPACES = re.compile(r" +[^ ]*")


@dataclass
class Pieces:
    text: list[str]
    score: list[float]
    kind: list[str]  # normal, byte, other
    algorithm: str = "bpe"

    def __post_init__(self):
        self.longest = max((len(t) for t, k in zip(self.text, self.kind) if k == "normal"), default=1)
        self.rank = {t: (-s, i) for i, (t, s, k) in enumerate(zip(self.text, self.score, self.kind)) if k == "normal"}
        self.byte0 = next((i for i, k in enumerate(self.kind) if k == "byte"), None)
        spans = [t for t in self.rank if "\n" in t or re.search(f"[^{MARK}]{MARK}", t)]
        if spans:
            raise ValueError(f"pieces span words: {spans[:3]}")
        # characters that stand together in a piece: a word may be cut between others
        self.pairs = {a + b for t in self.rank for a, b in zip(t, t[1:])}
        held = {p[1] for p in self.pairs if p[0].isalpha()}
        self.ends = "".join(c for c in ",.;:?!|*#$%&" if c not in held)
        # what a character outside the vocabulary costs a path
        self.unknown = min((s for s, k in zip(self.score, self.kind) if k == "normal"), default=0.0) - 10
        # what a piece stands for, as bytes
        self.raw = [bytes([i - self.byte0]) if k == "byte" else t.replace(MARK, " ").encode() if k == "normal" else b"" for i, (t, k) in enumerate(zip(self.text, self.kind))]

    def table(self, spark: SparkSession) -> DataFrame:
        """(sub, rank, score, id): the vocabulary, a bounded table whatever the corpus; the empty sub marks a word."""
        order = {c: r for r, c in enumerate(sorted({c for c, _ in self.rank.values()}))}
        return spark.createDataFrame([("", -1, 0.0, -1), *((t, order[c], -float(c), i) for t, (c, i) in self.rank.items())], "sub string, rank int, score double, id int")


@dataclass
class Cuts:
    """What cutting words needs of a vocabulary: a worker that does not encode holds no pieces."""

    ends: str
    pairs: set[str]
    byte0: int | None


def load(path: str, algorithm: str = "bpe") -> Pieces:
    from sentencepiece import SentencePieceProcessor

    s = SentencePieceProcessor(model_file=path)
    ids = range(s.vocab_size())
    kind = ["byte" if s.is_byte(i) else "other" if s.is_control(i) or s.is_unknown(i) or s.is_unused(i) else "normal" for i in ids]
    return Pieces([s.id_to_piece(i) for i in ids], [s.get_score(i) for i in ids], kind, algorithm)


def spaced(text: str) -> list[str]:
    """What follows each word-starting space of " " + text; all but single spaces stay in front."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [w[1:] for w in _SPACES.findall(" " + text)]
    return text.split(" ")


def words_of(part: str, pieces: Pieces | Cuts) -> list[str]:
    """The words of " " + part in order, with ``\\n`` for each line end; their join is " " + part."""
    out: list[str] = []
    for k, line in enumerate((" " + part).split("\n")):
        if k:
            out.append("\n")
        if not line:
            continue
        head = line.rstrip(pieces.ends) if pieces.ends else line
        cuts = [head, line[len(head) :]] if head and head != line and head[-1].isalpha() else [line]
        for w in cuts:
            out += [w] if len(w) <= LONG_WORD else _apart(w, pieces.pairs)
    return out


def _apart(word: str, pairs: set[str]) -> list[str]:
    """A long word cut wherever two characters stand together in no piece."""
    marked = word.replace(" ", MARK)
    at = [0, *(i for i in range(1, len(word)) if marked[i - 1 : i + 1] not in pairs), len(word)]
    return [word[a:b] for a, b in zip(at, at[1:])]


def _first(x: Column) -> Column:
    return F.get(x, F.lit(0))


def _shift(x: int, n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(x).cast("long"), n)


def _intact(m: Column, x: Column) -> Column:
    """Whether both ends of an edge are boundaries of mask m."""
    return m.bitwiseAND(x["ends"]) == x["ends"]


def _bpe_fold(n: Column, edges: Column) -> Column:
    """Mask of the boundaries left after all merges; edges come best rank first, then leftmost."""

    def step(acc: Column, _: Column) -> Column:
        m = acc["m"]
        alive = F.filter(acc["e"], lambda x: _intact(m, x))

        # Bound by a lambda each, as what is written twice is evaluated twice.
        def merged(e: Column) -> Column:
            hit = _first(F.filter(e, lambda x: F.bit_count(m.bitwiseAND(x["inner"])) == 1))["inner"]
            return _first(F.transform(F.array(hit), lambda h: F.struct(F.when(h.isNull(), m).otherwise(m.bitwiseAND(F.bitwise_not(h))).alias("m"), F.when(h.isNotNull(), e).alias("e"))))

        return F.when(acc["e"].isNull(), acc).otherwise(_first(F.transform(F.array(alive), merged)))

    start = F.struct((_shift(2, n) - 1).alias("m"), F.filter(edges, lambda x: x["k"] > 1).alias("e"))
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda acc: acc["m"])


def _viterbi_fold(n: Column, edges: Column, unknown: float) -> Column:
    """Mask of the boundaries on the best path; a character without an edge costs ``unknown``."""

    def step(acc: Column, e: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: (x["k"] > 0) & (x["s"] + x["k"] == e)), lambda x: F.struct((F.get(acc, x["s"])["c"] + x["score"]).alias("c"), x["s"].alias("p")))
        alone = F.struct((F.get(acc, e - 1)["c"] + F.lit(unknown)).alias("c"), (e - 1).alias("p"))
        return F.concat(acc, F.array(F.array_max(F.concat(ways, F.array(alone)))))

    best = F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(F.lit(0.0).alias("c"), F.lit(-1).alias("p"))), step)

    def back(acc: Column, _: Column) -> Column:
        p = F.greatest(F.get(best, acc["at"])["p"], F.lit(0))
        return F.struct(p.alias("at"), acc["m"].bitwiseOR(_shift(1, p)).alias("m"))

    return F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), _shift(1, n).alias("m")), back, lambda acc: acc["m"])


def dictionary(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, chunks, ids) of (word, chunks): words as in the text, spaces not yet marked.

    ids is null for words that do not fit the mask; ``_entries`` folds them.  A
    word may come several times, told apart by the columns beside these two.
    """
    keys = [k for k in words.columns if k != "chunks"]
    marked = words.withColumn("w", F.translate("word", " ", MARK)).withColumn("n", F.char_length("w"))
    fits = F.col("n") <= LONG_WORD
    starts = marked.select(*keys, "chunks", "w", "n", F.explode(F.sequence(F.lit(0), F.when(fits, F.col("n") - 1).otherwise(0))).alias("s"))
    # An empty substring at the start keeps words without any edge.
    spots = starts.select(*keys, "chunks", "s", "w", F.explode(F.sequence(F.when(F.col("s") == 0, 0).otherwise(1), F.when(fits, F.least(F.lit(pieces.longest), F.col("n") - F.col("s"))).otherwise(0))).alias("k"))
    subs = spots.select(*keys, "chunks", "s", "k", F.expr("substring(w, s + 1, k)").alias("sub"))
    # Joined by a hash, as one long key is looked up several times faster than a string; then the strings must be equal.
    table = pieces.table(words.sparkSession).select(F.xxhash64("sub").alias("key"), F.col("sub").alias("piece"), "rank", "score", "id")
    found = subs.withColumn("key", F.xxhash64("sub")).join(F.broadcast(table), "key").where(F.startswith("sub", "piece") & F.startswith("piece", "sub"))
    end = F.col("s") + F.col("k")
    edge = ["rank", "s", "k", "id", "score"] if pieces.algorithm != "bpe" else ["rank", "s", "k", "id"]
    ends, inner = _shift(1, F.col("s")).bitwiseOR(_shift(1, end)), _shift(1, end) - _shift(2, F.col("s"))
    # Only a word's first row carries its chunks: the others are grouped in as few bytes as they need.
    found = found.select(*keys, F.when(F.col("k") == 0, F.col("chunks")).alias("chunks"), F.struct(*edge, ends.alias("ends"), F.when(F.col("k") > 1, inner).otherwise(F.lit(0).cast("long")).alias("inner")).alias("edge"))
    held = found.groupBy(*keys).agg(F.any_value("chunks", True).alias("chunks"), F.sort_array(F.collect_list("edge")).alias("edges"))
    held = held.withColumn("n", F.char_length("word"))
    fold = _bpe_fold(F.col("n"), F.col("edges")) if pieces.algorithm == "bpe" else _viterbi_fold(F.col("n"), F.col("edges"), pieces.unknown)
    held = held.withColumn("m", F.when(fits, fold))
    kept = F.filter("edges", lambda x: (x["k"] > 0) & _intact(F.col("m"), x) & (F.col("m").bitwiseAND(x["inner"]) == 0))
    held = held.withColumn("symbols", F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["id"].alias("id")))))
    covered = F.aggregate("symbols", F.lit(0), lambda a, x: a + x["k"])

    def at(i: Column) -> Column:
        """Ids of the symbol that starts at character i; none inside another."""
        own = F.transform(F.filter("symbols", lambda x: x["s"] == i), lambda x: x["id"])
        inside = F.exists("symbols", lambda x: (x["s"] < i) & (x["s"] + x["k"] > i))
        code = F.hex(F.encode(F.substring(F.translate("word", " ", MARK), i + 1, F.lit(1)), "UTF-8"))
        fallback = F.transform(F.sequence(F.lit(1), F.length(code) - 1, F.lit(2)), lambda j: F.conv(F.substring(code, j, F.lit(2)), 16, 10).cast("int") + (pieces.byte0 or 0))
        return F.when((F.size(own) > 0) | inside, own).otherwise(fallback)

    ids = F.when(covered == F.col("n"), F.transform("symbols", lambda x: x["id"])).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), at)))
    return held.select("word", "chunks", F.when(fits, ids).alias("ids"))


def _symbol_ids(parts: list[str], rank: dict, byte0: int) -> list[int]:
    out: list[int] = []
    for p in parts:
        out += [rank[p][1]] if p in rank else [byte0 + x for x in p.encode()]
    return out


def fold_long(word: str, pieces: Pieces) -> list[int]:
    """Ids of a word that does not fit the mask."""
    marked, byte0 = word.replace(" ", MARK), pieces.byte0 or 0
    return heap_bpe(marked, pieces.rank, byte0) if pieces.algorithm == "bpe" else path_unigram(marked, pieces.rank, byte0, -pieces.unknown, pieces.longest)


def heap_bpe(word: str, rank: dict, byte0: int) -> list[int]:
    """The same merges with a heap and links, for words of any length."""
    n = len(word)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (r := rank.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r[0], i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or end[right[i]] != stop:
            continue
        j = right[i]
        end[i], alive[j] = stop, False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return _symbol_ids([word[i : end[i]] for i in range(n) if alive[i]], rank, byte0)


def path_unigram(word: str, rank: dict, byte0: int, unknown: float, longest: int) -> list[int]:
    """The least-cost path, for long words."""
    best = [(0.0, -1)]
    for e in range(1, len(word) + 1):
        best.append(min((best[s][0] + (rank[word[s:e]][0] if word[s:e] in rank else unknown if e - s == 1 else math.inf), s) for s in range(max(0, e - longest), e)))
    parts, e = [], len(word)
    while e > 0:
        parts.append(word[best[e][1] : e])
        e = best[e][1]
    return _symbol_ids(parts[::-1], rank, byte0)


def decode(ids, pieces: Pieces) -> str:
    """The text of ids: pieces' bytes, marks as spaces, without the first dummy space."""
    raw = b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace")
    return raw[1:] if raw.startswith(" ") else raw


# Arrow arrays from and to buffers: ``pa.array`` and ``to_numpy`` load pandas into every worker, 35 MB each.


def _plain(x: np.ndarray) -> pa.Array:
    """An array of numbers, without a copy, or of booleans."""
    if x.dtype == bool:
        return pa.Array.from_buffers(pa.bool_(), len(x), [None, pa.py_buffer(np.packbits(x, bitorder="little"))])
    return pa.Array.from_buffers(pa.from_numpy_dtype(x.dtype), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])


def _numbers(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The values of an array without nulls, without a copy but for booleans."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    if not len(x):
        return np.zeros(0, str(x.type))
    if pa.types.is_boolean(x.type):
        bits = np.unpackbits(np.frombuffer(x.buffers()[1], np.uint8), bitorder="little")
        return bits[x.offset : x.offset + len(x)].astype(bool)
    return np.frombuffer(x.buffers()[1], str(x.type))[x.offset : x.offset + len(x)]


def _binary(values: list[bytes], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(at), pa.py_buffer(b"".join(values))])


def _strings(values) -> pa.Array:
    return _binary([v.encode() for v in values], pa.string())


def _lists(at: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(_plain(at.astype(np.int32)), values)


def _sealed(t: pa.Table, level: int = 3) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def _opened(blob) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def _blobs(t: pa.Table, chunk: np.ndarray) -> list[tuple[int, pa.Table]]:
    """t's rows by chunk, in their order."""
    order = np.argsort(chunk, kind="stable")
    c = chunk[order]
    edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]])) if len(c) else [0]
    if (order != np.arange(len(order))).any():
        t = t.take(_plain(order))
    return [(int(c[a]), t.slice(a, b - a)) for a, b in zip(edge, edge[1:])]


_BLOB = "chunk int, kind int, place long, blob binary"


def _rows(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    chunk, kind, place, blob = zip(*found) if found else [()] * 4
    return pa.RecordBatch.from_arrays([_plain(np.array(chunk, np.int32)), _plain(np.array(kind, np.int32)), _plain(np.array(place, np.int64)), _binary(list(blob), pa.binary())], ["chunk", "kind", "place", "blob"])


def _texts(batches):
    """Compressed runs of a chunk's rows, about BLOB_BYTES of text each."""
    for b in batches:
        t = pa.Table.from_batches([b])
        for c, own in _blobs(t.drop_columns(["chunk"]), _numbers(b.column("chunk"))):
            size = np.cumsum(_numbers(pc.binary_length(own["text"])))
            lo = 0
            while lo < own.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BLOB_BYTES, "right")))
                part = own.slice(lo, hi - lo).combine_chunks()
                yield _rows([(c, 1, part["place"][0].as_py(), _sealed(part, 6))])
                lo = hi
    b = t = own = part = None  # noqa: F841  nothing of the last batch is held
    release()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Each text's ``spaced`` parts, as a list array, and the texts' indices in its order."""
    odd = _numbers(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))) | (_numbers(pc.binary_length(texts)) == 0)
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    plain = pc.split_pattern(texts.filter(_plain(~odd)), " ")
    parts = [spaced(t) for t in texts.filter(_plain(odd)).to_pylist()]
    rest = _lists(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), _strings([x for own in parts for x in own]))
    return pa.concat_arrays([plain.cast(rest.type), rest]), order


class _Cut:
    """``words_of`` distinct parts: plain ones, with marks after an ASCII letter or none, are cut as arrays."""

    def __init__(self, parts: pa.Array, pieces: Pieces | Cuts):
        marks = re.escape(pieces.ends)
        short = pc.and_not(_plain(_numbers(pc.utf8_length(parts)) < LONG_WORD), pc.match_substring(parts, "\n"))
        whole = pc.and_(short, pc.match_substring_regex(parts, f"[^{marks}]$" if marks else "."))
        split = pc.and_(short, pc.match_substring_regex(parts, f"[A-Za-z][{marks}]+$")) if marks else pc.and_not(whole, whole)
        hard = pc.invert(pc.or_(whole, split))
        self.whole, self.split, self.hard = (np.flatnonzero(_numbers(m)) for m in (whole, split, hard))
        ended = parts.filter(split)
        self.heads = pc.utf8_replace_slice(pa.concat_arrays([parts.filter(whole), pc.utf8_rtrim(ended, pieces.ends) if marks else ended]), 0, 0, " ")
        self.tails = pc.extract_regex(ended, f"(?P<end>[{marks}]+)$").field("end") if marks else ended
        self.lists = [words_of(p, pieces) for p in parts.filter(hard).to_pylist()]


def _vocabulary(batches, pieces: Pieces | Cuts):
    """(word, chunk): each chunk's distinct words."""

    def out(chunk: int, seen: list[pa.Array]):
        cut = _Cut(pc.unique(pa.chunked_array(seen, pa.string())), pieces)
        rest = {w for ws in cut.lists for w in ws} - {"\n"}
        words = pc.unique(pa.chunked_array([cut.heads, cut.tails, _strings(rest)], pa.string()))
        for k in range(0, len(words), 50_000):
            one = words.slice(k, 50_000)
            yield pa.RecordBatch.from_arrays([one, _plain(np.full(len(one), chunk, np.int32))], ["word", "chunk"])

    last, seen = None, []
    for b in batches:
        for c, own in _blobs(pa.Table.from_batches([b]), _numbers(b.column("chunk"))):
            if c != last and seen:  # rows come in order; a chunk that goes on later comes in parts
                yield from out(last, seen)
                seen = []
            last = c
            for lo in range(0, own.num_rows, 1_024):
                seen.append(pc.unique(_split(own["text"].slice(lo, 1_024).combine_chunks())[0].flatten()))
    if seen:
        yield from out(last, seen)
    b = own = seen = None  # noqa: F841  nothing of the last batch is held
    release()


def _entries(batches, pieces: Pieces):
    """Dictionary blobs per chunk: word, ids and whether the ids decode to the word."""
    small = pa.uint16() if len(pieces.text) <= 1 << 16 else pa.int32()
    waiting: list[tuple[pa.Table, np.ndarray]] = []
    size = 0

    def flush():
        """A blob for each chunk, one at a time: only the entries themselves are held twice."""
        t, chunk = pa.concat_tables([w for w, _ in waiting]).combine_chunks(), np.concatenate([c for _, c in waiting])
        waiting.clear()
        order = np.argsort(chunk, kind="stable").astype(np.int32)
        chunk = chunk[order]
        edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]]))
        for lo, hi in zip(edge, edge[1:]):
            yield _rows([(int(chunk[lo]), 0, 0, _sealed(t.take(_plain(order[lo:hi]))))])

    for b in batches:
        if not b.num_rows:
            continue
        words, ids = b.column(0).to_pylist(), b.column(2)
        if ids.null_count:
            each = [fold_long(w, pieces) if i is None else i for w, i in zip(words, ids.to_pylist())]
            ids = _lists(np.concatenate([[0], np.cumsum([len(i) for i in each])]), _plain(np.array([x for i in each for x in i], np.int32)))
        flat, at = ids.flatten(), np.concatenate([[0], np.cumsum(_numbers(pc.list_value_length(ids)))]).astype(np.int32)
        raw, codes = list(map(pieces.raw.__getitem__, flat.to_pylist())), at.tolist()
        fine = [b"".join(raw[x:y]) == w.encode() for w, x, y in zip(words, codes, codes[1:])]
        t = pa.Table.from_arrays([b.column(0), _lists(at, flat.cast(small)), _plain(np.array(fine, bool))], ["word", "ids", "fine"])
        who = pc.list_parent_indices(b.column(1))
        waiting.append((t.take(who), _numbers(b.column(1).flatten()).copy()))
        size += len(who)
        t = ids = words = raw = codes = flat = fine = who = None
        if size >= PACK_ENTRIES:
            yield from flush()
            size = 0
            release()
    if waiting:
        yield from flush()
    b = None  # noqa: F841  nothing of the last batch is held
    release()


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, end to end."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class _Dictionary:
    """A chunk's words with their ids end to end."""

    def __init__(self, tables: list[pa.Table], pieces: Pieces | Cuts):
        self.pieces = pieces
        self.words = pa.concat_arrays([*(c for t in tables for c in t["word"].chunks), _strings(["\n"])])
        ids = [c for t in tables for c in t["ids"].chunks]
        kind = str(ids[0].type.value_type) if ids else "int32"
        self.flat = np.concatenate([*(_numbers(c.flatten()) for c in ids), np.array([(pieces.byte0 or 0) + 10], kind)])
        self.size = np.concatenate([*(_numbers(pc.list_value_length(c)) for c in ids), np.ones(1, np.int32)])
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size
        self.fine = np.concatenate([*(_numbers(c) for t in tables for c in t["fine"].chunks), np.ones(1, bool)])

    def find(self, words: pa.Array) -> np.ndarray:
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            raise KeyError(words.filter(pc.is_null(at))[0].as_py())
        return _numbers(at)

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, start, size, whether they decode) of distinct parts."""
        cut = _Cut(parts, self.pieces)
        counts = np.ones(len(parts), np.int64)
        counts[cut.split] = 2
        counts[cut.hard] = [len(ws) for ws in cut.lists]
        first = np.cumsum(counts) - counts
        word = np.empty(int(counts.sum()), np.int64)
        place = [first[np.concatenate([cut.whole, cut.split])], first[cut.split] + 1, _spread(first[cut.hard], counts[cut.hard])]
        word[np.concatenate(place)] = self.find(pa.concat_arrays([cut.heads, cut.tails, _strings([w for ws in cut.lists for w in ws])]))
        ids = self.flat[_spread(self.start[word].astype(np.int64), self.size[word])]
        owner = np.repeat(np.arange(len(parts)), counts)
        size = np.bincount(owner, self.size[word], len(parts)).astype(np.int64)
        return ids, np.cumsum(size) - size, size, np.bincount(owner[~self.fine[word]], minlength=len(parts)) == 0


def _coded(t: pa.Table, known: _Dictionary, carry: tuple[str, ...]):
    """Coded documents of some texts of a chunk, in their order."""
    lists, order = _split(t["text"].combine_chunks())
    coded = lists.flatten().dictionary_encode()
    ids, start, size, fine = known.parts(coded.dictionary)
    code, first = _numbers(coded.indices), np.concatenate([[0], np.cumsum(_numbers(pc.list_value_length(lists)))])
    back = np.argsort(order)
    if (back != np.arange(len(back))).any():  # the order of the texts again
        code = code[_spread(first[back], np.diff(first)[back])]
        first = np.concatenate([[0], np.cumsum(np.diff(first)[back])])
    words = np.concatenate([[0], np.cumsum(size[code])])
    tokens, wrong = words[first], np.concatenate([[0], np.cumsum(~fine[code])])[first]
    lo = 0
    while lo < t.num_rows:
        hi = max(lo + 1, int(np.searchsorted(tokens, tokens[lo] + BATCH_IDS, "right")) - 1)
        own = code[first[lo] : first[hi]]
        out = ids[_spread(start[own], size[own])].astype("<i4")
        at = (tokens[lo : hi + 1] - tokens[lo]).astype(np.int32)
        raw = memoryview(out).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        rows = [t[n].slice(lo, hi - lo).combine_chunks() for n in ("doc_id", *carry)]
        made = [_lists(at, _plain(out)), _plain(np.diff(at).astype(np.int64)), _plain(np.array(crc, np.int64)), _plain(wrong[lo + 1 : hi + 1] == wrong[lo:hi])]
        yield pa.RecordBatch.from_arrays([rows[0], *made, *rows[1:]], ["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_ok", *carry])
        lo = hi


def _assembled(batches, pieces: Pieces | Cuts, carry: tuple[str, ...]):
    """Coded documents of a partition in order: a chunk's dictionary blobs come before its texts."""
    chunk, tables, known, texts, size = None, [], None, [], 0
    for b in batches:
        for c, kind, blob in zip(b.column("chunk").to_pylist(), b.column("kind").to_pylist(), b.column("blob")):
            if texts and (c != chunk or size >= CODED_BYTES):
                yield from _coded(pa.concat_tables(texts), known, carry)
                texts, size = [], 0
                pa.default_memory_pool().release_unused()
            if c != chunk:
                chunk, tables, known = c, [], None
                release()
            t = _opened(blob)
            if kind == 0:
                tables.append(t)
                continue
            if known is None:
                known, tables, t = _Dictionary(tables, pieces), [], None
                release()
                t = _opened(blob)
            texts.append(t)
            size += t["text"].nbytes
    if texts:
        yield from _coded(pa.concat_tables(texts), known, carry)
    b = t = texts = tables = known = None  # noqa: F841  nothing of the last batch is held
    release()


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), place: str | None = None, chunk_bytes: int | None = None, lattice_bytes: int | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, decoded_ok: one row per row of docs.

    decoded_ok tells that decoding the ids gives the text back: each word's ids
    are decoded, and a text is its words end to end.  A null or empty text has
    no ids.  Null ids and repeated rows pass through; ties of merges go to the
    left.  Words of any length are read whole.  Of the other columns of docs
    those in ``carry`` are returned, after these.  ``place`` names a column that
    holds each row's place from 0; without one it is the place in docs' files.
    The result is in that order.  ``chunk_bytes`` of text are coded at a time, and the
    words of ``lattice_bytes`` make one task's lattices: they decide on memory,
    disk and time, not on results.  An empty table gives an empty result.  The
    session's Arrow batches are bounded (``bound_batches``).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if place is None:
        place = "__place"
        docs, _ = with_position(docs.select(*dict.fromkeys((id_col, text_col, *carry))), place)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry, F.col(place).cast("long").alias("place"))
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.max(place).alias("last")).first()
    chunk_bytes, lattice_bytes = chunk_bytes or CHUNK_BYTES, lattice_bytes or LATTICE_BYTES
    per_chunk = max(1, int(chunk_bytes * ((size["last"] or 0) + 1) // max(1, size["bytes"] or 0)))
    chunks = (size["last"] or 0) // per_chunk + 1
    rows = rows.withColumn("chunk", F.floor(F.col("place") / per_chunk).cast("int"))
    shared, cuts = spark.sparkContext.broadcast(pieces), spark.sparkContext.broadcast(Cuts(pieces.ends, pieces.pairs, pieces.byte0))

    # A common word is coded once for every CHUNKS_OF_A_WORD chunks, so no list grows with the corpus; lattices are
    # many times the words they come from, so words are dealt by the bytes of text and not by their own.
    deals = max(1, -(-min(size["bytes"] or 0, CHUNKS_OF_A_WORD * chunk_bytes) // lattice_bytes))
    words = rows.select("chunk", "text").mapInArrow(lambda it: _vocabulary(it, cuts.value), "word string, chunk int")
    deal = F.floor(F.col("chunk") / CHUNKS_OF_A_WORD) * deals + F.pmod(F.xxhash64("word"), F.lit(deals))
    words = words.withColumn("deal", deal).repartition(deals * ((chunks - 1) // CHUNKS_OF_A_WORD + 1), "deal").groupBy("deal", "word").agg(F.collect_set("chunk").alias("chunks"))
    entries = dictionary(words, pieces).mapInArrow(lambda it: _entries(it, shared.value), _BLOB)
    dealt = rows.mapInArrow(_texts, _BLOB).unionByName(entries).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "kind", "place")
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return dealt.mapInArrow(lambda it: _assembled(it, cuts.value, carry), f"doc_id {kind}, ids array<int>, n_tokens long, ids_crc32 long, decoded_ok boolean" + more)
