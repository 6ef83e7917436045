"""Token ids on disk, compressed by a Re-Pair grammar per shard.

Documents are range-partitioned and sorted by id; each partition encodes its
texts and closes a shard after about ``SHARD_IDS`` ids.  In a shard, frequent
adjacent pairs of symbols are replaced by new symbols, round after round, until
no pair pays for its rule or all symbols are taken; the rules and their
expansion lengths are stored, so any document, and any token range in it, is
decoded without the rest.

A shard is one binary value (all integers little-endian):

    magic b"RPG1", uint32 documents, uint32 rules, uint64 symbols, uint64 ids
    int64  doc_id per document        uint8 1 where doc_id is null
    uint64 first symbol per document, and the end
    uint64 first id per document, and the end
    uint16 left, right per rule       uint32 expansion length per rule
    uint16 symbol ...

A symbol under ``TERMINALS`` is a token id; others are rules in order.  Shards
are rows (part, seq, n_docs, n_ids, data) of a Parquet table, so they are
written under Spark's commit protocol to any file system; (part, seq) is the
order of doc_id.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massflow.llm.frames import cut, work_path

END_ID = 2
SHARD_IDS = 1 << 20
TERMINALS = 50_257
LEAST_COUNT = 16
#: Pairs are counted in a table of this many bits.
TABLE_BITS = 20
#: Words whose ids a worker remembers at most; then it forgets those not met again since half of them.
CACHE_WORDS = 2_000_000
#: Shard heads of at most this many rows are broadcast to the shards.
BROADCAST_SHARDS = 100_000
MAGIC = b"RPG1"


#: How a byte-level vocabulary writes bytes: printable ones as themselves, the rest from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Marks that split off from letters before them, as one run (an apostrophe may begin a token of its own).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Spaced(dict):
    """Ids, as bytes, of a space and what follows it; ``old`` is what an earlier table held."""

    def __init__(self, enc: WordEncoder, old: dict):
        self.enc, self.old = enc, old

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            enc = self.enc
            if piece.isalpha():
                got = enc.letters(piece, "\u0120")
            elif "\n" in piece:
                head, *lines = piece.split("\n")
                if head and all(lines):
                    return self[head] + b"".join([enc.newline + enc.word(x) for x in lines])
                got = enc.pack(" " + piece)
            else:
                head = piece.rstrip(MARKS)
                got = self[head] + enc.word(piece[len(head) :]) if head != piece and head.isalpha() else enc.pack(" " + piece)
        self[piece] = got
        return got


class WordEncoder:
    """The tokenizer's ids of whole texts, one word at a time.

    A text is cut before single spaces: no token of a byte-level vocabulary
    crosses the step from a visible character, or from other white space, to a
    space before a word.  Each piece is split and merged by the tokenizers
    library itself and its ids remembered.  Texts with runs of spaces, or with
    the string of an added token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > TERMINALS:
            raise ValueError(f"more than {TERMINALS} token ids")
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split, self.merge = self.whole.pre_tokenizer.pre_tokenize_str, self.whole.model.tokenize
        self.packed = [struct.pack("<I", i) for i in range(TERMINALS)]
        self.plain: dict[str, bytes] = {}
        self.spaced = _Spaced(self, {})
        self.newline = self.pack("\n")

    def pack(self, chunk: str) -> bytes:
        return b"".join([self.packed[t.id] for word, _ in self.split(chunk) for t in self.merge(word)])

    def letters(self, chunk: str, ahead: str = "") -> bytes:
        """A run of letters is one token to merge."""
        mapped = ahead + (chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(BYTE_CHARS))
        return b"".join([self.packed[t.id] for t in self.merge(mapped)])

    def word(self, chunk: str) -> bytes:
        got = self.plain.get(chunk)
        if got is None:
            head = chunk.rstrip(MARKS)
            if not head.isalpha():
                got = self.pack(chunk)
            else:
                got = self.letters(head) if head == chunk else self.word(head) + self.word(chunk[len(head) :])
            self.plain[chunk] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "  " in text or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if 2 * (len(self.spaced) + len(self.plain)) > CACHE_WORDS:
            self.spaced = _Spaced(self, dict(self.spaced))
            self.plain = {}
        first, *rest = text.split(" ")
        head = b"" if not first else self.word(first) if "\n" not in first else self.pack(first)
        return head + b"".join(map(self.spaced.__getitem__, rest))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slots(code: np.ndarray) -> np.ndarray:
    return ((code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - TABLE_BITS)).astype(np.int32)


def _union(parts: list[np.ndarray], n: int) -> np.ndarray:
    """Sorted distinct places under n."""
    if sum(map(len, parts)) < n >> 6:
        return np.unique(np.concatenate(parts))
    mask = np.zeros(n, bool)
    for p in parts:
        mask[p] = True
    return np.flatnonzero(mask)


def _chosen(code: np.ndarray, slot: np.ndarray, count: np.ndarray, rank_of: np.ndarray, close: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hits, their names from 0, the pairs named, places of pairs met too seldom) among frequent places in order.

    Slots are ranked by count; of each, the pair met last is taken.  ``close``
    tells that a place and the next one overlap: the better rank is replaced.
    rank_of is a table to work in.
    """
    rank_of[slot] = np.arange(len(slot))
    often = slot[rank_of[slot] == np.arange(len(slot))]  # each slot once
    # Ties by slot, which is a hash: in a passage that repeats, many pairs then outrank their neighbours at once.
    often = often[np.lexsort((often, -count[often]))][:most]
    none = len(often)
    rank_of[slot] = none
    rank_of[often] = np.arange(none)
    rank = rank_of[slot]
    value = np.zeros(none + 1, np.uint32)
    value[rank] = code
    same = (code == value[rank]) & (rank < none)
    real = np.append(np.bincount(rank[same], minlength=none)[:none] >= LEAST_COUNT, False)
    hit = same & real[rank]
    both = close & hit[1:] & hit[:-1]
    rare = same & ~hit  # it only shares its slot
    hit[1:] &= ~(both & (rank[1:] >= rank[:-1]))
    hit[:-1] &= ~(both & (rank[:-1] > rank[1:]))
    used = np.zeros(none, bool)
    used[rank[hit]] = True
    return hit, (np.cumsum(used) - 1)[rank[hit]], value[:none][used], rare


def re_pair(ids: np.ndarray, starts: np.ndarray, terminals: int = TERMINALS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first symbol per document and the end, left, right).

    starts: first id of each document, and the end.  Each round counts the
    pairs inside documents in a table, ranks the frequent ones and replaces
    those occurrences that outrank both overlapping neighbours.  While rounds
    replace much, all is counted anew and moved up; then symbols are linked,
    and only counts and places round the replaced ones change.  Rounds go on
    until no pair that occurs ``LEAST_COUNT`` times is left, or no symbol.
    """
    seq, starts = ids.astype(np.uint32), starts.astype(np.int64)
    rules: list[np.ndarray] = []
    made, most = 0, (1 << 16) - terminals
    rank_of = np.zeros((1 << TABLE_BITS) + 1, np.int32)

    def named(value: np.ndarray) -> None:
        nonlocal made
        rules.append(value)
        made += len(value)

    while len(seq) > 1 and made < most:
        code = (seq[:-1] << np.uint32(16)) | seq[1:]
        slot = _slots(code)
        inner = starts[1:-1]
        slot[inner[(inner > 0) & (inner < len(seq))] - 1] = 1 << TABLE_BITS  # a pair across two documents
        count = np.bincount(slot, minlength=(1 << TABLE_BITS) + 1).astype(np.int32)
        count[-1] = 0
        at = np.flatnonzero(count[slot] >= LEAST_COUNT)
        hit, name, value, _ = _chosen(code[at], slot[at], count, rank_of, at[1:] == at[:-1] + 1, most - made)
        at = at[hit]
        seq[at] = terminals + made + name
        named(value)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        starts = starts - np.searchsorted(at + 1, starts)
        much = len(at) > len(seq) >> 5
        seq = seq[keep]
        if not much:
            break

    n = len(seq)
    after, ahead = np.arange(1, n + 1), np.arange(-1, n - 1)  # linked symbols; n and -1 beyond a document
    first = starts[:-1][starts[:-1] < starts[1:]]
    after[first[1:] - 1], ahead[first] = n, -1
    gone = np.zeros(n, bool)

    def codes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = (seq[at] << np.uint32(16)) | seq[after[at]]
        return code, _slots(code)

    active = np.flatnonzero(after < n)
    code, slot = codes(active)
    count = np.bincount(slot, minlength=1 << TABLE_BITS).astype(np.int32)
    while True:
        frequent = count[slot] >= LEAST_COUNT
        active, code, slot = active[frequent], code[frequent], slot[frequent]
        if not len(active) or made >= most:
            break
        hit, name, value, rare = _chosen(code, slot, count, rank_of, after[active[:-1]] == active[1:], most - made)
        at, active = active[hit], active[~rare]
        if len(at):
            second, before = after[at], ahead[at]
            old = _union([before[before >= 0], at, second[after[second] < n]], n)
            np.subtract.at(count, codes(old)[1], 1)
            seq[at] = terminals + made + name
            named(value)
            beyond = after[second]
            after[at] = beyond
            inside = beyond < n
            ahead[beyond[inside]] = at[inside]
            gone[second] = True
            before = ahead[at]
            fresh = _union([before[before >= 0], at[after[at] < n]], n)
            np.add.at(count, codes(fresh)[1], 1)
            active = _union([active[~gone[active] & (after[active] < n)], fresh], n)
        code, slot = codes(active)
    starts = starts - np.concatenate([[0], np.cumsum(gone)])[starts]
    pairs = np.concatenate(rules or [np.zeros(0, np.uint32)])
    return seq[~gone].astype(np.uint16), starts, (pairs >> np.uint32(16)).astype(np.uint16), (pairs & np.uint32(0xFFFF)).astype(np.uint16)


def _lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Expansion length of every symbol."""
    size = [1] * TERMINALS
    for a, b in zip(left.tolist(), right.tolist()):
        size.append(size[a] + size[b])
    return np.array(size, np.int64)


def pack_shard(doc_ids: list, texts_ids: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(texts_ids), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in texts_ids])]).astype(np.int64)
    seq, first, left, right = re_pair(ids, starts)
    size = _lengths(left, right)[TERMINALS:]
    head = MAGIC + struct.pack("<IIQQ", len(doc_ids), len(left), len(seq), len(ids))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1")
    return b"".join([head, *(x.tobytes() for x in (*known, first.astype("<u8"), starts.astype("<u8"), left.astype("<u2"), right.astype("<u2"), size.astype("<u4"), seq.astype("<u2")))])


class Shard:
    """A packed shard; ``document(k)`` and ``tokens(k, a, b)`` decode only what they need."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        n, r, m, self.n_ids = struct.unpack_from("<IIQQ", data, 4)
        at = 28
        parts = []
        for kind, count in (("<i8", n), ("u1", n), ("<u8", n + 1), ("<u8", n + 1), ("<u2", r), ("<u2", r), ("<u4", r), ("<u2", m)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        ids, null, self.first, self.start, self.left, self.right, size, self.seq = parts
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.size = np.concatenate([np.ones(TERMINALS, np.int64), size.astype(np.int64)])
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions end to end, and where each begins."""
        if self._flat is None:
            begin = np.concatenate([[0], np.cumsum(self.size)])
            flat = np.empty(begin[-1], np.uint32)
            flat[:TERMINALS] = np.arange(TERMINALS)
            depth = [0] * TERMINALS
            for a, b in zip(self.left.tolist(), self.right.tolist()):
                depth.append(1 + max(depth[a], depth[b]))
            depth = np.array(depth[TERMINALS:])
            for d in range(1, int(depth.max(initial=0)) + 1):  # rules whose parts are known
                k = np.flatnonzero(depth == d)
                for part, at in ((self.left[k], begin[TERMINALS + k]), (self.right[k], begin[TERMINALS + k] + self.size[self.left[k]])):
                    n = self.size[part]
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    flat[np.repeat(at, n) + inside] = flat[np.repeat(begin[part], n) + inside]
            self._flat = flat, begin
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._expansions()
        size = self.size[symbols]
        end = np.cumsum(size)
        return flat[np.repeat(begin[symbols] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]

    def ids(self) -> np.ndarray:
        return self.expand(self.seq)

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.seq[self.first[k] : self.first[k + 1]])

    def tokens(self, k: int, a: int, b: int) -> np.ndarray:
        """Ids a..b - 1 of document k, from the symbols that cover them."""
        part = self.seq[self.first[k] : self.first[k + 1]]
        end = np.cumsum(self.size[part])
        lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(end, b, "left") + 1
        skip = a - (end[lo - 1] if lo else 0)
        return self.expand(part[lo:hi])[skip : skip + b - a]


def write_store(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode every row's whole text, add END_ID, and write shards in ascending doc_id order.

    A null or empty text has the end id only; null ids come first.  Rows that
    repeat an id are stored each, least text first.  An empty table writes no
    shard.  The string of an added token in a text is that token, as the library has it.
    """
    end = array("I", [END_ID]).tobytes()

    def run(batches):
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def shard():
            data = pack_shard(ids, texts)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_docs", "n_ids", "data"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                x = enc.encode(t.as_py() or "") + end
                ids.append(d)
                texts.append(x)
                size += len(x) // 4
                if size >= shard_ids:
                    yield shard()
                    ids, texts, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, data binary").write.option("parquet.block.size", 32 << 20).option("compression", "none").mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the files."""
    heads = spark.read.parquet(path).select("part", "seq", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition written
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = cut(heads.join(parts, "part").select("part", "seq", (F.col("ahead") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start")))
    small = heads.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS

    def run(batches):
        for b in batches:
            for data, start in zip(b.column(0), b.column(1).to_pylist()):
                s = Shard(data.as_py())
                raw = s.ids().astype("<u4").tobytes()
                at = s.start.astype(np.int64)
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.parquet(path).select("part", "seq", "data").join(F.broadcast(heads) if small else heads, ["part", "seq"])
    return shards.select("data", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the store in the shared folder and return its digest, read back.

    Repeated rows are stored each; an empty table gives an empty result; other
    columns are not read, whatever their names.
    """
    path = work_path(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer)
    return read_store(docs.sparkSession, path)
