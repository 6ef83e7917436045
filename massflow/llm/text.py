"""Vectorised text kernels over Arrow string buffers.

Everything here works on the UTF-8 bytes of a slice of documents laid end to
end: ``buf`` (uint8) and ``off`` (n + 1 byte offsets).  Words are maximal runs
of bytes outside a separator table; word hashes come from one prefix hash, so
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The separators of the contract's words, [\x20\x09-\x0D].
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_pows = np.ones(1, np.uint64)
_ipows = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a plain word: controls, ASCII punctuation, digits and blanks.
NON_LETTER = np.ones(256, bool)
NON_LETTER[65:91] = NON_LETTER[97:123] = NON_LETTER[128:] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift multiplies)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pows, _ipows
    if len(_pows) < n + 1:
        m = max(n + 1, 1 << 20)
        for name, base in (("_pows", _MULT), ("_ipows", _INV)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _pows, _ipows


class PrefixHash:
    """Hashes of any byte span from one cumulative polynomial, modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        pows, self._ip = _powers(len(buf))
        self._h = np.empty(len(buf) + 1, np.uint64)
        self._h[0] = 0
        np.cumsum(_BYTE[buf] * pows[: len(buf)], out=self._h[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._h[end] - self._h[start]) * self._ip[start])


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def slices(col: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about max_bytes: (first, last + 1, buf, off)."""
    buf, off = string_buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@dataclass
class Words:
    start: np.ndarray  # byte where each word begins
    end: np.ndarray
    first: np.ndarray  # per document, index of its first word; n + 1 long
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE, prefix: PrefixHash | None = None) -> Words:
    inside = ~separators[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside
    end[:-1] &= ~inside[1:] | edge[1:-1] if len(buf) else end[:-1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return Words(s, e, np.searchsorted(s, off), (prefix or PrefixHash(buf)).span(s, e))


def per_doc(flags: np.ndarray, off: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """Sums of a per-byte (or per-word) array over each document's range."""
    c = np.empty(len(flags) + 1, np.float64 if flags.dtype.kind == "f" else np.int64)
    c[0] = 0
    np.cumsum(flags, out=c[1:])
    stop = off[1:] if end is None else end
    return c[stop] - c[off[:-1]]


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside documents, and each one's first word."""
    if len(w.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w.hash) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x100000001B3) + w.hash[j : j + m]
    left = np.repeat(w.first[1:], w.counts)[:m]
    at = np.flatnonzero(np.arange(n, m + n) <= left)
    return mix64(h[at]), at


# The symbols counted by the contract's n_symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _seeded(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix64(h ^ mix64(doc.astype(np.uint64) + np.uint64(0x51ED27)))


def rule_counts(buf: np.ndarray, off: np.ndarray, prefix: PrefixHash | None = None, w: Words | None = None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    n = len(off) - 1
    prefix = prefix or PrefixHash(buf)
    w = w or words(buf, off, prefix=prefix)
    solid = ~SPACE[buf] & ((buf & 0xC0) != 0x80)
    c = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid, out=c[1:])
    out = {"n_words": w.counts, "word_chars": c[off[1:]] - c[off[:-1]], "n_symbols": per_doc(SYMBOLS[buf], off)}

    ls = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1]))
    ls = ls[ls < len(buf)]
    le = np.append(ls[1:], len(buf))
    le = le - (buf[le - 1] == 10) if len(ls) else le[:0]
    ok = c[le] > c[ls] if len(ls) else np.zeros(0, bool)
    ls, le = ls[ok], le[ok]
    ld = np.searchsorted(off, ls, "right") - 1
    _, keep = np.unique(_seeded(prefix.span(ls, le), ld), return_index=True)
    out["n_dup_lines"] = np.bincount(ld, minlength=n) - np.bincount(ld[keep], minlength=n)

    h, at = grams(w, 3)
    hit = np.zeros(len(w.hash), bool)
    if len(h):
        k = _seeded(h, w.doc[at])
        order = np.argsort(k)
        same = k[order][1:] == k[order][:-1]
        dup = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        for j in range(3):
            hit[dup + j] = True
    out["n_repeat_words"] = per_doc(hit, w.first)
    return out
