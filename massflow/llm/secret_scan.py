"""Secret scans through nested encodings.

Every text is scanned for the base patterns.  Then a worklist of its layers is
unwrapped until nothing new comes: percent escapes, Unicode escapes, base64 runs
and the compressed streams in them.  A layer keeps, for each of its characters,
the span of the original text that it comes from, so what is found in it is
reported where it stands.  A layer that was seen before at the same place is not
taken again, which also ends cycles such as an archive that holds itself.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("assign", "access", "hex")
# The contract's base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ASSIGN_LEAST = 8
# A run that fails these lengths holds no later start that does not, so they can stand in the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Characters of the shortest match of any base pattern.
SHORTEST = 14
#: Base64 digits that hold SHORTEST bytes, less one for a byte shared with what stands before.
RUN = 18
#: Bytes that one document's compressed streams may grow to; a document beyond it is marked ``unread``.
MOST_INFLATED = 256 << 20

_MAY_MATCH = r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{32}"
_MAY_UNWRAP = r"%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{18}"
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# More than one backslash stands before an escape that was escaped itself.
_UNICODE = re.compile(
    r"\\+u(?P<high>[dD][89abAB][0-9A-Fa-f]{2})\\+u(?P<low>[dD][c-fC-F][0-9A-Fa-f]{2})|\\+u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|\\+u(?P<four>[0-9A-Fa-f]{4})|\\+U(?P<eight>[0-9A-Fa-f]{8})|\\+x(?P<two>[0-9A-Fa-f]{2})|&#[xX](?P<ref>[0-9A-Fa-f]{1,6});|&#(?P<decimal>[0-9]{1,7});"
)
# What a match or an escape can hold; nothing reaches over other characters.
_LIVE = re.compile(r"[A-Za-z0-9+/_.=\-\"' :%\\{}&#;\r\n]+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/_-]{40,}\r?\n)+[A-Za-z0-9+/_-]+|[A-Za-z0-9+/_-]{18,})")
_PLAIN = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){14,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, by kind."""
    yield from ((m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST)
    yield from ((m.start(), m.end(), 1) for m in ACCESS.finditer(text))
    yield from ((m.start(), m.end(), 2) for m in HEX.finditer(text))


@dataclass
class Layer:
    """A text, with the original span of each character, and the codes that were unwrapped on the way."""

    text: str
    start: list[int] | range
    end: list[int] | range
    path: tuple[str, ...] = ()

    def key(self) -> tuple[bytes, int, int]:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.start[0], self.end[-1]


class _Mended:
    """A window of a layer in which some spans are replaced by other characters."""

    def __init__(self, layer: Layer, lo: int, hi: int):
        self.layer, self.at, self.hi = layer, lo, hi
        self.text, self.start, self.end, self.changed = [], [], [], False

    def keep(self, upto: int) -> None:
        self.text.append(self.layer.text[self.at : upto])
        self.start += self.layer.start[self.at : upto]
        self.end += self.layer.end[self.at : upto]
        self.at = upto

    def put(self, char: str, lo: int, hi: int) -> None:
        self.keep(lo)
        self.text.append(char)
        self.start.append(self.layer.start[lo])
        self.end.append(self.layer.end[hi - 1])
        self.at, self.changed = hi, True

    def done(self, code: str) -> Layer:
        self.keep(self.hi)
        return Layer("".join(self.text), self.start, self.end, (*self.layer.path, code))


def _windows(layer: Layer, escape: re.Pattern) -> Iterator[tuple[_Mended, list[re.Match]]]:
    if escape.search(layer.text):
        for w in _LIVE.finditer(layer.text):
            if found := list(escape.finditer(layer.text, w.start(), w.end())):
                yield _Mended(layer, w.start(), w.end()), found


def _unwrap_url(layer: Layer) -> Iterator[Layer]:
    """Percent escapes as UTF-8; bytes that are none stay escaped."""
    for window, found in _windows(layer, _URL):
        for m in found:
            at = m.start()
            for ch in bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape"):
                if "\udc80" <= ch <= "\udcff":
                    at += 3
                    continue
                size = 3 * len(ch.encode())
                window.put(ch, at, at + size)
                at += size
        if window.changed:
            yield window.done("url")


def _unwrap_unicode(layer: Layer) -> Iterator[Layer]:
    for window, found in _windows(layer, _UNICODE):
        for m in found:
            if m["high"]:
                code = 0x10000 + ((int(m["high"], 16) & 0x3FF) << 10 | int(m["low"], 16) & 0x3FF)
            else:
                code = int(m["decimal"]) if m["decimal"] else int(m["braced"] or m["four"] or m["eight"] or m["two"] or m["ref"], 16)
            if code < 0x110000 and not 0xD800 <= code < 0xE000:
                window.put(chr(code), m.start(), m.end())
        if window.changed:
            yield window.done("unicode")


def _inflated(data: bytes, room: int) -> tuple[bytes, bool]:
    """What the stream at data's start holds, as far as it is whole and room is left, and whether there was more."""
    if data[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
    elif data[:1] == b"\x78":
        unpack = zlib.decompressobj(15)
    elif data[:3] == b"BZh":
        unpack = bz2.BZ2Decompressor()
    elif data[:1] == b"\xfd":
        unpack = lzma.LZMADecompressor()
    else:
        import zstandard

        reader = zstandard.ZstdDecompressor().stream_reader(data)
        got = bytearray()
        try:
            while len(got) <= room and (part := reader.read(1 << 16)):
                got += part
        except (zstandard.ZstdError, MemoryError):
            pass
        return bytes(got[:room]), len(got) > room
    try:
        if data[:1] in (b"\x1f", b"\x78"):
            got, size = bytearray(), 1 << 16
            while data and len(got) <= room and not unpack.eof:
                got += unpack.decompress(data, size)
                data = unpack.unconsumed_tail
            got += unpack.flush() if not data else b""
            return bytes(got[:room]), len(got) > room
        got = unpack.decompress(data, room + 1)
        return got[:room], len(got) > room
    except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
        return bytes(got) if "got" in locals() else b"", False


class Scan:
    """The layers of one text and what is found in them."""

    def __init__(self, text: str, most_inflated: int = MOST_INFLATED):
        self.found: dict[tuple[int, int, int], tuple[str, ...]] = {}  # (start, kind, end): path
        self.seen: set = set()
        self.room, self.unread = most_inflated, False
        whole = Layer(text, range(len(text)), range(1, len(text) + 1))
        self._look(whole)
        self.work = deque(self._below(whole))
        while self.work:
            layer = self.work.popleft()
            if not layer.text or (key := layer.key()) in self.seen:
                continue
            self.seen.add(key)
            self._look(layer)
            self.work.extend(self._below(layer))

    def _look(self, layer: Layer) -> None:
        for s, e, kind in base_spans(layer.text):
            self.found.setdefault((layer.start[s], kind, layer.end[e - 1]), layer.path)

    def _below(self, layer: Layer) -> Iterator[Layer]:
        yield from _unwrap_url(layer)
        yield from _unwrap_unicode(layer)
        for m in _BASE64.finditer(layer.text):
            at = [i for i in range(m.start(), m.end()) if layer.text[i] not in "\r\n"]
            digits = "".join(layer.text[i] for i in at).replace("-", "+").replace("_", "/")
            for skip in range(min(4, len(digits))):  # what stands before the code may look like digits
                own = digits[skip:]
                own = own[: len(own) - (len(own) % 4 == 1)]
                data = base64.b64decode(own + "=" * (-len(own) % 4))
                first = [skip + k * 8 // 6 for k in range(len(data))]
                start = [layer.start[at[f]] for f in first]
                end = [layer.end[at[skip + ((k + 1) * 8 - 1) // 6]] for k in range(len(data))]
                yield from self._bytes(data, start, end, (*layer.path, "base64"))

    def _bytes(self, data: bytes, start: list[int], end: list[int], path: tuple[str, ...]) -> Iterator[Layer]:
        """Layers of decoded bytes: runs of text, and compressed streams."""
        for m in _PLAIN.finditer(data):
            text = m.group().decode("utf-8", "replace")
            k, at = m.start(), []
            for ch in text:
                at.append(k)
                k += len(ch.encode()) if ch != "�" else 3
            if k != m.end():  # some sequence only looks like UTF-8: bytes as they are
                text, at = m.group().decode("latin-1"), list(range(m.start(), m.end()))
            yield Layer(text, [start[i] for i in at], [end[(at[n + 1] if n + 1 < len(at) else m.end()) - 1] for n in range(len(at))], path)
        for m in _PACKED.finditer(data):
            packed = data[m.start() :]
            key = (hashlib.blake2b(packed, digest_size=16).digest(), start[m.start()], end[-1])
            if key in self.seen:
                continue
            self.seen.add(key)
            got, more = _inflated(packed, self.room)
            self.room -= len(got)
            self.unread |= more
            if got:
                yield from self._bytes(got, [start[m.start()]] * len(got), [end[-1]] * len(got), (*path, "compressed"))

    def spans(self) -> list[tuple[int, int, int, str]]:
        """(start, kind, end, path) by start, kind and end; base spans have no path."""
        return [(*k, ">".join(p)) for k, p in sorted(self.found.items())]


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])


def _worth_a_scan(texts: pa.Array) -> list[bool]:
    """Texts that hold a beginning of some pattern or code; vectorised."""
    return pc.fill_null(pc.match_substring_regex(texts, f"{_MAY_MATCH}|{_MAY_UNWRAP}"), False).to_pylist()


def _scanned(texts: pa.Array) -> Iterator[tuple[str | None, Scan | None]]:
    for text, open_ in zip(texts, _worth_a_scan(texts)):
        yield (text.as_py(), Scan(text.as_py())) if open_ else (None, None)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with findings (kind, start, end, path) and unread.

    Spans are code points of the text, end exclusive; path names the codes
    around a finding, outermost first, and is empty for base spans.  ``unread``
    is true where compressed streams grew beyond MOST_INFLATED and their rest
    was not looked at.  A null or empty text has no findings; repeated rows each
    have theirs; an empty table gives an empty result.  Other columns pass
    through, but for those named like an output, which go.
    """
    rest = [k for k in docs.columns if k not in (text_col, "findings", "unread")]
    schema = StructType([*docs.select(*rest).schema, *StructType.fromDDL("findings array<struct<kind: string, start: long, end: long, path: string>>, unread boolean")])

    def run(batches):
        for b in batches:
            found, unread = [], []
            for _, s in _scanned(b.column(b.num_columns - 1)):
                found.append([] if s is None else [{"kind": KINDS[k], "start": lo, "end": hi, "path": p} for lo, k, hi, p in s.spans()])
                unread.append(s is not None and s.unread)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(_FINDING)), pa.array(unread, pa.bool_())], schema.names)

    return docs.select(*rest, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every found span, also those of encoded secrets, replaced by ``mask``; spans that overlap are one.

    Texts without findings, null ones too, stay as they are.
    """
    schema = StructType(list(docs.schema))

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index(text_col)
            texts = b.column(k).to_pylist()
            for i, (text, s) in enumerate(_scanned(b.column(k))):
                if s is None or not s.found:
                    continue
                out, at = [], 0
                for lo, hi in sorted((lo, hi) for lo, _, hi in s.found):
                    if lo >= at or not out:
                        out += [text[at:lo], mask]
                    at = max(at, hi)
                texts[i] = "".join(out) + text[at:]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, b.schema.field(k).type), *b.columns[k + 1 :]], b.schema.names)

    return docs.mapInArrow(run, schema)


def _joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, all spans, and n_added, paths and unread of the others."""
    base = F.filter("findings", lambda f: f["path"] == "")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    added = F.filter("findings", lambda f: f["path"] != "")
    return scan(docs.select("doc_id", "text")).select("doc_id", *map(number, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"), F.size(added).cast("long").alias("n_added"), F.array_join(F.array_sort(F.array_distinct(F.transform(added, lambda f: f["path"]))), ",").alias("paths"), "unread")
