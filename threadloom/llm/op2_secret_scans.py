"""Secret scans with a recursive decoding worklist.

Each text is layer 0. A layer is scanned, then unwrapped in every way that changes it: percent escapes,
Unicode escapes (\\uXXXX, \\xXX, HTML character references), base64 runs, and compressed bytes (gzip, zlib,
bzip2, xz) inside base64 or hex. Each result is a new layer with a map back to the original's code points; layers go
on a worklist until none is new. A layer already seen at the same place is not taken up again, so cycles (as
compressed data that contains itself) end. Spans found in deeper layers are mapped to the original: what a run
was decoded from counts as a whole.

Base64 runs may go on over lines. A run that as a whole is neither text nor compressed may have something else glued to it, as a path: it is then
decoded from each of its four alignments, and stretches of text and members of compressed blobs in the results are layers, spans of the characters they come from.
Bytes of a percent run that are no UTF-8 stay as they are, the others are decoded.

Compressed bytes are read as a stream, member after member, in memory of about ``most`` bytes (64 MiB): longer content is scanned in parts that end at a
character which no rule and no encoding has, so that nothing spans two parts; a run without such a character is held as a whole. What follows
the last member is scanned as it stands, as is what could be read of a broken blob. Of content longer than 64 KiB, stretches of that size
that are no text are left out.
Null is empty. An empty text has no spans and the digest of "". Repeated rows, and rows without an id, give a row each. Spans of different kinds at one place are all told,
in the order of the kinds. An empty table gives no rows. Long texts are scanned whole. Columns other than id and text are not read; ``redact`` keeps them, whatever their names.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from codecs import getincrementaldecoder
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex")
_any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(
    f"({'|'.join(map(_any_case, KEYWORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")  # maximal runs: those under 20 characters fail anyway
HEX = re.compile("[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "api")

PERCENT = re.compile("(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|amp|lt|gt|apos);)+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same over lines: each but the last fills its line.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*\r?\n[ \t]*[A-Za-z0-9+/_-]{2,}={0,2}")
LINE_END = re.compile(r"\r?\n[ \t]*")
#: A stretch of text in decoded bytes, long enough for the shortest secret.
PRINTABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
#: How gzip, zlib, bzip2 and xz data begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
LONG_HEX = re.compile("[0-9A-Fa-f]{36,}")
#: No rule's or encoding's match has it.
GAP = re.compile(r"""[^A-Za-z0-9+/_.=%\\&#;:"'\x20-]""")
MOST, STRETCH = 64 << 20, 1 << 16


def found(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base rules in one layer."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A text and pieces (start here, start in the original, end in the original); a piece of equal lengths maps place by place."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int]]) -> None:
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    def _piece(self, at: int) -> tuple[int, int, int, bool]:
        k = bisect_right(self.starts, at) - 1
        here, a, b = self.pieces[k]
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        return here, a, b, end - here == b - a

    def origin(self, start: int, end: int) -> tuple[int, int]:
        here, a, _, even = self._piece(start)
        first = a + start - here if even else a
        here, a, b, even = self._piece(max(start, end - 1))
        return first, a + end - here if even else b

    def replaced(self, pattern: re.Pattern, decode) -> Layer | None:
        """The layer with the pattern's matches decoded, None if nothing changes."""
        text, pieces, size, at = [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal size
            while a < b:  # along this layer's own pieces, so that even pieces stay even
                k = bisect_right(self.starts, a) - 1
                end = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else b)
                pieces.append((size, *self.origin(a, end)))
                text.append(self.text[a:end])
                size += end - a
                a = end

        for m in pattern.finditer(self.text):
            for s, e, new in decode(m):
                copy(at, s)
                if new:
                    pieces.append((size, *self.origin(s, e)))
                    text.append(new)
                    size += len(new)
                at = e
        if at == 0:
            return None
        copy(at, len(self.text))
        return Layer("".join(text), pieces)


def _percent(m: re.Match) -> list[tuple[int, int, str]]:
    raw = unquote_to_bytes(m[0])
    out, at = [], m.start()
    for c in raw.decode("utf-8", "surrogateescape"):  # character by character, so that spans map closely
        if 0xDC80 <= ord(c) <= 0xDCFF:  # a byte that is part of no character
            at += 3
            continue
        n = 3 * len(c.encode())
        out.append((at, at + n, c))
        at += n
    return out


_ONE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&[^;]+;")


def _escape(m: re.Match) -> list[tuple[int, int, str]]:
    out = []
    for k in _ONE.finditer(m[0]):
        s = k[0]
        c = html.unescape(s) if s[0] == "&" else s.encode("ascii").decode("unicode_escape")
        if len(c) == 2:
            c = c.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if c != s and not (len(c) == 1 and 0xD800 <= ord(c) < 0xE000):
            out.append((m.start() + k.start(), m.start() + k.end(), c))
    return out


def maker(head: bytes):
    """What makes a decompressor for data that starts so, None if it isn't compressed."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return lambda: zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lambda: lzma.LZMADecompressor(memlimit=256 << 20)
    return None


def unpacked(pieces: Iterator[bytes]) -> Iterator[bytes | None]:
    """The contents of a compressed blob's members, as far as they can be read, in pieces of STRETCH bytes at most; None after each member."""
    rest, first = b"", True
    while True:
        while len(rest) < 6 and (more := next(pieces, b"")):
            rest = (rest + more).lstrip(b"\0") if not first else rest + more
        if not rest:
            return
        if (make := maker(rest)) is None:
            yield rest
            yield from pieces
            yield None
            return
        d, first = make(), False
        try:
            while not d.eof:
                out = d.decompress(rest, STRETCH)
                if out:
                    yield out
                rest = getattr(d, "unconsumed_tail", b"")
                if not d.eof and not rest and len(out) < STRETCH and getattr(d, "needs_input", True) and not (rest := next(pieces, b"")):
                    break
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            yield None
            return
        yield None
        rest = d.unused_data.lstrip(b"\0")


def one(events: Iterator[bytes | None]) -> Iterator[bytes]:
    """The pieces of the next content."""
    for piece in events:
        if piece is None:
            return
        yield piece


def contents(events: Iterator[bytes | None], above: frozenset[bytes]) -> Iterator[bytes | None]:
    """The same, contents that are compressed again unpacked. above: the whole blobs that this one is in, so that cycles end."""
    while (piece := next(events, b"")) != b"":
        if piece is None:
            continue
        head, mine = piece, one(events)
        while len(head) < STRETCH and (more := next(mine, b"")):
            head += more
        if readable(head) is None and maker(head) and head not in above:
            inner = contents(unpacked(chain([head], mine)), above | {head})
            yield from inner
        else:
            yield head
            yield from mine
            yield None
        for _ in mine:
            pass


def plain(data: bytes) -> bool:
    """Nearly all is printable."""
    odd = sum(c < 32 and c not in (9, 10, 13) or c == 127 for c in data)
    return odd * 20 <= len(data)


def stretches(pieces: Iterator[bytes]) -> Iterator[str | None]:
    """Each stretch of STRETCH bytes as text, None if it is not UTF-8 of which nearly all is printable."""
    held, decoder, fresh = b"", getincrementaldecoder("utf-8")(), False
    for last, piece in chain(((False, p) for p in pieces), [(True, b"")]):
        held += piece
        while len(held) >= STRETCH or (last and held):
            data, held = held[:STRETCH], held[STRETCH:]
            if fresh:  # after a stretch that is no text this one may start within a character
                data = data[next((k for k in range(min(4, len(data))) if data[k] & 0xC0 != 0x80), 0) :]
            try:
                s = decoder.decode(data, last and not held)
                fresh = False
            except UnicodeDecodeError:
                decoder.reset()
                s, fresh = None, True
            yield s if s is not None and plain(data) else None


def texts(pieces: Iterator[bytes], most: int) -> Iterator[str]:
    """The text of one content, in parts of about ``most`` characters that end at a GAP."""
    held: list[str] = []
    size, limit, some = 0, most, False
    for s in stretches(pieces):
        some |= s is not None
        held.append("\ufffd" if s is None else s)
        size += len(held[-1])
        if size < limit:
            continue
        text = "".join(held)
        if cut := last_gap(text):
            if some:
                yield text[:cut]
            held, limit, some = [text[cut:]], most, cut < len(text)
            size = len(held[0])
        else:
            held, limit = [text], 2 * size
    if some and (text := "".join(held)):
        yield text


def last_gap(text: str) -> int:
    """The end of the last GAP, 0 if there is none."""
    for end in range(len(text), 0, -STRETCH):
        start = max(0, end - STRETCH)
        for m in reversed(list(GAP.finditer(text, start, end))):
            return m.end()
    return 0


def readable(data: bytes) -> str | None:
    """Bytes as text: UTF-8 of which nearly all is printable, of long ones the stretches that are."""
    return next(texts(iter([data]), len(data) + 1), None) or None


def blobs(data: bytes, most: int) -> Iterator[str]:
    """The texts in compressed bytes."""
    if maker(data) is not None:
        events = contents(unpacked(iter([data])), frozenset([data]))
        while (piece := next(events, b"")) != b"":
            if piece is not None:
                mine = one(events)
                yield from texts(chain([piece], mine), most)


def _bytes(run: str) -> bytes | None:
    body = run.rstrip("=").translate({45: "+", 95: "/"})
    body = body[: len(body) - 1] if len(body) % 4 == 1 else body
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except ValueError:
        return None


def _decoded(layer: Layer, run: str, start: int, end: int, most: int, glued: bool = True) -> Iterator[Layer]:
    """The layers in a base64 run from start to end: its text, or what its compressed bytes hold; else stretches of text and compressed members in any of its alignments."""
    data, some = _bytes(run), False
    if data is None:
        return
    for s in blobs(data, most):
        some = True
        yield Layer(s, [(0, *layer.origin(start, end))])
    if not some and (s := readable(data)) is not None:
        some = True
        yield Layer(s, [(0, *layer.origin(start, end))])
    if some or not glued:
        return
    for shift in range(4):
        data = _bytes(run[shift:])
        if not data:
            continue
        place = lambda k, s=shift: min(start + s + k * 4 // 3, end)
        for m in PRINTABLE.finditer(data):
            s = m[0].decode("utf-8", "ignore")  # the pattern lets some bytes pass that are no characters
            yield Layer(s, [(0, *layer.origin(place(m.start()), min(end, place(m.end()) + 1)))])
        for m in MAGIC.finditer(data):
            for s in blobs(data[m.start() :], most):
                yield Layer(s, [(0, *layer.origin(place(m.start()), end))])


def children(layer: Layer, most: int = MOST) -> Iterator[Layer]:
    t = layer.text
    if "%" in t and (new := layer.replaced(PERCENT, _percent)) is not None:
        yield new
    if ("\\" in t or "&" in t) and (new := layer.replaced(ESCAPE, _escape)) is not None:
        yield new
    for m in BASE64.finditer(t):
        yield from _decoded(layer, m[0], m.start(), m.end(), most)
    if "\n" in t:
        for m in WRAPPED.finditer(t):
            lines = LINE_END.split(m[0])
            body, whole = "".join(lines), LINE_END.sub("", m[0])
            some = False
            for new in _decoded(layer, body, m.start(), m.end(), most, glued=False):
                some = True
                yield new
            if not some and len(whole) > len(lines[-1]):  # the last line may be the next word
                yield from _decoded(layer, "".join(lines[:-1]), m.start(), m.end() - len(lines[-1]), most, glued=False)
    for m in LONG_HEX.finditer(t):
        body = m[0]
        data = bytes.fromhex(body[: len(body) // 2 * 2])
        for s in blobs(data, most):
            yield Layer(s, [(0, *layer.origin(m.start(), m.end()))])


def scan(text: str, most: int = MOST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base spans, all spans, layers): spans as (start, kind's index, end), sorted."""
    base = found(text)
    spans, layers = set(base), 1
    root = Layer(text, [(0, 0, len(text))])
    work, seen = [root], {(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), 0, len(text))}
    while work:
        for new in children(work.pop(), most):
            if not new.text:
                continue
            key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *new.origin(0, len(new.text)))
            if key in seen:
                continue
            seen.add(key)
            layers += 1
            for s, kind, e in found(new.text):
                a, b = new.origin(s, e)
                spans.add((a, kind, b))
            work.append(new)
    return sorted(base), sorted(spans), layers


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones together) replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_spans, spans, layers of every text."""
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t, most) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _, _ in rows], pa.int64()) for k in range(3)]
            texts = [pa.array([joined(r[i]) for r in rows], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, *texts, pa.array([r[2] for r in rows], pa.int64())],
                ["id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "layers"],
            )

    out = picked.mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string, layers long")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", most: int = MOST) -> DataFrame:
    """The same rows and columns, every secret replaced by a mark; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index(text_col)
            new = [t if t is None or not (s := scan(t, most)[1]) else redacted(t, s) for t in b.column(k).to_pylist()]
            yield b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "layers")
