"""Secret scans with a worklist of decoded layers.

Three patterns are searched in every whole text and in every layer that decoding uncovers. Percent and Unicode escapes
are undone once over the whole layer and, where escapes are left or arise, to the end: as no two escapes overlap, the
end is the same in whatever order they are undone, and one pass with a stack reaches it. The layers between, which only
hold shorter nests, are skipped. Base64 runs are decoded one by one, those wrapped into lines of one width also as a whole,
and what they hold is unpacked while it is compressed and read as UTF-8, else latin-1, and as UTF-16 where there are NULs.
A new layer is scanned and decoded in turn unless the same text was seen before in this document, and unpacking stops at
bytes seen before, so a text or an archive that holds itself ends there. Digests are kept of what was seen, no texts. Each
layer knows, for each of its characters, the span of the original text it came from, and findings are reported there.

A run is decoded from each of its first four characters on where it may begin with something else, as in a path, and without
an odd character at its end.

What is unpacked is streamed: it is scanned in windows of about `PIECE` bytes that end at a line end which no pattern, no
escape and no wrapped run goes across, so nothing is cut in two. Where a stretch of HELD bytes has no such end, it is cut
anywhere and the next window begins OVERLAP bytes before the cut: all of its findings have the span of what was unpacked, and what is left
of a longer match is long enough to be found. Escapes and runs of base64 across such a cut are read up to it.

A batch is searched for traces first (key words, long runs, escapes); only texts that have one become Python strings.

Cases: a null or empty text has no finding. Equal findings (kind and span) count once, with the layers of the first found,
depth first. Spans count code points of the original text, ends are exclusive. Texts are never cut; memory follows the
text and the layers of one nest, whatever they unpack to.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lacuna.llm import tokens
from lacuna.llm.storage import small_batches

KINDS = ("assign", "access", "hex")
PIECE, HELD, OVERLAP = 1 << 20, 1 << 22, 1 << 12
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_NEXT = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+)(={0,2})")

_BYTES = re.compile("[\udc80-\udcff]+")
_OPENER = re.compile(r"[%\\]")
_BEGUN = re.compile(r"%[0-9A-Fa-f]?|\\(?:u[0-9A-Fa-f]{0,3}|U[0-9A-Fa-f]{0,7}|x[0-9A-Fa-f]?|u\{[0-9A-Fa-f]{0,6})?")
_RUN_AT_END = re.compile(rb"[A-Za-z0-9+/_-]{16}={0,2}\r?\Z")

_HEX_BYTE = np.isin(np.arange(256), list(b"0123456789abcdef"))
_ANY_HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))
_BASE64_BYTE = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))

SECRETS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("layers", T.StringType(), False)]), False)


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """The three patterns, leftmost and non-overlapping for each kind; matches that are too short drop out."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


class Layer:
    """A text and, for each of its characters, where it comes from; no arrays for the original itself."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, path: str = "") -> None:
        self.text, self.start, self.end, self.path = text, start, end, path
        self.unescaped = False  # made by undoing escapes: what is left of them is undone elsewhere

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))

    def spans(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if self.start is None:
            return np.arange(a, b), np.arange(a + 1, b + 1)
        return self.start[a:b], self.end[a:b]

    def pieces(self, parts: list[tuple[str, int, int]], step: str) -> Layer:
        """A layer put together from (text, a, b): a piece as long as b - a keeps its places, another has them all."""
        starts, ends = [], []
        for text, a, b in parts:
            if len(text) == b - a:
                s, e = self.spans(a, b)
            else:
                s, e = (np.full(len(text), x) for x in self.span(a, b))
            starts.append(s)
            ends.append(e)
        return Layer("".join(p[0] for p in parts), np.concatenate(starts), np.concatenate(ends), f"{self.path}/{step}")


def _rewritten(layer: Layer, found: list[tuple[int, int, str]], step: str) -> Layer:
    parts, at = [], 0
    for a, b, new in found:
        if at < a:
            parts.append((layer.text[at:a], at, a))
        if new:
            parts.append((new, a, b))
        at = b
    if at < len(layer.text):
        parts.append((layer.text[at:], at, len(layer.text)))
    return layer.pieces(parts, step) if parts else Layer("", np.zeros(0, int), np.zeros(0, int), f"{layer.path}/{step}")


def _percent(layer: Layer) -> Layer | None:
    """A run of escaped ASCII bytes keeps a place for each; other runs are decoded as UTF-8."""
    found = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        if raw.isascii():
            found += [(m.start() + 3 * i, m.start() + 3 * i + 3, chr(c)) for i, c in enumerate(raw)]
        else:
            found.append((m.start(), m.end(), raw.decode("utf-8", "replace")))
    return _rewritten(layer, found, "url") if found else None


def _escaped(layer: Layer) -> Layer | None:
    found = []
    for m in _ESCAPE.finditer(layer.text):
        point = int(next(x for x in m.groups() if x), 16)
        if point <= 0x10FFFF and not 0xD800 <= point < 0xE000:
            found.append((m.start(), m.end(), chr(point)))
    return _rewritten(layer, found, "unicode") if found else None


def _unpacker(raw: bytes) -> Callable | None:
    """What makes decompressors for the format that the bytes begin with."""
    if raw[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor
    return lzma.LZMADecompressor if raw[:6] == b"\xfd7zXZ\x00" else None


def _unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What bytes that come in pieces unpack to, in pieces: all members one after another, up to the first fault."""
    data = b""
    while True:
        while len(data) < 6 and (more := next(pieces, None)) is not None:
            data = (data + more).lstrip(b"\0")
        make = _unpacker(data)
        if not make:
            return
        unpack = make()
        while not unpack.eof:
            try:
                piece = unpack.decompress(data, PIECE)
            except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
                return
            if piece:
                yield piece
            data = getattr(unpack, "unconsumed_tail", b"")
            if not unpack.eof and not piece and not data and (data := next(pieces, None)) is None:
                return
        data = unpack.unused_data.lstrip(b"\0")


def _opened(raw: bytes) -> tuple[Callable[[], Iterator[bytes]], int]:
    """The innermost content of bytes as pieces, and how often it had to be unpacked; ends where bytes come back."""
    seen, at, times = {hashlib.blake2b(raw, digest_size=16).digest()}, lambda: iter([raw]), 0
    while True:
        def inner(outer: Callable = at) -> Iterator[bytes]:
            return _unpacked(outer())

        digest, size = hashlib.blake2b(digest_size=16), 0
        for piece in inner():
            digest.update(piece)
            size += len(piece)
        if not size or digest.digest() in seen:
            return at, times
        seen.add(digest.digest())
        at, times = inner, times + 1


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces joined and cut anew, at line ends before which no run of base64 stands, or anywhere in a stretch of HELD bytes without one."""
    held = b""
    for piece in pieces:
        held += piece
        cut = held.rfind(b"\n") if len(held) >= PIECE else -1
        while cut >= 0 and _RUN_AT_END.search(held, max(0, cut - 20), cut):
            cut = held.rfind(b"\n", 0, cut)
        if cut >= 0:
            yield held[: cut + 1]
            held = held[cut + 1 :]
        elif len(held) >= HELD:
            yield held
            held = held[-OVERLAP:]
    if held:
        yield held


def _base64_runs(text: str) -> Iterator[np.ndarray]:
    """The places of the characters of each run without its padding, and of runs wrapped into lines of one width."""
    joined = 0
    for m in _BASE64.finditer(text):
        line = np.arange(m.start(), m.start() + len(m[0].rstrip("=")))
        yield line
        if m.start() < joined or m[0].endswith("="):
            continue
        lines, at = [line], m.end()
        while len(lines[-1]) == len(line) and (n := _NEXT.match(text, at)) and len(n[1]) <= len(line):
            lines.append(np.arange(n.start(1), n.end(1)))
            at = n.end()
            if len(n[1]) == len(line):
                joined = at
            if n[2]:
                break
        if len(lines) > 1:
            places = np.concatenate(lines)
            yield places[: len(places) - (len(places) % 4 == 1)]


def _aligned(text: str, places: np.ndarray) -> Iterator[np.ndarray]:
    """A run from its first character and, where characters that part words stand in it, from the next three: less an odd one at the end."""
    a, b = int(places[0]), int(places[-1]) + 1
    parted = len(places) == b - a and any(x in text[a:b] for x in "/+-_")
    for first in range(4 if parted else 1):
        rest = places[first:]
        yield rest[: len(rest) - (len(rest) % 4 == 1)]


def _texts(raw: bytes) -> Iterator[tuple[str, int]]:
    """UTF-8, or else latin-1; UTF-16 of either order too where there is a NUL or a byte order mark. With the least bytes of a character."""
    try:
        yield raw.decode("utf-8"), 1
    except UnicodeDecodeError:
        yield raw.decode("latin-1"), 1
    if b"\0" in raw or raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        yield raw.decode("utf-16-le", "replace"), 2
        yield raw.decode("utf-16-be", "replace"), 2


def _decoded(layer: Layer) -> Iterator[Layer]:
    for places in (x for run in _base64_runs(layer.text) for x in _aligned(layer.text, run)):
        a, b = int(places[0]), int(places[-1]) + 1
        body = layer.text[a:b] if len(places) == b - a else "".join(layer.text[a:b].split())
        body = body.replace("-", "+").replace("_", "/")
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        content, times = _opened(raw)
        path = "base64" + "/compressed" * times
        for raw, text, wide in ((w, *x) for w in _windows(content()) for x in _texts(w)):
            if not text:
                continue
            if not times and len(raw) == len(body) * 3 // 4 and len(text) == -(-len(raw) // wide):  # byte k stands in characters 4k/3 to (4k + 4)/3
                k = np.arange(0, len(raw), wide)
                z = np.minimum(k + wide, len(raw)) - 1
                s, e = (x[places - a] for x in layer.spans(a, b))
                yield Layer(text, s[4 * k // 3], e[np.minimum((4 * z + 4 + 2) // 3 - 1 + (z % 3 != 2), len(body) - 1)], f"{layer.path}/{path}")
            else:
                pad = len(layer.text[b : b + 2]) - len(layer.text[b : b + 2].lstrip("="))
                start, end = layer.span(a, b + pad)
                yield Layer(text, np.broadcast_to(start, len(text)), np.broadcast_to(end, len(text)), f"{layer.path}/{path}")


def _settled(layer: Layer) -> Layer:
    """All escapes undone until none is left, by a stack: what an escape stands for may be part of the next one.

    Bytes above ASCII wait as lone surrogates and are read as UTF-8 at the end."""
    text, at = layer.text, 0
    out: list[str] = []
    lo: list[int] = []
    hi: list[int] = []
    begun: list[int] = []
    chunks: list[tuple[str, np.ndarray, np.ndarray]] = []
    while at < len(text):
        if not begun:
            if out:
                chunks.append(("".join(out), np.array(lo), np.array(hi)))
                out, lo, hi = [], [], []
            m = _OPENER.search(text, at)
            stop = m.start() if m else len(text)
            if stop > at:
                chunks.append((text[at:stop], np.arange(at, stop), np.arange(at + 1, stop + 1)))
            if not m:
                break
            at = stop
        out.append(text[at])
        lo.append(at)
        hi.append(at + 1)
        at += 1
        while True:
            if out[-1] == "%" or out[-1] == "\\":
                begun.append(len(out) - 1)
                break
            if not begun:
                break
            first = begun[-1]
            tail = "".join(out[first : first + 11])
            if _BEGUN.fullmatch(tail):
                break
            if m := _PERCENT.fullmatch(tail):
                byte = int(tail[1:], 16)
                new = chr(byte) if byte < 128 else chr(0xDC00 + byte)
            elif m := _ESCAPE.fullmatch(tail):
                point = int(next(x for x in m.groups() if x), 16)
                new = chr(point) if point <= 0x10FFFF and not 0xD800 <= point < 0xE000 else ""
            else:
                new = ""
            if not new:  # never an escape, nor are those that began before it
                begun.clear()
                break
            begun.pop()
            span = lo[first], hi[-1]
            del out[first:], lo[first:], hi[first:]
            out.append(new)
            lo.append(span[0])
            hi.append(span[1])
    if out:
        chunks.append(("".join(out), np.array(lo), np.array(hi)))
    whole = "".join(c[0] for c in chunks)
    first, last = (np.concatenate([c[k] for c in chunks]) for k in (1, 2))
    s, e = (first, last) if layer.start is None else (layer.start[first], layer.end[last - 1])
    made = Layer(whole, s, e, f"{layer.path}/escapes")
    wide = [(m.start(), m.end(), m[0].encode("utf-8", "surrogateescape").decode("utf-8", "replace")) for m in _BYTES.finditer(whole)]
    if wide:
        made = _rewritten(made, wide, "")
        made.path = f"{layer.path}/escapes"
    return made


def _unescaped(layer: Layer) -> Iterator[Layer]:
    once = [x for x in (_percent(layer) if "%" in layer.text else None, _escaped(layer) if "\\" in layer.text else None) if x]
    if len(once) > 1 or any(_PERCENT.search(x.text) or _ESCAPE.search(x.text) for x in once):
        once.append(_settled(layer))
    for x in once:
        x.unescaped = True
        yield x


def _inside(layer: Layer) -> Iterator[Layer]:
    if not layer.unescaped:
        yield from _unescaped(layer)
    yield from _decoded(layer)


def findings(text: str) -> list[dict]:
    """All findings of a text, by start and then kind; `layers` is empty for those of the text itself."""
    out: dict[tuple[int, int, int], str] = {}
    work, seen = [iter([Layer(text)])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if digest in seen:
            continue
        seen.add(digest)
        for kind, a, b in base_findings(layer.text):
            s, e = layer.span(a, b)
            out.setdefault((s, KINDS.index(kind), e), layer.path)
        work.append(_inside(layer))
    return [{"kind": KINDS[k], "start": s, "end": e, "layers": path} for (s, k, e), path in sorted(out.items())]


def _runs(solid: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Where runs of at least that length begin; no run goes beyond the row that it begins in."""
    cut = np.zeros(len(solid) + 1, dtype=bool)
    cut[bounds] = True
    start = np.flatnonzero(solid & (cut[:-1] | np.append(True, ~solid[:-1])[: len(solid)]))
    end = np.flatnonzero(solid & (cut[1:] | np.append(~solid[1:], True)[: len(solid)])) + 1
    return start[end - start >= least]


def suspects(column: pa.Array) -> np.ndarray:
    """Rows that may have a finding: any trace that a pattern or a decoder needs."""
    data, offsets = tokens.utf8(column)
    places = [_runs(_BASE64_BYTE[data], offsets, 16), _runs(_HEX_BYTE[data], offsets, 32)]
    low = tokens.LOWER[data].tobytes()
    for key in _KEYS:
        at, hits = low.find(key), []
        while at >= 0:
            hits.append(at)
            at = low.find(key, at + 1)
        places.append(np.array(hits, dtype=np.int64))
    if len(data) > 2:
        places.append(np.flatnonzero((data[:-2] == 0x25) & _ANY_HEX[data[1:-1]] & _ANY_HEX[data[2:]]))
        places.append(np.flatnonzero((data[:-1] == 0x5C) & np.isin(data[1:], list(b"uUx"))))
    return np.unique(np.searchsorted(offsets, np.concatenate(places), side="right") - 1)


def scan(documents: DataFrame) -> DataFrame:
    """documents with `secrets` appended: an array of (kind, start, end, layers)."""
    small_batches(documents.sparkSession)
    documents = documents.drop("secrets")
    schema = T.StructType([*documents.schema.fields, T.StructField("secrets", SECRETS, False)])
    at = documents.columns.index("text")
    kind = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False), pa.field("layers", pa.string(), False)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(at), [[] for _ in range(batch.num_rows)]
            for r in suspects(column):
                out[r] = findings(column[int(r)].as_py() or "")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=schema.names)

    return documents.mapInArrow(tokens.tidy(run), schema)
