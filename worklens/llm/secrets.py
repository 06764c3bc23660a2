"""Secret scanning through nested encodings.

A worklist starts with the text itself. Each layer is scanned for secrets, then unwrapped: percent
escapes, Unicode escapes, base64 runs, and compressed payloads (gzip, zlib, bzip2, xz, zstd) inside
those runs give further layers, until no layer is new. A layer of the same content from the same
original ranges as one met before is skipped (cycle detection); the same content elsewhere in the
document is scanned there too, and ``n_layers`` counts distinct contents. Every layer carries, for each of its characters, the
range of the original text it came from, so spans found at any depth are reported as code point
ranges of the original text; inside a compressed payload the range is the whole encoded run.

Defined results: null text counts as empty (no spans, hash of the empty string); a null doc_id is
passed through; repeated rows are scanned and returned row by row; an empty table gives an empty
result; other columns are ignored by :func:`scan` and kept by :func:`redact`. Base64 runs of 16 characters
or more (less holds no secret), in one line or joined from lines of any length, are decoded at their four
alignments; decoded bytes are scanned whole, printable or not (``n_layers`` counts those that are UTF-8 with
at most a tenth of control characters), and searched for compressed payloads, of which all members are read.
Payloads written as percent or backslash escapes, with plain characters between, are unpacked as well: their
range goes from the first to the last character of the payload, or of the escapes where its end is not found.
Backslash escapes are read with the short ones of string literals, and without. Runs of eight or more characters that alternate with NUL are read as UTF-16, in both byte orders where their
ends tell neither. Content beyond ``max_inflate`` bytes is scanned
in overlapping parts. Payloads of such content, and those that cannot be read to their end, count in
``n_oversize``; the latter :func:`redact` masks as a whole: they are cut short (zlib, whose mark is weak, from
64 bytes on), broken, or ask for more than 256 MB (xz) or a window of more than 128 MB (zstd).
"""

from __future__ import annotations

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

from worklens.llm.common import text_batches, tidied

KINDS = ("assign", "access", "hex")
MAX_INFLATE = 32 << 20
#: Bytes that are inflated at once, and the memory an xz payload may ask for.
PIECE = 1 << 18
#: As little as makes a few blocks of zstd, which inflate to 128 KB each.
ZSTD_PIECE = 128
MEMORY = 256 << 20

# The patterns of the three kinds of secrets.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})")
BACKSLASH_BYTE = re.compile(r"""\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'"/])""")
SHORT_ESCAPES = dict(zip("abfnrtv0\\'\"/", b"\a\b\f\n\r\t\v\0\\'\"/"))
SHORT = re.compile(r"""\\[abfnrtv0\\'"/]""")
BACKSLASH = re.compile(f"(?:{BACKSLASH_BYTE.pattern})+")
UTF16 = re.compile(r"\x00?(?:[^\x00\xfe\xff]\x00){8,}[^\x00\xfe\xff]?")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
#: Lines of a run wrapped at less than 16 characters, but for the first.
SHORT_LINES = re.compile(r"\n[\x20\t]*[A-Za-z0-9+/_-]{1,15}+(?![A-Za-z0-9+/_-])(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{1,15}+(?![A-Za-z0-9+/_-]))*+={0,2}")
SHORT_FIRST = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{1,15}\r?\Z")
SHORTEST = 16
#: A payload whose end is not found ends at the last escape before more than GAP characters of which one in PROSE or
#: more is white space.
GAP, PROSE = 32, 12
SPACE = re.compile(r"\s")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
ZSTD = b"\x28\xb5\x2f\xfd"
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17\x72\x45\x38\x50\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|x[\x01\x5e\x9c\xda]")
#: Bytes without any of these hold no secret and no encoding; runs of INSIDE bytes contain every match of the patterns.
OF_NOTE = re.compile(rb"(?i)passw|secret|token|api_?key|akia|[0-9a-f]{32}|%[0-9a-f]{2}|\\[ux]|[a-z0-9+/_-]{16}|(?:[^\x00]\x00){8}|[a-z0-9+/_-]{1,15}\r?\n[\x20\t]*[a-z0-9+/_-]")
INSIDE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"' :%\\{}\r\n\t"
TO_STANDARD = str.maketrans("-_", "+/")


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """Secrets of one layer as (start, index of kind, end), sorted."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


class Report:
    """Payloads beyond the bound or not read to their end, and the original ranges of the latter."""

    def __init__(self):
        self.oversize, self.unread = 0, set()


class Inflated:
    """The content of the compressed payload that begins at an offset, through all its members, by pieces.
    ``end``: where it ends; ``whole``: it was read to its end; ``sure``: it is compressed beyond doubt; ``cut``: the
    data end before it does."""

    def __init__(self, data: bytes, at: int):
        self.data, self.end, self.whole, self.sure, self.cut = data, at, False, data[at : at + 1] != b"x", False

    def __iter__(self) -> Iterator[bytes]:
        try:
            yield from self._frames() if self.data.startswith(ZSTD, self.end) else self._members()
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, MemoryError):
            return
        except Exception as e:
            if type(e).__name__ != "ZstdError":
                raise

    def _frames(self) -> Iterator[bytes]:
        import zstandard

        while self.data.startswith(ZSTD, self.end):
            job = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
            self.whole, at = False, self.end
            while not job.eof and at < len(self.data):
                fed = self.data[at : at + ZSTD_PIECE]
                at += len(fed)
                yield job.decompress(fed)
            if not job.eof:
                self.cut = True
                return
            self.whole, self.end = True, at - len(job.unused_data)

    def _members(self) -> Iterator[bytes]:
        kind = self.data[self.end : self.end + 1]
        while self.data.startswith(kind, self.end) and PACKED.match(self.data, self.end):
            job = zlib.decompressobj(47) if kind in b"\x1fx" else bz2.BZ2Decompressor() if kind == b"B" else lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=MEMORY)
            self.whole, at = False, self.end
            while not job.eof and at < len(self.data):
                fed = self.data[at : at + PIECE]
                at += len(fed)
                yield job.decompress(fed, PIECE)
                if kind in b"\x1fx":
                    while job.unconsumed_tail and not job.eof:
                        yield job.decompress(job.unconsumed_tail, PIECE)
                else:
                    while not job.eof and not job.needs_input:
                        yield job.decompress(b"", PIECE)
            if not job.eof:
                self.cut = at - self.end >= 64
                return
            self.whole, self.end = True, at - len(job.unused_data)
            while kind == b"\xfd" and self.data.startswith(bytes(4), self.end):  # padding between streams
                self.end += 4


def _readable(data: bytes) -> bool:
    """UTF-8 text with few control characters: what ``n_layers`` counts. Other layers are scanned as well."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return bool(text) and sum(1 for _ in CONTROL.finditer(text)) * 10 <= len(text)


class Layer:
    """A decoded text; starts/ends: the original code point range behind each character; whole: one range behind
    all of them (neither: the text itself). data: the bytes that the text shows as Latin-1, if it was decoded,
    and run: the range of the encoded run that they come from. literal: short escapes (as in "\\n") stand for
    themselves from here on."""

    __slots__ = ("text", "starts", "ends", "whole", "data", "run", "counts", "literal")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, whole: tuple | None = None, data: bytes | None = None, run: tuple | None = None, counts: bool = True):
        self.text, self.starts, self.ends, self.whole, self.data, self.run, self.counts = text, starts, ends, whole, data, run or whole, counts
        self.literal = False

    def root(self, a: int, b: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        return (a, b) if self.starts is None else (int(self.starts[a:b].min()), int(self.ends[a:b].max()))

    def place(self) -> bytes:
        return str(self.whole).encode() if self.starts is None else self.starts.tobytes() + self.ends.tobytes()


def _spliced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of ``pattern`` decoded. ``decode`` gives (text, start, end) pieces of a match."""
    parts, starts, ends, last = [], [], [], 0
    if layer.whole is not None:
        text = pattern.sub(lambda m: "".join(p[0] for p in decode(m)), layer.text)
        return Layer(text, whole=layer.whole) if text != layer.text else None
    n = len(layer.text)
    own_s = layer.starts if layer.starts is not None else np.arange(n)
    own_e = layer.ends if layer.ends is not None else np.arange(1, n + 1)
    changed = False
    for m in pattern.finditer(layer.text):
        pieces = decode(m)
        changed = True
        parts.append(layer.text[last : m.start()])
        starts.append(own_s[last : m.start()])
        ends.append(own_e[last : m.start()])
        parts += [text for text, _, _ in pieces]
        starts.append(own_s[np.array([a for text, a, _ in pieces for _ in text], np.int64)])  # places only grow along a layer
        ends.append(own_e[np.array([b - 1 for text, _, b in pieces for _ in text], np.int64)])
        last = m.end()
    if not changed:
        return None
    parts.append(layer.text[last:])
    starts.append(own_s[last:])
    ends.append(own_e[last:])
    return Layer("".join(parts), np.concatenate(starts), np.concatenate(ends))


def _percent(m: re.Match) -> list:
    data = binascii.unhexlify(m[0].replace("%", ""))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return [(chr(c), m.start() + 3 * i, m.start() + 3 * i + 3) for i, c in enumerate(data)]
    out, at = [], m.start()
    for c in text:
        n = 3 * len(c.encode("utf-8"))
        out.append((c, at, at + n))
        at += n
    return out


def _unicode(m: re.Match, escape: re.Pattern = ESCAPE) -> list:
    units = [(SHORT_ESCAPES[e[5]] if e.lastindex == 5 else int(e[e.lastindex], 16), m.start() + e.start(), m.start() + e.end()) for e in escape.finditer(m[0])]
    out, i = [], 0
    while i < len(units):
        code, a, b = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, b, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            code = 0xFFFD
        out.append((chr(code), a, b))
        i += 1
    return out


def _utf16(m: re.Match, big: bool) -> list:
    """The run in one byte order, or as it is where its ends speak for the other one."""
    first, final = m[0][0] == "\0", m[0][-1] == "\0"
    if first != final and big != first:
        return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0])]
    begin = int(first != big)
    end = begin + (len(m[0]) - begin) // 2 * 2
    pairs = [(m[0][i + big], m.start() + i, m.start() + i + 2) for i in range(begin, end, 2)]
    head = [(m[0][0], m.start(), m.start() + 1)] if begin else []
    return head + pairs + ([(m[0][-1], m.end() - 1, m.end())] if end < len(m[0]) else [])


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Where base64 runs begin and end: those with a first line of 16 characters, and those of shorter lines."""
    for m in BASE64.finditer(text):
        yield m.span()
    if "\n" in text:
        for m in SHORT_LINES.finditer(text):
            if before := SHORT_FIRST.search(text[max(0, m.start() - 17) : m.start()]):
                yield m.start() - len(before[0]), m.end()


def _blobs(layer: Layer) -> Iterator[Layer]:
    """The bytes of the base64 runs of a layer, each run at its four alignments, as it may follow other text."""
    for begin, end in _runs(layer.text):
        run = layer.text[begin:end].rstrip("=")
        broken = "\n" in run
        tight = "".join(run.split()) if broken else run
        if len(tight) < SHORTEST:
            continue
        tight = tight.translate(TO_STANDARD)
        for skip in range(4):
            n = len(tight) - skip
            n -= n % 4 == 1
            data = binascii.a2b_base64(tight[skip : skip + n] + "=" * (-n % 4))
            counts = _readable(data)
            if not counts and not OF_NOTE.search(data) and not PACKED.search(data):
                continue
            if layer.whole is not None:
                yield Layer(data.decode("latin-1"), whole=layer.whole, data=data, counts=counts)
                continue
            where = np.arange(begin, begin + len(run))
            if broken:
                where = where[[not c.isspace() for c in run]]
            first = np.arange(len(data)) * 4 // 3 + skip
            final = where[np.minimum(-(-np.arange(1, len(data) + 1) * 4 // 3) + skip, len(tight)) - 1]
            first = where[first]
            if layer.starts is not None:
                first, final = layer.starts[first], layer.ends[final]
            else:
                final = final + 1
            yield Layer(data.decode("latin-1"), first, final, data=data, run=layer.root(begin, end), counts=counts)


def _byte(m: re.Match) -> str:
    """The byte that an escape stands for, as a character; a question mark for what is none."""
    if m.lastindex == 5:
        return chr(SHORT_ESCAPES[m[5]])
    code = int(m[m.lastindex], 16)
    return chr(code) if code < 256 else "?"


class Escapes:
    """The escapes of a text that stand for bytes: where each begins and ends, and the place of its byte."""

    def __init__(self, text: str, pattern: re.Pattern):
        self.text = text
        spans = np.fromiter((p for m in pattern.finditer(text) for p in m.span()), np.int64).reshape(-1, 2)
        self.begins, self.ends = spans[:, 0], spans[:, 1]
        self.shorter = np.concatenate([[0], np.cumsum(self.ends - self.begins - 1)])
        self.bytes = self.begins - self.shorter[:-1]

    def origin(self, at: int) -> int:
        """Where the character or escape begins that gives the byte at a place."""
        return at + int(self.shorter[np.searchsorted(self.bytes, at)])

    def near(self, at: int, length: int) -> bool:
        i = np.searchsorted(self.bytes, at)
        return bool(i < len(self.bytes) and self.bytes[i] < at + length)

    def chain(self, at: int) -> int:
        """The end of the last escape, from the one at or after the byte at a place, before plain text (see
        GAP)."""
        i = int(np.searchsorted(self.bytes, at))
        for gap in i + np.flatnonzero(self.begins[i + 1 :] - self.ends[i:-1] > GAP):
            plain = self.text[self.ends[gap] : self.begins[gap + 1]]
            if len(SPACE.findall(plain)) * PROSE >= len(plain):
                return int(self.ends[gap])
        return int(self.ends[-1])


def _packed_escapes(layer: Layer, pattern: re.Pattern, limit: int, report: Report) -> Iterator[Layer]:
    """The content of the compressed payloads that stand as escapes in a layer's text."""
    data = pattern.sub(_byte, layer.text).encode("latin-1", "replace")
    if not PACKED.search(data):
        return
    escapes = Escapes(layer.text, pattern)

    def place(at: int) -> tuple[int, int] | None:
        if not escapes.near(at, 2 if data[at : at + 1] == b"x" else 64):
            return None
        source = Inflated(data, at)
        for _ in source:
            pass
        return layer.root(escapes.origin(at), escapes.origin(source.end) if source.whole else max(escapes.chain(at), escapes.origin(at + 1)))

    yield from _unpacked(data, place, True, limit, report)


def _unpacked(data: bytes, place: Callable[[int], tuple], inner: bool, limit: int, report: Report) -> Iterator[Layer]:
    """The content of the compressed payloads in a layer's bytes, wherever they begin. Content beyond ``limit``
    bytes comes in parts, which overlap from the last character that no secret and no encoding contains. ``place``:
    the original range of the payload that begins at an offset, or None where there is none; ``inner``: a payload of
    zlib that breaks off counts as one."""
    at = 0
    while m := PACKED.search(data, at):
        if (whole := place(m.start())) is None:
            at = m.start() + 2
            continue
        source, held, got, big, unread = Inflated(data, m.start()), bytearray(), False, False, False
        for piece in source:
            held += piece
            got = got or bool(piece)
            if len(held) > limit:
                big = True
                yield Layer(held.decode("latin-1"), whole=whole, data=bytes(held), counts=_readable(bytes(held)))
                cut = len(held.rstrip(INSIDE))
                if len(held) - cut > limit // 2:
                    cut, unread = len(held) - limit // 2, True
                del held[:cut]
        if held:
            yield Layer(held.decode("latin-1"), whole=whole, data=bytes(held), counts=_readable(bytes(held)))
        if not source.whole and (source.sure or source.cut or got and inner):
            unread = True
        if unread:
            report.unread.add(whole)
        report.oversize += big or unread
        at = max(source.end, m.start() + 2)


def _deeper(layer: Layer, limit: int, report: Report) -> Iterator[Layer]:
    if "%" in layer.text and (found := _spliced(layer, PERCENT, _percent)):
        yield found
        yield from _packed_escapes(layer, PERCENT_BYTE, limit, report)
    if "\\" in layer.text and (found := _spliced(layer, UNICODE, _unicode)):
        found.literal = True
        yield found
        yield from _packed_escapes(layer, BACKSLASH_BYTE, limit, report)
    if "\\" in layer.text and not layer.literal and SHORT.search(layer.text) and (found := _spliced(layer, BACKSLASH, lambda m: _unicode(m, BACKSLASH_BYTE))):
        yield found
    if "\0" in layer.text:
        for big in (False, True):
            if found := _spliced(layer, UTF16, lambda m, big=big: _utf16(m, big)):
                yield found
    yield from _blobs(layer)
    if layer.data is not None:
        yield from _unpacked(layer.data, lambda at: layer.run, layer.whole is not None, limit, report)


def _scanned(text: str | None, max_inflate: int) -> tuple[list, list, int, Report]:
    text = text or ""
    base = find_spans(text)
    report, seen, met, spans = Report(), set(), set(), set(base)
    layers = 0
    work: list[Iterator[Layer]] = [iter([Layer(text)])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        place = hashlib.blake2b(mark + layer.place(), digest_size=16).digest()
        if place in seen:
            continue
        seen.add(place)
        if len(seen) > 1:
            layers += layer.counts and mark not in met
            spans.update((*(r := layer.root(a, b))[:1], kind, r[1]) for a, kind, b in find_spans(layer.text))
        met.add(mark)
        work.append(_deeper(layer, max_inflate, report))
    return base, sorted(spans), layers, report


def scan_text(text: str | None, max_inflate: int = MAX_INFLATE) -> tuple[list, list, int, int]:
    """(base spans, all spans, decoded layers, oversize payloads) of one text."""
    base, spans, layers, report = _scanned(text, max_inflate)
    return base, spans, layers, report.oversize


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_oversize long"


def scan(docs: DataFrame, max_inflate: int = MAX_INFLATE) -> DataFrame:
    """One row per document with its secrets; see the module's text for every defined case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t, max_inflate) for t in batch.column(1).to_pylist()]
            counts = [[sum(s[1] == k for s in r[0]) for r in rows] for k in range(3)]
            cols = [pa.array(c, pa.int64()) for c in counts]
            cols += [pa.array([hashlib.sha256(joined(r[0]).encode()).hexdigest() for r in rows], pa.string())]
            cols += [pa.array([joined(r[1]) for r in rows], pa.string())]
            cols += [pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3)]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_oversize"]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], names=names)

    return text_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidied(run), SCAN_SCHEMA)


def redacted(text: str | None, mask: str = "[SECRET]", max_inflate: int = MAX_INFLATE) -> str | None:
    """The text with every span, at whatever depth it was found, and every encoded run that could not be read to
    its end replaced by the mask."""
    if not text:
        return text
    out, last = [], 0
    merged: list[list[int]] = []
    _, spans, _, report = _scanned(text, max_inflate)
    for a, b in sorted({(a, b) for a, _, b in spans} | report.unread):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[last:a], mask]
        last = b
    return "".join(out) + text[last:]


def redact(docs: DataFrame, mask: str = "[SECRET]", max_inflate: int = MAX_INFLATE) -> DataFrame:
    """The documents, all columns kept, with secrets masked in ``text``; ``n_chars``, if there, follows the text.
    Null and empty texts stay as they are."""
    at = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t, mask, max_inflate) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            if sized is not None:
                was = batch.column(sized).to_pylist()
                cols[sized] = pa.array([n if t is None else len(t) for n, t in zip(was, texts)], batch.schema.field(sized).type)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return text_batches(docs).mapInArrow(tidied(run), docs.schema)
