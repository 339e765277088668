"""Secret scans by a recursive decoding worklist.

A text is scanned, and so is everything that is encoded in it: percent escapes, Unicode and hexadecimal escapes,
character references, base64 (both alphabets, also of UTF-16), and gzip, zlib, bzip2 or xz data in base64 or written with any of
these escapes. A layer of escapes is what a secret through one of them can reach: runs of a secret's characters on both sides, across
one sign with its quotes and spaces. An escape that was escaped itself, over and over, is one unit, so a long chain is read once. A
decoded layer goes on the worklist and is unwrapped in turn until no new layer appears; a text already unwrapped at the same place
is not unwrapped there again, which ends cycles. Each layer carries, for every character, the span of the original text that it came from, so what is found deep
inside is reported at its place in the text. Scanning is a map over whole texts; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_batches

KINDS = ("assign", "access", "hex")
#: Letters of the names in either case; ASCII only.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is matched whole, as any longest run would be
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A run of what a secret's words, or escapes of them, are written with; and what of a secret can stand beyond such a run, the
#: same read from either end.
RUN = re.compile(r"[A-Za-z0-9+/_.=%\\&#;{}-]*", re.ASCII)
BEYOND = re.compile(rf"""["']?\x20*[:=]?\x20*["']?{RUN.pattern}""", re.ASCII)
#: A shorter run holds at most 11 bytes, and the shortest secret has 14.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs of escapes, each with the chain of escapes of its own sign before it.
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
PERCENT_UNITS = re.compile(rf"(?:{PERCENT.pattern})+")
UNICODE = re.compile(r"\\(?:u005[cC])*u([0-9A-Fa-f]{4})")
ESCAPE_UNITS = re.compile(rf"(?:{UNICODE.pattern})+|\\x[0-9A-Fa-f]{{2}}|\\u\{{[0-9A-Fa-f]{{1,6}}\}}")
ENTITY_UNITS = re.compile(r"&(?:amp;)*((?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});)")
#: Where compressed data begin that are written with escapes, and the bytes of such writing, in any of its forms.


def _written(*values: int) -> str:
    """A pattern for one of some bytes, as itself or in any form of escape."""
    forms = (f"{re.escape(chr(v)) + '|' if 0x20 < v < 0x7F else ''}(?:%|\\\\x|\\\\u00)(?i:{v:02x})|&#(?:[xX](?i:{v:02x})|{v});" for v in values)
    return f"(?:{'|'.join(forms)})"


ESCAPED_MAGIC = re.compile(
    "|".join("".join(_written(*([v] if isinstance(v, int) else v)) for v in magic) for magic in ((0x1F, 0x8B), (0x78, (0x01, 0x5E, 0x9C, 0xDA)), (*b"BZh", tuple(b"123456789"), *b"1AY"), (0xFD, *b"7zXZ")))
)
ESCAPED_BYTE = re.compile(r"""(?:%|\\x|\\u00|&#x)([0-9A-Fa-f]{2});?|&#([0-9]{1,3});|\\([abfnrtv0\\'"])|([\x20-\x7e])""")
_SIMPLE = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "\\": 92, "'": 39, '"': 34}
#: Lines of a wrapped run: each stands up to its line's end, and the next begins its line.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{4,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
RUN_PART = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Bytes that read as text, so many that a secret can be in them.
STRETCH = re.compile(
    rb"(?:[\x20-\x7e\t\r\n]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}"
)
#: The same in UTF-16: ASCII with a zero on one side.
STRETCH16 = re.compile(rb"(?:[\x20-\x7e\t\r\n]\x00){12,}|(?:\x00[\x20-\x7e\t\r\n]){12,}")
#: Where compressed data begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
#: A compressed layer unfolds in windows of so many bytes, which guards a worker against a decompression bomb. Each begins
#: with the end of the one before: its last run without white space, or the overlap if that run is as long as a window.
UNFOLD, OVERLAP = 1 << 24, 1 << 20

Span = tuple[str, int, int]


def find_secrets(text: str) -> list[Span]:
    """(kind, start, end) of the secrets that stand openly in a text, in code points, end exclusive."""
    found: list[Span] = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def ordered(spans: set[Span] | list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Layer:
    """A text with, for each of its characters, the span of the original that it stands for."""

    __slots__ = ("end", "start", "text")

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray) -> None:
        self.text, self.start, self.end = text, start, end

    @classmethod
    def piece(cls, text: str, at: int, parent: Layer | None) -> Layer:
        """The layer of ``text``, which stands at ``at`` of its parent, or of the original text if that is None."""
        if parent is None:
            place = np.arange(at, at + len(text))
            return cls(text, place, place + 1)
        return cls(text, parent.start[at : at + len(text)], parent.end[at : at + len(text)])

    @classmethod
    def joined(cls, parts: list[Layer]) -> Layer:
        """Parts that stand in different places, read as one text."""
        return cls("".join(p.text for p in parts), np.concatenate([p.start for p in parts]), np.concatenate([p.end for p in parts]))

    def part(self, at: int) -> Layer:
        return Layer(self.text[at:], self.start[at:], self.end[at:])

    def spans(self) -> Iterator[Span]:
        for kind, a, b in find_secrets(self.text):
            yield kind, int(self.start[a:b].min()), int(self.end[a:b].max())


#: Decoded text with the spans that its parts stand for.
Decoded = list[tuple[str, int, int]]


def _rewritten(text: str, parent: Layer | None) -> Iterator[Layer]:
    """Layers with the escape units of a text decoded: each unit with all that a secret through it can reach."""
    n, back = len(text), ""
    parts: list[Layer] = []
    begun = done = -1  # the open layer, and how far it is made
    reach = run_end = -1
    for m in UNITS.finditer(text):
        decoded = _DECODERS[m[0][0]](m)
        a, b = m.span()
        if a >= run_end:  # the first unit of its run
            back = back or text[::-1]
            left = n - BEYOND.match(back, RUN.match(back, n - a).end()).end()
            if begun >= 0 and left > reach:
                yield Layer.joined([*parts, Layer.piece(text[done:reach], done, parent)])
                begun = -1
            if begun < 0:
                begun, done, parts = left, left, []
            run_end = RUN.match(text, b).end()
            reach = BEYOND.match(text, run_end).end()
        parts.append(Layer.piece(text[done:a], done, parent))
        plain = "".join(c for c, _, _ in decoded)
        at = Layer.piece(text[a:b], a, parent)
        sizes = [len(c) for c, _, _ in decoded]
        starts = np.repeat([x - a for _, x, _ in decoded], sizes).astype(np.int64)
        ends = np.repeat([y - a - 1 for _, _, y in decoded], sizes).astype(np.int64)
        parts.append(Layer(plain, at.start[starts], at.end[ends]))
        done = b
    if begun >= 0:
        yield Layer.joined([*parts, Layer.piece(text[done:reach], done, parent)])


def _percent(m: re.Match) -> Decoded:
    """Bytes as UTF-8, or one by one where they are not."""
    units = [(bytes.fromhex(u[1]), *u.span()) for u in PERCENT.finditer(m[0])]
    at, data = m.start(), b"".join(u[0] for u in units)
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = data.decode("latin-1")
        return [(c, at + a, at + b) for c, (_, a, b) in zip(text, units, strict=True)]
    out, k = [], 0
    for c in text:
        size = len(c.encode())
        out.append((c, at + units[k][1], at + units[k + size - 1][2]))
        k += size
    return out


def _escape(m: re.Match) -> Decoded:
    unit, at = m[0], m.start()
    if unit.startswith("\\u{"):
        code = int(unit[3:-1], 16)
        return [(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", at, m.end())]
    if unit.startswith("\\x"):
        return [(chr(int(unit[2:], 16)), at, m.end())]
    out: Decoded = []
    for u in UNICODE.finditer(unit):
        code, (a, b) = int(u[1], 16), u.span()
        if 0xDC00 <= code < 0xE000 and out and "\ud800" <= out[-1][0] < "\udc00":
            high, first, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), first, at + b))
        else:
            out.append((chr(code), at + a, at + b))
    return [("\ufffd" if "\ud800" <= c <= "\udfff" else c, a, b) for c, a, b in out]


def _entity(m: re.Match) -> Decoded:
    return [(html.unescape("&" + ENTITY_UNITS.fullmatch(m[0])[1]), *m.span())]


UNITS = re.compile("|".join(p.pattern for p in (PERCENT_UNITS, ESCAPE_UNITS, ENTITY_UNITS)))
_DECODERS: dict[str, Callable[[re.Match], Decoded]] = {"%": _percent, "\\": _escape, "&": _entity}


def _escaped_data(text: str, parent: Layer | None) -> Iterator[Layer]:
    """What unfolds of compressed data whose bytes are written with escapes; it stands for the writing as a whole."""
    done = 0
    for m in ESCAPED_MAGIC.finditer(text):
        if m.start() < done:
            continue
        data, at, ends = bytearray(), m.start(), []
        while (u := ESCAPED_BYTE.match(text, at)) is not None:
            value = int(u[1], 16) if u[1] else int(u[2]) if u[2] else _SIMPLE[u[3]] if u[3] else ord(u[4])
            if value > 255:
                break
            data.append(value)
            at = u.end()
            ends.append(at)
        left: list[int] = []
        for _ in _unfolded(bytes(data), left):  # what follows the data looks like more of them
            pass
        if left and len(ends) > left[-1]:
            at = ends[len(ends) - left[-1] - 1]
        for inner in _windows(_unfolded(bytes(data))):
            done = at
            place = Layer.piece(text[m.start() : at], m.start(), parent)
            yield Layer(inner, np.broadcast_to(place.start.min(), len(inner)), np.broadcast_to(place.end.max(), len(inner)))


def _decompressor(data: bytes):
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _unfolded(data: bytes, unused: list[int] | None = None) -> Iterator[bytes]:
    """Compressed data, all members of it, unfolded in parts of at most UNFOLD bytes; none if it is not compressed.

    ``unused`` is given the number of bytes after each member.
    """
    try:
        while (member := _decompressor(data)) is not None:
            zipped = not hasattr(member, "needs_input")
            part = member.decompress(data, UNFOLD)
            while part:
                yield part
                if member.eof:
                    break
                part = member.decompress(member.unconsumed_tail if zipped else b"", UNFOLD)
            if not member.eof:
                return
            if unused is not None:
                unused.append(len(member.unused_data))
            data = member.unused_data.lstrip(b"\x00")  # members may be padded
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return


def _windows(parts: Iterator[bytes]) -> Iterator[str]:
    """The readable stretches of the parts, a line each, in windows; members and windows meet without a gap."""
    held, fresh = b"", False  # whether ``held`` has more than the overlap
    for part in parts:
        held, fresh = held + part, True
        if len(held) > UNFOLD:
            if text := _stretches(held):
                yield text
            space = max(held.rfind(c) for c in (b" ", b"\n", b"\t"))
            held, fresh = held[space if space > len(held) - UNFOLD else -OVERLAP :], False
    if fresh and (text := _stretches(held)):
        yield text


def _stretches(data: bytes) -> str:
    """All that reads as UTF-8, or as ASCII in UTF-16; other bytes end a line."""
    found = [m[0].decode() for m in STRETCH.finditer(data)]
    if b"\x00" in data:
        found += [m[0].replace(b"\x00", b"").decode() for m in STRETCH16.finditer(data)]
    return "\n".join(found)


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if _is_readable(text) else None


def _is_readable(text: str) -> bool:
    odd = sum(not (c.isprintable() or c in "\t\n\r") for c in text)
    return bool(text) and odd * 10 <= len(text)


def _base64(run: str, layer: Layer) -> Iterator[Layer]:
    """The text, or the compressed text, in a base64 run. A compressed layer stands for the run as a whole."""
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return
    try:
        data = base64.b64decode((body + "=" * (-len(body) % 4)).replace("-", "+").replace("_", "/"))
    except (binascii.Error, ValueError):
        return
    if _decompressor(data) is not None:
        found = False
        for text in _windows(_unfolded(data)):
            found, n = True, len(text)
            yield Layer(text, np.broadcast_to(layer.start.min(), n), np.broadcast_to(layer.end.max(), n))
        if found:
            return
    text = _readable(data)
    if text is None:
        return
    # Three bytes stand for four characters.
    sizes = np.fromiter((len(c.encode()) for c in text), dtype=np.int64, count=len(text))
    last = np.cumsum(sizes) * 8 - 1
    first = (np.cumsum(sizes) - sizes) * 8
    yield Layer(text, layer.start[first // 6], layer.end[last // 6])


def _in_run(run: str, layer: Callable[[], Layer]) -> Iterator[Layer]:
    """The layers in a base64 run: all of it, or else whatever reads as text, or unfolds, at any of the four offsets.

    The first is how a run stands by itself. Behind a prefix of base64's own letters the data begin at any place.
    """
    found = False
    if _may_be_base64(run):
        for inner in _base64(run, layer()):
            found = True
            yield inner
    body = "" if found else run.rstrip("=").replace("-", "+").replace("_", "/")
    for shift in range(4):
        part = body[shift:]
        if len(part) < 16:
            return
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        for m in STRETCH.finditer(data):
            text, at = m[0].decode(), layer()
            sizes = np.fromiter((len(c.encode()) for c in text), dtype=np.int64, count=len(text))
            ends = (m.start() + np.cumsum(sizes)) * 8
            yield Layer(text, at.start[shift + (ends - sizes * 8) // 6], at.end[shift + (ends - 1) // 6])
        for m in STRETCH16.finditer(data) if b"\x00" in data else ():
            text, at = m[0].replace(b"\x00", b"").decode(), layer()
            first = (m.start() + 2 * np.arange(len(text))) * 8
            yield Layer(text, at.start[shift + first // 6], at.end[shift + (first + 15) // 6])
        for m in MAGIC.finditer(data):
            for text in _windows(_unfolded(data[m.start() :])):
                at, n = layer(), len(text)
                yield Layer(text, np.broadcast_to(at.start[shift + m.start() * 8 // 6 :].min(), n), np.broadcast_to(at.end.max(), n))


def _wrapped_runs(m: re.Match) -> Iterator[list[tuple[int, str]]]:
    """(place, run) of the lines of each wrapped run: its lines are of equal length, but for the first and a shorter last."""
    lines = [(m.start() + x.start(), x[0]) for x in RUN_PART.finditer(m[0])]
    at = 0
    while at < len(lines) - 1:
        width, end = len(lines[at + 1][1]), at + 2
        while end < len(lines) and len(lines[end][1]) == width and not lines[end - 1][1].endswith("="):
            end += 1
        if end < len(lines) and len(lines[end][1]) < width and not lines[end - 1][1].endswith("="):
            yield lines[at : end + 1]
        yield lines[at:end]
        at = max(end - 1, at + 1)


def decoded_layers(text: str, parent: Layer | None = None) -> Iterator[Layer]:
    """The layers that are encoded directly in a text."""
    if "%" in text or "\\" in text or "&" in text:
        yield from _rewritten(text, parent)
        yield from _escaped_data(text, parent)
    for m in BASE64.finditer(text):
        # A word of prose: its letters give no text. The first bytes tell most of them before anything is copied.
        yield from _in_run(m[0], lambda m=m: Layer.piece(m[0], m.start(), parent))
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        for lines in _wrapped_runs(m):
            if sum(len(x) for _, x in lines) >= 16:
                yield from _in_run("".join(x for _, x in lines), lambda lines=lines: Layer.joined([Layer.piece(x, at, parent) for at, x in lines]))


def _may_be_base64(run: str) -> bool:
    """Whether the first eight characters decode to the start of text or of compressed data."""
    try:
        head = base64.b64decode(run[:8].replace("-", "+").replace("_", "/"))
    except (binascii.Error, ValueError):
        return False
    return head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:4] == b"\xfd7zX" or head[0] == 0x78 or all(x >= 0x20 or x in (9, 10, 13) for x in head) and (max(head) < 0x80 or _opens_text(head))


def _opens_text(head: bytes) -> bool:
    try:
        head.decode()
    except UnicodeDecodeError as e:
        return e.reason == "unexpected end of data"
    return True


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(spans that stand openly, all spans in place of the original text), both ordered."""
    base = ordered(find_secrets(text))
    every = set(base)
    work, seen = deque(decoded_layers(text)), {(text, 0, len(text))}
    while work:
        layer = work.popleft()
        if not layer.text:
            continue
        every.update(layer.spans())
        # A cycle comes back to a text at its place, as the same escapes taken in another order do. Elsewhere, equal text has spans of its own.
        here = (layer.text, int(layer.start[0]), int(layer.end[-1]))
        if here not in seen:
            seen.add(here)
            work.extend(decoded_layers(layer.text, layer))
    return base, ordered(every)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` for each row: arrays of (kind, start, end) in code points.

    ``base`` holds what stands openly, ``spans`` that and what was found in decoded layers. A null or empty text has none.
    Other columns are ignored; repeated rows are scanned each on its own; no rows give no rows. A text is read whole, of any length,
    by one task that holds it and its layers; what unfolds out of compressed data is held in windows.
    """
    text_batches(docs.sparkSession)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(spans: list[Span]) -> list[dict]:
            return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

        for batch in batches:
            found = [scan(x or "") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([cells(b) for b, _ in found], span_type), pa.array([cells(s) for _, s in found], span_type)], names=["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cell = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, base {cell}, spans {cell}")


def digest(spans: list[Span]) -> str:
    """SHA-256 of joined spans."""
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def span_text(column: str):
    """kind:start:end of an array of spans, comma-joined, as a column."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
