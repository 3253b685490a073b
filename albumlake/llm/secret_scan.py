"""Secret scans with a recursive decoding worklist.

A text is the first layer. Every layer is scanned, then unwrapped: URL escapes, and escapes of
programs and markup, give a rewritten layer; every run of base64 gives a layer of its own, or layers of what its compressed
data unpacks to. Bytes that are no text stay in a layer as lone surrogates, which no pattern takes.
Base64 may hold UTF-8 or UTF-16, and gzip, zlib, bare deflate, bzip2 or xz data. A line break within
it, indented or not, is read both as the run's end and as a wrap. Layers go on a worklist until
none is new; a text that was a layer of the same place before is not taken again, which ends cycles.
Each layer knows which characters of the original its own came from.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_or_empty

KINDS = ("assign", "access", "hex")
#: What counts as a secret before decoding.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"""\\(?:u[0-9A-Fa-f]{4}|u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2}|[0-7]{3}|[nrtbf"'/\\])|&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?""")
#: What a backslash and a letter stand for.
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
#: Runs of base64 over single line breaks and what indents the lines; shorter ones than 16 characters are left out later.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+|[A-Za-z0-9+/_-]++(?=[\x20\t]*[\r\n]))(?:[\x20\t]*(?:\r\n?|\n)[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
#: How base64 of gzip, zlib, bzip2 and xz data begins within a word, and its first letters at all.
_GLUED = re.compile(r"H4sI|e[AFJN]|Qlpo|/Td6")
_HEADS = "HCGKOSWaeQ/_"
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: What every layer has that holds a secret or can be unwrapped further.
_WORTH = re.compile(rb"[A-Za-z0-9+/_.=-]{8}|%[0-9A-Fa-f]{2}|\\[ux0-7nrtbf\"'/\\]|&#|[A-Za-z0-9+/_-][\r\n][\n\x20\tA-Za-z0-9+/_-]")
#: Ends of these are in no secret, escape or base64 of a text or of what its escapes stand for.
_CUT = re.compile(rb"[\x00-\x09\x0b\x0c\x0e-\x1f!$()*,<>?@\[\]^`|~\x7f]|[\x80-\xff](?=[\x00-\x7f\xc0-\xff])|(?<=[a-z]{3})\x20(?=[A-Za-z0-9])")
_PART = 1 << 16

SCHEMA = "doc_id long, found array<struct<kind:string,start:int,end:int,base:boolean,via:string,value:string>>"


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost and non-overlapping per kind."""
    low = text.encode("utf-8", "surrogatepass").lower()
    found = []
    if any(h in low for h in _HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if b"akia" in low:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


class Layer:
    """A text whose character i comes from characters spans[i] of the original (None: itself; a
    tuple: every character from that one span)."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | tuple[int, int] | None, via: str):
        self.text, self.spans, self.via = text, spans, via

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.spans, tuple):
            return self.spans
        if self.spans is None or start >= end:
            return start, end
        return min(s for s, _ in self.spans[start:end]), max(e for _, e in self.spans[start:end])


def _rewritten(layer: Layer, pattern: re.Pattern, decode, via: str) -> Layer | None:
    """The layer with every match replaced by (character, its place in the match) pairs."""
    text, spans, at = [], [], 0
    for m in pattern.finditer(layer.text):
        pairs = decode(m[0])
        if pairs is None:
            continue
        text.append(layer.text[at : m.start()])
        spans += [layer.origin(i, i + 1) for i in range(at, m.start())]
        for char, a, b in pairs:
            text.append(char)
            spans.append(layer.origin(m.start() + a, m.start() + b))
        at = m.end()
    if not text:
        return None
    text.append(layer.text[at:])
    spans += [layer.origin(i, i + 1) for i in range(at, len(layer.text))]
    return Layer("".join(text), layer.spans if isinstance(layer.spans, tuple) else spans, f"{layer.via}>{via}" if layer.via else via)


def _url(run: str):
    out, at = [], 0
    for c in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        n = 3 * len(c.encode("utf-8", "surrogateescape"))
        out.append((c, at, at + n))
        at += n
    return out


def _unicode(run: str):
    if run[0] == "\\" and run[1] not in "ux01234567":
        return [(_PLAIN.get(run[1], run[1]), 0, len(run))]
    digits = run.strip("\\uxX&#;{}")
    code = int(digits, 16 if run[:2] in ("\\u", "\\x") or run[2] in "xX" else 8 if run[0] == "\\" else 10)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), 0, len(run))]


class _Unpacker:
    """One packed member: ``take`` gives a bounded part of what it holds; ``rest`` is what wasn't used."""

    def __init__(self, head: bytes, bare: bool = False):
        kind = bz2.BZ2Decompressor if head[:3] == b"BZh" else lzma.LZMADecompressor if head[:6] == b"\xfd7zXZ\x00" else None
        self.own = zlib.decompressobj(-15 if bare else 47) if kind is None else kind()
        self.zlib, self.rest, self.waits = kind is None, b"", False

    def take(self, data: bytes) -> bytes:
        try:
            out = self.own.decompress(data, _PART)
        except (OSError, EOFError, lzma.LZMAError) as e:
            raise zlib.error(str(e)) from e
        self.rest = self.own.unused_data if self.own.eof else self.own.unconsumed_tail if self.zlib else b""
        self.waits = not self.zlib and not self.own.eof and not self.own.needs_input  # more to come of what it took
        return out

    @property
    def eof(self) -> bool:
        return self.own.eof


def _packed(data: bytes) -> bool:
    """Whether gzip, zlib, bzip2 or xz data begins here, as far as its first part shows."""
    zlib_head = len(data) > 2 and data[0] & 15 == 8 and data[0] < 0x80 and int.from_bytes(data[:2], "big") % 31 == 0
    if not zlib_head and data[:2] != b"\x1f\x8b" and data[:3] != b"BZh" and data[:6] != b"\xfd7zXZ\x00":
        return False
    try:
        _Unpacker(data).take(data[:_PART])
    except zlib.error:
        return False
    return True


def _bare(data: bytes) -> bool:
    """Whether this is deflate data without a head: it must unpack without a fault, to what is worth a look or mostly printable."""
    try:
        unpack = zlib.decompressobj(-15)
        out = unpack.decompress(data[:_PART], _PART)
    except zlib.error:
        return False
    whole = unpack.eof or unpack.unconsumed_tail or len(data) > _PART
    shown = sum(32 <= c < 127 or c in b"\t\n\r" for c in out[:256])
    return len(out) >= 12 and bool(whole) and (_WORTH.search(out) is not None or 4 * shown > 3 * len(out[:256]))


def _parts(data: bytes):
    return (data[i : i + _PART] for i in range(0, len(data), _PART))


def _inflated(parts, size: list[int] | None = None, bare: bool = False):
    """What all packed members unpack to, in small parts, then what lies behind them.

    A fault ends it. ``size`` gets the number of bytes that the members take.
    """
    held, unpack, read = b"", None, 0
    parts = iter(parts)
    for part in parts:
        held, read = held + part, read + len(part)
        while held or unpack is not None and unpack.waits:
            if unpack is None:
                if not bare and not _packed(held):
                    yield b"\0" + held
                    yield from parts
                    return
                unpack, bare = _Unpacker(held, bare), False
            try:
                out = unpack.take(held)
            except zlib.error:
                return
            if out:
                yield out
            held = unpack.rest
            if size is not None:
                size[:] = [read - len(held)]
            if unpack.eof:
                unpack = None
    if unpack is not None and unpack.zlib:
        yield unpack.own.flush()


def _stream(data: bytes, bare: bool = False):
    """(parts of what packed data unpacks to, how many times it was packed)."""
    parts, depth, heads = _parts(data), 0, set()
    if bare:
        parts, depth = _inflated(parts, bare=True), 1
    head = next(parts, b"")
    while _packed(head) and head not in heads:
        heads.add(head)
        parts = _inflated(chain([head], parts))
        head, depth = next(parts, b""), depth + 1
    return chain([head], parts), depth


def _pieces(parts, room: int):
    """The parts joined to pieces of about ``room`` bytes, cut only where nothing is cut in two."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= room and (cuts := [m.end() for m in _CUT.finditer(part)]):
            yield b"".join(held[:-1]) + part[: cuts[-1]]
            held = [part[cuts[-1] :]]
            size = len(held[0])
    yield b"".join(held)


def _bytes(layer: Layer, lines: list[tuple[int, int]]) -> bytes:
    """What lines of base64 hold; a last character that completes no byte is left out."""
    run = "".join(layer.text[a:b] for a, b in lines).encode().translate(_STANDARD)
    run = run[: len(run) - (len(run) % 4 == 1)]
    return binascii.a2b_base64(run + b"=" * (-len(run) % 4))


def _plain(layer: Layer, lines: list[tuple[int, int]], data: bytes, via: str):
    """A layer of the data, whose byte b lies in the characters of its six-bit groups."""
    if _WORTH.search(data):
        at, spans, b = [i for line in lines for i in range(*line)], [], 0
        text = data.decode("utf-8", "surrogateescape")
        for c in text:
            n = len(c.encode("utf-8", "surrogateescape"))
            spans.append(layer.origin(at[b * 8 // 6], at[((b + n) * 8 - 1) // 6] + 1))
            b += n
        yield Layer(text, layer.spans if isinstance(layer.spans, tuple) else spans, via)
    for order, zeros in (("le", data[1:512:2]), ("be", data[:512:2])):
        if 3 * zeros.count(0) > len(zeros) > 7:  # mostly Latin letters in two bytes each
            at, spans, b = [i for line in lines for i in range(*line)], [], 0
            text = data[: len(data) // 2 * 2].decode(f"utf-16-{order}", "replace")
            for c in text:
                n = 4 if ord(c) > 0xFFFF else 2
                spans.append(layer.origin(at[min(b * 8 // 6, len(at) - 1)], at[min(((b + n) * 8 - 1) // 6, len(at) - 1)] + 1))
                b += n
            yield Layer(text, layer.spans if isinstance(layer.spans, tuple) else spans, f"{via}>utf16")


def _streamed(layer: Layer, data: bytes, span: tuple[int, int], via: str, room: int, bare: bool = False):
    """Layers of what packed data unpacks to, all of whose characters come from its run."""
    parts, depth = _stream(data, bare)
    whole = layer.origin(*span)
    for piece in _pieces(parts, room):
        if _WORTH.search(piece):
            yield Layer(piece.decode("utf-8", "surrogateescape"), whole, via + ">inflate" * depth)


def _unpacked(layer: Layer, room: int):
    """Layers of each base64 run: of its lines joined, from each place where that gives other bytes,
    and of each line alone."""
    via = f"{layer.via}>base64" if layer.via else "base64"
    for m in _BASE64.finditer(layer.text):
        lines = [x.span() for x in _LINE.finditer(layer.text, *m.span())]
        starts = list(accumulate((b - a for a, b in lines), initial=0))
        if starts[-1] < 16:
            continue
        joined, phases = {}, set()  # phase: line -> bytes from there on
        for i, (a, b) in enumerate(lines):
            alone = len(lines) == 1
            if (phase := starts[i] % 4) not in phases and starts[-1] - starts[i] >= 16:
                phases.add(phase)
                joined[phase] = starts[i], _bytes(layer, lines[i:])
                if not alone:
                    yield from _plain(layer, lines[i:], joined[phase][1], via)
                    if i == 0 and _bare(joined[phase][1]):
                        yield from _streamed(layer, joined[phase][1], m.span(), via, room, True)
            taken = False
            if phase in joined and layer.text[a] in _HEADS:  # how packed data begins
                since, data = joined[phase]
                at = (starts[i] - since) // 4 * 3
                if taken := _packed(data[at : at + _PART]):
                    data = data[at:]
                    last = len(lines) - 1
                    if not alone:  # the run ends with the line where the members end
                        size = [0]
                        for _ in _inflated(_parts(data), size):
                            pass
                        last = next(j for j in range(i, len(lines)) if (starts[j + 1] - starts[i]) * 6 // 8 >= size[0])
                    end = m.end() if last == len(lines) - 1 else lines[last][1]
                    yield from _streamed(layer, data[: (starts[last + 1] - starts[i]) * 6 // 8], (a, end), via, room)
            if not taken and b - a >= 16:
                data = _bytes(layer, [(a, b)])
                end = m.end() if i == len(lines) - 1 else b
                if _packed(data):
                    yield from _streamed(layer, data, (a, end), via, room)
                    continue
                yield from _plain(layer, [(a, b)], data, via)
                if _bare(data):
                    yield from _streamed(layer, data, (a, end), via, room, True)
                # the run may be glued to what stands before it: a path, a name, a word
                for shift in (1, 2, 3):
                    yield from _plain(layer, [(a + shift, b)], _bytes(layer, [(a + shift, b)]), via)
                for head in _GLUED.finditer(layer.text, a + 1, b):
                    at = head.start()
                    if b - at >= 16 and _packed(_bytes(layer, [(at, min(b, at + 4096))])):
                        yield from _streamed(layer, _bytes(layer, [(at, b)]), (at, end), via, room)


def _inner(layer: Layer, room: int):
    """The layers directly within a layer, made one at a time."""
    if "\\" in layer.text or "&#" in layer.text:
        if (x := _rewritten(layer, _UNICODE, _unicode, "unicode")) is not None:
            yield x
    if "%" in layer.text:
        if (x := _rewritten(layer, _URL, _url, "url")) is not None:
            yield x
    yield from _unpacked(layer, room)


def find_secrets(text: str, limit: int = 1 << 26) -> list[tuple[str, int, int, bool, str, str]]:
    """(kind, start, end, in the text itself, decodings, value), spans in the original, ordered."""
    base = scan(text)
    found = {(k, a, b): (True, "", text[a:b]) for k, a, b in base}
    work, seen = [iter([Layer(text, None, "")])], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.origin(0, len(layer.text))
        if mark in seen:
            continue
        seen.add(mark)
        if layer.via:
            for kind, a, b in scan(layer.text):
                found.setdefault((kind, *layer.origin(a, b)), (False, layer.via, layer.text[a:b]))
        work.append(_inner(layer, limit))
    order = sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*s, *found[s]) for s in order]


def _scan_batches(limit: int):
    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("via", pa.string()), ("value", pa.string())]))
        names = ("kind", "start", "end", "base", "via", "value")
        for batch in batches:
            for part in pieces(batch, rows=500):
                found = [[dict(zip(names, x)) for x in find_secrets(t or "", limit)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return run


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 26) -> DataFrame:
    """One row per input row: doc_id, found (kind, start, end, base, via, value), ordered by start.

    Positions are code points of the original text, end exclusive; ``base`` tells spans of the plain
    patterns from those that only a decoded layer shows, ``via`` names the decodings. A null or
    empty text has none; null or repeated ids are ordinary rows; extra columns are ignored; an empty
    table gives an empty result. Compressed runs are unpacked to their end, ``limit`` bytes in
    memory at a time, more only where one unbroken token is longer. One pass without a shuffle.
    """
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(_scan_batches(limit), SCHEMA)


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of the scan's rows."""
    shown = lambda only: F.array_join(F.transform(only, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
