"""Secret scan: base patterns, and a worklist that unwraps encoded layers and scans each of them.

A layer is a text with a map from its spans to spans of the layer it was
found in. Layers come from URL or Unicode escapes, undone in the whole text, and
from long base64 runs, also over wrapped lines, whose bytes may be compressed. A layer equal to one of those it
came from ends there (a cycle); one equal to a layer done before is not scanned again, its spans are mapped to the new
place; otherwise unwrapping goes on until nothing decodes. Spans are in code points of the document's own text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import by_slices

#: The base kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Every access key and hex run of full length lies in such a run, and so does base64.
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Such runs parted by single line ends (MIME, PEM); the last line may be short.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]*={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Bytes that are not UTF-8 as a whole are a layer if they hold such a run: no secret is shorter.
RUN = re.compile(rb"[\x20-\x7e]{16,}")
#: One character each: what is no UTF-8 beside it stays as it stands.
PERCENT = re.compile(r"%(?:[0-7][0-9A-F]|[CD][0-9A-F]%[89AB][0-9A-F]|E[0-9A-F](?:%[89AB][0-9A-F]){2}|F[0-7](?:%[89AB][0-9A-F]){3})", re.I)
ESCAPE = re.compile(r"\\u([dD][89abAB]X{2})\\u([dD][c-fC-F]X{2})|\\u\{(X{1,6})\}|\\u(X{4})|\\U(X{8})|\\x(X{2})|&#x(X{1,6});|&#([0-9]{1,7});".replace("X", "[0-9A-Fa-f]"))
#: A layer that inflates to more is scanned in chunks of so many bytes that share OVERLAP, one at a time, and counted in n_cut.
MAX_LAYER, OVERLAP = 16 << 20, 1 << 20
#: Characters of layers that are read of one document at most; only nested compression bombs have more. Layers beyond it are counted in n_left.
MAX_WORK = 1 << 30
#: Memory that a compressed stream's dictionary may ask for (that of xz -9 is half of it); one that asks for more is not read and counted in n_left.
MAX_DICTIONARY = 128 << 20
#: Kind of a place whose inside was not read.
UNREAD = "unread"

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base kinds' spans, by start and kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    for run in LONG.finditer(text):
        out += [("access", run.start() + m.start(), run.start() + m.end()) for m in ACCESS.finditer(run[0]) if len(m[0]) >= 18]
        out += [("hex", run.start() + m.start(), run.start() + m.end()) for m in HEX.finditer(run[0]) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _text(data: bytes) -> str | None:
    """The bytes as text, if they are UTF-8 or hold a run of it; a byte that is no part of a character stands for itself."""
    try:
        return data.decode("utf-8") or None
    except UnicodeDecodeError:
        return data.decode("utf-8", "surrogateescape") if RUN.search(data) else None


def _inflated(data: bytes) -> Iterator[tuple[bytes | None, bool]]:
    """The inflated bytes, in overlapping chunks, and whether there is more than one; nothing if the bytes are not compressed. A broken stream ends where it breaks; None for what asks for a dictionary over MAX_DICTIONARY."""
    make = (lambda: zlib.decompressobj(47)) if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and int.from_bytes(data[:2], "big") % 31 == 0 else bz2.BZ2Decompressor if data[:3] == b"BZh" else (lambda: lzma.LZMADecompressor(memlimit=MAX_DICTIONARY)) if data[:6] == b"\xfd7zXZ\0" else None
    if make is None:
        return
    head, made, held, chunks = data[:2], make(), b"", 0
    while True:
        try:
            got = made.decompress(data, MAX_LAYER)
        except lzma.LZMAError as error:
            if "limit" in str(error).lower():
                yield None, False
            break
        except (zlib.error, OSError, EOFError):
            break
        held += got
        if made.eof:
            if (data := made.unused_data)[:2] != head:  # else a further member of the stream
                break
            made = make()
        elif hasattr(made, "unconsumed_tail"):
            data = made.unconsumed_tail
            if not got and not data:
                break
        else:
            data = b""
            if made.needs_input and not got:
                break
        if len(held) > MAX_LAYER:
            yield held[:MAX_LAYER], True
            held, chunks = held[MAX_LAYER - OVERLAP :], chunks + 1
    if held:
        yield held, chunks > 0


def _replaced(text: str, pattern: re.Pattern, value: Callable[[re.Match], str | None]) -> tuple[str, Callable[[int, int], tuple[int, int]]] | None:
    """The text with matches replaced, and the map of spans of the result to spans of the text."""
    out, begins, places, at, size = [], [], [], 0, 0
    for m in pattern.finditer(text):
        got = value(m)
        if got is None:
            continue
        out += [text[at : m.start()], got]
        begins.append(size + m.start() - at)
        places.append((m.start(), m.end(), len(got)))
        size += m.start() - at + len(got)
        at = m.end()
    if not at:
        return None

    def back(i: int) -> int:
        if (k := bisect_right(begins, i) - 1) < 0:
            return i
        start, end, n = places[k]
        i -= begins[k]
        return start + i * (end - start) // n if i < n else end + i - n

    return "".join([*out, text[at:]]), lambda s, e: (back(s), back(e))


def _url(m: re.Match) -> str | None:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _unicode(m: re.Match) -> str | None:
    if m[1]:
        return chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00)
    code = int(m[8]) if m[8] else int(next(g for g in m.groups() if g), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _bytes_before(layer: str) -> Callable[[int], int]:
    """The number of UTF-8 bytes before a place of the layer; counted once, when first asked for."""
    if layer.isascii():
        return lambda i: i
    counts: list[np.ndarray] = []

    def before(i: int) -> int:
        if not counts:
            codes = np.frombuffer(layer.encode("utf-32-le", "surrogatepass"), "<u4")
            wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            wide[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1  # a byte that stands for itself
            counts.append(np.concatenate(([0], np.cumsum(wide))))
        return int(counts[0][i])

    return before


def unwrapped(text: str) -> Iterator[tuple[str, str | None, Callable[[int, int], tuple[int, int]], bool]]:
    """Layers directly inside a text: encoding, layer (None: not read), map of spans to the text's, whether it was cut."""
    for name, marks, pattern, value in (("url", ("%",), PERCENT, _url), ("unicode", ("\\", "&#"), ESCAPE, _unicode)):
        if any(mark in text for mark in marks) and (got := _replaced(text, pattern, value)):
            yield name, *got, False
    for pattern in (WRAPPED, LONG) if "\n" in text else (LONG,):
        for run in pattern.finditer(text):
            lines = [(m.start() + run.start(), m[0]) for m in LINE.finditer(run[0])]
            raw = "".join(x for _, x in lines).rstrip("=").replace("-", "+").replace("_", "/")
            if len(raw) % 4 == 1:
                raw = raw[:-1]
            try:
                data = base64.b64decode(raw + "=" * (-len(raw) % 4))
            except (binascii.Error, ValueError):
                continue
            packed = False
            for part, short in _inflated(data):
                packed = True
                if part is None or (layer := _text(part)) is not None:
                    layer = None if part is None else layer
                    yield "base64+compressed", layer, (lambda s, e, run=run: run.span()), short
            if not packed and (layer := _text(data)) is not None:
                begins = list(accumulate((len(x) for _, x in lines[:-1]), initial=0))

                def to(s: int, e: int, before: Callable[[int], int] = _bytes_before(layer), lines: list = lines, begins: list = begins) -> tuple[int, int]:
                    a, b = before(s), before(e)
                    place = lambda i: lines[k := bisect_right(begins, i) - 1][0] + i - begins[k]
                    return place(a * 8 // 6), place(-(-b * 8 // 6) - 1) + 1

                yield "base64", layer, to, False


class Layer:
    """A layer on the worklist: what is still to unwrap in it, and the spans seen in it and below: (base kind, start, end) to encodings."""

    def __init__(self, text: str, name: str, to: Callable | None):
        self.name, self.to, self.left = name, to, unwrapped(text)
        self.key = digest(text)
        self.spans: dict[Span, tuple[str, ...]] = {s: () for s in base_spans(text)}

    def take(self, name: str, to: Callable, spans: dict[Span, tuple[str, ...]]) -> None:
        """Spans of a layer found in this one; of two ways to one span the shorter chain of encodings counts, then the first by name."""
        for (kind, s, e), names in spans.items():
            span, chain = (kind, *to(s, e)), (name, *names)
            old = self.spans.get(span)
            if old is None or (len(chain), chain) < (len(old), old):
                self.spans[span] = chain


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan_text(text: str) -> tuple[list[Span], list[Span], int, int, int]:
    """Base spans, spans found in layers (kind: encodings joined by '+', '.', base kind), layers read, layers in chunks, layers left.

    The place of a layer that is left is a span of kind ``unread``, so that what masks spans masks it whole. A span that the text itself shows is not given again. The worklist goes deepest first, so that of a layer that inflates in
    chunks one is done before the next is made; layers that are equal are read once.
    """
    top = Layer(text, "", None)
    work, open_, done = [top], {top.key}, {}
    layers = cut = left = size = 0
    while work:
        at = work[-1]
        found = next(at.left, None)
        if found is None:
            work.pop()
            open_.discard(at.key)
            if work:
                done[at.key] = at.spans
                work[-1].take(at.name, at.to, at.spans)
            continue
        name, layer, to, short = found
        if layer is None:
            left += 1
            at.take(name, to, {(UNREAD, 0, 0): ()})
            continue
        key = digest(layer)
        if key in open_:
            continue
        if key in done:
            at.take(name, to, done[key])
            continue
        if size + len(layer) > MAX_WORK:
            left += 1
            at.take(name, to, {(UNREAD, 0, len(layer)): ()})
            continue
        layers, cut, size = layers + 1, cut + short, size + len(layer)
        work.append(Layer(layer, name, to))
        open_.add(key)
    base = [s for s, names in top.spans.items() if not names]
    more = [(f"{'+'.join(names)}.{kind}", s, e) for (kind, s, e), names in top.spans.items() if names]
    return base, sorted(more, key=lambda s: (s[1], s[0], s[2])), layers, cut, left


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span], mask: str) -> str:
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", mask: str | None = None) -> DataFrame:
    """Secrets of every whole text.

    Returns key, n_assign, n_access, n_hex, base_sha256 (of the base spans,
    joined), spans (base ones and those of unwrapped layers, by start, then
    kind), n_layers (different ones), n_cut (chunks of layers over MAX_LAYER when inflated), n_left (layers not read, as
    the document's layers have over MAX_WORK characters or a stream asks for over MAX_DICTIONARY; each place is in spans, as ``unread``); with ``mask``
    also redacted: the text with every span replaced (null stays null). Null
    text: as empty: no spans. Repeated rows give equal rows, an empty table an
    empty one, other columns are left out. No shuffle.
    """
    kept = docs.select(key, text)
    schema = f"`{key}` {kept.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_cut long, n_left long" + ", redacted string" * (mask is not None)

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for x in part.column(1).to_pylist():
                base, more, *numbers = scan_text(x or "")
                count = {k: sum(s[0] == k for s in base) for k in KINDS}
                every = sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else 3, s[0], s[2]))
                rows.append((*count.values(), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), *numbers, *([None if x is None else redacted(x, every, mask)] if mask is not None else [])))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.string()] * (mask is not None)
            names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_cut", "n_left"] + ["redacted"] * (mask is not None)
            return pa.RecordBatch.from_arrays([part.column(0)] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        return run

    return kept.mapInArrow(by_slices(make), schema)


def masked(docs: DataFrame, mask: str, text: str = "text") -> DataFrame:
    """The documents, all columns, with every span that scan() finds replaced by ``mask``, places of layers that were not read (``unread``) too; null texts stay null."""

    def make():
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for x in part.column(text).to_pylist():
                base, more, *_ = scan_text(x or "")
                out.append(redacted(x, base + more, mask) if base or more else x)
            at = part.schema.get_field_index(text)
            return part.set_column(at, text, pa.array(out, pa.string()))

        return run

    return docs.mapInArrow(by_slices(make), docs.schema)
