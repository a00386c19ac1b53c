"""Secret scans: patterns on the text as it stands, and on every layer that nested encodings unwrap to.

A worklist holds layers of a text. Each is scanned, and everything in it that decodes (percent and Unicode escapes,
base64 runs, compressed data inside either) becomes a further layer, until nothing new turns up; a layer whose content
has been seen before at the same place of the document is not taken again, so cycles end and every copy is found. A layer knows how its positions map to the layer above, and spans found
in it are reported as positions in the document.

Defined cases: a null or empty text has no spans; repeated rows are each scanned; positions are code points, ends
exclusive. Compressed data is read to the end of its last member, in windows of about ``EXPAND_BYTES`` that overlap by a
quarter, so memory is bounded and no amount is left out; only a single encoded run or inner stream longer than the
overlap may be cut, where it stands within compressed data. Data that breaks off is scanned as far as it goes. A chain of
eight or more escapes of characters that begin escapes is one step, so long texts of them take time in proportion to their length.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import codecs
import hashlib
import html
import itertools
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, texts

KINDS = ("assign", "access", "hex")
EXPAND_BYTES = 32 << 20
READ_BYTES = 64 << 10
SLICE_BYTES = 8 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: An escape of a character that begins escapes, again and again: ``%252525``, ``&#38;#38;`` and the like.
_CHAIN = re.compile(r"[%&\\](?:2[56]|5[cC]|#(?:3[78]|92|[xX](?:2[56]|5[cC]));|u00(?:2[56]|5[cC])|x(?:2[56]|5[cC])){8,}")
#: What follows such a character in one step of a chain, and where the number of the next character stands in it.
_LINKS = {"%": re.compile(r"(2[56]|5[cC])"), "&": re.compile(r"#(3[78]|92|[xX](?:2[56]|5[cC]));"), "\\": re.compile(r"(?:u00|x)(2[56]|5[cC])")}
_ESCAPE = re.compile(_CHAIN.pattern + r"|(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
#: A run of base64 goes on over line breaks, also those spelled out in strings, with what indents the next line.
_BREAK = re.compile(r"[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*")
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]++(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)*+={{0,2}}")
#: The shortest secret has 14 characters, and in every encoding it is ASCII characters in a row; base64 makes 19 of 14.
_LEAST_RUN = 19
_SOME_TEXT = re.compile(rb"[\t\r\n -~]{14}")
#: The same in UTF-16 of either order of bytes: every other byte is 0.
_WIDE_TEXT = re.compile(rb"\0?(?:[\t\r\n -~]\0){13,}[\t\r\n -~]?")
_MAGIC: dict[bytes, Callable[[], object]] = {
    b"\x1f\x8b": lambda: zlib.decompressobj(47),
    b"x\x01": zlib.decompressobj,
    b"x\x5e": zlib.decompressobj,
    b"x\x9c": zlib.decompressobj,
    b"x\xda": zlib.decompressobj,
    b"BZh": bz2.BZ2Decompressor,
    b"\xfd7zXZ": lzma.LZMADecompressor,
}
_MAGICS = re.compile(b"|".join(map(re.escape, _MAGIC)))
_ZEROS = re.compile(b"\0*")
#: The same in a layer's text, where a byte that is not UTF-8 is a lone surrogate (x da may begin a valid character).
_PACKED = re.compile("\x1f\udc8b|x[\x01^\udc9c\udcda\u0680-\u06bf]|BZh|\udcfd7zXZ")
_LATIN = re.compile("[\0-\xff]+")
#: In strings with escapes of bytes, other escapes and (in forms) a plus for a space are bytes as well.
_BYTES = re.compile(r"\\(?:x|u00)[0189A-Fa-f][0-9A-Fa-f]")
_FORM_BYTES = re.compile(r"%[0189A-Fa-f][0-9A-Fa-f]")
_STRING = re.compile(_ESCAPE.pattern + r"|\\[0abfnrtv'\"\\/]")
_FORM = re.compile(_ESCAPE.pattern + r"|\+")
_SHORT = dict(zip("0abfnrtv'\"\\/", "\0\a\b\f\n\r\t\v'\"\\/"))

Span = tuple[int, int]
Up = Callable[[int, int], Span]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, rank of the kind) of the three patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found + [(m.start(), m.end(), 2) for m in _HEX.finditer(text)], key=lambda x: (x[0], x[2], x[1]))


def _parts(data: bytes, at: int, ends: list[int | None]) -> Iterator[bytes]:
    """What compressed data from ``at`` on holds, member after member; ``ends`` gets where each ends, None for one that breaks off."""
    view = memoryview(data)
    while k := _MAGICS.match(data, _ZEROS.match(data, at).end() if ends else at):
        one, read, feed = _MAGIC[k.group()](), k.start(), b""
        try:
            while not one.eof:
                if not feed and getattr(one, "needs_input", True):
                    feed = view[read : read + READ_BYTES]
                    read += len(feed)
                    if not feed:
                        if hasattr(one, "flush"):
                            yield one.flush()
                        break
                part = one.decompress(feed, min(1 << 20, EXPAND_BYTES // 4))
                feed = getattr(one, "unconsumed_tail", b"")
                yield part
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            pass
        if not one.eof:
            ends.append(None)
            return
        at = read - len(one.unused_data)
        ends.append(at)


def _windows(parts: Iterator[bytes]) -> Iterator[str]:
    """The text of all parts, in windows of bounded size that overlap."""
    decode = codecs.getincrementaldecoder("utf-8")("surrogateescape").decode
    held, size, new = [], 0, 0
    for text in itertools.chain(map(decode, parts), [None]):
        text = decode(b"", True) if text is None else text
        held.append(text)
        size, new = size + len(text), new + len(text)
        if size >= EXPAND_BYTES:
            yield (whole := "".join(held))
            held, new = [whole[-(EXPAND_BYTES // 4) :]], 0
            size = len(held[0])
    if new:
        yield "".join(held)


def _unpacked(data: bytes) -> Iterator[tuple[int, int, Iterator[str]]]:
    """(start, end, text in windows) of everything compressed in ``data``."""
    at = 0
    while k := _MAGICS.search(data, at):
        ends: list[int | None] = []
        at = k.start() + 1
        if sum(map(len, _parts(data, k.start(), ends))):
            yield k.start(), ends[-1] or len(data), _windows(_parts(data, k.start(), []))
            at = max([at, *filter(None, ends)])


def _as_text(data: bytes) -> str:
    """The text of any bytes; those that are not UTF-8 become a character each, which ``_offsets`` counts as one byte."""
    return data.decode("utf-8", "surrogateescape")


def _offsets(text: str) -> range | np.ndarray:
    """Where each character of ``_as_text`` begins in the bytes, and where the last one ends."""
    if text.isascii():
        return range(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = np.ones(len(code) + 1, np.int8)
    width[0] = 0
    for least in (0x80, 0x800, 0x10000):
        width[1:] += code >= least
    width[1:][(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return np.cumsum(width, dtype=np.int64)


def _end_of_chain(unit: str) -> str:
    """All steps of a chain of escapes at once, in one pass, however many levels it has."""
    head, at = unit[0], 1
    while link := _LINKS[head].match(unit, at):
        code = link.group(1)
        head = chr(int(code) if head == "&" and code.isdigit() else int(code.lstrip("xX"), 16))
        at = link.end()
    return head + unit[at:]


def _unescaped(unit: str) -> str:
    """The text of a run of escapes; bytes that are not text stay apart as in ``_as_text``."""
    if _CHAIN.fullmatch(unit):
        return _end_of_chain(unit)
    if unit == "+":
        return " "
    if unit[0] == "%":
        return _as_text(bytes.fromhex(unit.replace("%", "")))
    if unit[0] == "&":
        return html.unescape(unit)
    if unit[1] == "x":
        return _as_text(bytes.fromhex(unit.replace("\\x", "")))
    if unit[1] == "u":
        return bytes.fromhex(unit.replace("\\u", "")).decode("utf-16-be", "replace")
    return _SHORT[unit[1]]


def _replaced(text: str, escape: re.Pattern = _ESCAPE) -> Iterator[tuple[str, Up]]:
    """The whole layer with its escapes undone."""
    parts, at, shown = [], 0, 0
    from_, to, begin, end = [], [], [], []
    for m in escape.finditer(text):
        plain = _unescaped(m.group())
        parts += [text[at : m.start()], plain]
        shown += m.start() - at
        from_.append(shown), begin.append(m.start())
        shown += len(plain)
        to.append(shown), end.append(m.end())
        at = m.end()
    if not from_:
        return
    parts.append(text[at:])
    #: A run of escapes of equal width that decode to one character each maps character by character.
    even = [(b - a) // (t - f) if t > f and (b - a) % (t - f) == 0 and text[a] in "%\\" and not _CHAIN.match(text, a) else 0 for f, t, a, b in zip(from_, to, begin, end)]

    def up(s: int, e: int) -> Span:
        i = bisect.bisect_right(from_, s) - 1
        if i < 0:
            start = s
        elif s < to[i]:
            start = begin[i] + (s - from_[i]) * even[i]
        else:
            start = end[i] + s - to[i]
        i = bisect.bisect_right(from_, e - 1) - 1
        if i < 0:
            return start, e
        if e - 1 < to[i]:
            return start, begin[i] + (e - from_[i]) * even[i] if even[i] else end[i]
        return start, end[i] + e - to[i]

    yield "".join(parts), up


def _base64_layers(text: str) -> Iterator[tuple[str, Up]]:
    """What runs of base64 characters decode to. Letters, digits, ``/ - _ +`` and short lines before the data belong to
    the run, so it is decoded from each of its first four characters: one of them is in step with any data in it."""
    for m in _BASE64.finditer(text):
        if m.end() - m.start() < _LEAST_RUN:
            continue
        pieces, starts, places, at, size = [], [], [], m.start(), 0
        for start, end in (*(k.span() for k in _BREAK.finditer(text, m.start(), m.end())), (m.end(), m.end())):
            pieces.append(text[at:start].rstrip("="))
            starts.append(size), places.append(at)
            size += len(pieces[-1])
            at = end
        run = "".join(pieces).replace("-", "+").replace("_", "/")

        def place(j: int, starts=starts, places=places) -> int:
            i = bisect.bisect_right(starts, j) - 1
            return places[i] + j - starts[i]

        for skip in range(4):
            if size - skip < _LEAST_RUN:
                break
            part = run[skip : size - ((size - skip) % 4 == 1)]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))

            def up(s: int, e: int, skip=skip, last=size - 1, place=place) -> Span:
                """Places of the bytes from s to e in the text."""
                return place(skip + s * 4 // 3), place(min(last, skip + (e - 1) * 4 // 3 + 1)) + 1

            if _SOME_TEXT.search(data) or _MAGICS.search(data):
                plain = _as_text(data)
                yield plain, lambda s, e, at=_offsets(plain), up=up: up(int(at[s]), int(at[e]))
            for wide in _WIDE_TEXT.finditer(data) if b"\0" in data else ():
                # A run that begins with 0 may be of the order that ends with a character; in the other one its zero comes last.
                first = wide.start() + (data[wide.start()] == 0)
                plain = data[first : wide.end() if first > wide.start() else wide.end() - (data[wide.end() - 1] != 0) : 2].decode("ascii")
                yield plain, lambda s, e, first=first, up=up: up(first + 2 * s, first + 2 * e - 1)


def _packed_layers(text: str) -> Iterator[tuple[str, Up]]:
    """What compressed data in a layer holds, whether its bytes are the layer's own or stand as characters up to U+00FF."""
    if k := _PACKED.search(text):
        data = text[k.start() :].encode("utf-8", "surrogateescape")
        for first, last, found in _unpacked(data):
            a, b = (min(len(text), k.start() + len(_as_text(data[:x]))) for x in (first, last))
            for inner in found:
                yield inner, lambda s, e, a=a, b=b: (a, b)
    if not text.isascii():
        for k in _LATIN.finditer(text):
            if not k.group().isascii():
                for first, last, found in _unpacked(k.group().encode("latin-1")):
                    for inner in found:
                        yield inner, lambda s, e, a=k.start() + first, b=k.start() + last: (a, b)


def _layers(text: str) -> Iterator[tuple[str, Up]]:
    yield from _replaced(text)
    if _BYTES.search(text):
        yield from _replaced(text, _STRING)
    if "+" in text and _FORM_BYTES.search(text):
        yield from _replaced(text, _FORM)
    yield from _base64_layers(text)
    yield from _packed_layers(text)


def _in_document(path: tuple[Up, ...], s: int, e: int) -> Span:
    for up in path:
        s, e = up(s, e)
    return s, e


def _key(layer: str, start: int, end: int) -> tuple[str | bytes, int, int]:
    """What a layer holds (long ones by a digest) and where it stands in the document."""
    return layer if len(layer) < 64 else hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), start, end


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): those of the text itself, and with those of every layer, as positions in the text."""
    base = base_spans(text)
    every, seen, work = set(base), {_key(text, 0, len(text))}, [(_layers(text), ())]
    while work:
        inners, ups = work[-1]
        inner, up = next(inners, (None, None))
        if up is None:
            work.pop()
            continue
        if not inner:
            continue
        path = (up, *ups)
        key = _key(inner, *_in_document(path, 0, len(inner)))
        if key in seen:
            continue
        seen.add(key)
        every.update((*_in_document(path, s, e), kind) for s, e, kind in base_spans(inner))
        work.append((_layers(inner), path))
    return base, sorted(every, key=lambda x: (x[0], x[2], x[1]))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _listed(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with ``base`` (spans in the text itself) and ``spans`` (those and all that layers add)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE_BYTES):
            found = [all_spans(x) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([_listed(f[i]) for f in found], _SPAN_TYPE) for i in (0, 1))], names=["id", "base", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, base {_SPANS}, spans {_SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The same rows and columns; secrets in ``text_col`` are replaced by their kind. Clean texts stay as they are.

    ``count_col`` names a column with the number of characters, which is set anew in the rows that change.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_col, SLICE_BYTES):
            at, found, changed = batch.schema.get_field_index(text_col), [], []
            for text in batch.column(at).to_pylist():
                spans = all_spans(text)[1] if text else []
                found.append(redacted(text, spans) if spans else text)
                changed.append(bool(spans))
            batch = batch.set_column(at, text_col, pa.array(found, pa.string()))
            if count_col in batch.schema.names:
                k = batch.schema.get_field_index(count_col)
                counts = [len(t) if c else n for t, c, n in zip(found, changed, batch.column(k).to_pylist())]
                batch = batch.set_column(k, count_col, pa.array(counts, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(clean, docs.schema)
