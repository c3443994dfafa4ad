"""Secret scans with a recursive decoding worklist.

A text is the first layer. A layer is scanned with the base patterns; then its URL escapes,
Unicode escapes, base64 runs and compressed payloads are unwrapped, and every layer that this
makes joins the worklist, compressed payloads included, until none is new. A layer's digest, with
its place, tells whether it was seen, so that cycles and commuting decoders end. Every layer carries a map of its
characters to those of the text, so that what is found in it has a span there.

Positions are code points, ends exclusive. Null text counts as empty and has no spans. Whole
texts are scanned, however long. A compressed payload is unpacked member by member and frame by
frame. What it holds is scanned as one text, or, if it is larger than BLOCK bytes, in blocks that
overlap by OVERLAP, of which one at a time is held; a payload within a payload is unpacked from its
parts, so only the innermost content is cut into blocks, at any depth. Payloads may grow a
thousandfold with each layer, so a document that has unpacked to MAX_UNPACKED bytes is not unpacked
further: the one bound, and n_refused counts the payloads that it leaves. Spans that start alike are
listed by kind, then by end. Repeated rows are scanned each for itself; empty tables give empty
results; extra columns, whatever their names, are unread.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import documents

#: Base kinds, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Least length of the value of an assignment, and of an access key.
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: Bytes of a block of an unpacked payload, and how much of a block the next one repeats.
BLOCK, OVERLAP = 16 << 20, 1 << 16
#: Bytes that the payloads of one document may unpack to, together.
MAX_UNPACKED = 4 << 30
#: Printable bytes in a row that decoded bytes need in order to be a layer: what a secret or a
#: further layer takes at least.
LEAST_PRINTS = 14

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|((?:\\u[0-9A-Fa-f]{4})+)|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 that an encoder has wrapped.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{60,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{4,}={0,2})+")
_LINE_END = re.compile(r"\r?\n[ \t]*")
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
_MAGIC_AT = re.compile(b"|".join(map(re.escape, _MAGIC)))
_PRINTS = bytes([9, 10, 13, *range(32, 127)])
_PRINTED = re.compile(rb"[\t\n\r\x20-\x7e]{%d}" % LEAST_PRINTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text and, as pieces (own start, own end, root start, root end, step), where its
    characters come from: step n > 0 means n root characters for each own one; 0 means that
    all own characters of the piece come from the whole root span."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int, int]], depth: int):
        self.text, self.pieces, self.depth = text, pieces, depth

    def root(self, start: int, end: int) -> tuple[int, int]:
        import bisect

        def at(i: int, right: bool) -> int:
            k = max(0, bisect.bisect_right(self.pieces, (i, float("inf"))) - 1)
            a, _, ra, rb, step = self.pieces[k]
            if not step:
                return rb if right else ra
            return ra + (i - a + right) * step

        return at(start, False), at(end - 1, True)


def _replaced(layer: Layer, edits: list[tuple[int, int, str]]) -> Layer:
    """The layer with spans of it replaced by decoded text."""
    out, pieces, at, own, first = [], [], 0, 0, 0

    def keep(a: int, b: int) -> None:  # spans come in order, so pieces before `first` are done with
        nonlocal own, first
        if a < b:
            out.append(layer.text[a:b])
            while layer.pieces[first][1] <= a:
                first += 1
            for k in range(first, len(layer.pieces)):
                x, y, rx, ry, step = layer.pieces[k]
                if x >= b:
                    break
                lo, hi, first = max(a, x), min(b, y), k
                r = (rx + (lo - x) * step, rx + (hi - x) * step) if step else (rx, ry)
                pieces.append((own, own + hi - lo, *r, step))
                own += hi - lo

    for a, b, text in edits:
        keep(at, a)
        if text:
            out.append(text)
            pieces.append((own, own + len(text), *layer.root(a, b), 0))
            own += len(text)
        at = b
    keep(at, len(layer.text))
    return Layer("".join(out), pieces, layer.depth + 1)


class Budget:
    """Bytes that a document may still unpack, and the payloads that were refused for that."""

    def __init__(self, left: int | None = None):
        self.left, self.refused = MAX_UNPACKED if left is None else left, 0


class Packed:
    """A compressed payload, as bytes or in parts, and the span of the text that it comes from."""

    def __init__(self, data: bytes | Iterator[bytes], place: tuple[int, int], depth: int):
        self.data, self.place, self.depth = data, place, depth


class _Reader:
    """What a decompressor that wants a file reads from."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def read(self, size: int) -> bytes:
        if not self.held:
            self.held = next(self.parts, b"")
        out, self.held = self.held[:size], self.held[size:]
        return out


def _stream(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The content of all members or frames of a compressed payload, in parts of `size` bytes at
    most. Ends where the data end, or are not such a payload (any more)."""
    data = b""
    while True:
        while len(data) < 6 and (more := next(parts, b"")):
            data += more
        if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78":
            d = zlib.decompressobj(47)
            while not d.eof:
                data = data or next(parts, b"")
                out = d.decompress(data, size)
                ended, data = not data and not out, d.unconsumed_tail
                yield out
                if ended:
                    break
        elif data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\x00":
            d = bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor()
            while not d.eof:
                if d.needs_input and not (data := data or next(parts, b"")):
                    break
                out = d.decompress(data, size)
                data = b""
                yield out
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(_Reader(itertools.chain([data], parts)), read_across_frames=True) as reader:
                while part := reader.read(size):
                    yield part
            return
        else:
            return
        if not d.eof:
            return
        data = d.unused_data + data


def _safe(parts: Iterator[bytes]) -> Iterator[bytes]:
    """parts, up to the first that is broken."""
    import zstandard

    try:
        yield from parts
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):
        return


def _opens(data: bytes) -> bool:
    """Whether bytes are a compressed payload, at least at their beginning."""
    return data.startswith(_MAGIC) and any(_safe(_stream(iter([data]), 1 << 12)))


def _unpacked(packed: Packed, budget: Budget) -> Iterator["Layer | Packed"]:
    """What a payload holds: a payload again, or texts: one, or overlapping blocks, each made when it is
    asked for, so that one at a time is held. A payload that breaks off gives what can be read of it."""

    def counted() -> Iterator[bytes]:
        if budget.left <= 0:
            budget.refused += 1
            return
        for part in _safe(_stream(iter([packed.data]) if isinstance(packed.data, bytes) else packed.data, BLOCK)):
            yield part
            budget.left -= len(part)
            if budget.left <= 0:
                budget.refused += 1
                return

    def layer(block: bytes) -> Layer:
        try:
            text = block.decode()
        except UnicodeDecodeError:
            text = block.decode("latin-1")
        return Layer(text, [(0, len(text), *packed.place, 0)], packed.depth)

    parts, held = counted(), b""
    while len(held) <= BLOCK + OVERLAP and (part := next(parts, None)) is not None:
        held += part
    if _opens(held):
        whole = len(held) <= BLOCK + OVERLAP
        yield Packed(held if whole else itertools.chain([held], parts), packed.place, packed.depth + 1)
        return
    while held:
        yield layer(held[: BLOCK + OVERLAP])
        if len(held) <= BLOCK + OVERLAP:
            return
        held = held[BLOCK:]
        while len(held) <= BLOCK + OVERLAP and (part := next(parts, None)) is not None:
            held += part


def _text(data: bytes) -> str:
    """Decoded bytes as a text; empty if they are none."""
    if data.isascii():
        return "" if data.translate(None, _PRINTS) else data.decode()
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return ""
    return text if all(c.isprintable() or c in "\t\r\n" for c in text) else ""


def _url(layer: Layer) -> Iterator[Layer | Packed]:
    if "%" not in layer.text:
        return
    edits = []
    for m in PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        if _opens(data):
            yield Packed(data, layer.root(*m.span()), layer.depth + 1)
            continue
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        at = m.start()
        for c in text:
            n = 3 * len(c.encode())
            edits.append((at, at + n, c))
            at += n
    if edits:
        yield _replaced(layer, edits)


def _unicode(layer: Layer) -> list[Layer]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return []
    edits = []
    for m in UNICODE.finditer(layer.text):
        if m[3]:
            units = bytes.fromhex(m[3].replace("\\u", ""))
            text = units.decode("utf-16-be", "surrogatepass")
            at = m.start()
            for c in text:
                n = 12 if ord(c) > 0xFFFF else 6
                if not 0xD800 <= ord(c) < 0xE000:
                    edits.append((at, at + n, c))
                at += n
            continue
        code = int(m[1] or m[2] or m[4] or m[5] or m[6], 10 if m[6] else 16)
        if code < 0xD800 or 0xE000 <= code < 0x110000:
            edits.append((*m.span(), chr(code)))
    return [_replaced(layer, edits)] if edits else []


def _quarters(layer: Layer, text: str, start: int, end: int) -> Layer:
    """A layer of one character for each decoded byte: three from each four of base64."""
    pieces = [
        (i, min(i + 3, len(text)), *layer.root(start + i // 3 * 4, min(start + i // 3 * 4 + 4, end)), 0)
        for i in range(0, len(text), 3)
    ]
    return Layer(text, pieces, layer.depth + 1)


def _base64(layer: Layer) -> Iterator[Layer | Packed]:
    """Layers of base64 runs. A payload may be glued to what stands before it, so each of the four
    alignments of a run is decoded once: as a text if all of it is one, else as bytes if a secret
    fits into what is printable, and from every mark of a compressed payload."""
    if "\n" in layer.text:
        edits = [
            (m.start() + e.start(), m.start() + e.end(), "")
            for m in WRAPPED.finditer(layer.text) for e in _LINE_END.finditer(m[0])
        ]
        if edits:
            yield _replaced(layer, edits)
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        for shift in range(4):
            part = run[shift:]
            if len(part) % 4 == 1:
                part = part[:-1]
            start, end = m.start() + shift, m.start() + shift + len(part)
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            text = "" if data.startswith(_MAGIC) else _text(data)
            if len(text) >= 4:
                if text.isascii():
                    yield _quarters(layer, text, start, end)
                else:
                    yield Layer(text, [(0, len(text), *layer.root(start, end), 0)], layer.depth + 1)
                continue
            for at in (x.start() for x in _MAGIC_AT.finditer(data)):
                if at % 3 == 0 and _opens(data[at:]):
                    yield Packed(data[at:], layer.root(start + at // 3 * 4, end), layer.depth + 1)
                    break  # its further members are read with it
            if _PRINTED.search(data):
                yield _quarters(layer, data.decode("latin-1"), start, end)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans (start, kind, end), layers scanned, payloads refused."""
    base = base_spans(text)
    spans, seen, layers, budget = set(base), set(), 1, Budget()

    def new(x: Layer | Packed) -> bool:
        """Whether a layer at its place has not been seen; parts of a large payload can't be told."""
        if isinstance(x, Packed):
            body, place = x.data, x.place
            if not isinstance(body, bytes):
                return True
        elif not x.text or x.text == text:
            return False
        else:
            body, place = x.text.encode("utf-8", "surrogatepass"), x.root(0, len(x.text))
        key = (hashlib.sha1(body).digest(), place)
        return key not in seen and not seen.add(key)

    def within(x: Layer | Packed) -> Iterator[Layer | Packed]:
        return _unpacked(x, budget) if isinstance(x, Packed) else itertools.chain(_base64(x), _url(x), _unicode(x))

    work = [within(Layer(text, [(0, len(text), 0, len(text), 1)], 0))] if text else []
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
        elif new(x):
            layers += isinstance(x, Layer)
            if isinstance(x, Layer):
                for start, kind, end in base_spans(x.text):
                    a, b = x.root(start, end)
                    spans.add((a, kind, b))
            work.append(within(x))
    return base, sorted(spans), layers, budget.refused


SPANS = "array<struct<start:int,kind:string,end:int>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans (arrays of start, kind, end), layers and n_refused of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        shape = lambda s: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in s]
        for batch in batches:
            found = [scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([shape(f[0]) for f in found], kind), pa.array([shape(f[1]) for f in found], kind),
                    pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()),
                ],
                ["id", "base", "spans", "layers", "n_refused"],
            )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"id long, base {SPANS}, spans {SPANS}, layers int, n_refused int")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in scan(text)[1]:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with every span that a scan finds replaced by a mark; null texts stay null. Where
    there is a column of lengths, it follows the text."""

    def cleaned(texts):
        import pyarrow as pa

        return pa.array([None if t is None else redacted(t) for t in texts.to_pylist()], pa.string())

    clean = F.arrow_udf(cleaned, "string")  # pandas would be held by each worker for nothing

    changed = docs.withColumn(text_col, clean(F.col(text_col)))
    if chars_col not in docs.columns:
        return changed
    length = F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col))
    return changed.withColumn(chars_col, length.cast(docs.schema[chars_col].dataType))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    listed = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"), "layers", "n_refused",
    )
