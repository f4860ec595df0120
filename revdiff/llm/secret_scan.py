"""Secrets in texts and in the encoded layers inside them."""

from __future__ import annotations

import base64
import binascii
import contextlib
import re
import zlib
from collections import deque
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean_batches
from .textbatch import byte_slices

# fixed values: the kinds in the order of the contract, and their patterns
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")

# the encodings of one character, by the character that introduces them
_CODES = {
    "%": re.compile(r"([0-9A-Fa-f]{2})()"),
    "\\": re.compile(r"(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4}))()"),
    "&": re.compile(r"#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));"),
}
_ESCAPE = re.compile(r"%(?=[0-9A-Fa-f]{2})|\\(?=x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[bfnrt\"/\\])|&(?=#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});)")
# the escapes of JSON that are one character, and what they stand for
_LETTERS = {"b": 8, "f": 12, "n": 10, "r": 13, "t": 9, '"': 34, "/": 47, "\\": 92}
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_DELIMITED = re.compile(r"[A-Za-z0-9]{16,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
# the first bytes of gzip, and those of zlib without a dictionary
_PACKED = re.compile("\x1f\x8b\x08|" + "|".join(f"{re.escape(chr(c))}[{''.join(re.escape(chr(f)) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 0x20)}]" for c in range(0x08, 0x80, 0x10)))


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, leftmost and non-overlapping per kind; the kind is its place in ``KINDS``."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


#: Characters of unpacked data that are scanned at once, and how many of them the next such part begins with.
WINDOW, OVERLAP = 1 << 20, 1 << 16
#: Packed bytes that are unpacked at once.
PIECE = 1 << 14


class _Layer:
    """A decoded text and where it lies in the original one.

    ``start[i]`` and ``end[i]`` belong to character i; they are None for the original
    text itself, and one number each for unpacked data, which lie in one place as a whole.
    """

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start, end):
        self.text, self.start, self.end = text, start, end

    def key(self) -> bytes:
        """Equal for layers of the same text that was decoded from the same places."""
        h = blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for x in (self.start, self.end):
            h.update(b"" if x is None else np.asarray(x, np.int32).tobytes())
        return h.digest()

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Where the characters from a to b lie."""
        if self.start is None:
            return a, b
        return (self.start, self.end) if isinstance(self.start, int) else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def part(self, text: str, first: np.ndarray, last: np.ndarray) -> _Layer:
        """A layer whose character i was made of the characters from ``first[i]`` to ``last[i]``, included."""
        if isinstance(self.start, int):
            return _Layer(text, self.start, self.end)
        if self.start is None:
            return _Layer(text, first.astype(np.int32), (last + 1).astype(np.int32))
        return _Layer(text, self.start[first], self.end[last])


def _unescaped(layer: _Layer) -> _Layer | None:
    """The layer with its URL, Unicode and HTML codes decoded; None if it has none.

    A code may stand for the sign that introduces the next one (``%2541``). Such a
    chain is followed to its end at once, which takes time in proportion to its length:
    the texts in between show nothing that the layer doesn't show, since these signs
    belong to no secret.
    """
    text, parts, src, size, last = layer.text, [], [], [], []
    at, m = 0, _ESCAPE.search(layer.text)
    while m is not None:
        sign, pos = m[0], m.end()
        letter = sign == "\\" and text[pos] in _LETTERS
        if letter:  # no chain: what a code stands for may be followed by any letter in packed data
            sign, pos = chr(_LETTERS[text[pos]]), pos + 1
        while not letter and sign in _CODES and (c := _CODES[sign].match(text, pos)) is not None:
            code = int(c[1], 16) if c[1] else int(c[2], 10 if sign == "&" else 16)
            if code >= 0x110000 or 0xD800 <= code < 0xE000:
                break
            sign, pos = chr(code), c.end()
        if pos > m.end():
            if at < m.start():
                parts.append(text[at : m.start()])
                src.append(at)
                size.append(m.start() - at)
                last.append(-1)
            parts.append(sign)
            src.append(m.start())
            size.append(1)
            last.append(pos - 1)
            at = pos
        m = _ESCAPE.search(text, pos)
    if not parts:
        return None
    parts.append(text[at:])
    if isinstance(layer.start, int):
        return _Layer("".join(parts), layer.start, layer.end)
    n = np.array([*size, len(text) - at], np.int64)
    first = np.repeat(np.array([*src, at], np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())
    until = np.repeat(np.array([*last, -1], np.int64), n)
    return layer.part("".join(parts), first, np.where(until < 0, first, until))


class _Unpacker:
    """Unpacks zlib or gzip data that are given in pieces.

    Members that follow one another are one content, as in gzip. Where the data are broken, all that comes before
    the error counts. ``size``: the bytes taken so far; ``whole``: the data ended where they should; ``over``: no more is taken.
    """

    def __init__(self) -> None:
        self.z, self.size, self.whole, self.over, self.between = None, 0, False, False, b""

    def feed(self, raw: bytes) -> Iterator[bytes]:
        """The content that ``raw`` adds, in parts of at most ``WINDOW`` bytes."""
        raw = self.between + raw
        self.between = b""
        while raw and not self.over:
            if self.z is None:
                zeros = len(raw) - len(raw.lstrip(b"\0")) if self.whole else 0
                if len(raw) - zeros < 3:  # too little to tell another member
                    self.between = raw
                    return
                if _PACKED.match(str(raw[zeros : zeros + 3], "latin-1")) is None:
                    self.over = True
                    return
                raw, self.size = raw[zeros:], self.size + zeros
                self.z, self.whole = zlib.decompressobj(31 if raw[0] == 0x1F else 15), False
            before = self.z.copy()
            try:
                yield self.z.decompress(raw, WINDOW)
                while self.z.unconsumed_tail:
                    yield self.z.decompress(self.z.unconsumed_tail, WINDOW)
            except zlib.error:
                self.over = True
                with contextlib.suppress(zlib.error):
                    for k in range(len(raw)):
                        made = before.decompress(raw[k : k + 1], WINDOW)
                        self.size += 1
                        yield made
                        while before.unconsumed_tail:
                            yield before.decompress(before.unconsumed_tail, WINDOW)
                return
            self.size += len(raw) - len(self.z.unused_data)
            raw = self.z.unused_data
            if self.z.eof:
                self.z, self.whole = None, True

    def begun(self) -> bool:
        """Whether the data go on, after all that was given."""
        return not self.over and self.z is not None


class _Flow:
    """Unpacked data that are never held whole, and what is encoded in them; all of it lies in one place.

    Parts of ``WINDOW`` characters, which overlap, become layers. What may be longer than a part is followed
    by flows of its own: a run of base64 longer than the overlap, decoded at each of the four places it may begin
    at, and packed data that go on beyond a part.
    """

    def __init__(self, place: tuple[int, int], out: deque[_Layer]):
        self.place, self.out = place, out
        self.held, self.fresh = b"", 0  # the part so far, and how much of it was in no part before
        self.run, self.runs = [], None  # the characters of the run that the data end with, or its decoders
        self.run_size = 0
        self.open: list[tuple[_Unpacker, _Flow]] = []

    def feed(self, data: bytes) -> None:
        if not data:
            return
        for unpacker, flow in self.open:
            for made in unpacker.feed(data):
                flow.feed(made)
        for unpacker, flow in self.open:
            if not unpacker.begun():
                flow.close()
        self.open = [x for x in self.open if x[0].begun()]
        self._follow_runs(data)
        self.held, self.fresh = self.held + data, self.fresh + len(data)
        while len(self.held) >= WINDOW + OVERLAP:
            self._part(self.held[:WINDOW])
            self.held = self.held[WINDOW - OVERLAP :]
            self.fresh = len(self.held) - OVERLAP

    def _part(self, data: bytes) -> None:
        text = data.decode("latin-1")
        self.out.append(_Layer(text, *self.place))
        for m in _PACKED.finditer(text, 0, max(len(text) - OVERLAP, 0)):
            unpacker = _Unpacker()
            for _ in unpacker.feed(data[m.start() :]):
                pass
            if unpacker.begun():
                unpacker, flow = _Unpacker(), _Flow(self.place, self.out)
                for made in unpacker.feed(data[m.start() :]):
                    flow.feed(made)
                for made in unpacker.feed(self.held[len(data) :]):  # what was taken in behind this part
                    flow.feed(made)
                if unpacker.begun():
                    self.open.append((unpacker, flow))
                else:
                    flow.close()

    def _follow_runs(self, data: bytes) -> None:
        at = 0
        for m in _NO_BASE64.finditer(data):
            self._more_of_run(data[at : m.start()])
            self._end_of_run()
            at = m.end()
        self._more_of_run(data[at:])

    def _more_of_run(self, data: bytes) -> None:
        if not data:
            return
        self.run_size += len(data)
        if self.runs is None:
            self.run.append(data)
            if self.run_size <= OVERLAP:
                return
            data, self.run = b"".join(self.run), []
            self.runs = [(bytearray(), _Flow(self.place, self.out)) for _ in range(4)]
            first = True
        else:
            first = False
        for phase, (rest, flow) in enumerate(self.runs):
            rest += data[phase:] if first else data
            whole = len(rest) // 4 * 4
            flow.feed(binascii.a2b_base64(bytes(rest[:whole]).translate(_STANDARD)))
            del rest[:whole]

    def _end_of_run(self) -> None:
        for rest, flow in self.runs or ():
            if len(rest) > 1:
                flow.feed(binascii.a2b_base64(bytes(rest).translate(_STANDARD) + b"=" * (4 - len(rest))))
            flow.close()
        self.run, self.runs, self.run_size = [], None, 0

    def close(self) -> None:
        self._end_of_run()
        for _, flow in self.open:
            flow.close()
        self.open = []
        if self.held and (self.fresh or len(self.held) > OVERLAP):
            self._part(self.held)
        for _, flow in self.open:
            flow.close()
        self.held, self.open = b"", []


_NO_BASE64 = re.compile(rb"[^A-Za-z0-9+/_-]+")
_STANDARD = bytes.maketrans(b"-_", b"+/")


def _packed_layers(layer: _Layer) -> Iterator[_Layer]:
    """What zlib or gzip data in the characters of a decoded layer hold, a part at a time; it lies where all of the data lie."""
    m = _PACKED.search(layer.text)
    if m is None:
        return
    raw = memoryview(layer.text.encode("latin-1", "replace"))

    def pieces(unpacker: _Unpacker, a: int) -> Iterator[bytes]:
        for k in range(a, len(raw), PIECE):
            yield from unpacker.feed(bytes(raw[k : k + PIECE]))
            if unpacker.over:
                return

    while m is not None:
        a, some, first = m.start(), False, _Unpacker()
        for made in pieces(first, a):
            some = some or bool(made)
        b = a + max(first.size, 1)
        if some:
            out: deque[_Layer] = deque()
            flow = _Flow(layer.span(a, b), out)
            for made in pieces(_Unpacker(), a):
                flow.feed(made)
                while out:
                    yield out.popleft()
            flow.close()
            yield from out
        # what has no end may be text that only begins like such data
        m = _PACKED.search(layer.text, b if first.whole else a + 1)


def _worth(text: str) -> bool:
    """Whether a decoded text has secrets or further layers."""
    return bool(_encoded(text) or _PACKED.search(text) or scan(text))


def _base64_text(body: str) -> str:
    """The bytes of base64 as characters, as many as there are."""
    body = body.rstrip("=")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body.translate({45: "+", 95: "/"}) + "=" * (-len(body) % 4)).decode("latin-1")
    except (binascii.Error, ValueError):
        return ""


def _base64_layers(layer: _Layer) -> Iterator[_Layer]:
    for m in _BASE64.finditer(layer.text):
        # what stands before the data may be joined to them, so all four places that they may begin at are tried
        runs = [(m.start() + phase, m.end()) for phase in range(4)]
        if re.search(r"[+/_-]", m[0]):
            # a part that ends before the run does
            runs += [(m.start() + d.start(), m.start() + d.end()) for d in _DELIMITED.finditer(m[0]) if d.start() % 4]
        for a, b in runs:
            made = _base64_text(layer.text[a:b])
            if _worth(made):
                first = a + np.arange(len(made)) // 3 * 4
                last = np.minimum(first + 4, b) - 1
                last[-1] = b - 1
                yield layer.part(made, first, last)
    if "\n" not in layer.text:
        return
    for m in _WRAPPED.finditer(layer.text):
        lines = [x.span() for x in _LINE.finditer(m[0])]
        body = "".join(m[0][a:b] for a, b in lines)
        edge = np.cumsum([0, *(b - a for a, b in lines)])
        # the words before the data are joined to them, and any line may be the first
        for phase in range(4):
            made = _base64_text(body[phase:])
            if _worth(made):
                place = np.repeat(m.start() + np.array([a for a, _ in lines]) - edge[:-1], np.diff(edge)) + np.arange(len(body))
                a = phase + np.arange(len(made)) // 3 * 4
                yield layer.part(made, place[a], place[np.minimum(a + 4, len(place)) - 1])


def _encoded(text: str) -> bool:
    return (
        (("%" in text or "\\" in text or "&#" in text) and _ESCAPE.search(text) is not None)
        or _BASE64.search(text) is not None
        or ("\n" in text and any(len(m[0]) >= 16 for m in _WRAPPED.finditer(text)))
    )


def _layers(layer: _Layer) -> Iterator[_Layer]:
    """What the layer becomes by each way of decoding that changes it."""
    made = _unescaped(layer)
    if made is not None:
        yield made
        del made
    if layer.start is not None:
        yield from _packed_layers(layer)
    yield from _base64_layers(layer)


def find_all(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the text itself, and those that only decoded layers show, as (start, kind, end) in the text.

    The worklist is a stack of layers that are still being decoded: each decoded
    layer is scanned and then decoded itself, until nothing is left. A layer that was
    met before, with the same text from the same places, is not decoded again, so
    nested data that contain themselves end; the same text from another place has spans
    of its own. Of layers that were met only a digest is kept, and unpacked data are made
    a window at a time, so memory grows with the text and the depth, not with what the
    data unpack to.
    """
    base = scan(text)
    if not _encoded(text):
        return base, []
    found: set[tuple[int, int, int]] = set()
    whole = _Layer(text, None, None)
    work, seen = [_layers(whole)], {whole.key()}
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif layer.text and (key := layer.key()) not in seen:
            seen.add(key)
            for a, kind, b in scan(layer.text):
                start, end = layer.span(a, b)
                found.add((start, kind, end))
            work.append(_layers(layer))
    return base, sorted(found - set(base))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in byte_slices(batch.column(1)):
            spans = []
            for text in batch.column(1).slice(lo, hi - lo):
                base, more = find_all(text.as_py() or "")
                own = set(base)
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in own} for a, k, b in sorted([*base, *more])])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in each whole text, and in URL, Unicode, base64 and compressed layers of it.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns a row
    per row of ``docs``: ``doc_id, spans``: array of (kind, start, end, base), by
    start, then kind. Positions are code points of the original text, end
    exclusive; a span of a decoded layer covers the characters it was decoded from,
    or all characters of the compressed data if it was compressed. ``base`` marks
    what the text shows without decoding. Every decoded layer is scanned, whatever
    its bytes, as the patterns are ASCII; base64 may be wrapped over lines;
    compressed data may begin anywhere in a decoded layer, have several members, be
    cut off or be broken, and are read up to there. Base64 is tried at all four places it may begin at, as a letter may
    stand before it, and the escapes of JSON (``\\n``, ``\\"`` ...) are decoded. What compressed data unpack to is scanned in
    overlapping parts of ``WINDOW`` characters; base64 and compressed data inside that are larger than
    a part are followed from part to part, at any depth. Compressed data of that size that are hidden in URL or Unicode codes, or in
    base64 wrapped over lines, inside compressed data are followed in their first part only. Nothing is shuffled; each text
    is handled by itself. Null is the empty text, without spans; null ids and repeated rows stay.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found, "doc_id bigint, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def masked(text: str, mask: str) -> str:
    """The text with every span replaced by ``mask``; overlapping spans are one."""
    base, more = find_all(text)
    out, at = [], 0
    spans: list[list[int]] = []
    for a, _, b in sorted([*base, *more]):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for a, b in spans:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with all columns, secrets of ``text`` replaced by ``mask``.

    ``n_chars``, if there is such a column, is set anew for changed texts. Rows
    without a secret stay as they are; nulls stay null.
    """
    lean_batches(docs.sparkSession)
    names = docs.columns

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, at = list(batch.columns), names.index("text")
        old, new, changed = columns[at], [], []
        for k, x in enumerate(old):
            text = x.as_py()
            other = text if text is None else masked(text, mask)
            if other != text:
                new.append(other)
                changed.append(k)
        if not changed:
            return batch
        which = np.zeros(len(old), bool)
        which[changed] = True
        columns[at] = pc.replace_with_mask(old, pa.array(which), pa.array(new, old.type))
        if "n_chars" in names:
            n = columns[names.index("n_chars")]
            columns[names.index("n_chars")] = pc.replace_with_mask(n, pa.array(which), pa.array([len(x) for x in new], n.type))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_slices(batch.column(names.index("text"))):
                yield one(batch.slice(lo, hi - lo))

    return docs.mapInArrow(run, docs.schema)
