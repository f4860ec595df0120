"""The parts of one word-processor file, with the standard library only."""

from __future__ import annotations

import base64
import hashlib
import io
import zipfile
from collections import deque
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

# fixed values: namespaces of the format
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
P = "{http://schemas.openxmlformats.org/package/2006/relationships}"

_OFF = {"0", "false", "none", "off"}


def _flag(props: ElementTree.Element | None, name: str) -> bool:
    found = props.find(W + name) if props is not None else None
    return found is not None and found.get(W + "val", "1") not in _OFF


def _run_text(run: ElementTree.Element) -> str:
    parts = {W + "t": lambda e: e.text or "", W + "tab": lambda e: "\t", W + "br": lambda e: "\n", W + "cr": lambda e: "\n", W + "noBreakHyphen": lambda e: "-"}
    return "".join(parts[e.tag](e) for e in run if e.tag in parts)


def _runs(paragraph: ElementTree.Element):
    return paragraph.findall(W + "r")


#: Bytes of a document's XML up to which it is parsed once; a larger one is parsed to its end before its first piece is given out.
PARSED_ONCE = 4 << 20
#: Runs and cells of a piece, about.
PIECE = 5000
_CHUNK = 1 << 16


def _named(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


class _Images:
    """The images of a document, in order, within a budget of bytes; what doesn't fit is read through and not held."""

    def __init__(self, z: zipfile.ZipFile, limit: int):
        self.z, self.left, self.full = z, limit, False
        rels = _named(z, "word/_rels/document.xml.rels")
        self.links = {e.get("Id"): e.get("Target") for e in rels.iter(P + "Relationship")} if rels is not None else {}

    def _blob(self, target: str) -> bytes | None:
        """The image, or None if it is broken or beyond the budget."""
        held, size = [], 0
        try:
            with self.z.open(target.lstrip("/") if target.startswith("/") else f"word/{target}") as f:
                while chunk := f.read(_CHUNK):
                    size += len(chunk)
                    if self.full or size > self.left:
                        held = []
                    else:
                        held.append(chunk)
        except (KeyError, zipfile.BadZipFile):
            return None
        if size and (self.full or size > self.left):
            self.full = True
            return None
        self.left -= size
        return b"".join(held)

    def of(self, paragraph: ElementTree.Element, block: int, number: int) -> list[tuple]:
        out = []
        for blip in paragraph.iter(A + "blip"):
            target = self.links.get(blip.get(R + "embed"), "")
            blob = self._blob(target)
            if blob is not None:
                kind = "jpeg" if target.lower().endswith((".jpg", ".jpeg")) else target.rpartition(".")[2].lower() or "png"
                uri = f"data:image/{kind};base64,{base64.b64encode(blob).decode('ascii')}"
                out.append((block, number + len(out), hashlib.sha1(blob).hexdigest(), len(blob), uri))
        return out


def _parts_of_body(stream: IO[bytes]) -> Iterator[tuple[int, int, ElementTree.Element]]:
    """(block, row, element) of each paragraph (row -1) and table row of the body, as the stream reaches their end; then they are dropped."""
    path: list[ElementTree.Element] = []
    block, row = -1, 0
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            path.append(e)
            if len(path) == 3 and path[1].tag == W + "body":
                block, row = block + 1, 0
            continue
        path.pop()
        if len(path) < 2 or path[1].tag != W + "body":
            continue
        if len(path) == 2:
            if e.tag == W + "p":
                yield block, -1, e
            path[-1].remove(e)
        elif len(path) == 3 and path[2].tag == W + "tbl":
            if e.tag == W + "tr":
                yield block, row, e
                row += 1
            path[-1].remove(e)


def unpack(content: bytes, max_images_bytes: int) -> Iterator[tuple[list[tuple], list[tuple], list[tuple]]]:
    """(runs, cells, images) of a file, in pieces.

    Runs: block_no, run_no, text, bold, italic, underline, style; cells: block_no,
    row_no, col_no, tc_id, text; images: block_no, img_no, sha1, n_bytes, data_uri. A
    merged cell has one ``tc_id`` wherever it reaches. A broken image is left out, a
    broken file raises before anything is given out. Neither the whole tree nor all images are in memory.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = _named(z, "word/styles.xml")
        names = {e.get(W + "styleId"): e.find(W + "name").get(W + "val") for e in styles.iter(W + "style") if e.find(W + "name") is not None} if styles is not None else {}
        images, once = _Images(z, max_images_bytes), z.getinfo("word/document.xml").file_size <= PARSED_ONCE
        if not once:
            with z.open("word/document.xml") as f:
                for block, row, item in _parts_of_body(f):
                    deque(_runs_of(item, block, names) if row < 0 else _cells_of(item, block, row, {}), 0)
        out: tuple[list[tuple], list[tuple], list[tuple]] = ([], [], [])
        open_: dict[int, int] = {}
        last, seen = -1, 0  # the block that images were counted for, and their number
        with z.open("word/document.xml") as f:
            for block, row, item in _parts_of_body(f):
                if not once and (len(out[0]) + len(out[1]) >= PIECE or out[2]):
                    yield out
                    out = ([], [], [])
                if block != last:
                    last, seen, open_ = block, 0, {}
                if row < 0:
                    out[0].extend(_runs_of(item, block, names))
                    paragraphs = [item]
                else:
                    paragraphs = []
                    for tc, cells in _cells_of(item, block, row, open_):
                        out[1].extend(cells)
                        paragraphs += tc.findall(W + "p")
                for p in paragraphs:
                    own = images.of(p, block, seen)
                    seen += len(own)
                    out[2].extend(own)
        yield out


def _runs_of(paragraph: ElementTree.Element, block: int, names: dict[str, str]) -> Iterator[tuple]:
    props = paragraph.find(W + "pPr")
    style = props.find(W + "pStyle") if props is not None else None
    name = names.get(style.get(W + "val"), style.get(W + "val")) if style is not None else ""
    for k, run in enumerate(_runs(paragraph)):
        p = run.find(W + "rPr")
        yield block, k, _run_text(run), _flag(p, "b"), _flag(p, "i"), _flag(p, "u"), name.replace("heading ", "Heading ") if name else ""


def _cells_of(item: ElementTree.Element, block: int, row: int, open_: dict[int, int]) -> Iterator[tuple[ElementTree.Element, list[tuple]]]:
    """Each cell of a table row, and the columns it covers; ``open_`` has the cells above."""
    col = 0
    for tc in item.findall(W + "tc"):
        props = tc.find(W + "tcPr")
        span = props.find(W + "gridSpan") if props is not None else None
        down = props.find(W + "vMerge") if props is not None else None
        own = hash_id(block, row, col)
        if down is not None and down.get(W + "val") != "restart" and col in open_:
            own = open_[col]
        text = "\n".join("".join(_run_text(x) for x in _runs(p)) for p in tc.findall(W + "p"))
        width = int(span.get(W + "val")) if span is not None else 1
        yield tc, [(block, row, col + k, own, text) for k in range(width)]
        open_ |= dict.fromkeys(range(col, col + width), own)
        col += width


def hash_id(block: int, row: int, col: int) -> int:
    """A number for the cell that begins here."""
    return (block << 40) | (row << 16) | col
