"""The words of one page: which lie in table cells, lines, list markers, paragraphs, table rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# fixed values: characters that mark list items, and distances in points
LIST_MARKERS = ("*", "-", "•", "–", "—")
MARKER_HEIGHT, MARKER_GAP, PARAGRAPH_GAPS = 3.0, 2.0, 1.6


class Word(NamedTuple):
    number: int
    text: str | None
    x0: float
    top: float
    x1: float
    bottom: float


class Cell(NamedTuple):
    """A cell of a table; one that isn't placed has no ``x0`` and no ``y0``."""

    table: int
    row: int
    column: int
    x0: float | None
    y0: float | None
    x1: float | None
    y1: float | None
    text: str | None


@lru_cache(maxsize=1 << 14)
def tenth(x: float) -> float:
    """``x`` to a tenth, of its decimal digits, halves to the even one."""
    return float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_EVEN))


def outside(words: Sequence[Word], cells: Sequence[Cell]) -> list[Word]:
    """The words whose centre lies in no cell, edges included; a cell meets only words of its height."""
    if not words or not cells:
        return list(words)
    x, y = (np.array([(w[a] + w[b]) / 2 for w in words]) for a, b in ((2, 4), (3, 5)))
    order = np.argsort(y, kind="stable")
    x, y = x[order], y[order]
    free = np.ones(len(words), bool)
    placed = [c for c in cells if c.x0 is not None]
    lows = np.searchsorted(y, [c.y0 for c in placed])
    highs = np.searchsorted(y, [c.y1 for c in placed], side="right")
    for c, low, high in zip(placed, lows.tolist(), highs.tolist()):
        if low < high:
            free[low:high] &= (x[low:high] < c.x0) | (x[low:high] > c.x1)
    keep = np.ones(len(words), bool)
    keep[order] = free
    return [w for w, k in zip(words, keep.tolist()) if k]


def lines(words: Sequence[Word]) -> tuple[list[tuple[float, list[Word]]], float]:
    """(top of the first word, words) of each line, and the page's gap, as ``layout.lines_from_words`` says."""
    if not words:
        return [], 0.0
    gap = sorted(w.bottom - w.top for w in words)[len(words) // 2]
    out: list[tuple[float, list[Word]]] = []
    for w in sorted(words, key=lambda w: (tenth(w.top), w.x0, w.number)):
        if not out or abs(w.top - out[-1][0]) > gap:
            out.append((w.top, []))
        out[-1][1].append(w)
    return out, gap


def with_markers(found: list[tuple[float, list[Word]]], chars: Sequence[Word]) -> list[tuple[float, list[Word]]]:
    """Lines with the list marker on their left, as ``layout.restore_list_markers`` says."""
    marks = sorted((m for m in chars if m.text in LIST_MARKERS), key=lambda m: m.top)
    tops = [m.top for m in marks]
    out = []
    for top, own in found:
        first = own[0]
        near = marks[bisect_left(tops, top - 2 * MARKER_HEIGHT) : bisect_right(tops, top + 2 * MARKER_HEIGHT)] if first.text is not None and first.text not in LIST_MARKERS else []
        near = [m for m in near if abs(m.top - top) <= MARKER_HEIGHT and m.x1 <= first.x0 - MARKER_GAP]
        out.append((top, [min(near, key=lambda m: (tenth(m.top), m.x0)), *own] if near else own))
    return out


def paragraphs(words: Sequence[Word], cells: Sequence[Cell], chars: Sequence[Word]) -> list[tuple[float, str]]:
    """(top, text) of each paragraph of the words beside the cells, as ``layout.paragraphs_from_lines`` says; blanks stay."""
    found, gap = lines(outside(words, cells))
    out: list[tuple[float, list[str]]] = []
    before = 0.0
    for top, own in with_markers(found, chars):
        if not out or top - before > PARAGRAPH_GAPS * gap:
            out.append((top, []))
        out[-1][1].append(" ".join(w.text for w in own if w.text is not None))
        before = max(w.bottom for w in own)
    return [(top, "\n".join(parts)) for top, parts in out]


def table_rows(cells: Sequence[Cell]) -> list[tuple[int, int, float, list[str]]]:
    """(table, row, top, texts) of each table row with a placed cell and a text, as ``layout.table_rows_from_rects`` says."""
    rows: dict[tuple[int, int], list[Cell]] = {}
    for c in cells:
        rows.setdefault((c.table, c.row), []).append(c)
    out = []
    for (table, row), own in rows.items():
        tops = [c.y0 for c in own if c.y0 is not None]
        texts = [t for _, t in sorted((c.column, c.text or "") for c in own)]
        if tops and any(t.strip() for t in texts):
            out.append((table, row, min(tops), texts))
    return out
