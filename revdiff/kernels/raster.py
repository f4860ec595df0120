"""Page rasters: thresholds, skew, regions. Masks are boolean arrays of ink."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

# fixed values: degrees, radius and shares of the page
SKEW_LIMIT, SKEW_STEP = 2.0, 0.25
CLOSING_RADIUS, MIN_REGION, NEAR = 2, 0.00005, 12


def histogram(grey: np.ndarray) -> np.ndarray:
    """How many pixels each of the 256 levels has; a page of two levels alone is told by comparisons."""
    if grey.size:
        low, high = grey.min(), grey.max()
        n = np.count_nonzero(grey == low)
        if low < high and n + np.count_nonzero(grey == high) == grey.size:
            out = np.zeros(256, np.int64)
            out[low], out[high] = n, grey.size - n
            return out
    return np.bincount(grey, minlength=256)


def otsu(grey: np.ndarray) -> int | None:
    """The grey level that separates two classes best (the first of equal ones); None for one level only."""
    count = histogram(grey.reshape(-1)).astype(np.float64)
    levels = np.flatnonzero(count)
    if len(levels) < 2:
        return None
    level = np.arange(256)
    w0, s0 = np.cumsum(count), np.cumsum(count * level)
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    some = slice(levels[0], levels[-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * w1 * (s0 / w0 - s1 / w1) ** 2
    return int(levels[0] + np.argmax(between[some]))


def ink(grey: np.ndarray) -> np.ndarray:
    """Dark pixels, up to the threshold; none on a page of one level."""
    t = otsu(grey) if grey.size else None
    return np.zeros(grey.shape, bool) if t is None else grey <= t


#: Rows of a page that are worked on at once.
STRIP_ROWS = 256


def rotated(image: np.ndarray, degrees: float, fill: int) -> np.ndarray:
    """The image turned about its centre, counter-clockwise, each pixel from its nearest source; made strip by strip."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    out = np.full_like(image, fill)
    for top in range(0, h, STRIP_ROWS):
        y, x = np.mgrid[top : min(top + STRIP_ROWS, h), 0:w]
        sx = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx
        sy = np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
        ix, iy = np.rint(sx).astype(int), np.rint(sy).astype(int)
        inside = (ix >= 0) & (ix < w) & (iy >= 0) & (iy < h)
        out[top : top + STRIP_ROWS][inside] = image[iy[inside], ix[inside]]
    return out


def turned(image: np.ndarray, degrees: float, fill: int) -> np.ndarray:
    """``rotated``, which says what a turn is, with less work: lines and columns are turned apart and added."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    out = np.full_like(image, fill)
    x, flat = np.arange(w) - cx, image.reshape(-1)
    for top in range(0, h, STRIP_ROWS):
        y = np.arange(top, min(top + STRIP_ROWS, h))[:, None] - cy
        sx = np.cos(a) * x - np.sin(a) * y + cx
        sy = np.sin(a) * x + np.cos(a) * y + cy
        ix, iy = np.rint(sx, out=sx), np.rint(sy, out=sy)
        inside = (ix >= 0) & (ix < w) & (iy >= 0) & (iy < h)
        at = (iy * w + ix).astype(np.int64)
        at[~inside] = 0
        out[top : top + STRIP_ROWS] = np.where(inside, flat[at], fill)
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and end of each run of ink, row by row."""
    h, w = mask.shape
    edge = np.zeros((h, w + 2), bool)
    edge[:, 1:-1] = mask
    at = np.flatnonzero(edge[:, 1:] != edge[:, :-1])
    return at[::2] // (w + 1), at[::2] % (w + 1), at[1::2] % (w + 1)


def _pieces(mask: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of ink, cut to ``most`` pixels."""
    row, first, end = runs(mask)
    n = -(-(end - first) // most)
    of = np.repeat(np.arange(len(row)), n)
    start = first[of] + most * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
    return row[of], start, np.minimum(start + most, end[of])


def _within(row: np.ndarray, first: np.ndarray, end: np.ndarray, sine: float, cosine: float, middle: np.ndarray, least: int, most: int) -> tuple[np.ndarray, ...]:
    """What of some runs lies between two columns when the page is turned: a run that crosses one of them pixel by pixel."""
    across = lambda r, c: np.rint((r - middle[0]) * sine + (c - middle[1]) * cosine + middle[1])
    left, right = across(row, first), across(row, end - 1)
    whole = (left >= least) & (right < most)
    cut = np.flatnonzero(~whole & (right >= least) & (left < most))
    n = end[cut] - first[cut]
    of = np.repeat(cut, n)
    c = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    x = across(row[of], c)
    inner = (x >= least) & (x < most)
    return np.concatenate([row[whole], row[of][inner]]), np.concatenate([first[whole], c[inner]]), np.concatenate([end[whole], c[inner] + 1])


def _centred(row: np.ndarray, first: np.ndarray, end: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first and last column of runs from the middle of the page, and their lengths."""
    return row - middle[0], first - middle[1], end - 1 - middle[1], end - first


def _turned_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray, sine: float, cosine: float, middle: float, least: int, most: int) -> np.ndarray:
    """The ink of the rows from ``least`` to ``most`` that some runs, which lie in two rows at most, have when the page is turned."""
    across = row * cosine
    line = lambda at, c: np.rint(at - c * sine + middle)
    y, y_last = line(across, first), line(across, last)
    bent = np.flatnonzero(y != y_last)
    if len(bent):
        at, start, own = across[bent], first[bent], y[bent]
        high = np.clip(np.ceil((at + middle - (own + y_last[bent]) / 2) / sine - start), 1, size[bent] - 1).astype(np.int64)  # the first pixel of the other row, or one beside it
        while (step := (line(at, start + high) == own).astype(np.int64) - (line(at, start + (high - 1)) != own)).any():
            high += step
    else:
        high = np.zeros(0, np.int64)
    before = size.copy()
    before[bent] = high
    y, n = np.concatenate([y, y_last[bent]]), np.concatenate([before, size[bent] - high])
    inner = (y >= least) & (y < most)
    return np.bincount(y[inner].astype(np.int64) - least, weights=n[inner], minlength=most - least)


def _skew_of_runs(mask: np.ndarray) -> float:
    """``skew`` of a page whose size may not come again.

    No page is turned and no pixel visited: a turn moves the ends of short runs of ink, which then lie
    in one row or in two neighbours, and where a run changes its row follows from the turn.
    """
    row, first, end = _pieces(mask, int(0.9 / np.sin(np.deg2rad(SKEW_LIMIT))))
    if not len(row):
        return 0.0
    middle = (np.array(mask.shape) - 1) / 2
    least = np.array(mask.shape) // 10
    most = np.array(mask.shape) - least
    limit = np.deg2rad(SKEW_LIMIT)
    moved = np.ceil(middle[0] * np.sin(limit) + middle[1] * (1 - np.cos(limit))) + 1  # no turn moves a pixel farther sideways
    safe = (first >= least[1] + moved) & (end <= most[1] - moved)
    near = ~safe & (end > least[1] - moved) & (first < most[1] + moved)
    edge = row[near], first[near], end[near]
    inside = _centred(row[safe], first[safe], end[safe], middle)
    steps = round(SKEW_LIMIT / SKEW_STEP)
    sharpness = np.zeros(2 * steps + 1)
    for k in range(-steps, steps + 1):
        sine, cosine = np.sin(np.deg2rad(k * SKEW_STEP)), np.cos(np.deg2rad(k * SKEW_STEP))
        parts = [inside, _centred(*_within(*edge, sine, cosine, middle, least[1], most[1]), middle)]
        per_row = sum(_turned_runs(*part, sine, cosine, middle[0], least[0], most[0]) for part in parts)
        sharpness[k + steps] = np.square(np.diff(per_row)).sum()
    return float((sharpness.argmax() - steps) * SKEW_STEP)


def _least(low: np.ndarray, high: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The least number from ``low`` on at which ``holds`` is true, which it stays from there; ``high`` if it isn't below."""
    low, high = low.copy(), high.copy()
    while (low < high).any():
        half = (low + high) // 2
        known = holds(half) | (half >= high)
        low, high = np.where(known, low, half + 1), np.where(known, half, high)
    return low


@lru_cache(maxsize=2)
def _turns(height: int, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each turn: the places in a page at which stretches begin that come to lie in one row of its middle four fifths, and that row; what lies between such stretches has a row of its own behind the last."""
    middle = (np.array((height, width)) - 1) / 2
    least = np.array((height, width)) // 10
    most = np.array((height, width)) - least
    steps = round(SKEW_LIMIT / SKEW_STEP)
    row, out = np.arange(height), []
    for k in range(-steps, steps + 1):
        sine, cosine = np.sin(np.deg2rad(k * SKEW_STEP)), np.cos(np.deg2rad(k * SKEW_STEP))
        across = lambda r, c: np.rint((r - middle[0]) * sine + (c - middle[1]) * cosine + middle[1])  # noqa: B023, E731
        line = lambda r, c: np.rint((r - middle[0]) * cosine - (c - middle[1]) * sine + middle[0]).astype(np.int64)  # noqa: B023, E731
        none, every = np.zeros(height, np.int64), np.full(height, width)
        left, right = (_least(none, every, lambda c: across(row, c) >= x) for x in (least[1], most[1]))  # noqa: B023
        some = np.flatnonzero(left < right)
        left, right = left[some], right[some]
        at_left, at_right = line(some, left), line(some, right - 1)
        way = -1 if sine > 0 else 1
        n = np.abs(at_right - at_left) + 1  # a step to the side moves a pixel by less than a row
        of = np.repeat(np.arange(len(some)), n)
        y = at_left[of] + way * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
        first = _least(left[of], right[of], lambda c: way * line(some[of], c) >= way * y)  # noqa: B023
        end = np.append(first[1:], 0)
        end[np.cumsum(n) - 1] = right
        inner = (y >= least[0]) & (y < most[0])
        last = np.flatnonzero(inner & np.append(~inner[1:] | (first[1:] != end[:-1]) | (of[1:] != of[:-1]), True))
        place = np.concatenate([(some[of] * width + first)[inner], some[of[last]] * width + end[last]])
        to = np.concatenate([(y - least[0])[inner], np.full(len(last), most[0] - least[0])])
        order = np.lexsort((to < most[0] - least[0], place))  # where one stretch ends another may begin
        out.append((place[order], to[order]))
    return out


@lru_cache(maxsize=1)
def _running(n: int) -> np.ndarray:
    """Room for a page's running count, used again by the next one; the first is 0."""
    return np.zeros(n, np.int32)


def _skew_of_counts(mask: np.ndarray) -> float:
    """``skew`` by the running count of ink: what a turn does to a page of this size is known, and only where a row's pixels change rows are counts looked up."""
    h, w = mask.shape
    counts = _running(h * w + 1)
    np.cumsum(mask.reshape(-1), out=counts[1:])
    sharpness = []
    for place, row in _turns(h, w):
        per_row = np.bincount(row[:-1], weights=np.diff(counts[place]), minlength=h - 2 * (h // 10) + 1)[:-1]
        sharpness.append(np.square(np.diff(per_row)).sum())
    return float((np.argmax(sharpness) - round(SKEW_LIMIT / SKEW_STEP)) * SKEW_STEP)


_size_before: list[tuple[int, ...]] = [()]


def skew(mask: np.ndarray) -> float:
    """The turn, of those tried, at which the rows' ink changes most sharply; 0 for a page without ink.

    The rows are counted within the middle four fifths of the page. Of equal turns the first, from the most
    negative one, counts. Pages of one size, one after another, share what is known about turning that size.
    """
    again = _size_before[0] == mask.shape
    _size_before[0] = mask.shape
    if not mask.any():
        return 0.0
    return _skew_of_counts(mask) if again else _skew_of_runs(mask)


def prepared(grey: np.ndarray) -> tuple[np.ndarray, float]:
    """The ink of a page set straight, and the turn that did it."""
    mask = ink(grey)
    angle = skew(mask)
    return (ink(turned(grey, angle, 255)) if angle else mask), angle


def packed(mask: np.ndarray) -> np.ndarray:
    """Ink as signed 64-bit words, row by row, the first pixel in the lowest bit."""
    bits = np.packbits(mask.reshape(-1), bitorder="little")
    return np.frombuffer(np.pad(bits, (0, -len(bits) % 8)).tobytes(), "<i8")


def pack(mask: np.ndarray) -> list[int]:
    """``packed`` as a list."""
    return packed(mask).tolist()


def unpack(words: list[int], height: int, width: int) -> np.ndarray:
    """The mask that ``pack`` packed."""
    bits = np.unpackbits(np.asarray(words, "<i8").view(np.uint8), bitorder="little")
    return bits[: height * width].reshape(height, width).astype(bool)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    """Common ink over all ink of two packed masks of one size; 1 if neither has any."""
    either = int(np.bitwise_count((a | b).view(np.uint64)).sum())
    return int(np.bitwise_count((a & b).view(np.uint64)).sum()) / either if either else 1.0


class Packed:
    """A packed mask, unpacked a few rows at a time."""

    def __init__(self, words: list[int], height: int, width: int):
        self.bytes, self.height, self.width = np.asarray(words, "<i8").view(np.uint8), int(height), int(width)

    def rows(self, lo: int, hi: int) -> np.ndarray:
        hi = max(min(hi, self.height), lo)
        first, last = lo * self.width, hi * self.width
        bits = np.unpackbits(self.bytes[first // 8 : -(-last // 8)], bitorder="little")
        return bits[first % 8 : first % 8 + last - first].reshape(hi - lo, self.width).astype(bool)


def difference(a: Packed, b: Packed, lo: int, hi: int) -> np.ndarray:
    """Where rows ``lo`` to ``hi`` of two masks differ, laid on each other at the upper left; all outside the common part differs."""
    x, y = a.rows(lo, hi), b.rows(lo, hi)
    out = np.ones((hi - lo, max(a.width, b.width)), bool)
    h, w = min(len(x), len(y)), min(a.width, b.width)
    out[:h, :w] = x[:h, :w] ^ y[:h, :w]
    return out


def _spread(mask: np.ndarray, radius: int) -> np.ndarray:
    """Ink grown by a disk: each row to both sides, as far as the disk is wide at each distance up and down."""
    h, w = mask.shape
    out, wide, width = np.zeros_like(mask), mask.copy(), 0
    for dy in range(radius, -1, -1):
        while (width + 1) ** 2 + dy * dy <= radius * radius and width + 1 < w:
            width += 1
            wide[:, width:] |= mask[:, :-width]
            wide[:, :-width] |= mask[:, width:]
        if dy < h:
            out[dy:] |= wide[: h - dy]
            out[: h - dy] |= wide[dy:]
    return out


def closed(mask: np.ndarray, radius: int = CLOSING_RADIUS) -> np.ndarray:
    """Closing with a disk: grown, then shrunk; the outside never shrinks it."""
    return ~_spread(~_spread(mask, radius), radius)


def joined(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run of ink, the first run of those it hangs together with, corners included. Runs are sorted.

    Runs of neighbouring rows that touch are links; each run points at the least run it is known to hang with, and
    all links are drawn together until none joins two.
    """
    n = len(row)
    span = int(end.max(initial=0)) + 2
    lo = np.searchsorted(row * span + end, (row - 1) * span + first)
    hi = np.searchsorted(row * span + first, (row - 1) * span + end, side="right")
    touching = np.maximum(hi - lo, 0)
    below = np.repeat(np.arange(n), touching)
    above = np.repeat(lo, touching) + np.arange(len(below)) - np.repeat(np.cumsum(touching) - touching, touching)
    top = np.arange(n)
    while len(below):
        a, b = top[above], top[below]
        apart = a != b
        above, below, a, b = above[apart], below[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while ((further := top[top]) != top).any():
            top = further
    return top


def components(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(area, x0, y0, x1, y1) of each region of touching runs, by its first run."""
    if not len(row):
        return []
    tops, of = np.unique(joined(row, first, end), return_inverse=True)
    least = [np.full(len(tops), np.iinfo(np.int64).max) for _ in range(2)]
    most = [np.zeros(len(tops), np.int64) for _ in range(2)]
    np.minimum.at(least[0], of, first)
    np.minimum.at(least[1], of, row)
    np.maximum.at(most[0], of, end)
    np.maximum.at(most[1], of, row + 1)
    area = np.bincount(of, weights=end - first).astype(np.int64)
    return list(zip(*(x.tolist() for x in (area, *least, *most))))


def merged(boxes: list[tuple[int, int, int, int]], gap: int = NEAR) -> list[tuple[int, int, int, int]]:
    """Boxes by descending area, each joined to the first group within ``gap`` pixels."""
    if not boxes:
        return []
    own = np.array(boxes, np.int64)
    own = own[np.argsort(-np.prod(own[:, 2:] - own[:, :2], axis=1), kind="stable")]
    groups, n = np.zeros_like(own), 0
    for box in own:
        apart = np.maximum(groups[:n, :2] - box[2:], box[:2] - groups[:n, 2:]).max(axis=1)
        near = np.flatnonzero(apart <= gap)
        at = near[0] if len(near) else n
        both = np.stack([groups[at], box]) if len(near) else box[None]
        groups[at] = np.concatenate([both[:, :2].min(axis=0), both[:, 2:].max(axis=0)])
        n += not len(near)
    return [tuple(g) for g in groups[:n].tolist()]


#: How far around a pixel closing can see.
_SEEN = 2 * CLOSING_RADIUS


def _closed_runs(mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of ``closed(mask)``, made only around what is there: rows far apart don't see each other."""
    rows = np.flatnonzero(mask.any(axis=1))
    for own in np.split(rows, np.flatnonzero(np.diff(rows) > 2 * _SEEN) + 1) if len(rows) else ():
        top, bottom = max(own[0] - _SEEN, 0), own[-1] + 1 + _SEEN
        columns = np.flatnonzero(mask[top:bottom].any(axis=0))
        left, right = max(columns[0] - _SEEN, 0), columns[-1] + 1 + _SEEN
        row, first, end = runs(closed(mask[top:bottom, left:right]))
        yield row + top, first + left, end + left


def changed_regions(a: Packed, b: Packed, least: float = MIN_REGION, strip: int = STRIP_ROWS) -> list[tuple[int, int, int, int]]:
    """Boxes of the larger differences of two pages.

    The page is gone through in strips of ``strip`` rows. A strip is closed together with the few rows around it that closing
    can see, and leaves only its runs; regions are joined over the strips' edges.
    """
    height, width = max(a.height, b.height), max(a.width, b.width)
    found = []
    for top in range(0, height, strip):
        lo, hi = max(top - _SEEN, 0), min(top + strip + _SEEN, height)
        for row, first, end in _closed_runs(difference(a, b, lo, hi)):
            own = (row + lo >= top) & (row + lo < top + strip)
            found.append((row[own] + lo, first[own], end[own]))
    if not found:
        return []
    return merged([box for area, *box in components(*(np.concatenate(x) for x in zip(*found))) if area >= least * height * width])
