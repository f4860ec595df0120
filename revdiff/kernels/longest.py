"""Matching blocks of long sequences with many repeats.

The result is that of ``difflib`` (every element counting): the longest common run, of
equal ones the first on the left, then on the right, and so on beside it. There, each
search looks at every pair of equal elements; here, ranks of runs of 1, 2, 4 ...
elements say whether two runs of any length are equal, so a length is tried at once for all
places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Hashable, Sequence
from difflib import SequenceMatcher

import numpy as np

#: Pairs of elements up to which a region is given to ``difflib``.
SMALL = 4096

Block = tuple[int, int, int]


class RunRanks:
    """Numbers for all runs of two sequences: equal for equal runs of one length."""

    def __init__(self, old: Sequence[Hashable], new: Sequence[Hashable]):
        kinds: dict[Hashable, int] = {}
        self.ranks = [tuple(np.fromiter((kinds.setdefault(x, len(kinds)) for x in side), np.int64, len(side)) for side in (old, new))]
        self.base = len(old) + len(new) + 1
        width = 1
        while width * 2 <= min(len(old), len(new)):
            a, b = (r[:-width] * self.base + r[width:] for r in self.ranks[-1])
            known, of = np.unique(np.concatenate([a, b]), return_inverse=True)
            of = of.reshape(-1)
            a, b = of[: len(a)], of[len(a) :]
            seen = np.zeros(len(known), bool)
            seen[a] = True
            if not seen[b].any():  # no common run is that long
                break
            self.ranks.append((a, b))
            width *= 2
        self.longest = 2 * width - 1

    def codes(self, side: int, lo: int, hi: int, length: int) -> np.ndarray:
        """A number for each run of ``length`` elements inside ``lo:hi`` of one side."""
        level = length.bit_length() - 1
        r = self.ranks[level][side]
        return r[lo : hi - length + 1] * self.base + r[lo + length - (1 << level) : hi - (1 << level) + 1]

    def common(self, region: tuple[int, int, int, int], length: int) -> bool:
        a0, a1, b0, b1 = region
        return bool(np.isin(self.codes(0, a0, a1, length), self.codes(1, b0, b1, length)).any())

    def longest_in(self, region: tuple[int, int, int, int], most: int) -> int:
        """The length of the longest common run in a region, which is ``most`` at most: doubled until there is none, then halved in."""
        a0, a1, b0, b1 = region
        most = min(most, a1 - a0, b1 - b0, self.longest)
        low, step = 0, 1
        while low < most:
            tried = min(low + step, most)
            if not self.common(region, tried):
                most = tried - 1
                break
            low, step = tried, step * 2
        while low < most:
            tried = (low + most + 1) // 2
            low, most = (tried, most) if self.common(region, tried) else (low, tried - 1)
        return low

    def runs_of(self, region: tuple[int, int, int, int], length: int) -> list[Block]:
        """The runs of the region's greatest length, each the first behind the one before on both sides.

        The region's first longest run leaves two regions. The left one has no run of that length, as it would
        have been first; in the right one the same rule holds, so one sweep finds all of them.
        """
        a0, a1, b0, b1 = region
        left, right = self.codes(0, a0, a1, length), self.codes(1, b0, b1, length)
        order = np.argsort(right, kind="stable")
        ranked = right[order]
        starts = np.searchsorted(ranked, left, side="left")
        ends = np.searchsorted(ranked, left, side="right")
        order = order.tolist()
        found, i, j = [], 0, 0
        for at in np.flatnonzero(starts < ends).tolist():
            if at < i:
                continue
            lo, hi = int(starts[at]), int(ends[at])
            spot = bisect_left(order, j, lo, hi)
            if spot < hi:
                found.append((a0 + at, b0 + order[spot], length))
                i, j = at + length, order[spot] + length
        return found


def matching_blocks(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[Block]:
    """(start in ``old``, start in ``new``, length) of the matching blocks, in order, neighbours joined.

    A region is never searched again for a length that it can't have: what lies between runs of a length has
    shorter ones only, and lengths add up to the sequences', so there are few of them one inside another.
    """
    index = RunRanks(old, new)
    found: list[Block] = []
    regions = [((0, len(old), 0, len(new)), index.longest)]
    while regions:
        region, most = regions.pop()
        a0, a1, b0, b1 = region
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= SMALL:
            small = SequenceMatcher(None, old[a0:a1], new[b0:b1], autojunk=False)
            found += [(a0 + i, b0 + j, n) for i, j, n in small.get_matching_blocks() if n]
            continue
        length = index.longest_in(region, most)
        if not length:
            continue
        runs = index.runs_of(region, length)
        found += runs
        for (i, j, n), (i2, j2, _) in zip([(a0, b0, 0), *runs], [*runs, (a1, b1, 0)]):
            regions.append(((i + n, i2, j + n, j2), length - 1))
    joined: list[Block] = []
    for i, j, n in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def opcodes(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[tuple[str, int, int, int, int]]:
    """What turns ``old`` into ``new``, block by block: (equal, replace, delete or insert, and the two half-open ranges)."""
    out, i, j = [], 0, 0
    for a, b, n in [*matching_blocks(old, new), (len(old), len(new), 0)]:
        if i < a or j < b:
            out.append(("replace" if i < a and j < b else "delete" if i < a else "insert", i, a, j, b))
        if n:
            out.append(("equal", a, a + n, b, b + n))
        i, j = a + n, b + n
    return out
