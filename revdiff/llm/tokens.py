"""Token ids of many texts at once."""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np

from .textbatch import Words, sorted_union, word_table

_CHUNKS = word_table(b"")

#: Chunks whose ids a worker keeps for later batches.
KNOWN_CHUNKS = 1_000_000


@functools.lru_cache(maxsize=2)
def _load(path: str):
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    import public_tokenizers

    letters = _byte_letters()
    specials = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in specials}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, sorted(specials)


@functools.lru_cache(maxsize=1)
def _full(path: str):
    """The library's own tokenizer, loaded only where a special token's string is met."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE files write each byte as a printable letter: itself, or the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class ByteBpe:
    """Byte-level BPE whose ids equal those of the ``tokenizers`` library for the same file.

    Texts are cut before a single space between two characters that are not white
    space: no token can reach over such a place, so equal cuts have equal ids and
    each distinct one of a batch is encoded once. Cuts that hold a special token's
    string are left to the ``tokenizers`` library.
    """

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.path, (self.fast, self.specials) = path, _load(path)
        self.keys, self.begin, self.size = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, texts: list[str], special: bool) -> list[list[int]]:
        if not special:
            return list(map(self.fast.encode_ordinary, texts))
        own = lambda x: any(s in x for s in self.specials)
        return [_full(self.path).encode(x, add_special_tokens=False).ids if own(x) else self.fast.encode_ordinary(x) for x in texts]

    def _lookup(self, raw: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk begin in ``self.flat`` and how many there are; unknown chunks are encoded."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        begin, size = self.begin[at], self.size[at]
        new = np.flatnonzero(~known)
        if len(new):
            special = any(s.encode() in raw for s in self.specials)
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist())]
            ids = self._ids(texts, special)
            size[new] = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(size[new].sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used), np.uint32)])
            self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
            begin[new] = self.used + np.cumsum(size[new]) - size[new]
            if len(self.keys) + len(new) <= KNOWN_CHUNKS:
                into = np.searchsorted(self.keys, hashes[new])
                self.keys = np.insert(self.keys, into, hashes[new])
                self.begin = np.insert(self.begin, into, begin[new])
                self.size = np.insert(self.size, into, size[new])
                self.used += total
        return begin, size

    @staticmethod
    def _cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the chunks begin, ascending, with the beginning of each text that isn't empty."""
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        if len(buf) < 4:
            return heads
        visible = (buf > 0x20) & (buf < 0x7F)
        two = (buf >= 0xC3) & (buf <= 0xDF)  # first byte of a character of two bytes that isn't white space
        before = visible.copy()
        before[1:] |= two[:-1]
        space = np.flatnonzero(buf[1:-1] == 0x20) + 1
        space = space[before[space - 1] & (visible | two)[space + 1]]
        return sorted_union(heads, space)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and all ids one after another; each text ends with ``end_id`` if it's given."""
        n = len(offsets) - 1
        start = self._cuts(buf, offsets)
        end = np.concatenate([start[1:], [len(buf)]]) if len(start) else start
        hashes = _chunk_hashes(buf, start, end)
        order = np.argsort(hashes)
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        first, which = order[new], np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        begin, size = self._lookup(buf.tobytes(), hashes[first], start[first], end[first])
        flat = self.flat
        doc = np.searchsorted(offsets, start, side="right") - 1
        if end_id is not None:  # as one more chunk after each text
            begin, size = np.concatenate([begin, [-1]]), np.concatenate([size, [1]])
            order = np.argsort(np.concatenate([doc, np.arange(n)]), kind="stable")
            which = np.concatenate([which, np.full(n, len(size) - 1)])[order]
            doc = np.concatenate([doc, np.arange(n)])[order]
        length = size[which] if len(which) else np.zeros(0, np.int64)
        count = np.bincount(doc, weights=length, minlength=n).astype(np.int64)
        shift = np.repeat(begin[which] - (np.cumsum(length) - length), length) if len(which) else np.zeros(0, np.int64)
        ids = flat[shift + np.arange(len(shift))]
        if end_id is not None:
            ids[np.cumsum(count) - 1] = end_id
        return count, ids


def _chunk_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each chunk; chunks are not empty and follow one another."""
    if not len(start):
        return np.zeros(0, np.uint64)
    edges = np.concatenate([start, [len(buf)]])
    return Words(buf, edges, _CHUNKS, lower=False).hash
