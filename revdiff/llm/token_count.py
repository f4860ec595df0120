"""Token counts of a unigram tokenizer, without making tokens: a Viterbi search that carries counts."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .storage import lean_batches
from .textbatch import Words, slices, text_buffer, word_table

#: Words whose counts a worker keeps for later batches.
KNOWN_WORDS = 2_000_000
_NOT_SPACE = word_table(b"\x20")
_MARK = "▁"
#: fixed value: what an unknown character scores below the lowest piece
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts pieces as ``tokenizers.models.Unigram`` makes them.

    All pieces are found at once by an Aho-Corasick automaton. For each end the
    candidates come from the longest piece to the shortest, and only a strictly
    better score replaces one, which is the library's rule for ties. A character
    without a piece of its own may be unknown, at the lowest score less
    ``UNKNOWN_PENALTY``; with ``byte_fallback`` it counts its UTF-8 bytes, else a
    run of unknown characters counts 1.
    """

    def __init__(self, vocab: Sequence[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def count(self, text: str) -> int:
        """Pieces of one pre-tokenised string."""
        n = len(text)
        best, pieces, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done, unknown, bytes_ = 0, self.unknown, self.byte_fallback

        def skip(end: int, single: bool, found: bool) -> None:
            """The unknown character before ``end``, unless a piece is that character."""
            s = end - 1
            if not single and (not found or best[s] + unknown > best[end]):
                best[end] = best[s] + unknown
                pieces[end] = pieces[s] + (len(text[s].encode("utf-8", "replace")) if bytes_ else not lost[s])
                lost[end] = True

        single = found = False
        at = 0
        for last, (size, score) in self.automaton.iter(text):
            end = last + 1
            while done + 1 < end:  # ends without any piece, or whose pieces are all seen
                done += 1
                skip(done, single and at == done, found and at == done)
            if at != end:
                at, single, found = end, False, False
            value = best[end - size] + score
            if not found or value > best[end]:
                best[end], pieces[end], lost[end] = value, pieces[end - size] + 1, False
            found = True
            single = single or size == 1
        while done < n:
            done += 1
            skip(done, single and at == done, found and at == done)
        return pieces[n]

    def count_word(self, word: str) -> int:
        """Pieces of a word after its space; the word may hold further space marks."""
        parts = word.split(_MARK)
        return sum(self.count(_MARK + p) for p in parts)


@functools.lru_cache(maxsize=2)
def _counter(path: str | None, byte_fallback: bool) -> _Cached:
    return _Cached(UnigramCounter(vocabulary.load(path)[0], byte_fallback))


class _Cached:
    """Counts of the words met so far, by their hashes."""

    def __init__(self, counter: UnigramCounter):
        self.counter = counter
        self.keys, self.values = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        self.gap = counter.count(_MARK)

    def words(self, words: Words) -> np.ndarray:
        order = np.argsort(words.hash)
        new = np.ones(len(order), bool)
        new[1:] = words.hash[order[1:]] != words.hash[order[:-1]]
        uniq, first = words.hash[order][new], order[new]
        at = np.minimum(np.searchsorted(self.keys, uniq), len(self.keys) - 1)
        values = self.values[at]
        miss = np.flatnonzero(self.keys[at] != uniq)
        if len(miss):
            values[miss] = [self.counter.count_word(w) for w in words.strings(first[miss])]
            if len(self.keys) + len(miss) <= KNOWN_WORDS:
                into = np.searchsorted(self.keys, uniq[miss])
                self.keys, self.values = np.insert(self.keys, into, uniq[miss]), np.insert(self.values, into, values[miss])
        out = np.empty(len(order), np.int64)
        out[order] = values[np.cumsum(new) - 1]
        return out

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        words = Words(buf, offsets, _NOT_SPACE, lower=False)
        total = np.bincount(words.doc, weights=self.words(words), minlength=n).astype(np.int64) if len(words) else np.zeros(n, np.int64)
        spaces = np.concatenate([[0], np.cumsum(buf == 0x20)])
        spaces = spaces[offsets[1:]] - spaces[offsets[:-1]]
        some = np.flatnonzero(np.diff(offsets) > 0)
        head = np.zeros(n, bool)
        head[some] = buf[offsets[some]] != 0x20  # a mark is put before such a text
        total += (spaces + head - np.diff(words.first)) * self.gap
        mark = np.frombuffer(_MARK.encode(), np.uint8)
        for i in some[np.diff(offsets)[some] >= 3]:
            a = offsets[i]
            if buf[a] == mark[0] and (buf[a : a + 3] == mark).all():  # except where it begins with one
                text = buf[a : offsets[i + 1]].tobytes().decode("utf-8", "replace").replace(" ", _MARK)
                total[i] = sum(self.counter.count(_MARK + p) for p in text.split(_MARK)[1:])
        return total


def count_tokens(docs: DataFrame, *, path: str | None = None, byte_fallback: bool = True) -> DataFrame:
    """Tokens of each whole text under a unigram tokenizer.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``path``: a
    SentencePiece file whose pieces and scores are the unigram vocabulary (default:
    the public 32k pieces, whose scores are their negated ranks). Spaces become the
    mark U+2581, one is put before the text, and no piece crosses a mark. Returns a
    row per row of ``docs``: ``doc_id, n_bytes, n_tokens``.

    No shuffle. Each distinct word of a slice is searched once, and a worker keeps
    the counts of up to ``KNOWN_WORDS`` words. Null and empty texts have 0 tokens;
    null ids and repeated rows stay; an empty table gives no rows.
    """
    lean_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, byte_fallback)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                tokens = counter.texts(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size = np.diff(offsets[lo : hi + 1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
