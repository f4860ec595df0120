"""Language-model scores: the lattice of all segmentations of a text's words into pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary
from .storage import lean_batches, staged
from .textbatch import Words, signed, slices, text_buffer

#: Words whose values are broadcast; all others are joined.
HEAD_WORDS = 300_000
_MARK = "▁"
#: What stands for a text's own mark: no piece has it, so it is spelt in bytes.
_OTHER = "\ue000"
_LOG10 = float(np.log(10.0))


class PieceTrie:
    """Pieces as a trie of numbered edges, and the walk of many words through it at once."""

    def __init__(self, pieces: Sequence[str]):
        edges: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for number, piece in enumerate(pieces):
            node = 0
            for c in piece:
                key = (node, ord(c))
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(self.piece)
                    self.piece.append(-1)
            self.piece[node] = number
        self.piece = np.array(self.piece, np.int32)
        self.parent = np.fromiter((k[0] for k in edges), np.int64, len(edges))
        self.char = np.fromiter((k[1] for k in edges), np.int64, len(edges))
        self.child = np.fromiter(edges.values(), np.int64, len(edges))
        self.n_pieces = len(pieces)

    def arcs(self, chars: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces) of all pieces in the padded words ``chars``, by begin, then end."""
        alphabet = np.unique(chars)
        number = np.zeros(0x110001, np.int32)
        number[alphabet] = np.arange(len(alphabet))
        own = np.zeros(0x110001, bool)
        own[alphabet] = True
        table = np.zeros((len(self.piece), len(alphabet)), np.int32)
        some = own[self.char]
        table[self.parent[some], number[self.char[some]]] = self.child[some]
        codes = number[chars]
        width = chars.shape[1]
        for begin in range(width):
            rows = np.flatnonzero(length > begin)
            node = np.zeros(len(rows), np.int32)
            for end in range(begin + 1, width + 1):
                node = table[node, codes[rows, end - 1]]
                live = (node > 0) & (length[rows] >= end)
                rows, node = rows[live], node[live]
                if not len(rows):
                    break
                hit = self.piece[node] >= 0
                if hit.any():
                    yield begin, end, rows[hit], self.piece[node[hit]]


class Lattice:
    """Sums over all segmentations of words, in logarithms.

    ``pieces`` are the vocabulary; numbers from ``len(pieces)`` on stand for the 256
    bytes, into which a character falls that has no piece of its own.
    """

    def __init__(self, pieces: Sequence[str]):
        self.trie = PieceTrie(pieces)
        self.single = {p: i for i, p in enumerate(pieces) if len(p) == 1}
        self.size = len(pieces) + 256

    def _padded(self, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(length, kind="stable")
        lo = 0
        while lo < len(order):
            hi = min(len(order), lo + max(1, min(16384, (1 << 20) // int(length[order[min(lo + 16384, len(order)) - 1]]))))
            some = order[lo:hi]
            width = int(length[some].max())
            text = "".join((_MARK + words[i].replace(_MARK, _OTHER)).ljust(width, "\0") for i in some)
            chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64).reshape(len(some), width)
            yield some, chars, length[some]
            lo = hi

    def _arcs(self, chars: np.ndarray, length: np.ndarray, log_p: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        out = [(b, e, rows, piece, log_p[piece]) for b, e, rows, piece in self.trie.arcs(chars, length)]
        known = np.zeros(0x110001, bool)
        known[[ord(p) for p in self.single]] = True
        base = self.size - 256
        bad_row, bad_at = np.nonzero(~known[chars] & (np.arange(chars.shape[1]) < length[:, None]))
        for row, at in zip(bad_row.tolist(), bad_at.tolist()):
            raw = chr(int(chars[row, at])).encode("utf-8", "replace")
            cost = log_p[[base + x for x in raw]].sum()
            out.append((at, at + 1, np.array([row]), np.array([-1]), np.array([cost])))
        return out

    def log_probs(self, words: Sequence[str], log_p: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability: forward recursion over the lattice."""
        out = np.empty(len(words))
        for some, chars, length in self._padded(words):
            alpha = self._forward(sorted(self._arcs(chars, length, log_p), key=lambda a: a[0]), chars.shape)
            out[some] = alpha[np.arange(len(some)), length]
        return out

    @staticmethod
    def _forward(arcs: list, shape: tuple[int, int]) -> np.ndarray:
        alpha = np.full((shape[0], shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for begin, end, rows, _, value in arcs:
            alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, begin] + value)
        return alpha

    def expected_counts(self, words: Sequence[str], weight: np.ndarray, log_p: np.ndarray, own: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each piece and byte is used, over all segmentations by their probability, weighted; and each word's own piece.

        ``own`` has the logarithmic probability of the piece that is the word itself, -inf where there is none; that
        piece is used ``most`` times at most, and the vocabulary's pieces for the rest.
        """
        total, taken = np.zeros(self.size), np.zeros(len(words))
        for some, chars, length in self._padded(words):
            arcs = sorted(self._arcs(chars, length, log_p), key=lambda a: a[0])
            alpha = self._forward(arcs, chars.shape)
            beta = np.full_like(alpha, -np.inf)
            every = np.arange(len(some))
            beta[every, length] = 0
            whole = alpha[every, length]
            taken[some] = np.minimum(weight[some] * np.exp(own[some] - np.logaddexp(whole, own[some])), most[some])
            left = weight[some] - taken[some]
            for begin, end, rows, piece, value in reversed(arcs):
                after = beta[rows, end] + value
                beta[rows, begin] = np.logaddexp(beta[rows, begin], after)
                share = np.exp(alpha[rows, begin] + after - whole[rows]) * left[rows]
                if piece[0] >= 0:
                    total += np.bincount(piece, weights=share, minlength=self.size)
                else:
                    for x in chr(int(chars[rows[0], begin])).encode("utf-8", "replace"):
                        total[self.size - 256 + x] += share[0]
        return total, taken


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each slice with their occurrences in training texts, and in all."""
    for batch in batches:
        train = batch.column(0).to_numpy(zero_copy_only=False)
        buf, offsets = text_buffer(batch.column(1))
        for lo, hi in slices(offsets):
            words = Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            order = np.argsort(words.hash)
            fresh = np.ones(len(order), bool)
            fresh[1:] = words.hash[order[1:]] != words.hash[order[:-1]]
            first = order[fresh]
            counted = np.concatenate([[0], np.cumsum(train[lo:hi][words.doc[order]].astype(np.int64))])
            edge = np.append(np.flatnonzero(fresh), len(order))
            count = counted[edge[1:]] - counted[edge[:-1]]
            columns = [pa.array(signed(words.hash[first])), pa.array(words.strings(first), pa.string()), pa.array(count), pa.array(np.diff(edge))]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "word", "c", "n"])


def word_pieces(vocab: Sequence[tuple[str, float]], scores: str) -> tuple[list[str], np.ndarray]:
    """The pieces that words can be made of, with the 256 bytes after them, and their logarithmic weights.

    ``scores`` says what the vocabulary's scores are: ``log``, logarithms of
    probabilities, or ``rank``, negated ranks, to which Zipf's law gives one over the rank.
    A byte has the weight of the least piece.
    """
    own = [(p, s) for p, s in vocab if not (p.startswith("<") and p.endswith(">")) and _MARK not in p[1:]]
    score = np.array([s for _, s in own])
    weight = {"log": lambda: score, "rank": lambda: -np.log(2 - score)}[scores]()
    weight = np.append(weight, np.full(256, weight.min(initial=0.0)))
    return [p for p, _ in own], weight - np.logaddexp.reduce(weight)


def _own(e: np.ndarray, log_total: float) -> np.ndarray:
    """Logarithmic probabilities of words as pieces, from their expected counts; -inf where that is 0."""
    with np.errstate(divide="ignore"):
        return np.log(e) - log_total


_WORDS = "h bigint, word string, c bigint, n bigint, e double"


def fit_pieces(words: DataFrame, ends: int, pieces: Sequence[str], log_p: np.ndarray, rounds: int, discount: float) -> tuple[DataFrame, np.ndarray, float, float, float]:
    """Pieces, words as pieces, and the end, fitted to ``words`` (``h, word, c, n``) by expectation maximisation.

    A text is a sequence of choices: at the beginning of a word, one of the words of the training texts as a whole, or
    a piece that begins a word, or the text's end; inside a word, a further piece, or the word's end. So two sets of
    probabilities have the sum 1 each. Those of the pieces begin at ``log_p``, with half of the sum for whole words and for
    the word's end; then each is its expected share, 0.01 added to all but whole words. Of each word's occurrences ``discount`` at least
    are made of pieces, which by that stand for words that no text has yet. Returns the words with the
    expected count ``e`` of their own piece, the logarithms of the pieces' probabilities, of the text's end and of the word's end,
    and that of the sum of the counts at the beginning of words. The words stay in Spark; what reaches the driver is a sum for each piece of the vocabulary.
    """
    spark = words.sparkSession
    lattice = spark.sparkContext.broadcast(Lattice(pieces))

    def expected(weights):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log_p, log_total, log_stop = weights.value
            total = np.zeros(lattice.value.size)
            for batch in batches:
                c, e = batch.column(2).to_numpy().astype(float), batch.column(4).to_numpy().copy()
                some = np.flatnonzero(c > 0)
                used, e[some] = lattice.value.expected_counts(batch.column(1).take(pa.array(some)).to_pylist(), c[some], log_p, _own(e[some], log_total) - log_stop, c[some] - discount)
                total += used
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(e), pa.nulls(len(e), pa.int32()), pa.nulls(len(e), pa.float64())], names=_EXPECTED)
            some = np.flatnonzero(total)
            none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.array(total[some])], names=_EXPECTED)

        return run

    state = words.select("h", "word", "c", "n", F.col("c").cast("double").alias("e"))
    every = words.agg(F.sum("c").alias("c")).first()["c"] or 0
    begins = np.array([p.startswith(_MARK) for p in pieces] + [False] * 256)
    log_p = log_p.copy()
    for group in (begins, ~begins):
        log_p[group] -= np.logaddexp.reduce(log_p[group], initial=-np.inf) + np.log(2)
    log_total, log_stop, log_end = float(np.log(2 * max(every, 1))), float(-np.log(2)), 0.0
    for _ in range(rounds):
        weights = spark.sparkContext.broadcast((log_p, log_total, log_stop))
        made = staged(state.mapInArrow(expected(weights), f"{_WORDS}, piece int, used double"))
        used = made.filter("piece IS NOT NULL").groupBy("piece").agg(F.sum("used").alias("used")).toPandas()
        count = np.full(len(log_p), 0.01)
        count[used["piece"].to_numpy(int)] += used["used"].to_numpy(float)
        state = made.filter("piece IS NULL").select("h", "word", "c", "n", "e")
        sums = state.agg(F.sum("e").alias("e"), F.sum(F.col("c") - F.col("e")).alias("rest")).first()
        stops = (sums["rest"] or 0.0) + 0.01
        log_total = float(np.log(count[begins].sum() + (sums["e"] or 0.0) + ends + 0.01))
        log_inside = float(np.log(count[~begins].sum() + stops))
        log_p = np.log(count) - np.where(begins, log_total, log_inside)
        log_end, log_stop = float(np.log(ends + 0.01)) - log_total, float(np.log(stops)) - log_inside
    return state, log_p, log_end, log_stop, log_total


_EXPECTED = ["h", "word", "c", "n", "e", "piece", "used"]


def score_documents(docs: DataFrame, *, path: str | None = None, scores: str = "rank", rounds: int = 2, discount: float = 0.75, head: int = HEAD_WORDS) -> DataFrame:
    """log10 probability of each whole text under a subword lattice model fitted to the table.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Text is
    lower-cased (A-Z); tokens are its runs without space and ``\\t\\n\\v\\f\\r`` and one
    end. Learned from are rows whose crc32(doc_id as text) modulo 7 isn't 2. Returns
    a row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``. ``base_score`` sums log10((c + 1) / (N + V + 1)).

    ``score`` is the marginal over all ways to cut the text into pieces, as no piece crosses words: the sum over its
    words of the forward recursion's result with the word's end, and the text's end; it is a probability of texts. Pieces are those of a public unigram vocabulary (``path``),
    and every word of the training texts, so they grow with the table. Their probabilities begin at the vocabulary's
    scores (of the kind ``scores``) and at the words' counts, and are fitted to all training words by ``rounds`` rounds of
    expectation maximisation, in which each word leaves ``discount`` (between 0 and 1) of its occurrences to the vocabulary.

    Counting, fitting and scoring go over the distinct words, which Spark gathers. The
    values of the ``head`` words that occur most often in all texts are broadcast; of all
    other words a document has a row for each, which is joined with the word table. Null
    texts are empty, with the end as their only token. Null ids are learned from; repeated
    rows count each time; an empty table gives no rows.
    """
    lean_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    counts = rows.select(~F.col("held_out"), "text").mapInArrow(_word_counts, "h bigint, word string, c bigint, n bigint")
    words = staged(counts.groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    ends = rows.filter(~F.col("held_out")).count()
    size = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (size["n"] or 0) + ends, size["v"] + (ends > 0)

    pieces, log_p = word_pieces(vocabulary.load(path)[0], scores)
    words, log_p, log_end, log_stop, log_total = fit_pieces(words, ends, pieces, log_p, rounds, discount)
    lattice, weights = spark.sparkContext.broadcast(Lattice(pieces)), spark.sparkContext.broadcast(log_p)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.logaddexp(lattice.value.log_probs(batch.column(1).to_pylist(), weights.value) + log_stop, _own(batch.column(4).to_numpy(), log_total)) / _LOG10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(value)], names=["h", "c", "n", "score"])

    def base(c: Column) -> Column:
        return F.log10((c + 1) / F.lit(float(n + v + 1)))

    values = words.mapInArrow(marginal, "h bigint, c bigint, n bigint, score double")
    values = staged(values.select("h", "n", (F.col("c") > 0).cast("int").alias("known"), base(F.col("c")).alias("base"), "score"))
    end_score = log_end / _LOG10
    end = spark.range(1).select(base(F.lit(ends)).alias("b"), F.lit(end_score).alias("s")).first()
    often = values.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(100_000).toArrow().to_pandas()
    fits = often[often["k"].cumsum() <= head]
    least = int(fits["n"].min()) if len(fits) else (int(often["n"].max()) + 1 if len(often) else 0)
    top: pd.DataFrame = values.filter(F.col("n") >= least).toArrow().to_pandas().sort_values("h")
    table = spark.sparkContext.broadcast((top["h"].to_numpy(np.int64), top[_SUMS].to_numpy(float)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums of its frequent words, and one for each of its other words with their number."""
        keys, known = table.value
        for batch in batches:
            buf, offsets = text_buffer(batch.column(3))
            for lo, hi in slices(offsets):
                k = hi - lo
                words_ = Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                h = signed(words_.hash)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                sums = [np.bincount(words_.doc[hit], weights=known[at[hit], i], minlength=k) if hit.any() else np.zeros(k) for i in range(len(_SUMS))]
                own = batch.slice(lo, k)
                ids = [own.column(i) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*ids, pa.nulls(k, pa.int64()), pa.array(np.diff(words_.first) + 1), *map(pa.array, sums)], names=_SPLIT)
                order = np.lexsort((h[~hit], words_.doc[~hit]))
                doc, other = words_.doc[~hit][order], h[~hit][order]
                if len(doc):
                    fresh = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])))
                    m, times = len(fresh), np.diff(np.append(fresh, len(doc)))
                    ids = [own.column(0).take(pa.array(doc[fresh])), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(other[fresh]), pa.array(times), *[pa.nulls(m, pa.float64())] * len(_SUMS)], names=_SPLIT)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    parts = staged(numbered.mapInArrow(split, "row bigint, doc_id bigint, held_out boolean, h bigint, n_tokens bigint, " + ", ".join(f"{x} double" for x in _SUMS)))
    rest = parts.filter("h IS NOT NULL").select("row", "h", F.col("n_tokens").alias("k"))
    tail = rest.join(values.filter(F.col("n") < least), "h").groupBy("row").agg(*(F.sum(F.col(x) * F.col("k")).alias(f"more_{x}") for x in _SUMS))
    whole = parts.filter("h IS NULL").join(tail, "row", "left")
    total = {x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0.0)) for x in _SUMS}
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (total["known"] + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (total["base"] + end["b"]).alias("base_score"),
        (total["score"] + end["s"]).alias("score"),
    )


_SUMS = ["known", "base", "score"]
_SPLIT = ["row", "doc_id", "held_out", "h", "n_tokens", *_SUMS]
