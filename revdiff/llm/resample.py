"""Importance resampling: documents drawn so that their word features resemble a target's."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .storage import lean_batches, staged
from .textbatch import ALNUM, Words, slices, text_buffer


def _crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial of zlib's crc32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()
#: Bytes up to which equal features are found by sorting; longer ones, which are few, by a dictionary.
_SORTED_BYTES = 64


def crc32_of_rows(matrix: np.ndarray) -> np.ndarray:
    """crc32 of each row of a matrix of bytes, all rows advanced one column at a time."""
    c = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in matrix.T:
        c = _CRC[(c ^ column) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    return ~c


def _distinct_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row of each kind, and each row's kind."""
    n, width = matrix.shape
    if width > _SORTED_BYTES:
        kinds: dict[bytes, int] = {}
        of = np.fromiter((kinds.setdefault(r.tobytes(), len(kinds)) for r in matrix), np.int64, n)
        return np.unique(of, return_index=True)[1], of
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = matrix
    words = words.view(np.uint64)
    order = np.lexsort(words.T)
    ranked = words[order]
    new = np.ones(n, bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def feature_buckets(raw: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> np.ndarray:
    """crc32 modulo ``buckets`` of each feature ``raw[start[i]:end[i]]``.

    Features of equal length are the rows of one matrix of bytes; its distinct rows get
    their checksums together, which are then scattered back to all places.
    """
    out = np.empty(len(start), np.int64)
    size = end - start
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for width, lo, hi in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        at = order[lo:hi]
        matrix = np.lib.stride_tricks.sliding_window_view(raw, width)[start[at]]
        one, of = _distinct_rows(matrix)
        out[at] = (crc32_of_rows(matrix[one]) % np.uint32(buckets)).astype(np.int64)[of]
    return out


class Features:
    """Runs of 1 to ``n`` words of some texts: ``bucket`` and ``doc`` of each, ``count`` by text, ``words`` by text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, n: int, buckets: int):
        w = Words(buf, offsets, ALNUM)
        size = w.end - w.start
        start = np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 0x20, np.uint8)  # each word and one space
        inside = w.buf[ALNUM[w.buf]]
        joined[np.arange(len(inside)) + np.repeat(np.arange(len(w)), size)] = inside
        self.words = np.diff(w.first)
        found, doc = [], []
        for g in range(1, n + 1):
            at = np.flatnonzero(np.arange(len(w)) + g <= w.first[1:][w.doc]) if len(w) else np.zeros(0, np.int64)
            found.append(feature_buckets(joined, start[at], (start + size)[at + g - 1], buckets))
            doc.append(w.doc[at])
        self.bucket, self.doc = np.concatenate(found), np.concatenate(doc)
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)


def _counted(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets):
                total += np.bincount(Features(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n, buckets).bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def _weighed(n: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                f = Features(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n, len(gains))
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, f.doc, gains[f.bucket])
                weight = total // np.maximum(f.count, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in (f.words, f.count, weight))],
                    names=["doc_id", "digest", "n_words", "n_features", "weight"],
                )

    return run


def feature_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How often the features of all texts (column ``text``) fall into each bucket: ``buckets`` numbers, whatever the input."""
    found = texts.select(F.col("text").cast("string")).mapInArrow(_counted(n, buckets), "bucket int, n bigint")
    found = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the source, with one added to each count."""
    k = float(len(source))
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _noise(seed: int, doc_id: Column) -> Column:
    """floor(1000 times a draw of Gumbel's distribution), from the id and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def importance_scores(docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """``doc_id, digest, n_words, n_features, weight, score`` of each row of ``docs``; ``digest`` is a hash of its text.

    ``docs`` needs ``doc_id`` (bigint) and ``text``, ``target`` ``text``; other columns are ignored. Text is
    lower-cased (A-Z) and split into words of ``0-9a-z`` and characters beyond ASCII. Features are runs of 1 to
    ``n`` words, repeats counted, put into ``buckets`` by their crc32. A bucket's gain compares its share in
    ``target`` with that in ``docs``; ``weight`` is the floored mean of a text's gains, ``score`` adds a draw of
    Gumbel's distribution made from the id: the highest scores are a draw without replacement by weight.

    Texts are read twice, once for the counts, and never shuffled; what reaches the driver is ``buckets`` counts.
    Null or empty text has no feature and weight 0. A null id draws as an empty one would. Rows that share
    an id share the draw and are weighed each by its own text. An empty ``target`` or ``docs`` counts nothing.
    """
    lean_batches(docs.sparkSession)
    gains = bucket_gains(feature_counts(docs, n, buckets), feature_counts(target, n, buckets))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(_weighed(n, gains), "doc_id bigint, digest bigint, n_words bigint, n_features bigint, weight bigint")
    return made.withColumn("score", F.col("weight") + _noise(seed, F.col("doc_id")))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024
) -> DataFrame:
    """``importance_scores`` with ``rank``: 1, 2, 3 ... of the drawn rows, best first, null for the others.

    Of the N rows with at least ``min_words`` words, ``floor(percent * N / 100)`` with the highest scores are drawn;
    ties go to the smaller id, a null id last, then to fewer features, then to the smaller digest. A histogram of
    the scores finds the lowest score drawn; only rows from there on are sorted, by ranges. Scores are whole
    thousandths of logarithms of ratios of counts, so the histogram has about 10^5 rows at most, whatever
    the input. Rows equal in id and text have ranks of their own. No row of ``docs`` is left out.
    """
    made = staged(importance_scores(docs, target, n=n, buckets=buckets, seed=seed))
    able = F.col("n_words") >= min_words
    hist = made.filter(able).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    total = np.cumsum(hist["n"].to_numpy()) if len(hist) else np.zeros(1, np.int64)
    drawn = int(total[-1]) * percent // 100
    if not drawn:
        return made.withColumn("rank", F.lit(None).cast("bigint"))
    lowest = hist["score"][int(np.searchsorted(total, drawn))].as_py()
    near = able & (F.col("score") >= lowest)
    best = numbered(made.filter(near), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("digest").asc()], "rank")
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.unionByName(made.filter(~near).withColumn("rank", F.lit(None).cast("bigint")))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns; ``options`` are those of ``importance_resample``.

    Rows are found again by id and text. Of rows equal in both, all stay if one is drawn.
    """
    chosen = importance_resample(docs, target, **options).filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id"), F.col("digest").alias("drawn_digest")).distinct()
    id_key, text_key = "drawn_by_id", "drawn_by_text"
    while {id_key, text_key} & set(docs.columns):
        id_key, text_key = id_key + "_", text_key + "_"
    keyed = docs.withColumn(id_key, F.col("doc_id").cast("bigint")).withColumn(text_key, F.xxhash64(F.col("text").cast("string")))
    same = keyed[id_key].eqNullSafe(chosen["drawn_id"]) & (keyed[text_key] == chosen["drawn_digest"])
    return keyed.join(chosen, same, "left_semi").drop(id_key, text_key)
