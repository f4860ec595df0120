"""Quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean_batches, staged
from .textbatch import Words, slices, text_buffer


def _classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    ascii_ = [chr(i) for i in range(128)] + [""] * 128
    of = lambda f: np.array([bool(c) and f(c) for c in ascii_])
    return {
        "upper": of(str.isupper),
        "lower": of(str.islower),
        "wide": b >= 0xC0,  # first byte of a character beyond ASCII
        "digit": of(str.isdigit),
        "stop": of(lambda c: c in ".?"),
        "shout": of(lambda c: c == "!"),
        "comma": of(lambda c: c in ",;:"),
        "bar": of(lambda c: c == "|"),
        "symbol": of(lambda c: c in "#$%&*+=<>@^_~\\/{}[]"),
        "newline": of(lambda c: c == "\n"),
    }


def document_statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; a text without words has zeros where a share isn't defined.

    Shares enter as log(share + 0.005), counts as log(1 + count), so that the
    classes are nearer to normal.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    share = lambda x, y: np.log(np.where(y > 0, x / np.maximum(y, 1), 0) + 0.005)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    counts = {k: per_text(t[buf]) for k, t in _classes().items()}
    words = Words(buf, offsets)
    m = np.diff(words.first)
    length = (words.end - words.start).astype(float)
    add = lambda x: np.bincount(words.doc, weights=x, minlength=n)
    mean = add(length) / np.maximum(m, 1)
    spread = np.sqrt(np.maximum(add(length * length) / np.maximum(m, 1) - mean * mean, 0))
    order = np.lexsort((words.hash, words.doc))
    d, h = words.doc[order], words.hash[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    runs = np.flatnonzero(fresh)
    often = np.zeros(n)
    np.maximum.at(often, d[runs], np.diff(np.append(runs, len(h))).astype(float))
    distinct = np.bincount(d[runs], minlength=n)
    again = np.zeros(len(words), bool)
    if len(words) > 1:
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    lines = counts["newline"] + 1
    letters = counts["upper"] + counts["lower"] + counts["wide"]
    columns = [
        np.log1p(m),
        np.log1p(mean),
        np.log1p(spread),
        share(letters, size),
        share(counts["upper"], letters),
        share(counts["digit"], size),
        share(counts["stop"], m),
        share(counts["shout"], m),
        share(counts["comma"], m),
        share(counts["bar"], m),
        share(counts["symbol"], m),
        share(distinct, np.maximum(m, 1)),
        np.log(np.maximum(distinct, 1)) / np.log(np.maximum(m, 2)),
        share(often, m),
        share(add(again), m),
        share(add(length <= 3), m),
        share(add(length >= 14), m),
        np.log1p(m / lines),
        np.log1p(lines),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


FEATURES = 19


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        for lo, hi in slices(offsets):
            x = document_statistics(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            flat = pa.array(x.reshape(-1))
            edges = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1])
            rest = [batch.column(i).slice(lo, hi - lo) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(edges, flat), *rest],
                names=["doc_id", "x", *batch.schema.names[2:]],
            )


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of the rows of each class, as numbered cells."""
    d = FEATURES
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        for k in (0, 1):
            z = x[y == k]
            total[k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)])
    cells = np.arange(total.size)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total.reshape(-1))], names=["cell", "value"])


class Discriminant:
    """Two normal densities with shrunken covariances and their priors.

    A class covariance is ``(1 - pool) * own + pool * common``, and then
    ``(1 - ridge) * that + ridge * diagonal of the common one``. Factors are made
    once; a score is the logistic of the difference of log densities plus log prior
    odds.
    """

    def __init__(self, totals: np.ndarray, pool: float, ridge: float):
        d = FEATURES
        n = totals[:, 0]
        self.share = float((n[1] + 1) / (n.sum() + 2))
        self.factors: list[tuple[np.ndarray, np.ndarray, float]] = []
        if min(n) < 2:
            return
        mean = totals[:, 1 : 1 + d] / n[:, None]
        second = totals[:, 1 + d :].reshape(2, d, d) / n[:, None, None]
        own = second - mean[:, :, None] * mean[:, None, :]
        common = (own * n[:, None, None]).sum(axis=0) / n.sum()
        diagonal = np.diag(np.maximum(np.diag(common), 1e-4))
        for k in (0, 1):
            cov = (1 - ridge) * ((1 - pool) * own[k] + pool * common) + ridge * diagonal
            lower = np.linalg.cholesky(cov)
            self.factors.append((mean[k], np.linalg.inv(lower), float(-np.log(np.diag(lower)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.share)
        logs = []
        for mean, inverse, log_det in self.factors:
            z = (x - mean) @ inverse.T
            logs.append(log_det - 0.5 * (z * z).sum(axis=1))
        odds = np.clip(logs[1] - logs[0] + np.log(self.share / (1 - self.share)), -700, 700)
        return 1 / (1 + np.exp(-odds))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _fit(features: DataFrame, labels: DataFrame, pool: float, ridge: float) -> Discriminant:
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y IN (0, 1)")
    rows = features.filter(~_held_out(F.col("doc_id"))).join(own, "doc_id").select("y", "x")
    cells = rows.mapInArrow(_moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    totals = np.zeros(2 * (1 + FEATURES + FEATURES * FEATURES))
    totals[cells["cell"].to_numpy(int)] = cells["value"].to_numpy(float)
    return Discriminant(totals.reshape(2, -1), pool, ridge)


def score_quality(docs: DataFrame, labels: DataFrame, *, pool: float = 0.3, ridge: float = 0.05) -> DataFrame:
    """A quality score of each whole text, learned from ``labels.quality``.

    ``docs`` needs ``doc_id, text``, ``labels`` needs ``doc_id, quality`` (0 or 1;
    other values and nulls are left out); further columns are ignored. Only rows
    whose crc32(doc_id as text) modulo 3 isn't 1 are learned from. Returns a row per
    row of ``docs``: ``doc_id, held_out, score`` (0 to 1) and ``predicted``.

    One pass makes the statistics of all texts, which are written once; class
    counts, sums and products are summed in Spark to some 760 numbers, whatever the
    size of the input. Null or empty texts are scored by their statistics too. If a
    class has fewer than two rows, all scores are the (smoothed) share of label 1.
    Null ids are scored, never learned from; repeated rows count each time; an empty
    table gives no rows.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = staged(rows.mapInArrow(_features, "doc_id bigint, x array<double>"))
    model = docs.sparkSession.sparkContext.broadcast(_fit(features, labels, pool, ridge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(batch.column(2).flatten().to_numpy().reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return features.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(
        run, "doc_id bigint, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, labels: DataFrame, *, pool: float = 0.3, ridge: float = 0.05, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``.

    The model is that of ``score_quality``, and so are the cases: null and empty texts
    are judged by their statistics, rows with a null id are judged and not learned
    from, repeated rows stay or go together, an empty table gives no rows. Texts aren't
    shuffled: they are read a second time to be scored in place.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = staged(rows.mapInArrow(_features, "doc_id bigint, x array<double>"))
    model = docs.sparkSession.sparkContext.broadcast(_fit(features, labels, pool, ridge))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(column))
            for lo, hi in slices(offsets):
                x = document_statistics(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield batch.slice(lo, hi - lo).filter(pa.array(model.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
