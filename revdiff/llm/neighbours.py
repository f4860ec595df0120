"""Nearest neighbours by query-aware collision counting."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged

#: Numbers of a data block, about: 16,384 vectors of 64 numbers.
BLOCK_VALUES = 1 << 20
#: Vectors to which the cells are fitted, fewest of them in a cell, and the dimensions in which cells are boxes.
SAMPLE_ROWS, LEAST_SAMPLE, COARSE = 4096, 8, 4
#: Candidates of a query in a block at least, if it has so many rows.
LEAST_CANDIDATES = 256
#: Times that windows are grown; a query that hasn't enough candidates by then is compared with its whole block.
MOST_GROWTHS = 400


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` to ``q``, also where squares overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt(((x - q) ** 2).sum(axis=1))
        for i in np.flatnonzero(~np.isfinite(out)).tolist():
            d = np.abs(x[i] - q)
            most = d.max()
            out[i] = most * np.sqrt(((d / most) ** 2).sum()) if np.isfinite(most) else np.inf
    return out


@dataclass
class Cells:
    """Boxes that part the space of a few orthonormal projections, fitted to a sample.

    A box is halved at the sample's median, in its widest dimension, the fullest box
    first, while a half keeps ``LEAST_SAMPLE`` vectors.
    """

    axes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sample: np.ndarray
    ids: np.ndarray

    @classmethod
    def fitted(cls, x: np.ndarray, ids: np.ndarray, count: int, seed: int = 8) -> Cells:
        d = x.shape[1]
        axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(COARSE, d))))[0]
        at = x @ axes
        boxes = [(np.arange(len(x)), np.full(axes.shape[1], -np.inf), np.full(axes.shape[1], np.inf))]
        done = []
        while boxes and len(boxes) + len(done) < count:
            boxes.sort(key=lambda b: len(b[0]))
            rows, low, high = boxes.pop()
            spread = np.ptp(at[rows], axis=0) if len(rows) else np.zeros(1)
            axis = int(spread.argmax())
            cut = float(np.median(at[rows, axis])) if len(rows) else 0.0
            below = at[rows, axis] < cut
            if min(below.sum(), (~below).sum()) < LEAST_SAMPLE:
                done.append((rows, low, high))
                continue
            upper, lower = low.copy(), high.copy()
            upper[axis] = lower[axis] = cut
            boxes += [(rows[below], low, lower), (rows[~below], upper, high)]
        every = boxes + done
        return cls(axes, np.array([b[1] for b in every]), np.array([b[2] for b in every]), x, ids)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = x @ self.axes
        out = np.empty(len(x), np.int32)
        for lo in range(0, len(x), 4096):
            part = at[lo : lo + 4096, None, :]
            out[lo : lo + 4096] = ((part >= self.low) & (part < self.high)).all(axis=2).argmax(axis=1)
        return out

    def near(self, q: np.ndarray, own: int, k: int) -> np.ndarray:
        """Cells that may hold one of the k nearest of ``q``.

        The k-th nearest in the sample bounds the distance. A difference keeps no more than
        a share of its length in a few random dimensions, but for a chance of about a
        thousandth.
        """
        d = distances(self.sample, q)[self.ids != own]
        _, first = np.unique(self.ids[self.ids != own], return_inverse=True)
        least = np.full(int(first.max(initial=-1)) + 1, np.inf)
        np.minimum.at(least, first, d)
        if len(least) < k:
            return np.arange(len(self.low))
        c = self.axes.shape[1]
        reach = min(1.0, math.sqrt((c + 3 * math.sqrt(2 * c)) / len(q))) * np.partition(least, k - 1)[k - 1]
        at = q @ self.axes
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        return np.flatnonzero(~(np.sqrt((gap * gap).sum(axis=1)) > reach))


class CollisionIndex:
    """Sorted projections of one block of vectors.

    A query stands in the middle of a window on each projection. Windows are grown
    together, step by step (virtual rehashing: nothing is hashed anew), and a vector
    counts one collision for each window that reaches it. Vectors with at least
    ``threshold`` of all projections are candidates, whose distances are computed;
    growing ends as soon as there are ``LEAST_CANDIDATES`` and a share of ``beta`` of the
    block. Rows of one id count as one candidate.
    """

    def __init__(self, x: np.ndarray, projections: int, seed: int = 6, ids: np.ndarray | None = None):
        self.x = x
        self.id = np.arange(len(x)) if ids is None else np.unique(ids, return_inverse=True)[1]
        self.ids = int(self.id.max(initial=-1)) + 1
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((x.shape[1], projections))
        self.scale = max(float(np.abs(x).max(initial=0)), 1e-300)
        h = (x / self.scale) @ self.a
        self.order = np.argsort(h, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(h, self.order.T, axis=0).T.copy()
        self.unit = float(np.median(h.std(axis=0))) if len(x) > 1 else 1.0

    def _windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and end of each query's window on each projection."""
        lo, hi = np.empty(at.shape, np.int64), np.empty(at.shape, np.int64)
        for j in range(at.shape[1]):
            lo[:, j] = np.searchsorted(self.sorted[j], at[:, j] - half, side="left")
            hi[:, j] = np.searchsorted(self.sorted[j], at[:, j] + half, side="right")
        return lo, hi

    def search(self, queries: np.ndarray, k: int, threshold: float, beta: float, growth: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of its candidates and their distances."""
        n, m = len(self.x), self.a.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.nan_to_num(np.clip(queries / self.scale, -1e150, 1e150) @ self.a)
        need = math.ceil(threshold * m)
        wanted = min(self.ids, max(LEAST_CANDIDATES, k + 1, math.ceil(beta * self.ids)))
        rows = max(wanted, math.ceil(beta * n))
        half = max(self.unit, 1e-12) / 2
        count = np.zeros((len(queries), n), np.int16)
        old_lo = old_hi = self._windows(at, -1e-300)[0]
        active, out = np.arange(len(queries)), [None] * len(queries)
        for _ in range(MOST_GROWTHS):
            if not len(active):
                break
            lo, hi = self._windows(at[active], half)
            left = []
            for i, q in enumerate(active.tolist()):
                a, b, c, d = lo[i].tolist(), old_lo[i].tolist(), old_hi[i].tolist(), hi[i].tolist()
                parts = [self.order[j, a[j] : b[j]] for j in range(m)] + [self.order[j, c[j] : d[j]] for j in range(m)]
                count[q] += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
                found = np.flatnonzero(count[q] >= need)
                enough = len(found) >= rows and (self.ids == n or len(np.unique(self.id[found])) >= wanted)
                if enough or (hi[i] - lo[i]).min() == n:
                    out[q] = (found, distances(self.x[found], queries[q]))
                else:
                    left.append(i)
            active, old_lo, old_hi = active[left], lo[left], hi[left]
            half *= growth
        for q in active.tolist():
            out[q] = (np.arange(n), distances(self.x, queries[q]))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


_KEY = ["size", "cell", "part"]


def nearest_neighbours(
    vectors: DataFrame,
    *,
    k: int = 10,
    every: int = 100,
    projections: int = 96,
    threshold: float = 0.8,
    beta: float = 0.18,
    growth: float = 1.1,
) -> DataFrame:
    """The ``k`` nearest rows found for each row whose ``vec_id`` is divisible by ``every``.

    ``vectors`` needs ``vec_id`` and ``embedding`` (array of numbers); other columns are
    ignored. Returns ``query_id, rank`` (from 1), ``vec_id, score``: the Euclidean
    distance of the original vectors in double precision; nearest first, ties to
    the smaller id. A query's own id is no candidate; with fewer than ``k`` candidates
    all are returned.

    All rows are indexed, each in one block of about ``BLOCK_VALUES`` numbers, and every
    block's index is built once. Blocks are cells of a space of ``COARSE`` dimensions,
    fitted to a sample of ``SAMPLE_ROWS`` rows; larger cells, as of equal vectors, are dealt
    to several blocks by a hash of id and vector. A query goes to the blocks of those cells
    alone that can hold one of its nearest, judged by its k-th nearest in the sample; they
    are few where the data have clusters, and all where they are spread evenly. Rows and
    queries are streamed to a block's task, which holds the block and a batch of
    queries. Each block gives at most the k nearest ids a query, and the best of
    these are ranked. ``beta`` is the share of a block whose distances are computed at least,
    which is what recall depends on (measured in the tests and the README).

    Rows with a null id take no part, nor do vectors that are null, empty, zero, or
    hold a null or a non-finite number; vectors of another length than the query's
    are not compared (lengths other than the sample's most frequent one have one cell). A
    repeated id is returned once a query, at its least distance. An empty table gives no
    rows.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id IS NOT NULL AND size(x) > 0")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = x.filter(finite & F.exists("x", lambda v: v != 0)).withColumn("size", F.size("x"))
    x = staged(x.distinct())  # equal rows are one
    key = F.xxhash64("vec_id", "x")
    taken = x.orderBy(key).limit(SAMPLE_ROWS).toArrow()
    sizes = taken["size"].to_numpy()
    common = int(np.bincount(sizes).argmax()) if len(sizes) else 1
    own = taken.filter(pa.array(sizes == common)) if len(sizes) else taken
    block_rows = max(1, BLOCK_VALUES // common)
    cells = spark.sparkContext.broadcast(
        Cells.fitted(_matrix(own["x"].combine_chunks()) if len(sizes) else np.zeros((0, 1)), own["vec_id"].to_numpy(), math.ceil(x.count() / block_rows))
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            some = batch.column(2).to_numpy() == common
            if some.any():
                cell[some] = cells.value.of(_matrix(batch.column(1).filter(pa.array(some))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "x", "size", "cell"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            near = [cells.value.near(_matrix(batch.column(1).slice(i, 1))[0], ids[i], k) if size[i] == common else np.zeros(1, np.int64) for i in range(len(ids))]
            of = pa.array(np.repeat(np.arange(len(ids)), [len(c) for c in near]))
            cell = np.concatenate(near).astype(np.int32) if near else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns), pa.array(cell)], names=["vec_id", "x", "size", "cell"])

    schema = "vec_id bigint, x array<double>, size int, cell int"
    data = staged(x.select("vec_id", "x", "size").mapInArrow(placed, schema))
    parts = staged(data.groupBy("size", "cell").agg(F.ceil(F.count("*") / F.greatest(F.lit(BLOCK_VALUES) / F.col("size"), F.lit(1))).cast("int").alias("parts")))
    queries = x.filter(F.col("vec_id") % every == 0).select("vec_id", "x", "size").mapInArrow(asked, schema)
    rows = data.join(parts, ["size", "cell"]).select(*_KEY[:2], F.pmod(key, F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "vec_id", "x")
    asks = queries.join(parts, ["size", "cell"]).select(*_KEY[:2], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "x")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks one after another: the rows of each, then its queries."""
        block, ids, held, index, indexed = None, [], [], None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                if lo == hi:
                    continue
                if block != (now := tuple(keys[lo, :3])):
                    block, ids, held, index, indexed = now, [], [], None, None
                part = batch.slice(lo, hi - lo)
                if not keys[lo, 3]:
                    ids.append(part.column(4).to_numpy())
                    held.append(_matrix(part.column(5)))
                    continue
                if index is None and ids:
                    indexed = np.concatenate(ids)
                    index = CollisionIndex(np.concatenate(held), projections, ids=indexed)
                    ids, held = [], []
                if index is not None:
                    yield answers(index, indexed, part)

    def answers(index: CollisionIndex, ids: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        own, wanted = part.column(4).to_numpy(), _matrix(part.column(5))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found_in = (pair for lo in range(0, len(own), 64) for pair in index.search(wanted[lo : lo + 64], k, threshold, beta, growth))
        for i, (found, score) in zip(own.tolist(), found_in):
            score, found = score[ids[found] != i], found[ids[found] != i]
            best = np.lexsort((ids[found], score))
            best = best[np.sort(np.unique(ids[found[best]], return_index=True)[1])[:k]]  # the nearest row of each id
            out.append((np.full(len(best), i), ids[found[best]], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*out), (np.int64, np.int64, float))], names=["query_id", "vec_id", "score"])

    streamed = rows.unionByName(asks).repartition(*_KEY).sortWithinPartitions(*_KEY, "asks", "vec_id")
    found = streamed.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
