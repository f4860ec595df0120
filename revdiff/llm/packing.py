"""Packing tokenised documents into training sequences along a Hilbert curve."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean_batches
from .textbatch import Words, slices, sorted_union, text_buffer
from .tokens import ByteBpe

BUCKETS, DIMENSIONS, BITS = 64, 3, 10


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (integers below ``2 ** bits``).

    Walks the bits from the highest: where a coordinate has the bit, the lower bits
    of the first are inverted, else they are exchanged with the first; the Gray
    code of the result, bits interleaved, is the place on the curve.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            has = (x[i] >> b) & 1 == 1
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))


def document_keys(buf: np.ndarray, offsets: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Hilbert keys of texts: signed hashed word counts, damped, of unit length, projected."""
    words, n = Words(buf, offsets), len(offsets) - 1
    bucket = (words.hash % np.uint64(BUCKETS)).astype(np.int64)
    sign = np.where((words.hash >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    v = np.bincount(words.doc * BUCKETS + bucket, weights=sign, minlength=n * BUCKETS).reshape(n, BUCKETS)
    v = np.sign(v) * np.log1p(np.abs(v))
    v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    cube = (np.tanh(0.8 * (v @ projection)) + 1) / 2
    return hilbert_key(np.minimum((cube * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


#: Rows from which the bounds of the partitions are taken, about, and bytes of text in a partition.
SAMPLE_ROWS, PARTITION_BYTES = 20_000, 32 << 20


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``place``: the Hilbert key and, below it, the highest bits of ``tie``, before the other columns; the text comes first."""
    projection = _projection()
    for batch in batches:
        buf, offsets = text_buffer(batch.column(0))
        for lo, hi in slices(offsets):
            key = document_keys(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], projection)
            own = batch.slice(lo, hi - lo)
            tie = own.column(1).to_numpy().view(np.uint64) >> np.uint64(DIMENSIONS * BITS + 1)
            place = (key << (63 - DIMENSIONS * BITS)) | tie.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), *own.columns], names=["place", *own.schema.names])


def _bounds(rows: DataFrame, partitions: int | None) -> np.ndarray:
    """Places at which partitions of about equal bytes begin, but for the first."""
    n = rows.count()
    sample = rows if n <= SAMPLE_ROWS else rows.sample(SAMPLE_ROWS / n, seed=10)
    sample = sample.mapInArrow(_places, "place bigint, text string, tie bigint, doc_id bigint").select("place", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).toArrow()
    place, size = sample["place"].to_numpy(), sample["size"].to_numpy().astype(np.int64) + 1
    if partitions is None:
        partitions = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(float(size.mean()) * n / PARTITION_BYTES)) if len(size) else 1
    order = np.argsort(place)
    reached = np.cumsum(size[order])
    at = np.searchsorted(reached, np.arange(1, partitions) * (reached[-1] if len(reached) else 0) / partitions)
    return np.unique(place[order][at]) if len(place) else place


_OUT = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]


class _Packer:
    """Cuts a stream of documents into sequences; what doesn't fill one yet is carried on."""

    def __init__(self, size: int, partition: int):
        self.size, self.next_id = size, partition << 40
        self.ids = np.zeros(0, np.uint32)
        self.doc, self.start, self.tokens, self.length = pa.array([], pa.int64()), *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, doc: pa.Array, tokens: np.ndarray, ids: np.ndarray, last: bool = False) -> pa.RecordBatch:
        self.doc = pa.concat_arrays([self.doc, doc])
        self.start = np.concatenate([self.start, np.zeros(len(tokens), np.int64)])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.length = np.concatenate([self.length, tokens])
        self.ids = np.concatenate([self.ids, ids])
        cuts = np.arange(0, len(self.ids) + 1, self.size)
        left = len(self.ids) - cuts[-1]
        if last:  # sequences whose length is a power of two need no padding
            parts = [1 << b for b in range(int(left).bit_length() - 1, -1, -1) if left >> b & 1]
            cuts = np.concatenate([cuts, cuts[-1] + np.cumsum(np.array(parts, np.int64))]).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(self.length)])
        at = sorted_union(edge[edge <= cuts[-1]], cuts)
        begin, end = at[:-1], at[1:]
        seg = np.searchsorted(edge, begin, side="right") - 1
        seq = np.searchsorted(cuts, begin, side="right") - 1
        start = self.start[seg] + begin - edge[seg]
        own = self.ids[: cuts[-1]].astype("<i4")
        raw = memoryview(own.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
        columns = [start, end - begin, np.array(crc, np.int64), self.tokens[seg], seq + self.next_id, begin - cuts[seq]]
        out = pa.RecordBatch.from_arrays(
            [self.doc.take(pa.array(seg)), *(pa.array(x.astype(np.int64)) for x in columns), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(own))],
            schema=pa.schema(_OUT),
        )
        self.next_id += len(cuts) - 1
        keep = int(np.searchsorted(edge, cuts[-1], side="right")) - 1  # the segment that holds the cut
        into = cuts[-1] - edge[keep]
        self.doc, self.start, self.tokens, self.length = self.doc.slice(keep), self.start[keep:].copy(), self.tokens[keep:], self.length[keep:].copy()
        if len(self.length):
            self.start[0] += into
            self.length[0] -= into
        self.ids = self.ids[cuts[-1] :]
        return out


def _packed(size: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        packer = _Packer(size, TaskContext.get().partitionId())
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets, 1 << 20):
                count, ids = bpe.encode(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], end_id=0)
                yield packer.add(batch.column(0).slice(lo, hi - lo), count, ids)
        yield packer.add(pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.uint32), last=True)

    return run


def pack_documents(docs: DataFrame, *, size: int = 1024, tokenizer: str | None = None, partitions: int | None = None) -> DataFrame:
    """Sequences of ``size`` tokens from all documents, neighbours on the curve side by side.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. ``tokenizer``
    is a path of a byte-level BPE file (default: the public 50k vocabulary). Each
    document is its ids and then id 0; null counts as the empty text, which is id 0
    alone. Returns a row per piece: ``doc_id, start`` (the document's ids before
    it), ``length, ids_crc32`` (of the ids as little-endian 32-bit numbers),
    ``doc_tokens, sequence_id, offset`` and ``ids``, the piece's token ids: the
    pieces of a ``sequence_id`` by ``offset`` are the training sequence.

    A document's signed, hashed word counts are projected to 3 dimensions; rows are
    range-partitioned and sorted by the place on the Hilbert curve through that cube
    and, as copies share a place, by a hash of the id and the row's number in the input, so
    that a hot text is spread over partitions, whatever its ids. The ranges are those of a
    sample of about ``SAMPLE_ROWS`` rows and hold about ``PARTITION_BYTES`` of text each, so
    that a task doesn't grow with the input. Each partition is one stream that is cut every
    ``size`` tokens; its last tokens become sequences whose lengths are powers of two, so
    nothing is padded. Texts are shuffled once and tokenised once, after the shuffle. Null
    ids and repeated rows are packed like others; an empty table gives no rows.
    """
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id()).alias("tie"), F.col("doc_id").cast("bigint").alias("doc_id"))
    bounds = _bounds(rows, partitions)
    begins = docs.sparkSession.sparkContext.broadcast(bounds)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _places(batches):
            part = np.searchsorted(begins.value, batch.column(0).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column(0), batch.column(3), batch.column(1)], names=["part", "place", "doc_id", "text"])

    keyed = rows.mapInArrow(ranged, "part int, place bigint, doc_id bigint, text string")
    ordered = keyed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("place", "doc_id", F.xxhash64("text")).select("doc_id", "text")
    return ordered.mapInArrow(_packed(size, tokenizer), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>")
