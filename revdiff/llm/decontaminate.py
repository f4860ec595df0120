"""Benchmark decontamination: a prefix-filtered set join of item windows with document texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean_batches, staged
from .textbatch import ALNUM, Words, distinct_pairs, shingles, signed, slices, sorted_union, text_buffer

#: Words of the shingles by which windows are found; a shorter window is one shingle.
SHINGLE = 3
#: (window, item) rows that are broadcast at a time; more rows are searched in blocks of this size.
BLOCK_ROWS = 200_000

_SPANS = "array<struct<start:int,end:int>>"


def _windows(window: int):
    """Rows (item_id, word hashes of a window, its shingles) of benchmark items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                words = Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                items, hashes, keys = [], [], []
                for i in range(hi - lo):
                    h = words.hash[words.first[i] : words.first[i + 1]]
                    for at in range(max(1, len(h) - window + 1) if len(h) else 0):
                        part = h[at : at + window]
                        k = min(SHINGLE, len(part))
                        items.append(lo + i)
                        hashes.append(signed(part).tolist())
                        keys.append(signed(_runs(part, k)).tolist())
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(items, pa.int64())), pa.array(hashes, kind), pa.array(keys, kind)],
                    names=["item_id", "words", "shingles"],
                )

    return run


class _OneText:
    """Word hashes of one text, as far as ``shingles`` needs them."""

    def __init__(self, h: np.ndarray):
        self.hash, self.first = h, np.array([0, len(h)])


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    return shingles(_OneText(h), k)[1]


def _frequencies(keys: np.ndarray, sizes: list[int]):
    """Occurrences of the given shingles in each batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(keys), np.int64)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets):
                words = Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                for k in sizes:
                    h = signed(shingles(words, k)[1])
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    count += np.bincount(at[keys[at] == h], minlength=len(keys))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(keys[seen]), pa.array(count[seen])], names=["shingle", "n"])

    return run


class _Index:
    """The windows of a block by their rarest shingle."""

    def __init__(self, prefix: np.ndarray, offset: np.ndarray, words: list[np.ndarray], item: list[str]):
        order = np.argsort(prefix, kind="stable")
        self.key, self.first = np.unique(prefix[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.offset = offset[order]
        self.length = np.array([len(words[i]) for i in order], np.int64)
        self.words = np.zeros((len(order), max(map(len, words), default=1)), np.int64)
        for row, i in enumerate(order):
            self.words[row, : len(words[i])] = words[i]
        self.names, self.item = np.unique(np.array([item[i] for i in order], dtype=object), return_inverse=True)
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.length})

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, item) of each occurrence of a window in the texts of ``words``."""
        starts, lengths, items = [], [], []
        count = np.diff(words.first)
        for k in self.sizes:
            row, h = shingles(words, k)
            h = signed(h)
            at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            hit = np.flatnonzero(self.key[at] == h)
            n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
            place = words.first[:-1][row[hit]] + hit - (np.cumsum(n) - n)[row[hit]]
            many = (self.last - self.first)[at[hit]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            window = np.repeat(self.first[at[hit]], many) + step
            doc = np.repeat(row[hit], many)
            begin = np.repeat(place, many) - self.offset[window]
            inside = (begin >= words.first[doc]) & (begin + self.length[window] <= words.first[doc + 1])
            begin, window = begin[inside], window[inside]
            same = np.ones(len(begin), bool)
            for j in range(self.words.shape[1]):
                here = np.minimum(begin + j, max(len(words) - 1, 0))
                same &= (j >= self.length[window]) | (signed(words.hash)[here] == self.words[window, j])
            starts.append(begin[same])
            lengths.append(self.length[window[same]])
            items.append(self.item[window[same]])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(items)


def _scan(batch: pa.RecordBatch, column: int, index: _Index | None) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """For slices of a batch: row range, and arrays n_words, n_hit, items, spans."""
    buf, offsets = text_buffer(batch.column(column))
    for lo, hi in slices(offsets):
        n = hi - lo
        words = Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
        found = index.find(words) if index is not None else (np.zeros(0, np.int64),) * 3
        start, length, item = found
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
        hit = np.cumsum(edge)[:-1] > 0
        doc = words.doc[start] if len(start) else start
        row, item = distinct_pairs(*_by_row(doc, item))
        names = pa.array([index.names[i] for i in item.tolist()] if index is not None else [], pa.string())
        items = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), names)
        inside = np.flatnonzero(hit)
        breaks = np.zeros(0, np.int64)
        if len(inside):
            fresh = np.ones(len(inside), bool)
            fresh[1:] = (np.diff(inside) > 1) | (words.doc[inside[1:]] != words.doc[inside[:-1]])
            breaks = np.flatnonzero(fresh)
        s = inside[breaks]
        e = inside[np.append(breaks[1:], len(inside)) - 1] + 1 if len(inside) else s
        base = words.first[words.doc[s]] if len(s) else s
        of = words.doc[s] if len(s) else s
        span = pa.StructArray.from_arrays([pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32))], names=["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), span)
        n_hit = np.bincount(words.doc, weights=hit, minlength=n).astype(np.int64)
        yield lo, hi, [pa.array(np.diff(words.first).astype(np.int64)), pa.array(n_hit), items, spans]


def _by_row(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(doc, kind="stable")
    return doc[order], item[order]


def _windows_of(docs: DataFrame, benchmark: DataFrame, window: int, block_rows: int) -> tuple[DataFrame, int]:
    """The distinct windows of all items, dealt to blocks of about ``block_rows``, and the number of blocks."""
    lean_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    made = items.filter("item_id IS NOT NULL").mapInArrow(_windows(window), "item_id string, words array<bigint>, shingles array<bigint>")
    rows = staged(made.distinct())
    blocks = math.ceil(rows.count() / block_rows)
    return rows.withColumn("block", F.pmod(F.xxhash64("words", "item_id"), F.lit(max(1, blocks)))), blocks


def _index(docs: DataFrame, rows: DataFrame, block: int):
    """The broadcast index of one block, by the frequencies of its shingles in ``docs``; None if it is empty."""
    own = rows.filter(F.col("block") == block).select("item_id", "words", "shingles").toPandas()
    if own.empty:
        return None
    words = [np.asarray(w, np.int64) for w in own["words"]]
    runs = [np.asarray(w, np.int64) for w in own["shingles"]]
    keys = sorted_union(np.concatenate(runs), np.zeros(0, np.int64))
    sizes = sorted({min(SHINGLE, len(w)) for w in words})
    counts = docs.select("text").mapInArrow(_frequencies(keys, sizes), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(len(keys), np.int64)
    often[np.searchsorted(keys, counts["shingle"].to_numpy(np.int64))] = counts["n"].to_numpy(np.int64)
    rarest = [int(np.lexsort((r, often[np.searchsorted(keys, r)]))[0]) for r in runs]
    prefix = np.array([r[i] for r, i in zip(runs, rarest)], np.int64)
    return docs.sparkSession.sparkContext.broadcast(_Index(prefix, np.array(rarest, np.int64), words, own["item_id"].tolist()))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Where windows of benchmark items occur in documents, word for word.

    ``docs`` needs ``doc_id, text``, ``benchmark`` needs ``item_id, text``; other
    columns are ignored. Text is lower-cased (A-Z); words are runs of ASCII digits,
    letters and characters beyond ASCII. A window is ``window`` consecutive words of
    an item, or the whole item if it has fewer. Returns a row per row of ``docs``:
    ``doc_id, n_words, n_hit`` (words inside any occurrence), ``items``
    (array<string>, distinct) and ``spans`` (word positions of hit runs, end
    exclusive).

    A window occurs only where all its shingles do, so its rarest one in the corpus
    is a sufficient prefix: a first pass counts the windows' shingles in all
    documents, a second one looks up the prefixes only. Where one is met, the start
    follows from its position in the window; occurrences that would begin before or
    end after the text are left out, and the words are compared. Both passes are
    scans without a shuffle of texts; a passage that many documents share costs no
    more than its occurrences. The broadcast index is limited to ``block_rows``
    rows. A larger benchmark is searched in blocks, one after another: the hits of
    a block are written before its index is released and the next one is made, so
    that one index at most is held at any time; then the hits are merged.

    Null or empty texts have no words. Null item ids are ignored; repeated items
    count once. Null doc ids and repeated rows are kept. Without any window,
    nothing is hit.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, blocks = _windows_of(docs, benchmark, window, block_rows)
    if blocks < 2:
        return _scanned(docs, _index(docs, rows, 0) if blocks else None)
    return _found_in_blocks(docs, rows, blocks).drop("digest")


def _digest(doc_id, text):
    """Same for rows of the same id and text, nulls included."""
    return F.xxhash64(doc_id.cast("bigint"), text.cast("string"))


def _scanned(docs: DataFrame, index) -> DataFrame:
    """Rows of ``find_contamination`` by one index; columns of ``docs`` after the text follow."""
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, made in _scan(batch, 1, index.value if index is not None else None):
                ids = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*ids[:1], *made, *ids[1:]], names=["doc_id", "n_words", "n_hit", "items", "spans", *more])

    return docs.mapInArrow(run, f"doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans {_SPANS}" + "".join(f", {c} bigint" for c in more))


def _found_in_blocks(docs: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``find_contamination`` and their ``digest``, by several blocks of windows."""
    docs = docs.withColumn("digest", _digest(F.col("doc_id"), F.col("text")))
    hits = None
    for block in range(blocks):
        index = _index(docs, rows, block)
        if index is None:
            continue
        part = staged(_scanned(docs, index).filter("n_hit > 0").select("digest", "items", "spans"))
        index.destroy()
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("all"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # runs that touch or overlap become one
    spans = F.aggregate(
        "all",
        F.lit(None).cast(_SPANS),
        lambda acc, x: F.when(acc.isNull(), F.array(x))
        .when(F.element_at(acc, -1)["end"] >= x["start"],
              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.select("digest", "items", spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return (
        _scanned(docs, None)
        .select("doc_id", "n_words", "digest")
        .join(merged, "digest", "left")
        .select("doc_id", "n_words", "digest", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    )


def is_contaminated(n_hit, n_words):
    """At least one hit word, and at least one in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't contaminated.

    Same rule and cases as ``find_contamination``; each row is judged by its own
    text, whatever other rows have its id. One benchmark block needs no shuffle;
    with several, the verdicts are joined by a digest of id and text.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, blocks = _windows_of(texts, benchmark, window, block_rows)
    if not blocks:
        return docs
    if blocks > 1:
        found = _found_in_blocks(texts, rows, blocks)
        key = "contaminated_digest"
        while key in docs.columns:
            key += "_"
        bad = found.filter(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("digest").alias(key)).distinct()
        return docs.withColumn(key, _digest(F.col("doc_id"), F.col("text"))).join(bad, key, "left_anti").drop(key)
    column, index = docs.columns.index("text"), _index(texts, rows, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, (n_words, n_hit, _, _) in _scan(batch, column, index.value):
                yield batch.slice(lo, hi - lo).filter(pa.array(~is_contaminated(n_hit.to_numpy(), n_words.to_numpy())))

    return docs.mapInArrow(run, docs.schema)
