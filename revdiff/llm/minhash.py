"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import lean_batches, staged
from .textbatch import Words, distinct_pairs, mix64, shingles, signed, slices, text_buffer

_STEP = np.uint64(0x9E3779B97F4A7C15)


def super_minhash(row: np.ndarray, element: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (n x m, unsigned 64-bit) of the sets ``element[row == i]``.

    Each element draws one random permutation of the m places, and at step j
    offers ``j + uniform`` to the j-th place of it; a place keeps the least offer.
    Steps run for all sets at once, and a set is done as soon as each of its
    places holds an offer of an earlier step, since later ones are larger. An
    offer is kept as ``j << 32 | 32 random bits``.
    """
    full = np.uint64((1 << 64) - 1)
    out = np.full(n * m, full, np.uint64)
    swaps: list[np.ndarray] = []
    base = row.astype(np.int64) * m
    for j in range(m):
        if not len(row):
            break
        drawn = mix64(element + np.uint64((j + 1) * int(_STEP) & int(full)))
        k = (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int16) + np.int16(j)
        place = k.copy()
        for i in range(j - 1, -1, -1):  # what stood at place k after the swaps before
            place[place == swaps[i]] = i
        np.minimum.at(out, base + place, (drawn >> np.uint64(32)) | np.uint64(j << 32))
        done = out.reshape(n, m).max(axis=1) < np.uint64((j + 1) << 32)
        if done[row].any():
            live = ~done[row]
            row, element, base, k = row[live], element[live], base[live], k[live]
            swaps = [x[live] for x in swaps]
        swaps.append(k)
    return out.reshape(n, m)


def _signatures(k: int, bands: int, rows: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, m + 1, dtype=np.uint64) * _STEP)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                n = hi - lo
                words = Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, h = distinct_pairs(*shingles(words, k))
                size = np.bincount(row, minlength=n)
                prints = []
                for c in (1, 2):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, row, mix64(h ^ mix64(np.full(1, c, np.uint64))))
                    prints.append(pa.array(signed(total)))
                sig = mix64(super_minhash(row, h, n, m) ^ salt)
                keys = mix64(sig.reshape(n, bands, rows).sum(axis=2, dtype=np.uint64))
                ends = np.cumsum(np.where(size > 0, bands, 0))
                flat = pa.array(signed(keys[size > 0].reshape(-1)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(size.astype(np.int64)), *prints, lists],
                    names=["doc_id", "digest", "n_shingles", "f1", "f2", "bands"],
                )

    return run


#: Counters of shingle frequencies; different shingles may share one, which makes an order less selective, never wrong.
COUNT_BUCKETS = 1 << 19


def _counted(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets):
                _, h = distinct_pairs(*shingles(Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), k))
                total += np.bincount((h % np.uint64(COUNT_BUCKETS)).astype(np.int64), minlength=COUNT_BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def _prefixes(k: int, num: int, den: int, often):
    """The rarest shingles of each set: two sets as similar as asked for share one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                n = hi - lo
                row, h = distinct_pairs(*shingles(Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), k))
                order = np.lexsort((h, often.value[(h % np.uint64(COUNT_BUCKETS)).astype(np.int64)], row))
                row, h = row[order], h[order]
                size = np.bincount(row, minlength=n)
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                keep = place < (size - (num * size + den - 1) // den + 1)[row]
                of = row[keep]
                at = pa.array(of + lo)
                columns = [pa.array(signed(h[keep])), batch.column(0).take(at), batch.column(1).take(at), pa.array(size[of]), pa.array((size[of] - place[keep] - 1).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "comp", "n", "left"])

    return run


def _sets(buf: np.ndarray, offsets: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of some rows' texts, as distinct (place in ``rows``, hash)."""
    texts = [buf[offsets[i] : offsets[i + 1]] for i in rows.tolist()]
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return distinct_pairs(*shingles(Words(np.concatenate(texts), edges), k))


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(0).to_numpy()
            buf_a, off_a = text_buffer(batch.column(2))
            buf_b, off_b = text_buffer(batch.column(3))
            linked = np.zeros(len(a), bool)
            for lo, hi in slices(off_a + off_b):
                _, where, of = np.unique(a[lo:hi], return_index=True, return_inverse=True)
                row_a, h = _sets(buf_a, off_a, where + lo, k)
                size_a = np.bincount(row_a, minlength=len(where))
                tagged = np.sort(mix64(h ^ mix64(row_a.astype(np.uint64))))
                row_b, h = _sets(buf_b, off_b, np.arange(lo, hi), k)
                want = mix64(h ^ mix64(of[row_b].astype(np.uint64)))
                at = np.minimum(np.searchsorted(tagged, want), len(tagged) - 1)
                both = np.bincount(row_b, weights=tagged[at] == want, minlength=hi - lo).astype(np.int64)
                union = size_a[of] + np.bincount(row_b, minlength=hi - lo) - both
                linked[lo:hi] = (den * both >= num * union) & (both > 0)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(4).filter(keep), batch.column(5).filter(keep)], names=["u", "v"])

    return run


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4
) -> DataFrame:
    """Groups of documents whose shingle sets have a Jaccard similarity of at least ``num / den``.

    ``docs`` needs ``doc_id`` (bigint) and ``text``; other columns are ignored.
    Text is lower-cased (A-Z) and split into words at space and ``\\t\\n\\v\\f\\r``;
    the set holds the distinct runs of ``shingle`` words, or the whole sequence if
    it is shorter. Returns one row per row of ``docs``: ``doc_id, n_shingles,
    component_id, kept``. ``component_id`` is the smallest id reachable by links,
    ``kept`` says that it is the row's own.

    1. One pass makes set size, set fingerprint and a SuperMinHash signature of
       ``bands * rows`` places per document. Equal sets are one class, so copies
       never meet in a bucket.
    2. Classes are bucketed by band. A pair at the threshold of 0.8 shares no bucket
       with a probability of 5e-8 (32 bands of 4 places); at 0.85, 6e-11.
    3. Every class of a bucket is compared with the bucket's class of the smallest id: links
       grow with the bucket, not with its square. Candidates are confirmed on full
       sets made from the texts.
    4. In a bucket that still holds several components, any two classes of different
       components may be linked. Instead of all pairs, the rarest shingles of the
       classes in such buckets are joined: sets of n shingles as similar as
       asked for share one of their ``n - ceil(n * num / den) + 1`` rarest ones, under any
       common order. Shingles that only one component has are left out. Set sizes and
       the place of the shared shingle bound what two sets can share; the pairs left
       are confirmed like the others. So no link that would join two components is
       left out.

    Null or empty text: no shingles, linked with nothing. A null ``doc_id``: the
    row stays, with a null ``component_id`` and ``kept`` true. Rows that share an
    id are judged each by its own text. An empty table gives no rows.
    """
    found = _grouped(docs, shingle, num, den, bands, rows).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _grouped(docs: DataFrame, shingle: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, digest`` (of the text), ``n_shingles, component_id`` of each row, and ``label``: a number of its component, null without shingles or id."""
    lean_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    made = staged(
        docs.mapInArrow(
            _signatures(shingle, bands, rows),
            "doc_id bigint, digest bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>",
        )
    )
    group = ["n_shingles", "f1", "f2"]
    # a class is a node of the graph; its number is written once, so it stays
    full = made.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*group).agg(F.min(F.struct("doc_id", "digest")).alias("of"), F.first("bands").alias("bands"))
    classes = staged(full.select(*group, F.col("of.doc_id").alias("rep"), F.col("of.digest").alias("digest"), "bands", F.monotonically_increasing_id().alias("node")))
    keyed = classes.select(F.explode("bands").alias("key"), "node", "rep")
    # what is known of each bucket is a table of its own, so that Spark can split a hot bucket's join
    shared = staged(keyed.groupBy("key").agg(F.min_by("node", "rep").alias("leader"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "leader"))
    members = staged(keyed.drop("rep").join(shared, "key"))

    # one text of each class; rows of equal id and text are made one before they are moved
    wanted = classes.select(F.col("rep").alias("doc_id"), "digest", "node").join(members.select("node").distinct(), "node", "left_semi")
    texts = staged(docs.filter("text IS NOT NULL").dropDuplicates(["doc_id", "digest"]).join(wanted, ["doc_id", "digest"]).select("node", "text"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links ``u, v`` of those ``pairs`` (``a, b, u, v``) whose texts a and b are similar enough."""
        left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
        rows_ = pairs.distinct().join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b", "u", "v")
        return staged(rows_.mapInArrow(_verify(shingle, num, den), "u bigint, v bigint"))

    first_links = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader").alias("u"), F.col("node").alias("v"))
    found = staged(connected_components(confirmed(first_links)))
    placed = staged(members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")))
    mixed = staged(placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key"))
    opened = placed.join(mixed, "key", "left_semi").select("node", "comp").distinct()
    counts = texts.select("text").mapInArrow(_counted(shingle), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNT_BUCKETS, np.int64)
    often[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    often = docs.sparkSession.sparkContext.broadcast(often)
    rare = staged(
        texts.join(opened, "node")
        .select("node", "comp", "text")
        .mapInArrow(_prefixes(shingle, num, den, often), "token bigint, node bigint, comp bigint, n bigint, left bigint")
    )
    # a token of one component alone links nothing new
    useful = staged(rare.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token"))
    rare = staged(rare.join(useful, "token", "left_semi"))
    x, y = rare.alias("x"), rare.alias("y")
    # "left": how many of a set's shingles follow its prefix token, so how many more two sets can share
    close = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.comp") < F.col("y.comp"))
        & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n"))
        & ((1 + F.least("x.left", "y.left")) * (num + den) >= num * (F.col("x.n") + F.col("y.n")))
    )
    rest = x.join(y, close).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("u"), F.col("y.comp").alias("v"))
    # these links join the components found so far
    final = staged(connected_components(confirmed(rest))).toDF("comp", "joined")
    placed = classes.join(found, "node", "left").select(*group, "rep", F.coalesce("component", "node").alias("comp"))
    placed = staged(placed.join(final, "comp", "left").select(*group, "rep", F.coalesce("joined", "comp").alias("label")))
    least = staged(placed.groupBy("label").agg(F.min("rep").alias("component")))
    joined = made.drop("bands").join(staged(placed.join(least, "label").drop("rep")), group, "left")
    has_id, has_words = F.col("doc_id").isNotNull(), F.col("n_shingles") > 0
    component = F.when(has_id, F.when(has_words, F.col("component")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.when(has_id & has_words, F.col("label")).alias("label"))


def keep_first(
    docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4
) -> DataFrame:
    """The rows of ``docs``, all columns, one document of each group of near duplicates.

    The document with the smallest id stays. Parameters and cases are those of
    ``near_duplicates``. Rows are judged by id and text: of rows equal in both one
    stays; where linked texts share the smallest id, the one of the smallest hash
    stays; texts that aren't linked stay, though they share an id. Rows with a null
    id stay. Rows equal in id and text are made one before texts are shuffled, once.
    """
    found = _grouped(docs, shingle, num, den, bands, rows).filter("doc_id IS NOT NULL AND doc_id = component_id")
    chosen = found.filter("label IS NOT NULL").groupBy("label", "doc_id").agg(F.min("digest").alias("digest")).drop("label")
    chosen = chosen.unionByName(found.filter("label IS NULL").select("doc_id", "digest").distinct()).toDF("kept_id", "kept_digest")
    key = "text_digest"
    while key in docs.columns + chosen.columns:
        key += "_"
    once = docs.filter("doc_id IS NOT NULL").withColumn(key, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", key])
    same = (once["doc_id"] == chosen["kept_id"]) & (once[key] == chosen["kept_digest"])
    return once.join(chosen, same, "left_semi").drop(key).unionByName(docs.filter("doc_id IS NULL"))
