from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from revdiff.kernels import raster
from revdiff.operators import pages
from revdiff.plans import compare

PAIR = "pair_id bigint, old_doc bigint, new_doc bigint, is_pdf boolean"


def page(seed: int, height: int = 60, width: int = 100) -> np.ndarray:
    """Grey text lines that differ by ``seed``."""
    r = np.random.default_rng(seed)
    out = np.full((height, width), 255, np.uint8)
    for y in range(8, height - 8, 10):
        for x in range(6, width - 6, 4):
            if r.random() < 0.7:
                out[y : y + 4, x : x + 3] = 20
    return out


def frame(spark, docs):
    rows = [(d, i + 1, *p.shape, bytearray(p.tobytes())) for d, own in docs.items() for i, p in enumerate(own)]
    return spark.createDataFrame(rows, "doc_id bigint, page int, height int, width int, content binary")


def test_otsu_sql_equals_the_kernel(spark):
    r = np.random.default_rng(1)
    docs = {0: [page(1), np.full((4, 4), 9, np.uint8)], 1: [r.integers(0, 256, (20, 20)).astype(np.uint8)], 2: [np.array([[0, 0, 255, 255]], np.uint8)]}
    got = {(x.doc_id, x.page): x.threshold for x in pages.otsu_threshold(pages.page_histogram(frame(spark, docs))).collect()}
    assert got == {(d, i + 1): raster.otsu(p) for d, own in docs.items() for i, p in enumerate(own)}


def test_masks(spark):
    m = pages.ink_masks(frame(spark, {0: [page(1), page(1), page(2), np.full((60, 100), 255, np.uint8)]})).orderBy("page").collect()
    assert m[0].sha1 == m[1].sha1 != m[2].sha1 and m[3].ink == 0
    assert (raster.unpack(m[0].bits, 60, 100) == (page(1) < 128)).all() and m[0].ink == (page(1) < 128).sum()


@pytest.mark.parametrize("turn", [0.0, 0.5, 1.0, -1.0])
def test_skew(turn):
    flat = np.full((300, 500), 255, np.uint8)
    for y in range(20, 280, 14):
        flat[y : y + 5, 20:480:1] = np.where(np.random.default_rng(y).random(460) < 0.8, 20, 255)
    assert raster.skew(raster.ink(raster.rotated(flat, turn, 255))) == pytest.approx(-turn, abs=0.3)


def test_scores_and_differences(spark):
    docs = {0: [page(1)], 1: [page(2)]}
    m = pages.ink_masks(frame(spark, docs))
    both = m.filter("doc_id = 0").select(F.col("bits").alias("a")).crossJoin(m.filter("doc_id = 1").select(F.col("bits").alias("b")))
    a, b = page(1) < 128, page(2) < 128
    r = both.select(pages.page_iou(F.col("a"), F.col("b")).alias("iou"), pages.pages_equal(F.col("a"), F.col("a"), F.lit(6000)).alias("same"), pages.pages_equal(F.col("a"), F.col("b"), F.lit(6000)).alias("other")).first()
    assert r.iou == pytest.approx((a & b).sum() / (a | b).sum()) and r.same and not r.other


def align(spark, old, new, **how):
    m = pages.ink_masks(frame(spark, {0: old, 1: new}))
    got = pages.align_pages(spark.createDataFrame([(7, 0, 1, True)], PAIR), m, **how).collect()
    return sorted((r.kind, r.old_page or 0, r.new_page or 0) for r in got)


def edited(p: np.ndarray) -> np.ndarray:
    out = p.copy()
    out[8:12, 6:30] = 255
    return out


def test_alignment(spark):
    a, b, c, d = (page(i) for i in (1, 2, 3, 4))
    how = {"threshold": 0.8}
    assert align(spark, [a, b], [a, b], **how) == [("identical", 1, 1), ("identical", 2, 2)]
    assert align(spark, [a, b], [a, c, b], **how) == [("identical", 1, 1), ("identical", 2, 3), ("only_new", 0, 2)]
    assert align(spark, [a, b, c, d], [a, d], **how) == [("identical", 1, 1), ("identical", 4, 2), ("only_old", 2, 0), ("only_old", 3, 0)]
    assert align(spark, [a, b], [edited(a), b], **how) == [("changed", 1, 1), ("identical", 2, 2)]
    assert align(spark, [], [a], **how) == [("only_new", 0, 1)]
    assert align(spark, [a, b], [a, c, b], max_pairs=1, **how) == align(spark, [a, b], [a, c, b], **how)
    assert align(spark, [c, a, b], [a, b], max_pairs=1, **how) == [("only_new", 0, 1), ("only_new", 0, 2), ("only_old", 1, 0), ("only_old", 2, 0), ("only_old", 3, 0)]


def test_regions(spark):
    a = page(1)
    m = pages.ink_masks(frame(spark, {0: [a], 1: [edited(a)]}))
    ids = spark.createDataFrame([(7, 0, 1, True)], PAIR)
    found = pages.changed_regions(pages.align_pages(ids, m), ids, m)
    boxes = found.first().regions
    assert 1 <= len(boxes) <= 3 and all(b.y0 <= 9 and b.y1 <= 14 and b.x1 <= 32 for b in boxes)
    assert {(r.side, r.page) for r in pages.regions_by_page(found).collect()} == {("old", 1), ("new", 1)}


def packed(mask: np.ndarray) -> raster.Packed:
    return raster.Packed(raster.pack(mask), *mask.shape)


def test_kernel_pieces():
    assert raster.merged([(0, 0, 10, 10), (20, 0, 25, 5), (60, 0, 70, 10)]) == [(0, 0, 25, 10), (60, 0, 70, 10)]
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[4, 4] = True
    assert sorted(c[0] for c in raster.components(*raster.runs(m))) == [1, 2]
    assert raster.difference(packed(np.ones((2, 2), bool)), packed(np.ones((3, 1), bool)), 0, 3).sum() == 4
    ring = np.zeros((15, 15), bool)
    ring[5:10, 5:10] = True
    ring[7, 7] = False
    assert raster.closed(ring)[7, 7] and raster.closed(ring).sum() == 25


def test_selection_of_regions(spark):
    box = lambda n: {"x0": 0, "y0": 0, "x1": n, "y1": 1}
    data = spark.createDataFrame([([box(5), box(9), box(3)],)], "r array<struct<x0:int,y0:int,x1:int,y1:int>>")
    s = data.select(pages.select_regions(F.col("r"), lambda r: r["x1"], 12).alias("s")).first().s
    assert [b.x1 for b in s.regions] == [9, 3] and s.truncated


def test_scans_read_only_what_changed(spark):
    a, b, c = page(1), page(2), page(3)
    grey = frame(spark, {0: [a, b], 1: [a, edited(b), c]})
    ids = spark.createDataFrame([(7, 0, 1, True)], PAIR)
    content = grey.select("doc_id", "page", F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("page").cast("string")).cast("binary").alias("content"))
    cache = spark.createDataFrame([], "key string, markdown string")
    text = {b"0-2": "same line\n\nold words here", b"1-2": "same line\n\nnew words here", b"1-3": "# Added"}
    made, al, fresh = compare.compare_scans(ids, content, pages.ink_masks(grey), cache, lambda x: text[x], "m", "1")
    assert {r.kind for r in al.collect()} == {"identical", "changed", "only_new"}
    shown = [(r.left.text if r.left else None, r.right.text if r.right else None) for r in made.rows.orderBy("row_no").collect()]
    assert shown == [("same line", "same line"), ("old words here", "new words here"), (None, "Added")]
    assert fresh.count() == 3 and not made.summary.first().degraded


def plain_walk(old, new, threshold):
    rows, j = [], 0
    for i, a in enumerate(old):
        score = lambda b: (a & b).sum() / max((a | b).sum(), 1) if (a | b).any() else 1.0  # noqa: B023, E731
        while j < len(new) and score(new[j]) < threshold:
            j += 1
        if j == len(new):
            break
        rows.append((i + 1, j + 1, score(new[j])))
        j += 1
    return rows


def test_the_walk_is_that_of_a_plain_one(spark):
    """Pages dropped, put in and moved; pairs that share a document; batches of any size."""
    r = np.random.default_rng(4)
    own = [r.random((16, 16)) < 0.3 for _ in range(40)]
    blank = np.zeros((16, 16), bool)
    docs = {0: own, 1: own[3:20] + own[25:], 2: [x for p in own for x in ((p, r.random((16, 16)) < 0.3) if r.random() < 0.4 else (p,))], 3: [blank] * 30 + own, 4: [], 5: [blank, own[5] ^ (r.random((16, 16)) < 0.02), blank]}
    rows = [(d, i + 1, 16, 16, raster.pack(p), int(p.sum()), p.tobytes().hex()) for d, pages_ in docs.items() for i, p in enumerate(pages_)]
    masks = spark.createDataFrame(rows, "doc_id bigint, page int, height int, width int, bits array<bigint>, ink bigint, sha1 string").repartition(5)
    ids = [(10 * a + b, a, b, True) for a in docs for b in docs if a != b]
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("10000", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = {}
            for x in pages.align_pages(spark.createDataFrame(ids, PAIR), masks, threshold=0.6, max_pairs=-1).filter("iou IS NOT NULL").orderBy("pair_id", "old_page").collect():
                got.setdefault(x.pair_id, []).append((x.old_page, x.new_page, x.iou))
            want = {p: plain_walk(docs[a], docs[b], 0.6) for p, a, b, _ in ids}
            assert got == {p: w for p, w in want.items() if w}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)


def test_a_walk_through_20000_pages_holds_few():
    """The stream of a pair of 20,000 pages of 484,000 bits a side, 300 of them put in: memory stays far below the pages' own 1.2 GB a side."""
    import tracemalloc

    import pyarrow as pa

    words, n, shift = 7563, 20_000, 300

    def page(k):
        out = np.zeros(words, np.int64)
        out[:64] = np.random.default_rng(k + shift).integers(-(2**62), 2**62, 64)
        return out

    def stream():
        for lo in range(0, n, 20):
            rows = [(7, side, k + 1, 600, 806, 2000, f"{k}" if side == 0 else f"{k - shift}x", page(k if side == 0 else k - shift)) for k in range(lo, lo + 20) for side in (0, 1)]
            columns = list(zip(*rows))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * words, pa.int32()), pa.array(np.concatenate(columns[7])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:7]] + [bits], names=["pair_id", "side", "page", "height", "width", "ink", "sha1", "bits"])

    tracemalloc.start()
    found = [b.num_rows for b in pages._walk(0.6)(stream())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(found) == n - shift and peak < 200e6
