"""Page rasters: masks, alignment of pages by their ink, changed regions."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import matching, raster
from ..sources.runs import lean_batches

# fixed values
MATCH_IOU, IDENTITY_IOU, CHANGE_RATIO, MAX_PAGE_PAIRS, CROP_BUDGET = 0.35, 0.999, 0.00005, 40_000, 4 * 1024 * 1024

_KEYS = ["doc_id", "page"]


def otsu_threshold(histogram: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The keys and ``threshold`` of each page: null for a page of one grey level.

    ``histogram``: the keys, ``grey, n``. The level that maximises the between-class
    variance, the first of equal ones; ink is grey up to it.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("grey").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    g = F.col("grey").cast("double")
    x = histogram.groupBy(*keys, "grey").agg(F.sum("n").alias("n")).filter("n > 0")
    x = x.withColumn("w0", F.sum("n").over(order)).withColumn("s0", F.sum(F.col("n") * g).over(order)).withColumn("w", F.sum("n").over(every)).withColumn("s", F.sum(F.col("n") * g).over(every))
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    between = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - s1 / w1, 2))
    return x.withColumn("v", between).groupBy(*keys).agg(F.max_by("grey", F.when(F.col("v").isNotNull(), F.struct(F.col("v"), -F.col("grey")))).cast("int").alias("threshold"))


def page_histogram(grey_pages: DataFrame) -> DataFrame:
    """``doc_id, page, grey, n`` of pages (``doc_id, page, content``: a byte a pixel), at most 256 rows a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256) for x in batch.column(2) if x.is_valid]
            flat = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            some = np.flatnonzero(flat)
            of = pa.array(np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))[some // 256])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array((some % 256).astype(np.int32)), pa.array(flat[some].astype(np.int64))], names=[*_KEYS, "grey", "n"])

    types = dict(grey_pages.dtypes)
    return grey_pages.select(*_KEYS, "content").mapInArrow(run, f"doc_id {types['doc_id']}, page {types['page']}, grey int, n bigint")


def page_sha1(height: Column, width: Column, bits: Column) -> Column:
    """A fingerprint of a mask: equal for equal sizes and ink only."""
    return F.sha1(F.concat_ws(",", height.cast("string"), width.cast("string"), F.transform(bits, lambda x: x.cast("string"))))


def _masks(pages: DataFrame, straighten: bool) -> DataFrame:
    lean_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h, w, content in zip(pdf["height"], pdf["width"], pdf["content"]):
                grey = np.frombuffer(bytes(content), np.uint8).reshape(int(h), int(w))
                mask, angle = raster.prepared(grey) if straighten else (raster.ink(grey), 0.0)
                rows.append((raster.packed(mask), int(mask.sum()), angle))
            yield pdf[[*_KEYS, "height", "width"]].assign(bits=[r[0] for r in rows], ink=[r[1] for r in rows], skew=[r[2] for r in rows])

    types = dict(pages.dtypes)
    out = pages.select(*_KEYS, "height", "width", "content").mapInPandas(run, f"doc_id {types['doc_id']}, page {types['page']}, height int, width int, bits array<bigint>, ink bigint, skew double")
    return out.withColumn("sha1", page_sha1(F.col("height"), F.col("width"), F.col("bits")))


def ink_masks(pages: DataFrame) -> DataFrame:
    """Ink of grey pages (``doc_id, page, height, width, content``): ``bits`` (64 pixels a number), ``ink, skew`` (0), ``sha1``."""
    return _masks(pages, straighten=False)


def deskew_pages(pages: DataFrame) -> DataFrame:
    """Like ``ink_masks``, each page turned straight first; ``skew`` is the turn in degrees."""
    return _masks(pages, straighten=True)


#: Makes the raster of a row of a table of pages, in the task that uses it.
Decode = Callable[[tuple], np.ndarray]


def _of_rasters(pages: DataFrame, decode: Decode | None, made: Callable[[np.ndarray], object], name: str, kind: str) -> DataFrame:
    """``doc_id, page, height, width`` and ``made`` of each page's raster, which isn't moved where ``decode`` makes it."""
    lean_batches(pages.sparkSession)
    rows = pages.select(*_KEYS, "height", "width", "content") if decode is None else pages
    given = lambda row: np.frombuffer(row.content, np.uint8).reshape(int(row.height), int(row.width))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [((grey := (decode or given)(row)).shape, made(grey)) for row in pdf.itertuples(index=False)]
            yield pdf[_KEYS].assign(height=[x[0] for x, _ in out], width=[x[1] for x, _ in out], **{name: [y for _, y in out]})

    types = dict(pages.dtypes)
    return rows.mapInPandas(run, f"doc_id {types['doc_id']}, page {types['page']}, height int, width int, {name} {kind}")


def page_skews(pages: DataFrame, decode: Decode | None = None) -> DataFrame:
    """``doc_id, page, skew`` of grey pages: the turns of ``deskew_pages``, for which no page is turned or masked.

    ``decode`` makes the raster of a row of ``pages`` where that holds none.
    """
    return _of_rasters(pages, decode, lambda grey: raster.skew(raster.ink(grey)), "skew", "double").select(*_KEYS, "skew")


def small_masks(pages: DataFrame, decode: Decode | None = None) -> DataFrame:
    """``doc_id, page, height, width, bits`` of ``ink_masks`` with the bits compressed, as ``changed_regions`` moves them; ``decode`` as for ``page_skews``."""
    return _of_rasters(pages, decode, lambda grey: zlib.compress(raster.packed(raster.ink(grey)).tobytes(), 1), "bits", "binary")


def _count(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: acc + F.bit_count(x))


def diff_mask(old_bits: Column, new_bits: Column) -> Column:
    """Ink in one of two masks of one size only."""
    return F.zip_with(old_bits, new_bits, lambda a, b: a.bitwiseXOR(b))


def page_iou(old_bits: Column, new_bits: Column) -> Column:
    """Common ink over all ink of two masks of one size; 1 if neither has any."""
    both = _count(F.zip_with(old_bits, new_bits, lambda a, b: a.bitwiseAND(b)))
    either = _count(F.zip_with(old_bits, new_bits, lambda a, b: a.bitwiseOR(b)))
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def pages_equal(old_bits: Column, new_bits: Column, area: Column, ratio: float = CHANGE_RATIO) -> Column:
    """Whether the difference of two masks of one size is nothing, or a negligible share of the page."""
    n = _count(diff_mask(old_bits, new_bits))
    return (n == 0) | (n / F.greatest(area, F.lit(1)) < ratio)


def page_scores(pairs: DataFrame, masks: DataFrame, threshold: float = MATCH_IOU) -> DataFrame:
    """``pair_id, old_page, new_page, iou`` of all page pairs whose IoU is at least ``threshold``.

    Equal fingerprints give 1, other sizes 0, and ink counts bound the IoU: only the
    page pairs left have their bits joined.
    """
    light = masks.select("doc_id", "page", "height", "width", "ink", "sha1")
    old = pairs.select("pair_id", F.col("old_doc"), "new_doc").join(light.toDF("old_doc", "old_page", "h1", "w1", "k1", "s1"), "old_doc")
    both = old.join(light.toDF("new_doc", "new_page", "h2", "w2", "k2", "s2"), "new_doc").filter((F.col("h1") == F.col("h2")) & (F.col("w1") == F.col("w2")))
    equal = F.col("s1") == F.col("s2")
    bound = F.least("k1", "k2") >= threshold * F.greatest("k1", "k2")
    settled = both.filter(equal).select("pair_id", "old_page", "new_page", F.lit(1.0).alias("iou"))
    bits = masks.select("doc_id", "page", "bits")
    open_ = both.filter(~equal & bound).select("pair_id", "old_doc", "new_doc", "old_page", "new_page")
    open_ = open_.join(bits.toDF("old_doc", "old_page", "b1"), ["old_doc", "old_page"]).join(bits.toDF("new_doc", "new_page", "b2"), ["new_doc", "new_page"])
    scored = open_.select("pair_id", "old_page", "new_page", page_iou(F.col("b1"), F.col("b2")).alias("iou")).filter(F.col("iou") >= threshold)
    return settled.unionByName(scored)


def _best_pages(numbers: DataFrame, scores: DataFrame) -> DataFrame:
    """``pair_id, old_page, new_page, iou``: pages paired in order for the largest total score."""
    listed = scores.groupBy("pair_id").agg(F.collect_list(F.struct(F.col("old_page").cast("int").alias("o"), F.col("new_page").cast("int").alias("n"), "iou")).alias("scores"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pair, old, new, scores_ in zip(pdf["pair_id"], pdf["old"], pdf["new"], pdf["scores"]):
                row, column = ({p: i for i, p in enumerate(pages)} for pages in (old, new))
                grid = np.zeros((len(old), len(new)))
                for s in scores_:
                    grid[row[s["o"]], column[s["n"]]] = s["iou"]
                rows += [(pair, old[i], new[j], grid[i, j]) for i, j in matching.best_monotone_pairs(grid)]
            yield pd.DataFrame(rows, columns=["pair_id", "old_page", "new_page", "iou"])

    return numbers.join(listed, "pair_id").select("pair_id", "old", "new", "scores").mapInPandas(run, f"pair_id {dict(numbers.dtypes)['pair_id']}, old_page int, new_page int, iou double")


class _Held:
    """A page that waits for its turn: its bits are kept, packed small if it may wait long."""

    def __init__(self, light: tuple, bits: np.ndarray, small: bool):
        self.page, self.size, self.ink, self.sha1 = light[0], light[1:3], light[3], light[4]
        self.bits, self.small = (zlib.compress(bits.tobytes(), 1), True) if small else (bits.copy(), False)

    def score(self, other: _Held, threshold: float) -> float:
        """The IoU of two pages, from sizes, fingerprints and ink where these decide it."""
        if self.size != other.size:
            return 0.0
        if self.sha1 == other.sha1:
            return 1.0
        if min(self.ink, other.ink) < threshold * max(self.ink, other.ink):
            return 0.0
        if self.small:
            self.bits, self.small = np.frombuffer(zlib.decompress(self.bits), np.int64), False
        return raster.iou(self.bits, other.bits)


#: Old pages that wait as they are; those behind them are compressed.
WAITING = 8


def _walk(threshold: float):
    """Walks through the pages of pairs, sorted by pair, place and side, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, waiting = None, deque()
        for batch in batches:
            light = list(zip(*(batch.column(i).to_pylist() for i in range(7))))
            lists = batch.column(7)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            rows = []
            for i, (now, side, *page) in enumerate(light):
                if now != pair:
                    pair, waiting = now, deque()
                bits = values[ends[i] : ends[i + 1]]
                if side == 0:
                    waiting.append(_Held(tuple(page), bits, len(waiting) >= WAITING))
                elif waiting:  # the old page whose turn it is takes this new page, or lets it pass
                    found = waiting[0].score(_Held(tuple(page), bits, False), threshold)
                    if found >= threshold:
                        rows.append((pair, waiting.popleft().page, page[0], found))
            if rows:
                pairs_, old, new, iou = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(pairs_, batch.column(0).type), pa.array(old, pa.int32()), pa.array(new, pa.int32()), pa.array(iou, pa.float64())], names=["pair_id", "old_page", "new_page", "iou"])

    return run


def _walked_pages(whole: DataFrame, masks: DataFrame, threshold: float) -> DataFrame:
    """``pair_id, old_page, new_page, iou``: each old page takes the next new page that fits; what was passed over isn't taken up again.

    ``whole``: ``pair_id, old_doc, new_doc`` and the documents' sorted page numbers ``old, new``. The pages of both sides
    stream through one task a pair, sorted by their place in the document, and each new page is seen once.
    An old page is taken before any new page behind its place, so no page is missed; only old pages
    whose turn hasn't come are held, as many as new pages were passed over.
    """
    m = masks.select("doc_id", F.col("page").cast("int").alias("page"), "height", "width", "ink", "sha1", "bits")
    side = lambda doc, own, number: whole.select("pair_id", F.col(doc).alias("doc_id"), F.lit(number).alias("side"), F.posexplode(own).alias("place", "page"))
    every = side("old_doc", "old", 0).unionByName(side("new_doc", "new", 1)).join(m, ["doc_id", "page"])
    ordered = every.repartition("pair_id").sortWithinPartitions("pair_id", "place", "side")
    streamed = ordered.select("pair_id", "side", "page", "height", "width", "ink", "sha1", "bits")
    return streamed.mapInArrow(_walk(threshold), f"pair_id {dict(whole.dtypes)['pair_id']}, old_page int, new_page int, iou double")


def align_pages(pairs: DataFrame, masks: DataFrame, threshold: float = MATCH_IOU, identity: float = IDENTITY_IOU, max_pairs: int = MAX_PAGE_PAIRS) -> DataFrame:
    """``pair_id, kind, old_page, new_page, iou``: which pages of two documents belong together.

    Kinds: ``identical`` (IoU of at least ``identity``), ``changed``, ``only_old``, ``only_new``.
    Pages are paired in order for the largest total IoU. Documents of more than
    ``max_pairs`` page pairs are walked through instead, and only the page pairs that the
    walk meets are scored.
    """
    numbers = masks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("page").cast("int"))).alias("pages"))
    none = F.array().cast("array<int>")
    whole = pairs.select("pair_id", "old_doc", "new_doc").join(numbers.toDF("old_doc", "old"), "old_doc", "left").join(numbers.toDF("new_doc", "new"), "new_doc", "left")
    whole = whole.select("pair_id", "old_doc", "new_doc", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
    small = F.size("old").cast("bigint") * F.size("new") <= max_pairs
    ids = ["pair_id", "old_doc", "new_doc"]
    near = whole.filter(small)
    matched = _best_pages(near, page_scores(near.select(*ids), masks, threshold)).unionByName(_walked_pages(whole.filter(~small), masks, threshold))
    taken = matched.groupBy("pair_id").agg(F.collect_list(F.struct("old_page", "new_page", "iou")).alias("m"))
    all_pages = whole.join(taken, "pair_id", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<old_page:int,new_page:int,iou:double>>")))
    row = lambda kind, old, new, iou: F.struct(kind.alias("kind"), old.cast("int").alias("old_page"), new.cast("int").alias("new_page"), iou.cast("double").alias("iou"))
    null, alone = F.lit(None), lambda pages, c: F.array_except(pages, F.transform("m", lambda x: x[c]))
    rows = F.concat(
        F.transform("m", lambda x: row(F.when(x["iou"] >= identity, "identical").otherwise("changed"), x["old_page"], x["new_page"], x["iou"])),
        F.transform(alone("old", "old_page"), lambda p: row(F.lit("only_old"), p, null, null)),
        F.transform(alone("new", "new_page"), lambda p: row(F.lit("only_new"), null, p, null)),
    )
    return all_pages.select("pair_id", F.explode(rows).alias("r")).select("pair_id", "r.*")


_BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def _small_masks(masks: DataFrame) -> DataFrame:
    """``doc_id, page, height, width, bits`` with the bits compressed, as a page's ink is many times smaller then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            small = [zlib.compress(values[a:b].tobytes(), 1) if known else None for a, b, known in zip(ends, ends[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(small, pa.binary())], names=[*_KEYS, "height", "width", "bits"])

    types = dict(masks.dtypes)
    return masks.mapInArrow(run, f"doc_id {types['doc_id']}, page int, height {types['height']}, width {types['width']}, bits binary")


def changed_regions(alignment: DataFrame, pairs: DataFrame, masks: DataFrame, least: float = raster.MIN_REGION) -> DataFrame:
    """``pair_id, old_page, new_page, regions`` (boxes) of the changed page pairs; masks are moved compressed, as ``small_masks`` gives them or made so here."""
    m = masks.select("doc_id", F.col("page").cast("int").alias("page"), "height", "width", "bits")
    m = m if dict(m.dtypes)["bits"] == "binary" else _small_masks(m)
    changed = alignment.filter("kind = 'changed'").select("pair_id", "old_page", "new_page").join(pairs.select("pair_id", "old_doc", "new_doc"), "pair_id")
    # the masks of both sides are met once: what makes them is run once, and no page is moved that isn't asked for twice
    pair = ["pair_id", "old_page", "new_page"]
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_doc").alias("doc_id"), F.col(f"{s}_page").cast("int").alias("page"))
    wanted = changed.select(*pair, F.explode(F.array(side("old"), side("new"))).alias("x")).select(*pair, "x.*")
    met = wanted.join(m, ["doc_id", "page"])
    of = lambda s: F.max_by(F.struct("height", "width", "bits"), F.when(F.col("side") == s, F.lit(1)))
    both = met.groupBy(*pair).agg(of("old").alias("o"), of("new").alias("n")).filter("o IS NOT NULL AND n IS NOT NULL")
    names = {f"{c}{k}": F.col(f"{s}.{n}") for k, s in ((1, "o"), (2, "n")) for c, n in (("h", "height"), ("w", "width"), ("b", "bits"))}
    both = both.withColumns(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h1, w1, b1, h2, w2, b2 in zip(pdf["h1"], pdf["w1"], pdf["b1"], pdf["h2"], pdf["w2"], pdf["b2"]):
                whole = lambda b: np.frombuffer(zlib.decompress(b), "<i8")
                boxes = raster.changed_regions(raster.Packed(whole(b1), h1, w1), raster.Packed(whole(b2), h2, w2), least)
                out.append([dict(zip(("x0", "y0", "x1", "y1"), box)) for box in boxes])
            yield pdf[["pair_id", "old_page", "new_page"]].assign(regions=out)

    both = both.select("pair_id", "old_page", "new_page", "h1", "w1", "b1", "h2", "w2", "b2")
    return both.mapInPandas(run, f"pair_id {dict(pairs.dtypes)['pair_id']}, old_page int, new_page int, regions array<{_BOX}>")


def select_regions(regions: Column, weight, limit: int = CROP_BUDGET) -> Column:
    """Regions by descending area as far as their weights fit (Column -> Column): struct of ``regions`` and ``truncated``.

    A region that doesn't fit is left out and smaller ones are still tried. ``weight``
    gives a region's bytes as a Column. The budget is that of the array: of a page pair
    if it holds one pair's regions, of a document pair if it holds all of them
    (``select_pair_regions``).
    """
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    numbered = F.transform(regions, lambda r, i: F.struct((-area(r)).alias("a"), i.alias("i"), weight(r).cast("bigint").alias("w"), r.alias("r")))
    empty = F.struct(F.array().cast(f"array<{_BOX}>").alias("regions"), F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("truncated"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["w"] <= limit
        return F.struct(
            F.when(fits, F.concat(acc["regions"], F.array(x["r"]))).otherwise(acc["regions"]).alias("regions"),
            F.when(fits, acc["used"] + x["w"]).otherwise(acc["used"]).alias("used"),
            (acc["truncated"] | ~fits).alias("truncated"),
        )

    return F.aggregate(F.array_sort(numbered), empty, step, lambda acc: F.struct(acc["regions"].alias("regions"), acc["truncated"].alias("truncated")))


def regions_by_page(regions: DataFrame) -> DataFrame:
    """``pair_id, side, page, regions``: the regions on each page of either side, once."""
    one = regions.select("pair_id", "old_page", "new_page", F.explode("regions").alias("r"))
    old = one.select("pair_id", F.lit("old").alias("side"), F.col("old_page").alias("page"), "r")
    new = one.select("pair_id", F.lit("new").alias("side"), F.col("new_page").alias("page"), "r")
    return old.unionByName(new).distinct().groupBy("pair_id", "side", "page").agg(F.array_sort(F.collect_list("r")).alias("regions"))


def select_pair_regions(regions: DataFrame, weight, limit: int = CROP_BUDGET) -> DataFrame:
    """``regions`` (``pair_id, old_page, new_page, regions``) under one budget for each document pair: the same columns and ``truncated``.

    Page pairs are served in the order of their pages, each by ``select_regions``' rule with
    what those before it left; a page pair's row stays if none of its regions fits.
    """
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    one = lambda r, i: F.struct(F.col("old_page"), F.col("new_page"), (-area(r)).alias("a"), i.alias("i"), weight(r).cast("bigint").alias("w"), r.alias("r"))
    every = regions.withColumn("x", F.transform("regions", one)).groupBy("pair_id").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["w"] <= limit
        return F.struct((acc["used"] + F.when(fits, x["w"]).otherwise(0)).alias("used"), F.concat(acc["fits"], F.array(fits)).alias("fits"))

    told = every.withColumn("fits", F.aggregate("x", start, step, lambda acc: acc["fits"]))
    flat = told.select("pair_id", F.posexplode(F.zip_with("x", "fits", lambda x, f: F.struct(x["old_page"].alias("old_page"), x["new_page"].alias("new_page"), x["r"].alias("r"), f.alias("f")))).alias("n", "z")).select("pair_id", "n", "z.*")
    kept = F.array_sort(F.collect_list(F.when(F.col("f"), F.struct("n", "r"))))
    made = flat.groupBy("pair_id", "old_page", "new_page").agg(F.transform(kept, lambda x: x["r"]).alias("s"), F.bool_or(~F.col("f")).alias("t"))
    out = regions.select("pair_id", "old_page", "new_page").join(made, ["pair_id", "old_page", "new_page"], "left")
    return out.select("pair_id", "old_page", "new_page", F.coalesce("s", F.array().cast(f"array<{_BOX}>")).alias("regions"), F.coalesce("t", F.lit(False)).alias("truncated"))
