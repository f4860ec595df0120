"""Aligned rows of two documents, with classes, word segments and image sub-rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..kernels import matching
from . import diff
from .blocks import table_parts

IMAGE = "struct<sha1:string,n_bytes:bigint,data_uri:string>"
_BLOCK = {"text": "string", "html": "string", "images": f"array<{IMAGE}>", "page": "int", "words": "array<struct<x0:double,top:double,x1:double,bottom:double>>", "cells": "array<string>"}


def sides(pairs: DataFrame) -> DataFrame:
    """``pair_id, side`` (0: old, 1: new) and ``doc_id`` of the documents of pairs."""
    side = lambda number, doc: F.struct(F.lit(number).alias("side"), F.col(doc).alias("doc_id"))
    return pairs.select("pair_id", F.explode(F.array(side(0, "old_doc"), side(1, "new_doc"))).alias("x")).select("pair_id", "x.*")


def with_pairs(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``in_pairs``, the pairs and sides of their document: as they lie by document already, this moves no text, nor does going to the pairs from there need a join."""
    own = sides(pairs).groupBy("doc_id").agg(F.collect_list(F.struct("pair_id", "side")).alias("in_pairs"))
    return blocks.join(own, "doc_id", "left")


def _whole_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, pos, b``: each block as a struct of all fields a row can show."""
    fields = [(F.col(n).cast(t) if n in blocks.columns else F.lit(None).cast(t)).alias(n) for n, t in _BLOCK.items()]
    given = F.col("cells").cast(_BLOCK["cells"]) if "cells" in blocks.columns else F.lit(None).cast(_BLOCK["cells"])
    table, sep, cells = table_parts(F.col("text"), given)
    fields = [cells.alias("cells") if n == "cells" else f for n, f in zip(_BLOCK, fields)]
    known = ["in_pairs"] if "in_pairs" in blocks.columns else []
    return blocks.select("doc_id", *known, F.col("pos").cast("int").alias("pos"), F.struct(*fields, sep.alias("sep"), table.alias("table")).alias("b"))


def _marked(pairs: DataFrame, fragments: DataFrame, labels: DataFrame) -> DataFrame:
    """Fragments with their ``slot`` among the stretches of a pair, ``label``, and whether they are mere ``formatting``; their texts are looked at where they lie and not moved."""
    equal = F.forall(F.zip_with("old_blocks", "new_blocks", lambda a, b: text.is_formatting_only(a, b)), lambda x: F.coalesce(x, F.lit(False)))
    same_keys = F.when(F.size("old_blocks") == F.size("new_blocks"), equal).otherwise(False)
    light = fragments.select("pair_id", "frag_no", "i1", "i2", "j1", "j2", same_keys.alias("same_keys"))
    f = light.join(labels.select("pair_id", "frag_no", "label"), ["pair_id", "frag_no"], "left").join(pairs.select("pair_id", "is_pdf", "old_doc", "new_doc"), "pair_id")
    formatting = (F.coalesce(F.col("label"), F.lit("")) == "formatting") | (F.col("is_pdf") & F.col("same_keys"))
    return f.select("pair_id", "old_doc", "new_doc", "frag_no", (2 * F.col("frag_no").cast("bigint") + 1).alias("slot"), "i1", "i2", "j1", "j2", "label", formatting.alias("formatting"))


def _stretches(pairs: DataFrame, blocks: DataFrame, marked: DataFrame) -> DataFrame:
    """Fragments and the equal stretches between them: ``pair_id, slot, i1, i2, j1, j2, label, plain``."""
    sizes = blocks.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    ends = pairs.select("pair_id", "old_doc", "new_doc").join(sizes.toDF("old_doc", "old_n"), "old_doc", "left").join(sizes.toDF("new_doc", "new_n"), "new_doc", "left")
    ends = ends.select("pair_id", F.coalesce("old_n", F.lit(0)).alias("i1"), F.coalesce("new_n", F.lit(0)).alias("j1"))
    last = ends.select("pair_id", F.lit(2**31).cast("bigint").alias("slot"), "i1", F.col("i1").alias("i2"), "j1", F.col("j1").alias("j2"))
    f = marked.select("pair_id", "slot", "i1", "i2", "j1", "j2")
    order = Window.partitionBy("pair_id").orderBy("slot")
    every = f.unionByName(last).withColumn("__i", F.lag("i2", 1, 0).over(order)).withColumn("__j", F.lag("j2", 1, 0).over(order))
    null = F.lit(None).cast("string")
    gaps = every.filter(F.col("i1") > F.col("__i")).select(
        "pair_id", (F.col("slot") - 1).alias("slot"), F.col("__i").alias("i1"), F.col("i1").alias("i2"), F.col("__j").alias("j1"), F.col("j1").alias("j2"), null.alias("label"), F.lit(True).alias("plain")
    )
    return marked.select("pair_id", "slot", "i1", "i2", "j1", "j2", "label", F.col("formatting").alias("plain")).unionByName(gaps)


def _sha1s(images: Column) -> Column:
    return F.transform(F.coalesce(images, F.array().cast(f"array<{IMAGE}>")), lambda x: x["sha1"])


_SUB = "array<struct<i1:int,i2:int,j1:int,j2:int,changed:boolean>>"


def image_subrows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``subs``: how the image fingerprints ``old`` and ``new`` of each row stand beside each other, as ranges of both sides.

    Rows whose lists are equal are left out, and only the others go to Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            subs = [[dict(zip(("i1", "i2", "j1", "j2", "changed"), x)) for x in matching.image_rows(list(a), list(b))] for a, b in zip(pdf["old"], pdf["new"])]
            yield pdf[keys].assign(subs=subs)

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", subs {_SUB}"
    return rows.filter(F.col("old") != F.col("new")).select(*keys, "old", "new").mapInPandas(run, schema)


_LINE = ["pair_id", "slot", "k"]


def _subrows(pairs: DataFrame, blocks: DataFrame, stretches: DataFrame) -> DataFrame | None:
    """``pair_id, slot, k, subs`` of the paired lines, no table rows, whose images differ; None if blocks have no images at all."""
    if "images" not in blocks.columns:
        return None
    light = blocks.filter(~F.coalesce(text.is_table_row(F.col("text")), F.lit(False))).select("doc_id", F.col("pos").cast("int").alias("pos"), _sha1s(F.col("images")).alias("s"))
    n = F.least(F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1"))
    lines = stretches.filter(n > 0).select("pair_id", "slot", "i1", "j1", F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).join(pairs.select("pair_id", "old_doc", "new_doc"), "pair_id")
    lines = lines.select(*_LINE, "old_doc", (F.col("i1") + F.col("k")).alias("old_pos"), "new_doc", (F.col("j1") + F.col("k")).alias("new_pos"))
    both = lines.join(light.toDF("old_doc", "old_pos", "old"), ["old_doc", "old_pos"]).join(light.toDF("new_doc", "new_pos", "new"), ["new_doc", "new_pos"])
    return image_subrows(both, _LINE)


def row_changes(pairs: DataFrame, blocks: DataFrame, fragments: DataFrame, labels: DataFrame) -> DataFrame:
    """``pair_id, change, n``: how many rows of each class ``build_rows`` makes, in parts.

    All follows from the ranges of the fragments; no text is moved, and blocks are
    joined for their images' fingerprints alone.
    """
    s = _stretches(pairs, blocks, _marked(pairs, fragments, labels))
    old, new = F.col("i2") - F.col("i1"), F.col("j2") - F.col("j1")
    own = F.coalesce(text.side_change(F.col("label"), "left"), text.side_change(F.col("label"), "right"))
    part = lambda change, n: F.struct(F.when(~F.col("plain"), change).alias("change"), n.cast("bigint").alias("n"))
    parts = F.array(part(own, F.least(old, new)), part(F.lit("removed"), old - F.least(old, new)), part(F.lit("added"), new - F.least(old, new)))
    out = s.select("pair_id", F.explode(parts).alias("p")).select("pair_id", "p.*").filter("n > 0")
    subs = _subrows(pairs, blocks, s)
    if subs is None:
        return out
    more = F.explode(F.transform("subs", lambda x: F.when(x["i1"] == x["i2"], "added").when(x["j1"] == x["j2"], "removed")))
    return out.unionByName(subs.select("pair_id", more.alias("change"), F.lit(1).cast("bigint").alias("n")))


def _segments(blocks: DataFrame, fragments: DataFrame, marked: DataFrame, max_tokens: int) -> DataFrame:
    """``pair_id, slot, k, words, cells`` of the paired blocks of changed fragments whose segments aren't known without a match."""
    n = F.least(F.size("old_blocks"), F.size("new_blocks"))
    none = F.lit(None).cast("array<string>")

    def both(a: Column, b: Column) -> Column:
        (_, old_sep, old_cells), (_, new_sep, new_cells) = table_parts(a, none), table_parts(b, none)
        return F.struct(a.alias("old"), b.alias("new"), old_cells.alias("oc"), new_cells.alias("wc"), old_sep.alias("os"), new_sep.alias("ws"))

    # cells are made inside the array, so that the explosion below keeps them from being made again for each use
    two = F.zip_with(F.slice("old_blocks", 1, n), F.slice("new_blocks", 1, n), both)
    changed = marked.filter((F.col("label") == "changed") & ~F.col("formatting") & (F.col("i2") > F.col("i1")) & (F.col("j2") > F.col("j1"))).drop("i2", "j2")
    texts = fragments.filter(n > 0).select("pair_id", "frag_no", "old_blocks", "new_blocks")
    lines = changed.join(texts, ["pair_id", "frag_no"]).select("pair_id", "slot", "old_doc", "new_doc", "i1", "j1", F.posexplode(two).alias("k", "t"))
    lines = lines.select(*_LINE, "old_doc", (F.col("i1") + F.col("k")).alias("old_pos"), "new_doc", (F.col("j1") + F.col("k")).alias("new_pos"), "t.*")
    if "cells" in blocks.columns:
        given = blocks.filter(F.col("cells").isNotNull()).select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("cells").cast("array<string>").alias("cells"))
        lines = lines.join(given.toDF("old_doc", "old_pos", "og"), ["old_doc", "old_pos"], "left").join(given.toDF("new_doc", "new_pos", "wg"), ["new_doc", "new_pos"], "left")
        sep = {s: F.col(s) & F.col(g).isNull() for s, g in (("os", "og"), ("ws", "wg"))}
        lines = lines.withColumns({"oc": F.coalesce("og", "oc"), "wc": F.coalesce("wg", "wc"), **sep})
    by_cells = F.col("oc").isNotNull() & F.col("wc").isNotNull()
    by_words = ~by_cells & ~F.col("os") & ~F.col("ws") & (F.col("old") != F.col("new"))
    some = lines.filter(by_cells | by_words)
    kept = lambda c, cond: F.when(cond, F.col(c))
    some = some.select(*_LINE, kept("old", by_words).alias("old"), kept("new", by_words).alias("new"), kept("oc", by_cells).alias("old_cells"), kept("wc", by_cells).alias("new_cells"))
    return diff.changed_segments(some, _LINE, max_tokens)


def _placed(pairs: DataFrame, whole: DataFrame, stretches: DataFrame) -> DataFrame:
    """``pair_id, side, pos, b`` of each block of a pair, and ``pair_id, side, pos, begins`` where a stretch begins on a side; ``_numbered`` brings them together."""
    side = lambda number, at: F.struct(F.lit(number).alias("side"), at.alias("at"))
    if "in_pairs" in whole.columns:
        own = whole.select("b", "pos", F.explode("in_pairs").alias("x")).select("x.pair_id", "x.side", "pos", "b")
    else:
        own = whole.join(sides(pairs), "doc_id").select("pair_id", "side", "pos", "b")
    begins = F.array(side(0, F.when(F.col("i2") > F.col("i1"), F.col("i1"))), side(1, F.when(F.col("j2") > F.col("j1"), F.col("j1"))))
    starts = stretches.select("pair_id", "slot", "plain", "label", F.explode(begins).alias("x")).filter("x.at IS NOT NULL")
    starts = starts.select("pair_id", "x.side", F.col("x.at").alias("pos"), F.struct("slot", F.col("x.at").alias("at"), "plain", "label").alias("begins"))
    return own.unionByName(starts, allowMissingColumns=True)


def _numbered(parts: DataFrame) -> DataFrame:
    """The blocks of ``parts`` with the ``slot``, ``plain`` and ``label`` of their stretch and their place ``k`` in it; other parts have slot and place already."""
    order = Window.partitionBy("pair_id", "side").orderBy("pos", F.col("begins").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumn("__in", F.when(F.col("side") < 2, F.last("begins", ignorenulls=True).over(order))).filter("begins IS NULL").drop("begins")
    return own.withColumns({"slot": F.coalesce("slot", "__in.slot"), "k": F.coalesce("k", F.col("pos") - F.col("__in.at")), "plain": F.col("__in.plain"), "label": F.col("__in.label")}).drop("__in", "pos")


def build_rows(pairs: DataFrame, blocks: DataFrame, fragments: DataFrame, labels: DataFrame, max_tokens: int = matching.MAX_INLINE_TOKENS) -> DataFrame:
    """Rows of both documents of each pair side by side.

    ``pairs``: ``pair_id, old_doc, new_doc, is_pdf``; ``blocks``: ``doc_id, pos`` (from 0,
    without gaps), ``text`` and perhaps ``html, images, page, words, cells``, or ``in_pairs`` of ``with_pairs``;
    ``fragments`` as ``find_diffs`` or ``refine_fragments`` gives them; ``labels``:
    ``pair_id, frag_no, label``. Returns ``pair_id, row_no`` (from 0), ``left, right``
    (structs or null) and ``placeholder``: the class that a missing side shows.

    Equal stretches are paired; in a fragment the k-th old block stands beside the
    k-th new one. A fragment is mere formatting if its label says so or, for PDFs,
    if its blocks have equal formatting keys; its rows have no class. Else a row of
    one side is removed or added, and a paired row has its label's class; changed
    pairs have word segments, by cells where both have cells. Where the images of a
    paired row differ, a table row is marked, and other rows give their images to
    sub-rows.
    """
    marked = _marked(pairs, fragments, labels)
    s = _stretches(pairs, blocks, marked)
    # a block is moved to its pair once; what Python makes goes there by itself, and there lines are put together and numbered
    parts = _placed(pairs, _whole_blocks(blocks), s).unionByName(_segments(blocks, fragments, marked, max_tokens).withColumn("side", F.lit(2)), allowMissingColumns=True)
    subs = _subrows(pairs, blocks, s)
    parts = parts.withColumn("subs", F.lit(None).cast(_SUB)) if subs is None else parts.unionByName(subs.withColumn("side", F.lit(2)), allowMissingColumns=True)
    parts = _numbered(parts.repartition("pair_id"))
    only = lambda c: F.first(c, ignorenulls=True)
    of_side = lambda number: only(F.when(F.col("side") == number, F.col("b")))
    lines = parts.groupBy(*_LINE).agg(of_side(0).alias("o"), of_side(1).alias("w"), *(only(c).alias(c) for c in ("plain", "label", "words", "cells", "subs")))
    paired = F.col("o").isNotNull() & F.col("w").isNotNull()
    left = F.when(F.col("plain"), F.lit(None)).when(~paired, "removed").otherwise(text.side_change(F.col("label"), "left"))
    right = F.when(F.col("plain"), F.lit(None)).when(~paired, "added").otherwise(text.side_change(F.col("label"), "right"))
    whole_words = paired & ~F.col("plain") & (F.col("label") == "changed") & F.col("words").isNull() & F.col("cells").isNull() & ~F.col("o.sep") & ~F.col("w.sep") & (F.col("o.text") == F.col("w.text"))
    lines = lines.select(
        *_LINE, "o", "w", "subs", F.when(F.col("o").isNotNull(), left).alias("lc"), F.when(F.col("w").isNotNull(), right).alias("rc"),
        F.when(whole_words, diff.equal_segments(F.col("o.text"))).otherwise(F.col("words")).alias("ws"), F.col("cells").alias("cs"),
    )
    table_images = (F.col("o.table") | F.col("w.table")) & (_sha1s(F.col("o.images")) != _sha1s(F.col("w.images"))) & F.col("o").isNotNull() & F.col("w").isNotNull()
    no_images = F.array().cast(f"array<{IMAGE}>")

    def side(b: str, change: str, which: str) -> Column:
        images = F.when(F.col("subs").isNotNull(), no_images).otherwise(F.coalesce(F.col(f"{b}.images"), no_images))
        return F.when(
            F.col(b).isNotNull(),
            F.struct(
                F.col(f"{b}.text").alias("text"), F.col(change).alias("change"), F.col(f"{b}.html").alias("html"), images.alias("images"), F.col(f"{b}.page").alias("page"),
                F.col(f"{b}.words").alias("words"), F.col(f"{b}.cells").alias("cells"), F.col(f"{b}.sep").alias("sep"), F.col(f"ws.{which}").alias("segments"),
                F.col(f"cs.{which}").alias("cell_segments"), F.coalesce(table_images, F.lit(False)).alias("images_changed"),
            ),
        )

    base = lines.select("pair_id", "slot", "k", "subs", F.col("o.images").alias("oi"), F.col("w.images").alias("wi"), side("o", "lc", "left").alias("left"), side("w", "rc", "right").alias("right"))
    kind = base.schema["left"].dataType

    def image_side(images: str, x: Column, first: str, end: str, alone: str) -> Column:
        a, b = ("j1", "j2") if first == "i1" else ("i1", "i2")
        count = x[end] - x[first]
        values = {
            "text": F.lit(""), "html": F.lit(""), "images": F.slice(F.coalesce(F.col(images), no_images), x[first] + 1, count), "change": F.when(x[a] == x[b], alone),
            "images_changed": x["changed"], "sep": F.lit(False),
        }
        return F.when(count > 0, F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields)))

    at = ["slot", "k"]
    if subs is not None:
        own = F.array(F.struct(F.lit(-1).alias("sub"), F.col("left"), F.col("right")))
        extra = F.transform("subs", lambda x, i: F.struct(i.alias("sub"), image_side("oi", x, "i1", "i2", "removed").alias("left"), image_side("wi", x, "j1", "j2", "added").alias("right")))
        base = base.select(*_LINE, F.explode(F.when(F.col("subs").isNull(), own).otherwise(F.concat(own, extra))).alias("r")).select(*_LINE, "r.*")
        at.append("sub")
    out = base.withColumn("row_no", F.row_number().over(Window.partitionBy("pair_id").orderBy(*at)) - 1)
    placeholder = F.when(F.col("left").isNull(), F.col("right.change")).when(F.col("right").isNull(), F.col("left.change"))
    return out.select("pair_id", "row_no", "left", "right", placeholder.alias("placeholder"))


def page_markers(alignment: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Collapsed ranges of identical pages, and unreadable pages: ``pair_id, page, last, unreadable, first_old, last_old``.

    Ranges are numbered by the new document's pages; unreadable pages of both sides
    (``pair_id, side, page``) have one marker each.
    """
    same = alignment.filter("kind = 'identical'").groupBy("pair_id", F.col("new_page").alias("page")).agg(F.min("old_page").alias("old_page"))
    island = F.col("page") - F.row_number().over(Window.partitionBy("pair_id").orderBy("page"))
    ranges = same.withColumn("island", island).groupBy("pair_id", "island").agg(
        F.min("page").alias("page"), F.max("page").alias("last"), F.lit(False).alias("unreadable"), F.min_by("old_page", "page").alias("first_old"), F.max_by("old_page", "page").alias("last_old")
    )
    lost = unreadable.select("pair_id", F.col("page")).distinct().select("pair_id", "page", F.col("page").alias("last"), F.lit(True).alias("unreadable"), F.lit(None).cast("int").alias("first_old"), F.lit(None).cast("int").alias("last_old"))
    return ranges.drop("island").unionByName(lost)


def rows_with_markers(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """``pair_id, place`` (from 0), ``row_no`` or the marker ``page, last, unreadable``.

    A marker stands before the first row whose page (the left one, else the right one)
    is above the marker's; the rest come last. Rows without a page are passed over.

    Rows and markers go through one sort by pair and falling page: what a marker stands before is the least
    row number so far. Nothing is joined, so work grows with rows and markers alone.
    """
    paged = rows.select("pair_id", "row_no", F.coalesce("left.page", "right.page").alias("row_page"))
    null = F.lit(None)
    # of one page, markers come first: a marker stands before rows of later pages only
    asked = markers.select("pair_id", F.col("page").alias("at_page"), F.lit(0).alias("is_row"), null.cast("int").alias("row_no"), "page", "last", "unreadable")
    seen = paged.filter("row_page IS NOT NULL").select("pair_id", F.col("row_page").alias("at_page"), F.lit(1).alias("is_row"), "row_no", null.cast("int").alias("page"), null.cast("int").alias("last"), null.cast("boolean").alias("unreadable"))
    falling = Window.partitionBy("pair_id").orderBy(F.col("at_page").desc(), "is_row").rowsBetween(Window.unboundedPreceding, 0)
    first = asked.unionByName(seen).withColumn("before", F.min("row_no").over(falling)).filter("is_row = 0")
    # a marker isn't placed before one that comes earlier
    order = Window.partitionBy("pair_id").orderBy("page", F.col("unreadable").cast("int"))
    reach = F.max(F.coalesce("before", F.lit(2**31 - 1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = first.withColumn("at", reach).withColumn("n", F.row_number().over(order))
    own = placed.select("pair_id", "at", F.lit(0).alias("kind"), "n", null.cast("int").alias("row_no"), "page", "last", "unreadable")
    plain = paged.select("pair_id", F.col("row_no").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("n"), "row_no", null.cast("int").alias("page"), null.cast("int").alias("last"), null.cast("boolean").alias("unreadable"))
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("at", "kind", "n")) - 1
    return own.unionByName(plain).select("pair_id", place.alias("place"), "row_no", "page", "last", "unreadable")


def table_groups(rows: DataFrame) -> DataFrame:
    """Tables made of consecutive rows: ``pair_id, table_no`` (from 0), ``first_row, last_row, n_rows, n_columns, left_empty, right_empty``.

    A row belongs to a table if each side is null or a table row, and one is one.
    Separator rows aren't counted. An empty side has the class of the first changed
    row opposite.
    """
    is_row = lambda s: F.col(f"{s}.cells").isNotNull() | F.coalesce(F.col(f"{s}.sep"), F.lit(False))
    fits = lambda s: F.col(s).isNull() | is_row(s)
    table = fits("left") & fits("right") & (F.coalesce(is_row("left"), F.lit(False)) | F.coalesce(is_row("right"), F.lit(False)))
    order = Window.partitionBy("pair_id").orderBy("row_no")
    marked = rows.withColumn("table", table).withColumn("island", F.sum((~table).cast("int")).over(order)).filter("table")
    sep = F.coalesce(F.col("left.sep"), F.lit(False)) | F.coalesce(F.col("right.sep"), F.lit(False))
    width = lambda s: F.greatest(F.coalesce(F.size(f"{s}.cells"), F.lit(0)), F.coalesce(F.size(f"{s}.cell_segments"), F.lit(0)))
    change = lambda s: F.min_by(F.struct(f"{s}.change"), F.when(F.col(f"{s}.change").isNotNull(), F.col("row_no")))["change"]
    out = marked.withColumn("is_sep", sep).groupBy("pair_id", "island").agg(
        F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.sum((~F.col("is_sep")).cast("int")).alias("n_rows"),
        F.max(F.greatest(width("left"), width("right"))).alias("n_columns"),
        F.when(F.count("left") == 0, change("right")).alias("left_empty"), F.when(F.count("right") == 0, change("left")).alias("right_empty"),
    )
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("first_row")) - 1
    return out.withColumn("table_no", number).select("pair_id", "table_no", "first_row", "last_row", "n_rows", "n_columns", "left_empty", "right_empty")
