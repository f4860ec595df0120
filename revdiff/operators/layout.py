"""Blocks from words, characters and table cells with their places on a page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, text
from ..kernels import page as one_page
from ..kernels.page import LIST_MARKERS, MARKER_GAP, MARKER_HEIGHT, PARAGRAPH_GAPS

# fixed value: points under a paragraph's top
WORD_BAND = 14.0

_PAGE = ["doc_id", "page"]


#: Sides, in points, of the squares by which words meet cells, and the most squares that a cell is dealt to.
SQUARE_WIDTH, SQUARE_HEIGHT, MOST_SQUARES = 64.0, 16.0, 4096


def words_outside_cells(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Words (``doc_id, page, x0, top, x1, bottom, ...``) whose centre lies in no cell (``doc_id, page, x0, y0, x1, y1``), edges included.

    A word meets only the cells that reach into its centre's square of the page, so a
    page's words aren't compared with all its cells; the few cells that cover very
    many squares are compared by page.
    """
    box = cells.filter("x0 IS NOT NULL").select(*_PAGE, F.col("x0").alias("cx0"), F.col("y0").alias("cy0"), F.col("x1").alias("cx1"), F.col("y1").alias("cy1"))
    square = lambda c, side: F.floor(c / side).cast("bigint")
    count = (square(F.col("cx1"), SQUARE_WIDTH) - square(F.col("cx0"), SQUARE_WIDTH) + 1) * (square(F.col("cy1"), SQUARE_HEIGHT) - square(F.col("cy0"), SQUARE_HEIGHT) + 1)
    box = box.filter("cx1 >= cx0 AND cy1 >= cy0").withColumn("__squares", count)
    small = box.filter(F.col("__squares") <= MOST_SQUARES).withColumn("__gx", F.explode(F.sequence(square(F.col("cx0"), SQUARE_WIDTH), square(F.col("cx1"), SQUARE_WIDTH))))
    small = small.withColumn("__gy", F.explode(F.sequence(square(F.col("cy0"), SQUARE_HEIGHT), square(F.col("cy1"), SQUARE_HEIGHT))))
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    same_page = (F.col("w.doc_id") == F.col("c.doc_id")) & (F.col("w.page") == F.col("c.page"))
    inside = same_page & x.between(F.col("c.cx0"), F.col("c.cx1")) & y.between(F.col("c.cy0"), F.col("c.cy1"))
    near = inside & (square(x, SQUARE_WIDTH) == F.col("c.__gx")) & (square(y, SQUARE_HEIGHT) == F.col("c.__gy"))
    rest = words.alias("w").join(small.alias("c"), near, "left_anti")
    return rest.alias("w").join(box.filter(F.col("__squares") > MOST_SQUARES).alias("c"), inside, "left_anti")


def lines_from_words(words: DataFrame) -> DataFrame:
    """Words with ``line_no`` (from 0), ``line_top``, the page's ``gap`` and ``line_pos`` (from 0, in the page).

    Words are taken by (top to a tenth, x0). The gap is the upper median of the word
    heights; a word belongs to the current line if its top is at most a gap from the
    top of the line's first word. A page's words are sorted as an array and folded once,
    which notes only where lines begin.
    """
    names = words.columns
    row = F.struct(F.bround("top", 1).alias("__top"), F.col("x0").alias("__x0"), F.col("word_no").alias("__no"), F.struct(*names).alias("w"))
    pages = words.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(row), lambda a, b: _before(a, b)).alias("ws"), F.sort_array(F.collect_list(F.col("bottom") - F.col("top"))).alias("heights"))
    pages = pages.withColumn("gap", F.element_at("heights", (F.floor(F.size("heights") / 2) + 1).cast("int")))
    starts = F.array().cast("array<struct<at:int,top:double>>")

    def step(acc, x):
        top = x["w"]["top"].cast("double")
        new = F.coalesce(F.abs(top - acc["top"]) > F.col("gap"), F.lit(True))
        begun = F.concat(acc["starts"], F.array(F.struct(acc["n"].alias("at"), top.alias("top"))))
        return F.when(new, F.struct((acc["n"] + 1).alias("n"), top.alias("top"), begun.alias("starts"))).otherwise(F.struct((acc["n"] + 1).alias("n"), acc["top"].alias("top"), acc["starts"].alias("starts")))

    first = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("top"), starts.alias("starts"))
    pages = pages.withColumn("starts", F.aggregate("ws", first, step, lambda acc: acc["starts"]))
    ends = F.concat(F.slice(F.transform("starts", lambda s: s["at"]), 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("ws")))
    cut = F.transform(F.arrays_zip("starts", F.col("ends")), lambda z: F.struct(z["starts"]["at"].alias("at"), z["starts"]["top"].alias("top"), F.slice("ws", z["starts"]["at"] + 1, z["ends"] - z["starts"]["at"]).alias("ws")))
    lines = pages.withColumn("ends", ends).select("gap", F.posexplode(cut).alias("line_no", "line"))
    every = lines.select("gap", "line_no", F.col("line.top").alias("line_top"), F.col("line.at").alias("at"), F.posexplode("line.ws").alias("i", "x"))
    return every.select("x.w.*", "line_no", "line_top", "gap", (F.col("at") + F.col("i")).alias("line_pos"))


def _before(a, b):
    """Order of two words by (top to a tenth, x0, number), whatever else they hold."""
    out = F.lit(0)
    for c in ("__no", "__x0", "__top"):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def restore_list_markers(lines: DataFrame, chars: DataFrame) -> DataFrame:
    """Line words (from ``lines_from_words``) and, before lines that lack one, the list marker on their left.

    ``chars``: ``doc_id, page, text, x0, top, x1, bottom``. Of the markers within 3 points
    of the line's top that end at least 2 points left of its first word, the first by
    (top to a tenth, x0) is added, with ``line_pos`` -1. Lines and markers meet in bands of
    3 points, so a page's lines aren't compared with all its markers.
    """
    first = lines.groupBy(*_PAGE, "line_no").agg(F.min_by(F.struct("text", "x0", "line_top", "gap"), "line_pos").alias("f"))
    first = first.filter(~F.col("f.text").isin(*LIST_MARKERS)).select(*_PAGE, "line_no", F.col("f.line_top").alias("line_top"), F.col("f.gap").alias("gap"), F.col("f.x0").alias("__x"))
    band = lambda c: F.floor(c / MARKER_HEIGHT).cast("bigint")
    first = first.withColumn("__band", F.explode(F.sequence(band(F.col("line_top")) - 1, band(F.col("line_top")) + 1)))
    marks = chars.filter(F.col("text").isin(*LIST_MARKERS)).select(*_PAGE, *(F.col(c).alias(f"m_{c}") for c in ("text", "x0", "top", "x1", "bottom")), band(F.col("top")).alias("__band"))
    near = (F.abs(F.col("m_top") - F.col("line_top")) <= MARKER_HEIGHT) & (F.col("m_x1") <= F.col("__x") - MARKER_GAP)
    mark = F.struct("m_text", "m_x0", "m_top", "m_x1", "m_bottom", "line_top", "gap")
    found = first.join(marks, [*_PAGE, "__band"]).filter(near).groupBy(*_PAGE, "line_no").agg(F.min_by(mark, F.struct(F.bround("m_top", 1), F.col("m_x0"))).alias("m")).select(*_PAGE, "line_no", "m.*")
    own = {"text": "m_text", "x0": "m_x0", "top": "m_top", "x1": "m_x1", "bottom": "m_bottom"}
    kept = {*_PAGE, "line_no", "line_top", "gap"}
    added = found.select(*(F.col(n) if n in kept else (F.col(own[n]).alias(n) if n in own else F.lit(-1 if n == "line_pos" else None).cast(t).alias(n)) for n, t in lines.dtypes))
    return lines.unionByName(added)


def paragraphs_from_lines(lines: DataFrame) -> DataFrame:
    """Paragraphs of a page: ``doc_id, page, par_no, top, text``.

    A line whose top is more than 1.6 gaps under the lowest bottom of the line before
    begins a paragraph. Words are joined by spaces, lines by line breaks.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_pos", "text")))
    rows = lines.groupBy(*_PAGE, "line_no").agg(
        F.first("line_top").alias("top"), F.first("gap").alias("gap"), F.max("bottom").alias("bottom"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text")
    )
    order = Window.partitionBy(*_PAGE).orderBy("line_no")
    breaks = F.coalesce(F.col("top") - F.lag("bottom").over(order) > PARAGRAPH_GAPS * F.col("gap"), F.lit(False))
    rows = rows.withColumn("par_no", F.sum(breaks.cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    whole = text.collapse_blanks(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"))
    return rows.groupBy(*_PAGE, "par_no").agg(F.min_by("top", "line_no").alias("top"), whole.alias("text"))


def paragraph_word_boxes(paragraphs: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, page, par_no, words``: boxes of the words within 14 points under a paragraph's top.

    ``sizes``: ``doc_id, page, width``. The page is cut into bands of that height; a paragraph meets the words of
    two of them alone, so a page's words aren't compared with all its paragraphs.
    """
    box = F.struct(*(F.col(f"w.{c}").alias(c) for c in ("x0", "top", "x1", "bottom")))
    band = F.floor(F.col("top") / WORD_BAND).cast("bigint")
    p = paragraphs.join(sizes.select(*_PAGE, "width"), _PAGE).withColumn("__band", F.explode(F.array(band, band + 1))).alias("p")
    w = words.withColumn("__band", band).alias("w")
    same_band = (F.col("p.doc_id") == F.col("w.doc_id")) & (F.col("p.page") == F.col("w.page")) & (F.col("p.__band") == F.col("w.__band"))
    near = same_band & F.col("w.x0").between(0, F.col("p.width")) & F.col("w.top").between(F.col("p.top"), F.col("p.top") + WORD_BAND)
    found = p.join(w, near).select("p.doc_id", "p.page", "p.par_no", F.struct(F.col("w.word_no").alias("n"), box.alias("b")).alias("w"))
    return found.groupBy(*_PAGE, "par_no").agg(F.transform(F.array_sort(F.collect_list("w")), lambda x: x["b"]).alias("words"))


def table_rows_from_rects(cells: DataFrame) -> DataFrame:
    """Table rows of pages: ``doc_id, page, table_no, row_no, top, text, cells``.

    ``cells``: ``doc_id, page, table_no, row_no, col_no, y0, text``; null texts are empty.
    Rows without any text, or without any placed cell, are left out. Pipes aren't escaped.
    """
    ordered = F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("t"))))
    rows = cells.groupBy(*_PAGE, "table_no", "row_no").agg(F.min("y0").alias("top"), F.transform(ordered, lambda x: x["t"]).alias("cells"))
    rows = rows.filter(F.col("top").isNotNull() & F.exists("cells", lambda x: text.strip(x) != ""))
    return rows.select(*_PAGE, "table_no", "row_no", "top", F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |")).alias("text"), "cells")


#: Gives the words, cells and further characters of a page from a row of a table of pages.
Place = Callable[[tuple], tuple[list[one_page.Word], list[one_page.Cell], list[one_page.Word]]]


def page_items(pages: DataFrame, place: Place) -> DataFrame:
    """Table rows (``kind`` 0) and paragraphs of the words beside them (1): ``doc_id, page, top, kind, table_no, no, text, cells``.

    ``pages`` has one row a page, ``doc_id, page`` and what ``place`` needs to give its words and cells. The rows are those of
    ``table_rows_from_rects`` and of ``words_outside_cells``, ``lines_from_words``, ``restore_list_markers`` and
    ``paragraphs_from_lines``; but where a page's words are known from its row, they are placed there, and no word is moved.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: list[tuple] = []
            for row in pdf.itertuples(index=False):
                words, cells, chars = place(row)
                made += [(row.doc_id, row.page, top, 0, table, no, f"| {' | '.join(texts)} |", texts) for table, no, top, texts in one_page.table_rows(cells)]
                made += [(row.doc_id, row.page, top, 1, 0, no, joined, None) for no, (top, joined) in enumerate(one_page.paragraphs(words, cells, chars))]
            yield pd.DataFrame(made, columns=["doc_id", "page", "top", "kind", "table_no", "no", "text", "cells"])

    types = dict(pages.dtypes)
    out = pages.mapInPandas(run, f"doc_id {types['doc_id']}, page {types['page']}, top double, kind int, table_no int, no int, text string, cells array<string>")
    return out.withColumn("text", F.when(F.col("kind") == 0, F.col("text")).otherwise(text.collapse_blanks(F.col("text"))))


def page_paragraphs(pages: DataFrame, place: Place) -> DataFrame:
    """The paragraphs of ``page_items``, as ``paragraphs_from_lines`` gives them."""
    return page_items(pages, place).filter("kind = 1").select(*_PAGE, F.col("no").cast("bigint").alias("par_no"), "top", "text")


def assemble_page_blocks(paragraphs: DataFrame, table_rows: DataFrame, images: DataFrame) -> DataFrame:
    """Blocks of text-layer documents: ``doc_id, pos, page, text, tag, html, cells, images``.

    Table rows and paragraphs by their top, table rows first on ties. A page's images
    (``doc_id, page, images``) go to its first block, or make a block without text.
    """
    p = paragraphs.select(*_PAGE, "top", F.lit(1).alias("kind"), F.lit(0).alias("table_no"), F.col("par_no").alias("no"), "text", F.lit(None).cast("array<string>").alias("cells"))
    t = table_rows.select(*_PAGE, "top", F.lit(0).alias("kind"), "table_no", F.col("row_no").alias("no"), "text", "cells")
    return assemble_items(p.unionByName(t), images)


def assemble_items(items: DataFrame, images: DataFrame) -> DataFrame:
    """``assemble_page_blocks`` of the rows that ``page_items`` gives: texts are moved once, to their document, where pages and blocks are numbered and meet their images."""
    own = items.filter("kind = 0 OR text <> ''").withColumn("images", F.lit(None).cast(images.schema["images"].dataType))
    some = images.filter(F.size("images") > 0).select(*_PAGE, F.lit(2).alias("kind"), "images")
    every = own.unionByName(some, allowMissingColumns=True).repartition("doc_id")
    # images stand behind a page's other rows: they see whether there are any, and the first of these takes them
    first = Window.partitionBy(*_PAGE).orderBy(F.col("kind") == 2, "top", "kind", "table_no", "no")
    page = Window.partitionBy(*_PAGE)
    told = every.withColumns({"n": F.row_number().over(first), "given": F.collect_list("images").over(page), "filled": F.min("kind").over(page) < 2})
    told = told.filter((F.col("kind") < 2) | ~F.col("filled"))
    mine = F.when(F.col("kind") == 2, F.array("images")).when((F.col("n") == 1) & (F.size("given") > 0), F.col("given"))
    out = told.select(*_PAGE, "n", F.coalesce("text", F.lit("")).alias("text"), "kind", "cells", F.explode_outer(mine).alias("images"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "n")) - 1
    tag = F.when(F.col("kind") == 0, "tr").when(F.col("kind") == 1, text.heading_tag(F.col("text"))).otherwise("p")
    placed = out.select("doc_id", pos.alias("pos"), "page", "text", tag.alias("tag"), "cells", "images")
    html = F.when(F.col("text") == "", "").otherwise(markup.block_html(F.col("text"), F.col("tag"), F.col("cells")))
    return placed.select("doc_id", "pos", "page", "text", "tag", html.alias("html"), "cells", "images")
