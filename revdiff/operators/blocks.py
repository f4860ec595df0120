"""Blocks of documents: normalisation, markdown, runs, tables, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, text

IMAGE_BUDGET = 10 * 1024 * 1024


def filled_blocks(blocks: DataFrame, fold_nbsp: bool = False) -> DataFrame:
    """Blocks with collapsed blanks, those without text and images dropped; ``pos`` stays.

    ``blocks``: ``doc_id, pos, text`` and, if there are any, ``images``; other columns pass.
    """
    raw = F.replace("text", F.lit("\u00a0"), F.lit(" ")) if fold_nbsp else F.col("text")
    out = blocks.withColumn("text", text.collapse_blanks(F.coalesce(raw, F.lit(""))))
    filled = F.col("text") != ""
    if "images" in blocks.columns:
        filled = filled | (F.coalesce(F.size("images"), F.lit(0)) > 0)
    return out.filter(filled)


def normalize_blocks(blocks: DataFrame, fold_nbsp: bool = False) -> DataFrame:
    """The blocks of ``filled_blocks``, ``pos`` given anew from 0."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    return filled_blocks(blocks, fold_nbsp).withColumn("pos", F.row_number().over(order) - 1).select(*blocks.columns)


def table_parts(c: Column, given: Column) -> tuple[Column, Column, Column]:
    """Whether a text is a table row, whether that is a separator, and its cells; ``given`` cells stay."""
    row = F.when(text.is_table_row(c), c)  # null for most blocks, which then cost nothing
    sep = F.coalesce(text.is_table_separator(row), F.lit(False))
    cells = F.when(given.isNotNull(), given).when(~sep, text.parse_table_row(row))
    return row.isNotNull(), given.isNull() & sep, cells


def enrich_table_cells(blocks: DataFrame) -> DataFrame:
    """``cells`` of table rows, and ``sep`` for separator rows; cells that are there stay."""
    given = F.col("cells").cast("array<string>") if "cells" in blocks.columns else F.lit(None).cast("array<string>")
    _, sep, cells = table_parts(F.col("text"), given)
    return blocks.withColumns({"sep": sep, "cells": cells})


def build_blocks(items: DataFrame) -> DataFrame:
    """``items`` (``text, tag`` and perhaps ``cells``) with their ``html``."""
    cells = F.col("cells") if "cells" in items.columns else None
    return items.withColumn("html", markup.block_html(F.col("text"), F.col("tag"), cells))


def markdown_blocks(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Blocks of markdown pages: the keys, ``pos`` (from 0), ``text``, ``tag``.

    ``pages``: the keys and ``markdown``. Headings, table rows and list items are blocks
    of their own; other lines up to a blank one make a paragraph.
    """
    keys = list(keys)
    lines = pages.select(*keys, F.posexplode(text.split_lines(F.coalesce("markdown", F.lit("")))).alias("line", "raw"))
    space = text.SPACE
    line = F.regexp_replace("raw", rf"(?U){space}+\z", "")
    heading = rf"(?U)\A{space}{{0,3}}(#{{1,6}}){space}+(.*)\z"
    item = rf"(?U)\A{space}*([-*+]|\d+[.)]){space}+(.*)\z"
    kind = (
        F.when(F.col("line_text") == "", "blank")
        .when(F.col("line_text").rlike(heading), "heading")
        .when(F.col("line_text").rlike(rf"(?U)\A{space}*\|.*\|{space}*\z"), "tr")
        .when(F.col("line_text").rlike(item), "item")
        .otherwise("text")
    )
    lines = lines.withColumn("line_text", line).withColumn("kind", kind)
    marker = F.regexp_extract("line_text", item, 1)
    tag = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("h"), F.length(F.regexp_extract("line_text", heading, 1))))
        .when(F.col("kind") == "tr", "tr")
        .when(F.col("kind") == "item", F.when(marker.rlike(r"\A\d"), "ol").otherwise("ul"))
        .otherwise("p")
    )
    content = (
        F.when(F.col("kind") == "heading", F.regexp_extract("line_text", heading, 2))
        .when(F.col("kind") == "item", F.regexp_extract("line_text", item, 2))
        .when(F.col("kind") == "tr", F.col("line_text"))
        .otherwise(text.strip(F.col("line_text")))
    )
    order = Window.partitionBy(*keys).orderBy("line")
    before = F.lag("kind", 1, "blank").over(order)
    starts = F.when((F.col("kind") != "text") | (before != "text"), 1).otherwise(0)
    lines = lines.withColumn("tag", tag).withColumn("content", content).withColumn("begins", starts)
    lines = lines.withColumn("island", F.sum("begins").over(order)).filter("kind <> 'blank'")
    parts = F.array_sort(F.collect_list(F.struct("line", "content")))
    grouped = lines.groupBy(*keys, "island").agg(F.first("tag").alias("tag"), parts.alias("parts"))
    joined = text.collapse_blanks(F.array_join(F.transform("parts", lambda x: x["content"]), " "))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("island")) - 1
    return grouped.withColumn("text", joined).filter("text <> ''").select(*keys, number.alias("pos"), "text", "tag")


def blocks_from_page_reads(reads: DataFrame) -> DataFrame:
    """Blocks of the pages of ``reads`` (``doc_id, page, markdown, unreadable``) in page order; unreadable pages give none."""
    made = build_blocks(markdown_blocks(reads.filter(~F.coalesce("unreadable", F.lit(False)))))
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    return made.withColumn("pos", F.row_number().over(order) - 1)


def style_tag(style: Column) -> Column:
    """Tag of a paragraph style."""
    level = F.regexp_extract(style, r"Heading (\d)", 1)
    number = F.least(F.greatest(level.try_cast("int"), F.lit(1)), F.lit(6))
    return (
        F.when(level != "", F.concat(F.lit("h"), number))
        .when(style.startswith("List Bullet"), "ul")
        .when(style.startswith("List Number"), "ol")
        .otherwise("p")
    )


def paragraphs_from_runs(runs: DataFrame) -> DataFrame:
    """Paragraph text and HTML from formatted runs.

    ``runs``: ``doc_id, block_no, run_no, text, bold, italic, underline, style``. White
    space is collapsed over the runs and stripped at the ends. Returns ``doc_id,
    block_no, text, tag, html``.
    """
    runs = runs.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?U){text.SPACE}+", " "))
    packed = F.array_sort(F.collect_list(F.struct("run_no", "text", "bold", "italic", "underline")))
    grouped = runs.groupBy("doc_id", "block_no").agg(packed.alias("runs"), F.first("style", ignorenulls=True).alias("style"))

    def step(acc: Column, run: Column) -> Column:
        t = F.when(acc["space"], F.regexp_replace(run["text"], r"\A +", "")).otherwise(run["text"])
        html = markup.escape(t)
        for flag, tag in (("bold", "strong"), ("italic", "em"), ("underline", "u")):
            html = F.when(F.coalesce(run[flag], F.lit(False)), F.concat(F.lit(f"<{tag}>"), html, F.lit(f"</{tag}>"))).otherwise(html)
        return F.when(t == "", acc).otherwise(
            F.struct(F.concat(acc["text"], t).alias("text"), F.concat(acc["html"], html).alias("html"), t.endswith(" ").alias("space"))
        )

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("html"), F.lit(True).alias("space"))
    out = grouped.withColumn("made", F.aggregate("runs", start, step))
    inner = F.regexp_replace("made.html", r"\s+((?:<[^>]+>)*)\z", "$1")
    inner = F.regexp_replace(inner, r"\A((?:<[^>]+>)*)\s+", "$1")
    plain = F.regexp_replace("made.text", r" +\z", "")
    tag = style_tag(F.coalesce("style", F.lit("")))
    made = out.select("doc_id", "block_no", plain.alias("text"), tag.alias("tag"), inner.alias("inner"))
    html = markup.wrap(F.col("tag"), markup.html_or_plain(F.col("inner"), F.col("text")))
    return made.select("doc_id", "block_no", "text", "tag", html.alias("html"))


def table_rows_from_cells(cells: DataFrame) -> DataFrame:
    """Table-row blocks from the cells of word-processor tables.

    ``cells``: ``doc_id, block_no, row_no, col_no, tc_id, text``; a merged cell repeats its
    ``tc_id``. A cell equal to the one before it, or met anywhere in the row above, is
    empty. Returns ``doc_id, block_no, row_no, text, tag, html``.
    """
    order = Window.partitionBy("doc_id", "block_no", "row_no").orderBy("col_no")
    above = cells.select("doc_id", "block_no", (F.col("row_no") + 1).alias("row_no"), "tc_id").distinct().withColumn("above", F.lit(True))
    one = text.strip(F.regexp_replace(F.coalesce("text", F.lit("")), rf"(?U){text.SPACE}+", " "))
    marked = cells.join(above, ["doc_id", "block_no", "row_no", "tc_id"], "left").withColumn(
        "again", F.coalesce("above", F.lit(False)) | F.coalesce(F.col("tc_id") == F.lag("tc_id").over(order), F.lit(False))
    )
    marked = marked.withColumn("raw", F.when(F.col("again"), "").otherwise(one))
    ordered = F.array_sort(F.collect_list(F.struct("col_no", "raw")))
    rows = marked.groupBy("doc_id", "block_no", "row_no").agg(F.transform(ordered, lambda x: x["raw"]).alias("raw"))
    shown = F.array_join(F.transform("raw", lambda x: F.replace(x, F.lit("|"), F.lit("\\|"))), " | ")
    return rows.select("doc_id", "block_no", "row_no", F.concat(F.lit("| "), shown, F.lit(" |")).alias("text"), F.lit("tr").alias("tag"), markup.cells_html(F.col("raw")).alias("html"))


def apply_image_budget(images: DataFrame, limit: int = IMAGE_BUDGET) -> DataFrame:
    """Images (``doc_id, pos, img_no, n_bytes, ...``) of each document in order, up to the first that overflows.

    Nothing after that one is kept, but for images of zero bytes.
    """
    order = Window.partitionBy("doc_id").orderBy("pos", "img_no").rowsBetween(Window.unboundedPreceding, 0)
    return images.withColumn("__used", F.sum("n_bytes").over(order)).filter((F.col("__used") <= limit) | (F.col("n_bytes") == 0)).drop("__used")


def has_text_layer(pages: DataFrame) -> DataFrame:
    """``doc_id, has_text``: whether any page (``doc_id, page, text``) has text."""
    return pages.groupBy("doc_id").agg(F.coalesce(F.bool_or(text.strip(F.col("text")) != ""), F.lit(False)).alias("has_text"))
