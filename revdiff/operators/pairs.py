"""Document pairs and the pages they need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def make_pairs(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of two known documents of one format.

    ``requests``: ``pair_id, old_doc, new_doc``; ``docs``: ``doc_id, ext``. Returns all
    requests with ``ext``, ``status`` (``ok`` or ``rejected``) and ``reason``
    (``unknown document``, ``different formats`` or null). Extensions are compared in
    lower case.
    """
    ext = docs.select(F.col("doc_id"), F.lower("ext").alias("ext"))
    both = requests.join(ext.toDF("old_doc", "old_ext"), "old_doc", "left").join(ext.toDF("new_doc", "new_ext"), "new_doc", "left")
    reason = F.when(F.col("old_ext").isNull() | F.col("new_ext").isNull(), "unknown document").when(F.col("old_ext") != F.col("new_ext"), "different formats")
    return both.select("pair_id", "old_doc", "new_doc", F.col("old_ext").alias("ext"), F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"), reason.alias("reason"))


def pair_branch(pairs: DataFrame, text_layers: DataFrame) -> DataFrame:
    """``pairs`` (with ``ext``) and their ``branch``.

    ``text`` for two PDFs with a text layer each, ``read`` for other PDFs, ``file`` for
    other formats. ``text_layers``: ``doc_id, has_text``.
    """
    layer = text_layers.select("doc_id", "has_text")
    both = pairs.join(layer.toDF("old_doc", "old_text"), "old_doc", "left").join(layer.toDF("new_doc", "new_text"), "new_doc", "left")
    text = F.coalesce("old_text", F.lit(False)) & F.coalesce("new_text", F.lit(False))
    branch = F.when(F.regexp_replace("ext", r"^\.", "") != "pdf", "file").when(text, "text").otherwise("read")
    return both.select(*pairs.columns, branch.alias("branch"))


def pages_to_read(alignment: DataFrame) -> DataFrame:
    """``pair_id, side, page``: pages of changed pairs and pages without a counterpart."""
    old = alignment.filter("kind IN ('changed', 'only_old')").select("pair_id", F.lit("old").alias("side"), F.col("old_page").alias("page"))
    new = alignment.filter("kind IN ('changed', 'only_new')").select("pair_id", F.lit("new").alias("side"), F.col("new_page").alias("page"))
    return old.unionByName(new).distinct()


def drop_unchanged_pages(blocks: DataFrame, alignment: DataFrame) -> DataFrame:
    """Blocks (``pair_id, side, page, ...``) that aren't on a page identical in both documents; a null page stays."""
    same = alignment.filter("kind = 'identical'")
    old = same.select("pair_id", F.lit("old").alias("side"), F.col("old_page").alias("page"))
    new = same.select("pair_id", F.lit("new").alias("side"), F.col("new_page").alias("page"))
    return blocks.join(old.unionByName(new), ["pair_id", "side", "page"], "left_anti")


def unreadable_pages(to_read: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages of ``to_read`` (``pair_id, side, page``) without any block."""
    return to_read.join(blocks.select("pair_id", "side", "page").distinct(), ["pair_id", "side", "page"], "left_anti")


def expand_pages(requests: DataFrame, blocks: DataFrame, text_layers: DataFrame, page_reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of a page range of documents, and what is wrong with a request.

    ``requests``: ``request_id, doc_id, first, last``; ``blocks``: ``doc_id, page, ...``;
    ``page_reads``: ``doc_id, page, unreadable``. Returns the blocks with their
    ``request_id``, and errors ``request_id, reason, pages``: a range that isn't
    ``1 <= first <= last``, or, for documents without a text layer, pages that weren't
    read or are unreadable. A request with an error gives no blocks.
    """
    valid = (F.col("first") >= 1) & (F.col("first") <= F.col("last"))
    none = F.array().cast("array<int>")
    bad = requests.filter(~F.coalesce(valid, F.lit(False))).select("request_id", F.lit("bad range").alias("reason"), none.alias("pages"))
    good = requests.filter(valid).join(text_layers.select("doc_id", "has_text"), "doc_id", "left")
    wanted = good.filter(~F.coalesce("has_text", F.lit(False))).select("request_id", "doc_id", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("page"))
    read = page_reads.select("doc_id", F.col("page").cast("int").alias("page"), F.col("unreadable"))
    state = wanted.join(read, ["doc_id", "page"], "left").withColumn("reason", F.when(F.col("unreadable").isNull(), "missing page").when(F.col("unreadable"), "unreadable page"))
    lost = state.filter("reason IS NOT NULL").groupBy("request_id", "reason").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    errors = bad.unionByName(lost)
    fine = good.join(errors.select("request_id").distinct(), "request_id", "left_anti").select("request_id", "doc_id", "first", "last")
    out = fine.join(blocks, "doc_id").filter(F.col("page").between(F.col("first"), F.col("last"))).drop("first", "last")
    return out, errors
