"""Summaries of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_counts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each class in a pair: ``pair_id, changed, removed, added, unchanged``.

    ``rows`` as ``build_rows`` or, more cheaply, ``row_changes`` gives them.
    """
    change = F.col("change") if "change" in rows.columns else F.coalesce("left.change", "right.change")
    own = rows.select("pair_id", change.alias("c"), (F.col("n") if "n" in rows.columns else F.lit(1)).alias("n"))
    count = lambda x: F.sum(F.when(F.col("c") == x, F.col("n")))
    sums = own.groupBy("pair_id").agg(*(count(x).alias(x) for x in ("changed", "removed", "added")), F.sum(F.when(F.col("c").isNull(), F.col("n"))).alias("unchanged"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x)
    return pairs.select("pair_id").join(sums, "pair_id", "left").select("pair_id", *(zero(x) for x in ("changed", "removed", "added", "unchanged")))


def degraded_pages(to_read: DataFrame, page_reads: DataFrame, unreadable: DataFrame) -> DataFrame:
    """``pair_id, side, page``: pages whose reading failed or that have no block."""
    bad = to_read.join(page_reads.filter("unreadable OR degraded").select("pair_id", "side", "page").distinct(), ["pair_id", "side", "page"], "left_semi")
    return bad.unionByName(unreadable.select("pair_id", "side", "page")).distinct()


def pair_summary(pairs: DataFrame, fragments: DataFrame, labels: DataFrame, degraded: DataFrame) -> DataFrame:
    """``pair_id, fragments_count, semantic, degraded, degraded_pages`` of each pair.

    ``semantic``: all labels came from a model, which holds for none too, and nothing
    is degraded. Formatting fragments are counted.
    """
    counts = fragments.groupBy("pair_id").agg(F.count("*").alias("n"))
    meaning = labels.groupBy("pair_id").agg(F.bool_and("semantic").alias("all_semantic"))
    bad = degraded.groupBy("pair_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    out = pairs.select("pair_id").join(counts, "pair_id", "left").join(meaning, "pair_id", "left").join(bad, "pair_id", "left")
    is_bad = F.col("pages").isNotNull()
    return out.select(
        "pair_id", F.coalesce("n", F.lit(0)).alias("fragments_count"), (F.coalesce("all_semantic", F.lit(True)) & ~is_bad).alias("semantic"), is_bad.alias("degraded"), F.coalesce("pages", F.array().cast("array<int>")).alias("degraded_pages")
    )


def documents_identical(pairs: DataFrame, summary: DataFrame, alignment: DataFrame, rows: DataFrame) -> DataFrame:
    """``pair_id, identical``: for PDFs whether nothing at all differs, null for other formats.

    No fragment, nothing degraded, no page changed or without a counterpart, no
    difference of images.
    """
    pages = alignment.filter("kind <> 'identical'").select("pair_id").distinct().withColumn("pages_differ", F.lit(True))
    has = lambda s: F.coalesce(F.size(f"{s}.images"), F.lit(0)) > 0
    one_sided = (F.col("left").isNull() & has("right")) | (F.col("right").isNull() & has("left"))
    marked = F.coalesce(F.col("left.images_changed"), F.lit(False)) | F.coalesce(F.col("right.images_changed"), F.lit(False))
    images = rows.filter(marked | one_sided).select("pair_id").distinct().withColumn("images_differ", F.lit(True))
    out = pairs.select("pair_id", "is_pdf").join(summary.select("pair_id", "fragments_count", "degraded"), "pair_id", "left").join(pages, "pair_id", "left").join(images, "pair_id", "left")
    same = (F.col("fragments_count") == 0) & ~F.col("degraded") & F.col("pages_differ").isNull() & F.col("images_differ").isNull()
    return out.select("pair_id", F.when(F.col("is_pdf"), same).alias("identical"))


def same_documents(pairs: DataFrame, blocks: DataFrame, degraded: DataFrame, alignment: DataFrame) -> DataFrame:
    """``pair_id, identical`` as ``documents_identical`` says it of a comparison, without making one.

    ``blocks`` as ``filled_blocks`` gives them. A pair has no fragment if its documents have the same sequence of texts; then
    all rows are pairs of the blocks at one place, and images differ if their fingerprints there do. So nothing
    is matched and no text is moved: a document is two hashes of its blocks' hashes.
    """
    if "images" in blocks.columns:
        image = lambda x: F.struct(x["sha1"].isNull(), x["sha1"])  # noqa: E731  a hash passes over nulls
        images = F.when(F.size("images") > 0, F.xxhash64(F.transform("images", image)))
    else:
        images = F.lit(None).cast("bigint")
    own = F.array_sort(F.collect_list(F.struct("pos", F.xxhash64("text").alias("h"), F.coalesce(images, F.lit(0)).alias("g"))))
    whole = blocks.groupBy("doc_id").agg(F.transform(own, lambda x: F.struct(x["h"], x["g"])).alias("own")).select("doc_id", F.struct(F.xxhash64("own"), F.xxhash64(F.lit(1), F.col("own"))).alias("own"))
    pages = alignment.filter("kind <> 'identical'").select("pair_id").unionByName(degraded.select("pair_id")).distinct().withColumn("pages_differ", F.lit(True))
    out = pairs.select("pair_id", "is_pdf", "old_doc", "new_doc").join(whole.toDF("old_doc", "a"), "old_doc", "left").join(whole.toDF("new_doc", "b"), "new_doc", "left").join(pages, "pair_id", "left")
    return out.select("pair_id", F.when(F.col("is_pdf"), F.col("a").eqNullSafe(F.col("b")) & F.col("pages_differ").isNull()).alias("identical"))


def page_summary(pairs: DataFrame, alignment: DataFrame, unreadable: DataFrame, page_counts: DataFrame) -> DataFrame:
    """``pair_id, unchanged`` (page pairs), ``unreadable_left, unreadable_right, page_count_left, page_count_right``."""
    same = alignment.filter("kind = 'identical'").groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("old_page", "new_page"))).alias("unchanged"))
    pages = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("page"))))
    lost = unreadable.groupBy("pair_id").agg(pages("old").alias("unreadable_left"), pages("new").alias("unreadable_right"))
    counts = page_counts.select("doc_id", "n_pages")
    out = pairs.select("pair_id", "old_doc", "new_doc").join(same, "pair_id", "left").join(lost, "pair_id", "left")
    out = out.join(counts.toDF("old_doc", "page_count_left"), "old_doc", "left").join(counts.toDF("new_doc", "page_count_right"), "new_doc", "left")
    none = F.array().cast("array<int>")
    return out.select(
        "pair_id", F.coalesce("unchanged", F.array().cast("array<struct<old_page:int,new_page:int>>")).alias("unchanged"), F.coalesce("unreadable_left", none).alias("unreadable_left"),
        F.coalesce("unreadable_right", none).alias("unreadable_right"), "page_count_left", "page_count_right",
    )
