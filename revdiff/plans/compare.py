"""Comparison of many document pairs in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as block_ops
from ..operators import diff, model, pages, rows, summary
from ..operators import pairs as pair_ops
from ..sources import runs


@dataclass
class Comparison:
    """Tables of a comparison, all keyed by ``pair_id``; ``rows``, ``summary`` and ``counts`` are planned when they are asked for.

    ``release`` frees what is kept for them. The tables can still be taken from here afterwards, at the price
    of being made anew; those taken before can't be read any more.
    """

    pairs: DataFrame
    blocks: DataFrame
    fragments: DataFrame
    labels: DataFrame
    degraded: DataFrame
    remake: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]
    kept: list[str]

    @cached_property
    def rows(self) -> DataFrame:
        return rows.build_rows(self.pairs, self.blocks, self.fragments, self.labels)

    @cached_property
    def summary(self) -> DataFrame:
        return summary.pair_summary(self.pairs, self.fragments, self.labels, self.degraded)

    @cached_property
    def counts(self) -> DataFrame:
        return summary.change_counts(self.pairs, rows.row_changes(self.pairs, self.blocks, self.fragments, self.labels))

    def release(self) -> None:
        for path in self.kept:
            runs.delete_folder(self.pairs.sparkSession, path)
        self.kept = []
        self.blocks, self.fragments, self.labels = self.remake()
        for planned in ("rows", "summary", "counts"):
            self.__dict__.pop(planned, None)


def cut(table: DataFrame) -> DataFrame:
    """``table``, made now and written to the checkpoint folder, so that plans upon it stay small.

    The folder is the session's ``spark.checkpoint.dir``. Only where Spark runs on this machine
    alone and none is set, as in tests, a temporary one is taken.
    """
    spark = table.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(runs.shared_folder(spark))
    return table.checkpoint()


def _stored(table: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``table``, made now and written to a folder of its own in the shared one, and that folder.

    Executors that share a cached table make its parts more than once, and a large one leaves them little memory; of a
    written one a reader takes the columns it needs.
    """
    path = runs.own_folder(table.sparkSession, name)
    typed = table.select(*(F.col(c).cast("string").alias(c) if t == "void" else F.col(c) for c, t in table.dtypes))
    typed.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(typed.schema).parquet(path), path


def _none_degraded(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", F.lit("old").alias("side"), F.lit(0).alias("page")).limit(0)


def identical_documents(pairs: DataFrame, blocks: DataFrame, alignment: DataFrame, degraded: DataFrame | None = None) -> DataFrame:
    """``pair_id, identical`` of document pairs, for which no comparison is made: tables as for ``compare_blocks``, and the alignment of the pages."""
    return summary.same_documents(pairs, block_ops.filled_blocks(blocks), _none_degraded(pairs) if degraded is None else degraded, alignment)


def compare_blocks(pairs: DataFrame, blocks: DataFrame, chat: model.Chat | None = None, degraded: DataFrame | None = None) -> Comparison:
    """Compare the blocks of document pairs.

    ``pairs``: ``pair_id, old_doc, new_doc, is_pdf``; ``blocks``: ``doc_id, pos, text`` and
    perhaps ``html, images, page, words, cells``; ``degraded``: ``pair_id, side, page``.
    The blocks and the fragments are written to the checkpoint folder, as several results need
    them and they are dear to make. So are a model's answers before
    they are used, so that it is asked once, whatever is lost later.
    """
    plain = block_ops.normalize_blocks(blocks)
    own, blocks_at = _stored(rows.with_pairs(pairs, plain), "blocks")
    fragments, fragments_at = _stored(diff.refine_fragments(diff.find_diffs(pairs, own)), "fragments")
    answers = None if chat is None else cut(model.ask_fragments(fragments, chat))
    labelled = lambda f: model.classify_fragments(f) if answers is None else model.labels_from_responses(f, answers)

    def remake() -> tuple[DataFrame, DataFrame, DataFrame]:
        found = diff.refine_fragments(diff.find_diffs(pairs, plain))
        return plain, found, labelled(found)

    if degraded is None:
        degraded = _none_degraded(pairs)
    return Comparison(pairs, own, fragments, labelled(fragments), degraded, remake, [blocks_at, fragments_at])


def compare_text_pages(pairs: DataFrame, blocks: DataFrame, masks: DataFrame, chat: model.Chat | None = None) -> tuple[Comparison, DataFrame]:
    """Compare documents with a text layer: pages identical by their ink are left out. Returns the comparison and the alignment.

    ``blocks`` need ``page``; ``masks``: ``doc_id, page, height, width, bits, ink, sha1``.
    As a document may be in several pairs, its blocks are taken for each pair apart.
    """
    alignment = cut(pages.align_pages(pairs, masks))
    sides = [pairs.select("pair_id", F.lit(s).alias("side"), F.col(f"{s}_doc").alias("doc_id")) for s in ("old", "new")]
    own = sides[0].unionByName(sides[1]).join(blocks, "doc_id")
    own = pair_ops.drop_unchanged_pages(own, alignment)
    key = lambda s: F.xxhash64("pair_id", F.lit(s))
    own = own.withColumn("doc_id", F.xxhash64("pair_id", "side")).drop("pair_id", "side")
    again = pairs.withColumn("old_doc", key("old")).withColumn("new_doc", key("new"))
    return compare_blocks(again, own, chat), alignment


def compare_scans(pairs: DataFrame, page_content: DataFrame, masks: DataFrame, cache: DataFrame, reader: model.Reader | None, model_name: str, version: str, chat: model.Chat | None = None) -> tuple[Comparison, DataFrame, DataFrame]:
    """Compare scanned documents, reading only the pages that changed.

    ``page_content``: ``doc_id, page, content``. Returns the comparison, the alignment and
    new rows for the cache. Alignment and reads are made at once and written to the
    checkpoint folder, so that no page is read twice.
    """
    alignment = cut(pages.align_pages(pairs, masks))
    wanted = pair_ops.pages_to_read(alignment)
    docs = pairs.select("pair_id", F.lit("old").alias("side"), F.col("old_doc").alias("doc_id")).unionByName(pairs.select("pair_id", F.lit("new").alias("side"), F.col("new_doc").alias("doc_id")))
    asked = wanted.join(docs, ["pair_id", "side"]).join(page_content.select("doc_id", F.col("page").cast("int").alias("page"), "content"), ["doc_id", "page"])
    reads, fresh = model.read_pages_cached(asked.select("pair_id", "side", "page", "content"), cache, reader, model_name, version)
    reads = cut(reads)
    keyed = reads.withColumn("doc_id", F.xxhash64("pair_id", "side"))
    own = block_ops.blocks_from_page_reads(keyed.select("doc_id", "page", "markdown", "unreadable"))
    sides = docs.select("pair_id", "side", F.xxhash64("pair_id", "side").alias("doc_id"))
    lost = pair_ops.unreadable_pages(wanted, own.join(sides, "doc_id"))
    bad = summary.degraded_pages(wanted, reads, lost)
    again = pairs.withColumn("old_doc", F.xxhash64("pair_id", F.lit("old"))).withColumn("new_doc", F.xxhash64("pair_id", F.lit("new")))
    return compare_blocks(again, own, chat, bad), alignment, fresh
