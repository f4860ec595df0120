"""Files: reading, validation, word-processor documents; results: writing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import docx
from . import runs

# fixed values
UPLOAD_LIMIT = 128 * 1024 * 1024
IMAGE_LIMIT = 10 * 1024 * 1024
MAGIC = {".docx": "504B0304", ".pdf": "25504446"}


def extension(path: Column) -> Column:
    """Extension with its dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.](\.[^./\\]*)$", 1))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, length, modificationTime, content, ext, doc_id`` of files, ``doc_id`` being a hash of the path."""
    files = spark.read.format("binaryFile").load(paths)
    return files.withColumn("ext", extension(F.col("path"))).withColumn("doc_id", F.xxhash64("path"))


def validate_files(files: DataFrame, allowed: tuple[str, ...] = (".docx", ".pdf"), limit: int = UPLOAD_LIMIT) -> DataFrame:
    """``files`` (``ext, length, content``) with ``status`` (``ok`` or ``rejected``) and ``reason``."""
    good = F.lit(False)
    for ext, magic in MAGIC.items():
        good = good | ((F.col("ext") == ext) & (F.hex(F.substring("content", 1, len(magic) // 2)) == magic))
    reason = F.when(~F.col("ext").isin(*allowed), "extension").when(F.col("length") > limit, "size").when(~good, "signature")
    return files.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("rejected"))


_DOCX = (
    "doc_id bigint, error string, runs array<struct<block_no:int,run_no:int,text:string,bold:boolean,italic:boolean,underline:boolean,style:string>>, "
    "cells array<struct<block_no:int,row_no:int,col_no:int,tc_id:bigint,text:string>>, images array<struct<block_no:int,img_no:int,sha1:string,n_bytes:bigint,data_uri:string>>"
)
_FIELDS = {
    "runs": ("block_no", "run_no", "text", "bold", "italic", "underline", "style"),
    "cells": ("block_no", "row_no", "col_no", "tc_id", "text"),
    "images": ("block_no", "img_no", "sha1", "n_bytes", "data_uri"),
}


def read_docx(files: DataFrame, max_images_bytes: int = IMAGE_LIMIT) -> dict[str, DataFrame]:
    """Tables ``runs``, ``cells``, ``images`` and ``errors`` (``doc_id, error``) of word-processor files.

    ``files``: ``doc_id, content``. A file is read as a stream and given out in pieces. Its images are taken in
    order as far as ``max_images_bytes`` reach; after the first that doesn't fit, none is but empty ones.
    What the files hold is kept (on disk where memory is
    short), so that they are unpacked once for all tables; ``unpersist`` of the table
    ``files`` frees it. A broken file gives an error row and nothing else.
    """

    runs.lean_batches(files.sparkSession)
    names = ["doc_id", "error", *_FIELDS]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    for part in docx.unpack(bytes(content), max_images_bytes):  # raises before its first piece
                        yield (doc, None, *([dict(zip(fields, x)) for x in own] for fields, own in zip(_FIELDS.values(), part)))
                except Exception as e:  # noqa: BLE001  any damage to a file is that file's error row
                    yield (doc, type(e).__name__, [], [], [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for piece in pieces(batches):  # small files are given out together
            held.append(piece)
            size += 10 + len(piece[2]) + len(piece[3]) + sum(10 + len(x["data_uri"]) // 100 for x in piece[4])
            if size >= docx.PIECE:
                yield pd.DataFrame(held, columns=names)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    whole = files.select("doc_id", "content").mapInPandas(run, _DOCX).persist(StorageLevel.MEMORY_AND_DISK)
    out = {k: whole.select("doc_id", F.explode(k).alias("x")).select("doc_id", "x.*") for k in _FIELDS}
    return out | {"files": whole, "errors": whole.filter("error IS NOT NULL").select("doc_id", "error")}


def result_json(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``pair_id, result``: the summary and all rows of a pair as one JSON text."""
    ordered = F.array_sort(F.collect_list(F.struct("row_no", "left", "right")))
    packed = rows.groupBy("pair_id").agg(F.transform(ordered, lambda r: F.struct(r["left"].alias("left"), r["right"].alias("right"))).alias("rows"))
    out = summary.join(packed, "pair_id", "left")
    return out.select("pair_id", F.to_json(F.struct(*(c for c in out.columns if c != "pair_id"))).alias("result"))


def write_result(rows: DataFrame, summary: DataFrame, path: str, run: str | None = None) -> str:
    """Rows and summaries of pairs as one run under ``path``; returns the run's id.

    A later run replaces the pairs that it has and no others. A run that was stopped isn't
    read; it can be repeated with the same ``run``. Rows are written by ranges of pairs, so that
    one pair is read from few files. ``summary`` has a row for each pair of the run, also where it has no rows.
    """
    ordered = rows.repartitionByRange("pair_id", "row_no").sortWithinPartitions("pair_id", "row_no")
    return runs.write_run({"summary": summary, "rows": ordered}, path, run)


def read_result(spark: SparkSession, path: str, rows_schema: str, summary_schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows and summaries under ``path``, each pair as its last run left it."""
    summary = runs.read_runs(spark, path, "summary", summary_schema)
    last = runs.last_of_each(summary, "pair_id")
    rows = runs.read_runs(spark, path, "rows", rows_schema)
    return rows.join(last, ["pair_id", "run_no"]).drop("run_no"), summary.join(last, ["pair_id", "run_no"]).drop("run_no")


def compact_result(spark: SparkSession, path: str, rows_schema: str, summary_schema: str) -> str:
    """Write what is valid under ``path`` as one run in place of all before."""
    rows, summary = read_result(spark, path, rows_schema, summary_schema)
    ordered = rows.repartitionByRange("pair_id", "row_no").sortWithinPartitions("pair_id", "row_no")
    return runs.write_run({"summary": summary, "rows": ordered}, path, replaces_all=True)
