"""Differences between the block sequences of document pairs."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..kernels import matching

_CODES = "array<struct<opcode:string,i1:int,i2:int,j1:int,j2:int>>"
_CODE_LIST = pa.list_(pa.struct([("opcode", pa.string()), *((n, pa.int32()) for n in ("i1", "i2", "j1", "j2"))]))
_SEGMENTS = "array<struct<text:string,type:string>>"


def block_sequences(blocks: DataFrame) -> DataFrame:
    """``doc_id, hashes``: the 64-bit hashes of each document's block texts, by ``pos``."""
    rows = blocks.select("doc_id", F.struct("pos", F.xxhash64("text").alias("h")).alias("b"))
    ordered = F.array_sort(F.collect_list("b"))
    return rows.groupBy("doc_id").agg(F.transform(ordered, lambda x: x["h"]).alias("hashes"))


_RANGES = ("i1", "i2", "j1", "j2")


def _with_texts(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fragments of ``spans`` with the texts of the blocks in their two ranges, one of which isn't empty.

    Spans are made by Python, so they go through once: each asks for its blocks, and what it holds itself goes along.
    """
    asked = lambda number, doc, first, end: F.when(F.col(end) > F.col(first), F.transform(F.sequence(F.col(first), F.col(end) - 1), lambda pos: F.struct(F.lit(number).alias("side"), F.col(doc).alias("doc_id"), pos.alias("pos")))).otherwise(F.array())
    keys = ["pair_id", "frag_no"]
    wanted = spans.select(*keys, "opcode", *_RANGES, F.explode(F.concat(asked(0, "old_doc", "i1", "i2"), asked(1, "new_doc", "j1", "j2"))).alias("x")).select(*keys, "opcode", *_RANGES, "x.*")
    found = wanted.join(blocks.select("doc_id", F.col("pos").cast("int").alias("pos"), "text"), ["doc_id", "pos"])
    texts = lambda number: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == number, F.struct("pos", "text")))), lambda x: x["text"])
    own = (F.first(c).alias(c) for c in ("opcode", *_RANGES))
    return spread(found, keys).groupBy(*keys).agg(*own, texts(0).alias("old_blocks"), texts(1).alias("new_blocks"))


def find_diffs(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fragments in which the two documents of a pair differ.

    ``pairs``: ``pair_id, old_doc, new_doc``; ``blocks``: ``doc_id, pos`` (from 0, without
    gaps), ``text``. Returns ``pair_id, frag_no`` (from 0), ``opcode`` (replace, delete,
    insert), half-open ranges ``i1, i2, j1, j2`` and the arrays ``old_blocks, new_blocks``.

    Only hashes are shuffled to be matched; equal sequences are settled by comparing
    arrays, and the texts are joined for the fragments alone. A document without
    blocks is an empty sequence.
    """
    seq = block_sequences(blocks)
    empty = F.array().cast("array<bigint>")
    both = (
        pairs.select("pair_id", "old_doc", "new_doc")
        .join(seq.toDF("old_doc", "a"), "old_doc", "left")
        .join(seq.toDF("new_doc", "b"), "new_doc", "left")
        .select("pair_id", "old_doc", "new_doc", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
        .filter(F.col("a") != F.col("b"))
    )

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = [
                [{"opcode": op, "i1": i1, "i2": i2, "j1": j1, "j2": j2} for op, i1, i2, j1, j2 in matching.opcodes(a.tolist(), b.tolist()) if op != "equal"]
                for a, b in zip(pdf["a"], pdf["b"])
            ]
            yield pdf[["pair_id", "old_doc", "new_doc"]].assign(codes=codes)

    types = dict(both.dtypes)
    schema = f"pair_id {types['pair_id']}, old_doc {types['old_doc']}, new_doc {types['new_doc']}, codes {_CODES}"
    spans = spread(both, ["pair_id"]).mapInPandas(match, schema).select("pair_id", "old_doc", "new_doc", F.posexplode("codes").alias("frag_no", "c"))
    return _with_texts(spans.select("pair_id", "frag_no", "old_doc", "new_doc", "c.*"), blocks)


def refine_fragments(fragments: DataFrame, threshold: float = matching.SIMILARITY_THRESHOLD, max_pairs: int = matching.MAX_REFINE_PAIRS, autojunk: bool = True) -> DataFrame:
    """Replaced fragments split by the similarity of their blocks.

    Similar blocks, paired in order for the largest total similarity, become
    ``replace`` fragments of one block a side; what is left between them becomes
    ``delete`` and ``insert`` fragments. Other fragments, and those of more than
    ``max_pairs`` block pairs, pass unchanged. ``frag_no`` is given anew.
    """
    names = fragments.columns
    at = [names.index(n) for n in ("opcode", "old_blocks", "new_blocks")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opcode, old, new = (batch.column(i) for i in at)
            few = pc.less_equal(pc.multiply(*(pc.cast(pc.list_value_length(x), pa.int64()) for x in (old, new))), max_pairs)
            codes: list[list[dict] | None] = [None] * batch.num_rows
            for k in np.flatnonzero(pc.fill_null(pc.and_(pc.equal(opcode, "replace"), few), False).to_numpy(zero_copy_only=False)).tolist():
                codes[k] = [dict(zip(("opcode", *_RANGES), c)) for c in matching.split_replaced(old[k].as_py(), new[k].as_py(), threshold, autojunk)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, _CODE_LIST)], names=[*names, "codes"])

    schema = ", ".join(f"`{n}` {t}" for n, t in fragments.dtypes) + f", codes {_CODES}"
    # all fragments go through once, as asking twice for them would make them twice; most are replaced ones
    whole = F.array(F.struct("opcode", *(n.cast("int").alias(r) for n, r in zip((F.lit(0), F.size("old_blocks"), F.lit(0), F.size("new_blocks")), _RANGES))))
    parts = spread(fragments, ["pair_id", "frag_no"]).mapInArrow(split, schema).select("*", F.posexplode(F.coalesce("codes", whole)).alias("sub", "c"))
    part = lambda blocks, a, b: F.slice(blocks, F.col(a) + 1, F.col(b) - F.col(a))
    changed = {
        "opcode": F.col("c.opcode"), "i1": F.col("i1") + F.col("c.i1"), "i2": F.col("i1") + F.col("c.i2"), "j1": F.col("j1") + F.col("c.j1"), "j2": F.col("j1") + F.col("c.j2"),
        "old_blocks": part("old_blocks", "c.i1", "c.i2"), "new_blocks": part("new_blocks", "c.j1", "c.j2"),
    }
    split_ = parts.select("sub", *(changed[n].alias(n) if n in changed else F.col(n) for n in names))
    order = Window.partitionBy("pair_id").orderBy("frag_no", "sub")
    return split_.withColumn("frag_no", F.row_number().over(order) - 1).select(*names)


def _ratio_of(old: pd.Series, new: pd.Series, threshold: pd.Series, autojunk: pd.Series) -> pd.Series:
    return pd.Series([matching.similarity(a, b, t, bool(j)) for a, b, t, j in zip(old, new, threshold, autojunk)])


def block_similarity(old: Column, new: Column, threshold: float = 0.0, autojunk: bool = True) -> Column:
    """Ratio of two texts (Column -> Column), 0 below ``threshold``; null if either is null.

    Every row goes to the Python helper; ``similar_texts`` sends only those that nothing else decides.
    """
    own = F.pandas_udf(_ratio_of, "double")(F.coalesce(old, F.lit("")), F.coalesce(new, F.lit("")), F.lit(float(threshold)), F.lit(autojunk))
    return F.when(old.isNotNull() & new.isNotNull(), F.when(old == new, 1.0).otherwise(own))


def similar_texts(rows: DataFrame, keys: list[str], threshold: float = 0.0, autojunk: bool = True) -> DataFrame:
    """The keys and ``ratio`` of the texts ``old`` and ``new`` of each row, as ``block_similarity`` gives it.

    Equal texts, and those whose lengths alone keep them below the threshold, are settled
    without Python.
    """
    ratio = F.when(F.col("old") == F.col("new"), 1.0).when(text.length_ratio_bound(F.col("old"), F.col("new")) < threshold, 0.0)
    known = rows.withColumn("ratio", ratio).withColumn("open", F.col("ratio").isNull() & F.col("old").isNotNull() & F.col("new").isNotNull())
    settled = known.filter(~F.col("open")).select(*keys, "ratio")
    return settled.unionByName(spread(known.filter("open").select(*keys, "old", "new"), keys).select(*keys, block_similarity(F.col("old"), F.col("new"), threshold, autojunk).alias("ratio")))


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` dealt anew over all tasks, as matching in Python takes much longer than moving the few texts that need it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_SEGMENT = pa.struct([("text", pa.string()), ("type", pa.string())])


def _lists(lists: list[list | None], values: pa.Array) -> pa.Array:
    """A list array of the given (or null) lists' lengths over ``values``."""
    ends = itertools.accumulate((len(x or ()) for x in lists), initial=0)
    at = pa.array([None if x is None else e for x, e in zip([*lists, ()], ends)], pa.int32())
    return pa.ListArray.from_arrays(at, values)


def _segment_array(sides: list[matching.Segments | None]) -> pa.Array:
    flat = [x for side in sides if side is not None for x in side]
    return _lists(sides, pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.string()), pa.array([k for _, k in flat], pa.string())], fields=list(_SEGMENT)))


def _cell_array(sides: list[list[matching.Segments] | None]) -> pa.Array:
    return _lists(sides, _segment_array([cell for side in sides if side is not None for cell in side]))


def _two(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([left, right], names=["left", "right"])


def _words_of(old: list, new: list, most: int) -> pa.Array:
    found = [matching.inline_diff(a, b, most) if a is not None and b is not None else None for a, b in zip(old, new)]
    return _two(*(_segment_array([None if x is None else x[i] for x in found]) for i in (0, 1)))


def _cells_of(old: list, new: list, most: int) -> pa.Array:
    found = [matching.cell_diff(a, b, most) if a is not None and b is not None else None for a, b in zip(old, new)]
    return _two(*(_cell_array([None if x is None else x[i] for x in found]) for i in (0, 1)))


def _whole(c: Column) -> Column:
    return F.when(c == "", F.array().cast(_SEGMENTS)).otherwise(F.array(F.struct(c.alias("text"), F.lit("same").alias("type"))))


def equal_segments(c: Column) -> Column:
    """Word segments of a text that didn't change: struct of ``left`` and ``right``."""
    return F.struct(_whole(c).alias("left"), _whole(c).alias("right"))


def inline_diff(rows: DataFrame, keys: list[str], max_tokens: int = matching.MAX_INLINE_TOKENS) -> DataFrame:
    """The keys and the word segments ``left, right`` of the texts ``old`` and ``new`` of each row.

    Both are null above ``max_tokens`` token pairs, and where a text is null. The texts of a
    side's segments, one after another, are that side's text. Only rows whose texts
    differ go to Python.
    """
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False))
    changed = changed_segments(rows.filter(~same).withColumns({"old_cells": F.lit(None).cast("array<string>"), "new_cells": F.lit(None).cast("array<string>")}), keys, max_tokens)
    equal = rows.filter(same).select(*keys, equal_segments(F.col("old")).alias("words"))
    return equal.unionByName(changed.drop("cells")).select(*keys, "words.left", "words.right")


def cell_diff(rows: DataFrame, keys: list[str], max_tokens: int = matching.MAX_INLINE_TOKENS) -> DataFrame:
    """The keys and ``left, right``: the word segments of each cell of the changed table rows ``old_cells, new_cells``."""
    texts = {c: F.lit(None).cast("string") for c in ("old", "new")}
    return changed_segments(rows.withColumns(texts), keys, max_tokens).select(*keys, "cells.left", "cells.right")


def changed_segments(rows: DataFrame, keys: list[str], max_tokens: int = matching.MAX_INLINE_TOKENS) -> DataFrame:
    """The keys and ``words, cells``: structs of ``left`` and ``right`` segments of ``old, new`` and of ``old_cells, new_cells``.

    All rows go to Python, so ``rows`` should hold what changed alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, new, old_cells, new_cells = (batch.column(i).to_pylist() for i in range(-4, 0))
            made = [_words_of(old, new, max_tokens), _cells_of(old_cells, new_cells, max_tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *made], names=[*keys, "words", "cells"])

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", words struct<left:{_SEGMENTS},right:{_SEGMENTS}>, cells struct<left:array<{_SEGMENTS}>,right:array<{_SEGMENTS}>>"
    return spread(rows.select(*keys, "old", "new", "old_cells", "new_cells"), keys).mapInArrow(run, schema)
