"""Tables in a global order: sorted ranges, and what must pass from one range to the next.

A sort by ranges spreads a hot key over several tasks, which a window can't. What is
carried over a border is one row for each range, so a few thousand rows at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

#: Rows of a range at most, about; a range lies in the memory of one task.
RANGE_ROWS = 1 << 20


def ranges_for(df: DataFrame, rows: int) -> int:
    """Into how many ranges ``rows`` rows are sorted: as many as Spark's own shuffles have, more where a range would be too large."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def in_order(df: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` over all ranges, each row with its range (``part``)."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a gapless number from 1 in ``order``, as column ``name``.

    The ranges are written first, so that their borders stay; their sizes, one number a range,
    are added up on the driver.
    """
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    made = staged(in_order(df, order).withColumn("at", at))
    sizes = made.groupBy("part").agg(F.count("*").alias("n")).toArrow().sort_by("part")
    before = np.cumsum([0, *sizes["n"].to_pylist()])[:-1]
    offsets = df.sparkSession.createDataFrame(list(zip(sizes["part"].to_pylist(), before.tolist())), "part int, before bigint")
    return made.join(F.broadcast(offsets), "part").withColumn(name, F.col("before") + F.col("at") + 1).drop("part", "at", "before")


#: Running sums are taken modulo 2^62, so that two of them can be added without an overflow.
MASK = (1 << 62) - 1

_FIRST, _LAST = 1, 2


def _with_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that have rows, with a mark at the first and at the last row of all."""
    held, first = None, _FIRST
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] |= first
            held, first = (batch, edge), 0
    if held is not None:
        held[1][-1] |= _LAST
        yield held


def _same_as_before(keys: list[np.ndarray], before: tuple | None) -> np.ndarray:
    """Which rows have the keys of the row before; ``before`` are the keys of the row before the first."""
    same = np.ones(len(keys[0]), bool)
    for k in keys:
        same[1:] &= k[1:] == k[:-1]
    same[0] = before is not None and all(k[0] == b for k, b in zip(keys, before))
    return same


def _running(key: str, sums: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carry = None, {c: np.uint64(0) for c in sums}
        for batch, edge in _with_edges(batches):
            names = batch.schema.names
            keys = batch.column(names.index(key)).to_numpy()
            same = _same_as_before([keys], before)
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            starts = np.flatnonzero(~same)
            of = np.searchsorted(starts, np.arange(len(keys)), side="right") - 1  # -1: the key of the batch before
            for c in sums:
                total = np.cumsum(columns[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), dtype=np.uint64)
                base = np.concatenate([[np.uint64(0)], total])[np.append(starts, 0)][of]
                total = np.where(of < 0, total + carry[c], total - base) & np.uint64(MASK)
                carry[c] = total[-1]
                columns[c] = pa.array(total.view(np.int64))
            before = (keys[-1],)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(edge)], names=[*columns, "edge"])

    return run


def running(df: DataFrame, key: str, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with each column of ``sums`` (not null) replaced by its sum, modulo 2^62, over the rows of the same ``key`` up to this one.

    ``key`` is a bigint without nulls. Ranges are summed each for itself; a key that
    goes on in later ranges gets there what it had before, one row for each range.
    """
    dealt = in_order(df, [F.col(key).asc(), *order]).withColumn("part", F.col("part").cast("int"))
    schema = ", ".join(f"{f.name} {'bigint' if f.name in sums else f.dataType.simpleString()}" for f in dealt.schema.fields)
    made = staged(dealt.mapInArrow(_running(key, sums), f"{schema}, edge int"))
    edges = made.filter("edge > 0").select("part", "edge", key, *sums).collect()
    carried, before, have = [], None, [0] * len(sums)  # ``have``: of the key that the ranges so far end with
    for part in sorted({r["part"] for r in edges}):
        first = next(r for r in edges if r["part"] == part and r["edge"] & _FIRST)
        last = next(r for r in edges if r["part"] == part and r["edge"] & _LAST)
        goes_on = first[key] == before
        if goes_on:
            carried.append((part, first[key], *have))
        own = [last[c] for c in sums]
        have = [(a + b) & MASK for a, b in zip(have, own)] if goes_on and last[key] == before else own
        before = last[key]
    more = df.sparkSession.createDataFrame(carried, "part int, carried_key bigint, " + ", ".join(f"more_{i} bigint" for i in range(len(sums))))
    found = made.join(F.broadcast(more.withColumnRenamed("part", "carried_part")), (F.col("part") == F.col("carried_part")) & (F.col(key) == F.col("carried_key")), "left")
    whole = {c: (F.col(c) + F.coalesce(F.col(f"more_{i}"), F.lit(0))).bitwiseAND(F.lit(MASK)) for i, c in enumerate(sums)}
    return found.select(*(whole.get(c, F.col(c)).alias(c) for c in df.columns))


def _followed(groups: list[str], value: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a batch waits for the first row of the next
        for batch, edge in _with_edges(batches):
            keys = [batch.column(g).to_numpy() for g in groups]
            values = batch.column(value).to_numpy()
            if held is not None:
                yield finish(held, keys, values)
            held = batch, edge, keys, values
        if held is not None:
            yield finish(held, None, None)

    def finish(held, next_keys, next_values) -> pa.RecordBatch:
        batch, edge, keys, values = held
        after = np.append(values[1:], 0 if next_values is None else next_values[0])
        has = np.append(_same_as_before(keys, None)[1:], next_keys is not None and all(k[-1] == n[0] for k, n in zip(keys, next_keys)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(edge), pa.array(after, pa.int64(), mask=~has)], names=[*batch.schema.names, "edge", "after"])

    return run


def followed(df: DataFrame, groups: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``after``: ``value`` of the next row of the same ``groups`` in ``order``, null at the last.

    All of these columns are whole numbers without nulls. A group may lie in many ranges.
    """
    dealt = in_order(df, [F.col(c).asc() for c in [*groups, *order]]).withColumn("part", F.col("part").cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    made = staged(dealt.mapInArrow(_followed(groups, value), f"{schema}, edge int, after bigint"))
    edges = made.filter("edge > 0").select("part", "edge", *groups, F.col(value).alias("value_")).collect()
    parts = sorted({r["part"] for r in edges})
    firsts = {r["part"]: r for r in edges if r["edge"] & _FIRST}
    lasts = {r["part"]: r for r in edges if r["edge"] & _LAST}
    over = [(p, firsts[q]["value_"]) for p, q in zip(parts, parts[1:]) if all(lasts[p][g] == firsts[q][g] for g in groups)]
    over = df.sparkSession.createDataFrame(over, "over_part int, over_value bigint")
    found = made.join(F.broadcast(over), (F.col("part") == F.col("over_part")) & (F.col("edge") >= _LAST), "left")
    return found.select(*df.columns, F.coalesce("after", "over_value").alias("after"))
