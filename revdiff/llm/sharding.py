"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged


class _FreeSpace:
    """Balanced search tree (a treap) of the bins by (space left, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.seed = 1

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, t: list | None, key: tuple) -> tuple:
        """(keys below ``key``, the others)."""
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def add(self, key: tuple[int, int]) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self.seed >> 16, None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least space left of at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        best = high
        while best[2] is not None:
            best = best[2]
        _, rest = self._split(high, (best[0][0], best[0][1] + 1))
        self.root = self._merge(low, rest)
        return best[0]


def best_fit_runs(sizes: Sequence[int], counts: Sequence[int], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Bins (from 0) of ``counts[i]`` items of ``sizes[i]`` each, sizes descending, as runs (bin, how many).

    Best fit decreasing: each item goes into the fullest bin that still holds it, the
    first of equally full ones, or else into a new bin. The bin that takes an item is still
    the fullest with room for the next of its size, so equal items are placed in runs. An
    item above the capacity has a bin of its own. None if more than ``most`` bins are needed.
    """
    free, out, bins = _FreeSpace(), [], 0
    for size, count in zip(sizes, counts):
        runs = []
        while count:
            got = free.take_tightest(size)
            if got is None and bins == most:
                return None
            left, at = got if got else (max(capacity, size), bins)
            bins += got is None
            here = min(count, left // size)
            runs.append((at, here))
            free.add((left - here * size, at))
            count -= here
        out.append(runs)
    return out


def best_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin (from 0) of each item, by ``best_fit_runs``; items of equal size go in their given order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out = [0] * len(sizes)
    for i, runs in zip(order, best_fit_runs([sizes[i] for i in order], [1] * len(order), capacity)):
        out[i] = runs[0][0]
    return out


def balanced_runs(sizes: Sequence[int], counts: Sequence[int], bins: int) -> list[list[tuple[int, int]]]:
    """``counts[i]`` items of ``sizes[i]`` (descending) in ``bins`` bins of near-equal sums, as runs (bin, how many).

    While the largest item is above an equal share of what remains, it takes a bin
    of its own. For the others, the smallest capacity is searched at which best fit
    decreasing needs no more than the remaining bins.
    """
    left, alone, counts = sum(s * c for s, c in zip(sizes, counts)), 0, list(counts)
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for i, size in enumerate(sizes):
        while counts[i] and alone < bins - 1 and size * (bins - alone) > left:
            out[i].append((alone, 1))
            counts[i] -= 1
            alone += 1
            left -= size
        if counts[i]:
            break
    rest = [i for i, c in enumerate(counts) if c]
    if not rest:
        return out
    own, n = ([sizes[i] for i in rest], [counts[i] for i in rest]), bins - alone
    low = max(own[0][0], math.ceil(left / n))
    failed, capacity, step = low - 1, low, 1
    while (best := best_fit_runs(*own, capacity, n)) is None:
        failed, capacity, step = capacity, low + step, 2 * step
    while capacity - failed > 1:
        middle = (capacity + failed) // 2
        packed = best_fit_runs(*own, middle, n)
        best, capacity, failed = (packed, middle, failed) if packed is not None else (best, capacity, middle)
    for i, runs in zip(rest, best):
        out[i] += [(alone + at, k) for at, k in runs]
    return out


#: Highest bits of a group's size that count, the rest being rounded up: sizes below 2 ** 14 are exact, larger ones
#: to 1 / 8192. So there are at most 8192 sizes for each doubling, whatever the number of groups.
SIZE_BITS = 14
#: Groups or rows, about, that are numbered in one task.
CELL_ROWS = 20_000


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("grp"),
    )


def rounded_size(size: Column) -> Column:
    """``size`` with its ``SIZE_BITS`` highest bits, rounded up."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0)))
    return (F.ceil(size / step) * step).cast("bigint")


def numbered(df: DataFrame, keys: list[str], order: list[str], salt: Column, cells: int, name: str) -> DataFrame:
    """Add ``name``: the place of each row among those of its ``keys``, without gaps from 0.

    Rows are dealt into cells by a hash of ``salt``; a cell's rows are numbered by
    themselves from the count of the cells before it, so that no task holds all rows of a
    key. ``df`` is read twice.
    """
    df = df.withColumn("__cell", F.pmod(F.xxhash64(salt), F.lit(cells)))
    counts = df.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "__cell", F.coalesce(before, F.lit(0)).alias("__base"))
    number = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(*order))
    return df.join(starts, [*keys, "__cell"]).withColumn(name, F.col("__base") + number - 1).drop("__cell", "__base")


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """``grp, shard`` of each group (``grp, size``), by best fit decreasing into ``shards`` shards of near-equal sizes.

    Which group of a size goes where doesn't matter to the packing. So the driver
    packs the table of sizes and their counts, which ``SIZE_BITS`` bounds, and gives for
    each size the runs of groups, by number, that a shard takes; the groups of each size are
    numbered in Spark and look up their run. Every group is packed by its size; none
    is dealt by a hash.
    """
    groups = staged(groups.withColumn("rounded", rounded_size(F.col("size"))))
    sizes = groups.groupBy("rounded").agg(F.count("*").alias("n")).toPandas().sort_values("rounded", ascending=False)
    rows = []
    for size, runs in zip(sizes["rounded"].tolist(), balanced_runs(sizes["rounded"].tolist(), sizes["n"].tolist(), shards)):
        first = 0
        for at, k in runs:
            rows.append((size, first, first + k - 1, at))
            first += k
    table = groups.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["rounded", "first", "last", "shard"]), "rounded bigint, first bigint, last bigint, shard int")
    cells = max(1, math.ceil(sizes["n"].sum() / CELL_ROWS))
    own = numbered(groups, ["rounded"], ["grp"], F.col("grp"), cells, "number")
    return own.join(F.broadcast(table), (own.rounded == table.rounded) & F.col("number").between(F.col("first"), F.col("last"))).select("grp", "shard")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All documents in ``shards`` shards of near-equal bytes, equal texts together.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document's
    size is its UTF-8 bytes plus 1; null counts as the empty text. Returns a row per
    row of ``docs``: ``doc_id, size, text_crc32, law`` (always ``bytes``), ``shard,
    slot, grown_shard`` (null).

    Groups are documents of one text hash, and indivisible; they are packed by
    ``group_shards``. A group above an equal share has a shard of its own. Null ids and
    repeated rows are kept as rows, and their numbering is spread over tasks too, by a
    random number that is written with each row; an empty table gives no rows.
    """
    base = staged(_sized(docs).withColumn("salt", F.rand(7)))
    groups = base.groupBy("grp").agg(F.sum("size").alias("size"))
    placed = staged(base.join(staged(group_shards(groups, shards)), "grp"))
    cells = max(128, math.ceil(placed.count() / (shards * CELL_ROWS)))
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size", "salt"], F.col("salt"), cells, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write ``docs``, all columns, as Parquet under ``path``, a folder ``shard=k`` for each of the shards of ``shard_documents``."""
    key = "grp"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    groups = _sized(docs).groupBy("grp").agg(F.sum("size").alias("size"))
    keyed.join(staged(group_shards(groups, shards)).withColumnRenamed("grp", key), key).drop(key).write.partitionBy("shard").parquet(path)


def pack_fixed_capacity(groups: DataFrame, capacity: int, region_bins: int = 256) -> DataFrame:
    """Few shards of a fixed capacity for any number of groups.

    ``groups``: ``grp, size``, one row each; rows with a null are left out. Groups
    are dealt by hash into regions of about ``region_bins`` shards, and each region
    is packed by best fit decreasing. Within a region, groups smaller than 1/256 of
    the capacity are first bundled by hash into parcels of about that size, so that
    a region's task handles a bounded number of units. Returns ``grp, size, shard``
    (bigint). A group above the capacity has a shard of its own; an empty table
    gives no rows.
    """
    groups = groups.select("grp", F.col("size").cast("bigint").alias("size")).na.drop()
    total = groups.agg(F.sum("size").alias("s")).first()["s"] or 0
    regions = max(1, math.ceil(total / (capacity * region_bins)))
    fine = max(1, capacity // 256)
    parcels = max(1, math.ceil(total / regions / fine))
    region = F.pmod(F.xxhash64("grp"), F.lit(regions))
    parcel = F.pmod(F.xxhash64(F.col("grp"), F.lit("parcel")), F.lit(parcels))
    big = F.col("size") >= fine
    keyed = groups.withColumn("region", region).withColumn("unit", F.when(big, F.to_json(F.struct("grp"))).otherwise(F.concat(F.lit("#"), parcel)))
    units = keyed.groupBy("region", "unit").agg(F.sum("size").alias("size"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "unit"], ascending=[False, True])
        pdf["shard"] = best_fit_decreasing(pdf["size"].tolist(), capacity)
        return pdf[["region", "unit", "shard"]]

    placed = units.groupBy("region").applyInPandas(pack, "region bigint, unit string, shard bigint")
    stride = F.lit(1 << 32)
    return keyed.join(placed, ["region", "unit"]).select("grp", "size", (F.col("region") * stride + F.col("shard")).alias("shard"))
