"""Connected components by union-find on each partition and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one batch: each node points at its root."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([parent[x] for x in nodes], pa.int64())], names=["u", "v"]
        )


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    ``edges``: columns ``u`` and ``v`` (bigint). Returns ``node, component``: the
    smallest node of each component, for every node but those smallest ones.
    Loops and repeated edges change nothing; rows with a null end are ignored; an
    empty table gives an empty table. Links stay in Spark: each round contracts
    every neighbourhood to a star around its smallest node (a minimum and a join),
    until a round changes nothing. A node with very many links is reduced by
    partial minima and its join can be split.
    """
    e = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = staged(e.mapInArrow(_local_stars, "u bigint, v bigint").distinct())
    before = _fingerprint(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = staged(
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        after = _fingerprint(e)
        if after == before:
            break
        before = after
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
