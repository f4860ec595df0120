from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from revdiff.llm import neighbours, sharding

from .conftest import EDGE, SCHEMA, prose, table


def naive(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(left, b) for b, left in enumerate(bins) if left >= sizes[i]]
        left, b = min(fits) if fits else (max(capacity, sizes[i]), len(bins))
        if not fits:
            bins.append(left)
        bins[b] = left - sizes[i]
        out[i] = b
    return out


def test_best_fit_equals_a_plain_search():
    r = random.Random(1)
    for _ in range(120):
        sizes = [r.randint(1, 60) for _ in range(r.randint(0, 80))]
        assert sharding.best_fit_decreasing(sizes, 50) == naive(sizes, 50)


def naive_balance(sizes, bins):
    """The bin of each item, one by one."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left, out, alone = sum(sizes), {}, 0
    while order and alone < bins - 1 and sizes[order[0]] * (bins - alone) > left:
        i = order.pop(0)
        out[i], left, alone = alone, left - sizes[i], alone + 1
    if order:
        capacity = max(sizes[order[0]], -(-left // (bins - alone)))
        while max(own := naive([sizes[i] for i in order], capacity)) >= bins - alone:
            capacity += 1
        out |= {i: alone + b for i, b in zip(order, own)}
    return out


def test_runs_equal_a_plain_search():
    assert sharding.balanced_runs([], [], 4) == []
    r = random.Random(3)
    for _ in range(60):
        counts = {r.choice([1, 2, 3, 5, 8, 40, 300]): r.randint(1, 30) for _ in range(r.randint(1, 5))}
        sizes = sorted(counts, reverse=True)
        runs = sharding.balanced_runs(sizes, [counts[s] for s in sizes], 4)
        items = [s for s in sizes for _ in range(counts[s])]
        want = naive_balance(items, 4)
        got = [b for own in runs for b, k in own for _ in range(k)]
        assert sorted(zip(items, got)) == sorted((items[i], b) for i, b in want.items())


def test_groups_are_packed_one_by_one(spark):
    r = random.Random(4)
    sizes = [r.choice([3, 7, 7, 7, 20, 55, 1000, r.randint(1, 400)]) for _ in range(3000)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "grp bigint, size bigint").repartition(5)
    got = {x.grp: x.shard for x in sharding.group_shards(groups, 8).collect()}
    want = naive_balance(sizes, 8)
    assert sorted((sizes[i], b) for i, b in got.items()) == sorted((sizes[i], b) for i, b in want.items())
    sums = [sum(s for i, s in enumerate(sizes) if got[i] == k) for k in range(8)]
    assert max(sums) - min(sums) <= 8
    assert sharding.group_shards(groups.limit(0), 8).count() == 0


def test_sizes_are_rounded_up(spark):
    sizes = [1, 16383, 16384, 16385, 10**6, 2**40 - 1]
    got = [x.r for x in spark.createDataFrame([(s,) for s in sizes], "s bigint").select(sharding.rounded_size(F.col("s")).alias("r")).collect()]
    assert got[:3] == sizes[:3] and all(s <= g <= s * (1 + 1 / 8192) for s, g in zip(sizes, got))


def test_shards_are_written(spark, tmp_path):
    texts = [prose(i, 20) for i in range(60)] + EDGE[:9]
    docs = table(spark, texts)
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    written = spark.read.parquet(f"{tmp_path}/out")
    assert set(written.columns) == {*docs.columns, "shard"} and written.count() == len(texts)
    want = {(x.doc_id, x.shard) for x in sharding.shard_documents(docs, 4).collect()}
    assert {(x.doc_id, x.shard) for x in written.collect()} == want


def check(got, texts):
    assert len(got) == len(texts)
    for k, own in got.groupby("shard"):
        assert 0 <= k < 8 and sorted(own.slot) == list(range(len(own)))
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_shards(spark):
    texts = [prose(i, 20) for i in range(400)] + [prose(5, 30)] * 60 + EDGE[:9]
    got = sharding.shard_documents(table(spark, texts)).toPandas()
    check(got, texts)
    got["text"] = [texts[i] or "" for i in got.doc_id]
    assert got.groupby("text").shard.nunique().max() == 1
    assert all(s == len(t.encode()) + 1 and c == zlib.crc32(t.encode()) for s, c, t in zip(got["size"], got.text_crc32, got.text))
    sums = got.groupby("shard")["size"].sum()
    rest = sums.sort_values()[:-1]  # one group is above an equal share and has a shard of its own
    assert rest.max() - rest.min() < 0.02 * sums.sum()


def test_shard_edge_cases(spark, edge):
    check(sharding.shard_documents(edge).toPandas(), EDGE)
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fixed_capacity(spark):
    r = random.Random(2)
    groups = spark.createDataFrame([(i, r.randint(1, 400)) for i in range(3000)] + [(9000, 5000), (None, 3), (9001, None)], "grp bigint, size bigint")
    got = sharding.pack_fixed_capacity(groups, 1000, region_bins=50)
    sums = got.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).toPandas()
    assert got.count() == 3001 and all(s <= 1000 or n == 1 for s, n in zip(sums.s, sums.n))
    assert len(sums) <= 1.1 * sums.s.sum() / 1000
    assert sharding.pack_fixed_capacity(groups.limit(0), 10).count() == 0


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in row], 1, 2, 3.0) for i, row in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, q int, b int, score double").repartition(3)


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (3000, 64)).astype(np.float32)
    x[100] = x[7]
    got = neighbours.nearest_neighbours(vectors(spark, x)).toPandas()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, d[own.vec_id], rtol=1e-12)
        assert list(zip(own.score, own.vec_id)) == sorted(zip(own.score, own.vec_id))
        hits += len(set(own.vec_id) & set(best))
    assert hits >= 0.95 * 300


def test_neighbour_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]), (7, [1.0, 0.1]), (8, [1.0, 2.0, 3.0]), (9, []), (1, [1.0, 0.1]), (100, [0.0, 0.0])]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 7)]
    assert neighbours.nearest_neighbours(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    same = neighbours.nearest_neighbours(vectors(spark, np.ones((40, 4)))).orderBy("rank").collect()
    assert [r.vec_id for r in same] == list(range(1, 11)) and all(r.score == 0 for r in same)


def test_repeated_ids_leave_room_for_the_others(spark, monkeypatch):
    r = np.random.default_rng(4)
    near, far = 0.01 * r.normal(0, 1, (400, 8)), r.normal(0, 1, (60, 8))
    for copies in (near, np.repeat(near[:1], 400, axis=0)):  # one id with many vectors, or with one many times
        x = np.concatenate([np.full((2, 8), 0.001), copies, far]).astype(np.float32)
        ids = [0, 0, *[1] * 400, *range(2, 62)]
        least = {}
        for i, v in zip(ids[2:], x[2:].astype(float)):
            d = np.sqrt(((v - x[0].astype(float)) ** 2).sum())
            least[i] = min(d, least.get(i, d))
        best = sorted((d, i) for i, d in least.items())[:10]
        for block in (1 << 20, 400):
            monkeypatch.setattr(neighbours, "BLOCK_VALUES", block)
            got = neighbours.nearest_neighbours(vectors(spark, x, ids)).orderBy("rank").collect()
            assert [(g.query_id, g["rank"], g.vec_id) for g in got] == [(0, k + 1, i) for k, (_, i) in enumerate(best)]
            assert np.allclose([g.score for g in got], [d for d, _ in best], rtol=1e-12)


def test_huge_and_tiny_numbers(spark):
    r = np.random.default_rng(6)
    x = [[1e300, 0.0, 0.0], [1e300, 1e290, 0.0], [-1e300, 0.0, 1.0], [1e-300, 0.0, 0.0], *r.normal(0, 1, (40, 3)).tolist()]
    got = neighbours.nearest_neighbours(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).orderBy("rank").collect()
    assert [g["rank"] for g in got] == list(range(1, 11)) and got[0].vec_id == 1 and got[0].score == 1e290
    assert all(g.score == 1e300 for g in got[1:]) and [g.vec_id for g in got[1:]] == list(range(3, 12))


def test_clusters_are_searched_where_they_are(spark, monkeypatch):
    r = np.random.default_rng(7)
    centre = 20 * r.normal(0, 1, (30, 16))
    x = (np.repeat(centre, 100, axis=0) + r.normal(0, 1, (3000, 16))).astype(np.float32)
    x = x[r.permutation(3000)]
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 16 * 200)
    cells = neighbours.Cells.fitted(x.astype(float), np.arange(3000), 15)
    assert len(cells.low) == 15 and np.bincount(cells.of(x.astype(float)), minlength=15).min() >= neighbours.LEAST_SAMPLE
    assert np.mean([len(cells.near(x[q].astype(float), q, 10)) for q in range(0, 3000, 100)]) < 5  # of 15
    got = neighbours.nearest_neighbours(vectors(spark, x)).toPandas()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(d)[:10]))
    assert hits >= 0.95 * 300


def test_blocks_whose_rows_and_queries_fill_many_batches(spark, monkeypatch):
    """A batch may end anywhere among a block's rows or queries."""
    x = np.random.default_rng(8).normal(size=(900, 8))
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 8 * 300)
    want = neighbours.nearest_neighbours(vectors(spark, x), every=20).orderBy("query_id", "rank").collect()
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("3", "17"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert neighbours.nearest_neighbours(vectors(spark, x), every=20).orderBy("query_id", "rank").collect() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert len(want) == 45 * 10
