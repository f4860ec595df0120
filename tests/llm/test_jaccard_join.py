from __future__ import annotations

import random

import numpy as np
import pytest

from revdiff.llm import jaccard_join

from .conftest import EDGE, SCHEMA, edited, prose, table
from .test_near_duplicates import brute, family


def plain(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (2, 60)])
def test_equals_brute_force(spark, k, num):
    texts = [t for s in range(6) for t in family(s, 25, 12)] + [prose(1000 + i, random.Random(i).randint(1, 60), 30) for i in range(80)] + [prose(7, 40)] * 20 + ["a b", "A  B", "a b c", "a b c d", "a b c d e"]
    random.Random(1).shuffle(texts)
    got = plain(jaccard_join.similar_sets(table(spark, texts), shingle=k, num=num))
    want, sizes = brute(texts, k, num)
    assert got == {i: (sizes[i], want[i]) for i in range(len(texts))}


def test_a_chain_around_no_centre(spark):
    """Neighbours are alike, the first and the last aren't: one component, not by the first of a list alone."""
    base = prose(50, 200).split()
    texts = [" ".join(f"w{j}" if j < 5 * i else w for j, w in enumerate(base)) for i in range(20)]
    order = list(range(20))
    random.Random(2).shuffle(order)
    texts = [texts[i] for i in order]
    assert {c for _, c in plain(jaccard_join.similar_sets(table(spark, texts), shingle=4, num=85)).values()} == set(brute(texts, 4, 85)[0])


def test_edge_cases(spark, edge):
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = jaccard_join.similar_sets(edge).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].component_id for i in (0, 1, 2, 4, 5, 6)] == [0, 1, 2, 4, 4, 4]
    assert [by[i][0].n_shingles for i in (0, 1, 2, 4)] == [0, 0, 0, 1]
    assert by[None][0].component_id is None and len(by[3]) == 2
    assert jaccard_join.similar_sets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_share_an_id(spark):
    a, b = prose(1, 80), prose(2, 80)
    got = jaccard_join.similar_sets(table(spark, [a, b, b + " too", edited(a, 1, 3), None], ids=[3, 3, 1, 9, 3])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (3, 1), (3, 3), (3, 3), (9, 3)]


def test_matches_asked_for_grow_with_the_cost_of_candidates():
    size, need = np.array([100, 100, 100, 3]), np.array([85, 85, 85, 3])
    none, few, many = np.zeros(6), np.linspace(1, 1.5, 6), np.linspace(100, 110, 6)
    a, b, c, d = jaccard_join.choose_matches(size, need, np.stack([none, few, many, many])).tolist()
    assert (a, c, d) == (1, 6, 3) and a < b <= c
    steep = np.array([1, 30, 900, 9000, 90_000, 900_000.0])
    assert jaccard_join.choose_matches(size[:1], need[:1], steep[None]).tolist() == [1]


def test_parities_never_tell_apart_more_than_there_is():
    r = np.random.default_rng(3)
    pool = r.integers(0, 2**63, 4000).astype(np.uint64)
    for size in (1, 5, 150, 2000):
        a = r.choice(pool, size, replace=False)
        for changed in (0, 1, size // 10, size // 2, size):
            b = np.concatenate([a[changed:], r.integers(0, 2**63, changed).astype(np.uint64)])
            both = jaccard_join.parities(np.array([0, size]), np.concatenate([a, b]))
            bits = int(np.bitwise_count(both[0] ^ both[1]).sum())
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert bits <= apart and (apart > 60 or bits >= 0.6 * apart)
