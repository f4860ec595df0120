from __future__ import annotations

import random

import numpy as np
import pytest

from revdiff.llm import components, minhash

from .conftest import EDGE, SCHEMA, edited, prose, table


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, num):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def family(seed, size, most):
    base = prose(seed, 150)
    return [edited(base, random.Random(seed * 99 + i).randint(0, most), i) for i in range(size)]


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, num):
    texts = [t for s in range(6) for t in family(s, 25, 12)] + [prose(1000 + i, random.Random(i).randint(1, 60)) for i in range(60)] + [prose(7, 40)] * 20 + ["a b", "A  B", "a b c"]
    random.Random(1).shuffle(texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, texts), shingle=k, num=num).collect()}
    want, sizes = brute(texts, k, num)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_edge_cases(spark, edge):
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].component_id for i in (0, 1, 2, 4, 5, 6)] == [0, 1, 2, 4, 4, 4]
    assert [by[i][0].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert by[None][0].component_id is None and by[None][0].kept
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_first_keeps_columns_and_one_of_each_group(spark, edge):
    kept = minhash.keep_first(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 3, 4, 7, 8, 9, 10, 11] and None in ids  # 3: two texts that aren't linked


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near_a = a + " and more"
    texts = [a, near_a, b, b, b + " too", c, "", "", None, a, near_a]
    ids = [3, 5, 5, 5, 9, 9, 5, 5, 7, None, None]
    docs = table(spark, texts, ids=ids)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).filter("doc_id IS NOT NULL").collect())
    size = {t: len(shingle_set(t, 5)) for t in texts if t is not None}
    assert got == sorted([(3, size[a], 3, True), (5, size[near_a], 3, False), (5, size[b], 5, True), (5, size[b], 5, True), (9, size[b + " too"], 5, False), (9, size[c], 9, True), (5, 0, 5, True), (5, 0, 5, True), (7, 0, 7, True)])
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted([("3", a), ("5", b), ("9", c), ("5", ""), ("7", "None"), ("None", a), ("None", near_a)])


def test_linked_texts_of_one_id_leave_one(spark):
    base = prose(4, 120)
    docs = table(spark, [base, base + " x", base, base + " y"] * 10, ids=[2, 2, 2, 1] * 10)
    kept = minhash.keep_first(docs).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(1, base + " y")]
    assert len(minhash.keep_first(docs.filter("doc_id = 2")).collect()) == 1


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    for share in (0.3, 0.7, 0.9):
        n = 400
        both = int(share * 2 * n / (1 + share))
        a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        sig = minhash.super_minhash(np.repeat([0, 1], n), np.concatenate([a, b]), 2, 256)
        assert abs((sig[0] == sig[1]).mean() - both / (2 * n - both)) < 0.1
    few = minhash.super_minhash(np.zeros(1, np.int64), pool[:1], 1, 128)
    assert len(set((few[0] >> np.uint64(32)).tolist())) == 128  # one permutation: every step once


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (50, 50), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100} | {i: 200 for i in range(201, 260)}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
