from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np

from revdiff.llm import resample

from .conftest import EDGE, SCHEMA, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + g]) for g in range(1, n + 1) for i in range(len(w) - g + 1)]


def brute(rows, target, n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    """[(id, n_features, weight, score, rank)] of (id, text) rows."""
    count = lambda texts: np.bincount([zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, n)[1]] or [0], minlength=buckets) * bool(any(features(t, n)[1] for t in texts))
    s, t = count([x for _, x in rows]), count(target)
    gain = [math.floor(1000 * math.log((int(t[b]) + 1) * (int(s.sum()) + buckets) / ((int(s[b]) + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words, found = features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([words, i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[0] >= min_words), key=lambda r: (-r[4], math.inf if r[1] is None else r[1], r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(i, f, w, s, rank.get(id(r))) for r in out for _, i, f, w, s in [r]]


def plain(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


def test_checksums_of_features():
    words = [b"a", b"b", "é".encode(), b"abcdefgh", b"abcdefgi", b"x" * 9, b"y" * 70, b"y" * 70, b"z" * 300, b"a", "日本".encode()]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    got = resample.feature_buckets(raw, end - [len(w) for w in words], end, 1 << 31)
    assert got.tolist() == [zlib.crc32(w) % (1 << 31) for w in words]


def test_equals_brute_force(spark):
    texts = [prose(i, 5 + 7 * (i % 40), 200 + i) for i in range(150)] + [prose(3, 60)] * 12 + EDGE
    ids = [*range(150), *[200 - i // 3 for i in range(12)], *range(300, 300 + len(EDGE) - 2), None, 3]
    target = [prose(5, 80, 205), prose(6, 90, 206), "One two 3three Ünï", None, ""]
    docs, aim = table(spark, texts, ids=ids), table(spark, target)
    for options in ({}, {"n": 3, "buckets": 500, "percent": 35, "min_words": 3, "seed": 7}):
        got = resample.importance_resample(docs, aim, **options)
        assert plain(got) == sorted(brute(list(zip(ids, texts)), target, **options), key=str)
        ranks = sorted(r.rank for r in got.collect() if r.rank)
        assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_ties_and_batches_of_three_rows(spark):
    texts = [prose(1, 30)] * 40
    ids = [9 - i // 10 for i in range(40)]
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = plain(resample.importance_resample(table(spark, texts, ids=ids), table(spark, [prose(2, 40)]), percent=50))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert got == sorted(brute(list(zip(ids, texts)), [prose(2, 40)], percent=50), key=str)


def test_empty_tables(spark, edge):
    nothing = spark.createDataFrame([], SCHEMA)
    assert resample.importance_resample(nothing, edge).count() == 0
    got = resample.importance_resample(edge, nothing)
    assert got.count() == len(EDGE) and resample.importance_resample(nothing, nothing).count() == 0
    assert {r.weight for r in got.filter("n_features = 0").collect()} == {0}


def test_drawn_rows_keep_their_columns(spark):
    texts = [prose(i, 40) for i in range(50)]
    docs = table(spark, texts + texts[:5], ids=[*range(50), *range(5)]).withColumnRenamed("key", "drawn_by_id")
    aim = table(spark, texts[:3])
    want = {(r.doc_id) for r in resample.importance_resample(docs, aim, percent=20).filter("rank IS NOT NULL").collect()}
    got = resample.resampled(docs, aim, percent=20)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want


def test_the_draw_resembles_the_target(spark):
    kinds = [prose(1000 + i, 60, 150) for i in range(10)]
    texts = [kinds[0] if i % 10 == 0 else prose(2000 + i, 60, 3000) for i in range(300)]
    got = resample.importance_resample(table(spark, texts), table(spark, [kinds[0]] * 200))
    drawn = [r.doc_id for r in got.filter("rank IS NOT NULL").collect()]
    assert len(drawn) == 30 and sum(i % 10 == 0 for i in drawn) >= 12
