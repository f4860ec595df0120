from __future__ import annotations

import corpus_pipeline
import pytest

from revdiff.llm import quality, queries, secret_scan
from revdiff.llm.storage import staged

from .test_contamination import brute as contamination
from .test_near_duplicates import brute as duplicates

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert names == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "packing"]

    good = staged(stages[names[0]](spark, docs, DATA))
    rejected = {r.doc_id for r in quality.score_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet")).filter("predicted = 0").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in good.collect()} == set(text) - rejected

    ids = sorted(set(text) - rejected)
    found, _ = duplicates([text[i] for i in ids], 5, 80)
    single = staged(stages[names[1]](spark, good, DATA))
    first = [i for k, i in enumerate(ids) if found[k] == k]
    assert sorted(r.doc_id for r in single.collect()) == first

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = contamination([text[i] for i in first], items)
    clean = [i for i, (n, h, _) in zip(first, bad) if not (h > 0 and 20 * h >= n)]
    decontaminated = staged(stages[names[2]](spark, single, DATA))
    assert sorted(r.doc_id for r in decontaminated.collect()) == clean

    masked = staged(stages[names[3]](spark, decontaminated, DATA))
    assert {r.doc_id: r.text for r in masked.collect()} == {i: secret_scan.masked(text[i], "[SECRET]") for i in clean}
    assert masked.columns == docs.columns

    packed = stages[names[4]](spark, masked, DATA)
    assert sorted({r.doc_id for r in packed.select("doc_id").collect()}) == clean
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()


def test_stages_take_any_rows(spark, edge, tmp_path):
    spark.createDataFrame([(0, 1, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", "two words"), (None, "x"), ("j", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edge, edge.limit(0)):
        docs = staged(docs)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, staged(stage(spark, docs, str(tmp_path)))
            assert docs.columns == edge.columns and docs.count() <= before.count(), name
        left = {r.doc_id for r in docs.collect()}
        assert left == ({0, 1, 2, 3, 7, 8, 9, 10, 11, None} if before.count() else set())
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert {r.doc_id for r in packed.select("doc_id").collect()} == left


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for frame in (got, want):  # a number that may be null comes in several types
        for c in columns:
            if frame[c].dtype.kind in "if":
                frame[c] = frame[c].astype(float)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))
