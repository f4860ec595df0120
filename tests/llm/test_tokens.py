from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from revdiff.llm import packing, queries, token_count, vocabulary
from revdiff.llm.textbatch import text_buffer
from revdiff.llm.tokens import ByteBpe

from .conftest import EDGE, SCHEMA, prose, table


def bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def strange(n, seed):
    r = random.Random(seed)
    signs = [*"ab1 '\n\t.,é日　\xa0 <|>́▁", "\U0001f600", "<|endoftext|>", " ", " ", "the", "'s"]
    return ["".join(r.choices(signs, k=r.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_library():
    texts = [t or "" for t in EDGE] + strange(1500, 2) + [prose(3, 500)]
    buf, offsets = text_buffer(pa.array(texts))
    tokenizer = ByteBpe()
    for _ in range(2):  # the second time from what is kept
        count, ids = tokenizer.encode(buf, offsets, end_id=0)
        want = [e.ids + [0] for e in bpe().encode_batch(texts, add_special_tokens=False)]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("fallback", [True, False])
def test_counts_equal_the_library(fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab, unknown = vocabulary.load()
    small = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁a", -3.0), ("bb", -1.5), ("th", -4.0)]
    for pieces, unk in ((vocab, unknown), (small, 0)):
        if pieces is small and fallback:
            continue
        library = Tokenizer(models.Unigram([(p, s) for p, s in pieces], unk_id=unk, byte_fallback=fallback))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        texts = [t or "" for t in EDGE] + strange(1500, 4)
        buf, offsets = text_buffer(pa.array(texts))
        got = token_count._Cached(token_count.UnigramCounter(pieces, fallback)).texts(buf, offsets)
        assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_operator(spark, edge):
    got = token_count.count_tokens(edge)
    assert got.count() == len(EDGE) and {r.n_tokens for r in got.filter("doc_id < 2").collect()} == {0}
    assert token_count.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packing_is_a_partition_of_all_ids(spark):
    texts = [*EDGE, *[prose(5, 60)] * 40, *(prose(i, random.Random(i).randint(1, 400)) for i in range(60))]
    docs = table(spark, texts)
    got = packing.pack_documents(docs, size=256).toPandas()
    want = [e.ids + [0] for e in bpe().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for i, ids in enumerate(want):
        own, at = got[got.doc_id == i].sort_values("start"), 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert zlib.crc32(np.array(ids[p.start : at], "<u4").tobytes()) == p.ids_crc32
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist()
        total = int(s.length.sum())
        assert total <= 256 and total & (total - 1) == 0  # nothing to pad


def test_packing_returns_the_ids(spark, tmp_path):
    texts = [*EDGE, *(prose(i, random.Random(i).randint(1, 400)) for i in range(30))]
    docs = table(spark, texts)
    got = sorted(packing.pack_documents(docs, size=256).collect(), key=lambda p: (p.sequence_id, p.offset))
    want = [e.ids + [0] for e in bpe().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces, sequences = {}, {}
    for p in got:
        assert len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        pieces.setdefault(p.doc_id, []).append((p.start, p.ids))
        assert p.offset == len(sequences.setdefault(p.sequence_id, []))
        sequences[p.sequence_id] += p.ids
    assert [sum((ids for _, ids in sorted(pieces[i])), []) for i in range(len(texts))] == want
    assert sum(map(len, sequences.values())) == sum(map(len, want))

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op10_packing(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    last = dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path))
    assert dict(last.dtypes)["ids"] == "array<int>"


def test_packing_follows_the_curve(spark):
    texts = [t for t in EDGE if t and len(t) < 10_000] + [prose(i, 20 + i % 50) for i in range(80)] + [prose(5, 60)] * 30
    ids = [None if i % 9 == 0 else i % 60 for i in range(len(texts))]
    docs = table(spark, texts, ids=ids)
    buf, offsets = text_buffer(pa.array(texts))
    key = packing.document_keys(buf, offsets, packing._projection())
    by_ids = {tuple(e.ids + [0]): int(k) for e, k in zip(bpe().encode_batch(texts, add_special_tokens=False), key)}
    for n in (1, 5):
        got = sorted(packing.pack_documents(docs, size=128, partitions=n).collect(), key=lambda p: (p.sequence_id, p.offset))
        found, open_ = [], []
        for p in got:
            open_ += p.ids
            if p.start + p.length == p.doc_tokens:  # a document ends where its last piece does
                found.append((p.sequence_id >> 40, by_ids[tuple(open_)]))
                open_ = []
        assert not open_ and len(found) == len(texts)
        assert found == sorted(found) and len({part for part, _ in found}) == n
        assert [k for _, k in found] == sorted(key.tolist())


def test_packing_edge_cases(spark, edge):
    got = packing.pack_documents(edge)
    assert got.select("doc_id").distinct().count() == len({*range(len(EDGE) - 2), None, 3})
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    key = packing.hilbert_key(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_equal_texts_have_equal_keys():
    texts = [prose(1, 50), prose(2, 50), prose(1, 50)]
    buf, offsets = text_buffer(pa.array(texts))
    key = packing.document_keys(buf, offsets, packing._projection())
    assert key[0] == key[2] != key[1]
