"""The quality score of every document, from statistics counted character by character and densities written out."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from revdiff.llm import quality
from revdiff.llm.queries import op8_quality
from revdiff.llm.textbatch import text_buffer

from .conftest import EDGE

DATA = "/root/testdata/sf0.001"


def plain_statistics(text):
    raw = (text or "").encode()
    of = lambda chars: sum(raw.count(c.encode()) for c in chars)
    upper, lower = (sum(a <= c <= b for c in raw) for a, b in ((65, 90), (97, 122)))
    letters = upper + lower + sum(c >= 0xC0 for c in raw)
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
    n, size = len(words), [len(w) for w in words]
    share = lambda x, y: math.log((x / y if y else 0) + 0.005)
    mean = sum(size) / n if n else 0
    spread = math.sqrt(max(sum(s * s for s in size) / n - mean * mean, 0)) if n else 0
    kinds = Counter(words)
    lines = raw.count(b"\n") + 1
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread), share(letters, len(raw)), share(upper, letters), share(sum(48 <= c <= 57 for c in raw), len(raw)),
        share(of(".?"), n), share(of("!"), n), share(of(",;:"), n), share(of("|"), n), share(of("#$%&*+=<>@^_~\\/{}[]"), n),
        share(len(kinds), max(n, 1)), math.log(max(len(kinds), 1)) / math.log(max(n, 2)), share(max(kinds.values(), default=0), n),
        share(sum(a == b for a, b in zip(words, words[1:])), n), share(sum(s <= 3 for s in size), n), share(sum(s >= 14 for s in size), n), math.log1p(n / lines), math.log1p(lines),
    ]


def test_statistics_are_those_counted_one_by_one():
    texts = [*EDGE, "One two, TWO! 33% | a_b\n\nlast?", "word word word other", "é É ñ 日", "a" * 20 + " b", "\n\n\n"]
    got = quality.document_statistics(*text_buffer(pa.array(texts)))
    assert got.shape == (len(texts), quality.FEATURES)
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain_statistics(text), abs=1e-9)


def test_every_score(spark):
    docs = {r.doc_id: plain_statistics(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in docs}
    told = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in docs and not held[r.doc_id]]
    own = [np.array([docs[d] for d, y in told if y == k]) for k in (0, 1)]
    means, covs = [z.mean(axis=0) for z in own], [np.cov(z.T, bias=True) for z in own]
    common = sum(len(z) * c for z, c in zip(own, covs)) / len(told)
    covs = [0.95 * (0.7 * c + 0.3 * common) + 0.05 * np.diag(np.maximum(np.diag(common), 1e-4)) for c in covs]
    share = (len(own[1]) + 1) / (len(told) + 2)
    got = {r.doc_id: r for r in op8_quality(spark, DATA).collect()}
    assert got.keys() == docs.keys()
    for d, x in docs.items():
        logs = [-0.5 * float((x - m) @ np.linalg.solve(c, x - m)) - 0.5 * np.linalg.slogdet(c)[1] for m, c in zip(means, covs)]
        odds = min(max(logs[1] - logs[0] + math.log(share / (1 - share)), -700), 700)
        assert got[d].held_out == held[d] and got[d].score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        assert got[d].predicted == (got[d].score >= 0.5)
