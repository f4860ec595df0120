from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from revdiff.llm import langid, lattice_lm, quality

from .conftest import EDGE, SCHEMA, prose, table

DATA = "/root/testdata/sf0.01"


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    lattice = lattice_lm.Lattice(pieces)
    log_p = np.log(np.linspace(0.01, 0.2, lattice.size))

    def brute(word):
        word = "▁" + word
        used, total = collections.Counter(), 0.0

        def walk(i, p, path):
            nonlocal total
            if i == len(word):
                total += p
                for x in path:
                    used[x] += p
                return
            for n, piece in enumerate(pieces):
                if word.startswith(piece, i):
                    walk(i + len(piece), p * math.exp(log_p[n]), [*path, n])
            if word[i] not in "▁ab":
                raw = [len(pieces) + x for x in word[i].encode()]
                walk(i + 1, p * math.exp(sum(log_p[x] for x in raw)), [*path, *raw])

        walk(0, 1.0, [])
        return math.log(total), {k: v / total for k, v in used.items()}

    words = ["", "a", "ab", "abab", "baba", "éa", "aébb", "abbabab"]
    assert lattice.log_probs(words, log_p) == pytest.approx([brute(w)[0] for w in words])
    want = np.zeros(lattice.size)
    for i, w in enumerate(words):
        for k, v in brute(w)[1].items():
            want[k] += v * (i + 1)
    weight, own = np.arange(1.0, len(words) + 1), np.full(len(words), -np.inf)
    used, taken = lattice.expected_counts(words, weight, log_p, own, weight)
    assert used == pytest.approx(want) and not taken.any()
    own[3] = brute(words[3])[0]  # as likely as all its segmentations
    for most, kept in ((weight, 2.0), (np.full(len(words), 1.5), 1.5)):
        used, taken = lattice.expected_counts(words, weight, log_p, own, most)
        less = want.copy()
        for k, v in brute(words[3])[1].items():
            less[k] -= v * kept
        assert used == pytest.approx(less) and taken == pytest.approx([0, 0, 0, kept, 0, 0, 0, 0])


def test_scores_of_documents(spark):
    texts = [*EDGE, *(prose(i, 40, vocabulary=60) for i in range(60))]
    docs = table(spark, texts)
    one = {r.doc_id: r for r in lattice_lm.score_documents(docs).collect()}
    few = {r.doc_id: r for r in lattice_lm.score_documents(docs, head=5).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    count = collections.Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    n, v = sum(count.values()), len(count)
    for i, own in tokens.items():
        r = one[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(own), sum(count[w] > 0 for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0 and math.isfinite(r.score) and r.score == pytest.approx(few[i].score)
        assert (few[i].n_tokens, few[i].n_known, few[i].base_score) == (r.n_tokens, r.n_known, pytest.approx(r.base_score))


def test_document_score_is_the_marginal_of_its_segmentations(spark, monkeypatch):
    vocab = [("<unk>", 0.0), ("▁", -3.0), ("a", -1.0), ("b", -2.0), ("ab", -1.5), ("▁a", -1.0), ("ba", -2.5), ("a▁b", -1.0)]
    monkeypatch.setattr(lattice_lm.vocabulary, "load", lambda path: (vocab, 0))
    pieces, log_p = lattice_lm.word_pieces(vocab, "log")
    assert pieces == ["▁", "a", "b", "ab", "▁a", "ba"] and np.exp(log_p).sum() == pytest.approx(1)
    assert lattice_lm.word_pieces([("x", 0.0), ("y", -1.0)], "rank")[1][0] - lattice_lm.word_pieces([("x", 0.0), ("y", -1.0)], "rank")[1][1] == pytest.approx(math.log(1.5))
    texts = ["a ab abab", "baba é", "", None, "ab AB  abb", "b bé a", "abba baab", "a é"]

    def cuts(word):
        """All segmentations of a word, as lists of piece numbers."""
        if not word:
            return [[]]
        out = [[n, *rest] for n, p in enumerate(pieces) if word.startswith(p) for rest in cuts(word[len(p) :])]
        if word[0] not in "▁ab":
            out += [[*(len(pieces) + x for x in word[0].encode()), *rest] for rest in cuts(word[1:])]
        return out

    words = [["▁" + w for w in (t or "").lower().split()] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for i in train for w in words[i])
    begins = np.array([x.startswith("▁") for x in pieces] + [False] * 256)
    p = np.exp(log_p)
    p[begins] /= 2 * p[begins].sum()
    p[~begins] /= 2 * p[~begins].sum()
    own, stop = {w: c / (2 * sum(count.values())) for w, c in count.items()}, 0.5
    for _ in range(3):
        used, own_used = np.full(len(p), 0.01), collections.Counter()
        for w, n in count.items():
            ways = cuts(w)
            chance = np.array([np.prod(p[x]) for x in ways])
            own_used[w] = min(n * own[w] / (chance.sum() * stop + own[w]), n - 0.75)
            for x, c in zip(ways, chance / chance.sum()):
                np.add.at(used, x, c * (n - own_used[w]))
        stops = sum(n - own_used[w] for w, n in count.items()) + 0.01
        total, inside = used[begins].sum() + sum(own_used.values()) + len(train) + 0.01, used[~begins].sum() + stops
        p = np.where(begins, used / total, used / inside)
        own, stop = {w: c / total for w, c in own_used.items()}, stops / inside
    end = (len(train) + 0.01) / total
    assert p[begins].sum() + sum(own.values()) + end == pytest.approx(1) == p[~begins].sum() + stop
    got = {r.doc_id: r.score for r in lattice_lm.score_documents(table(spark, texts), scores="log", rounds=3).collect()}
    for i, one in enumerate(words):
        assert got[i] == pytest.approx(sum(math.log10(sum(np.prod(p[x]) for x in cuts(w)) * stop + own.get(w, 0)) for w in one) + math.log10(end))


def test_known_words_are_nearly_as_likely_as_by_their_counts(spark):
    """On held-out texts the model gives known words about what counting gives, and it gives unknown words something."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    per = F.sum("n_tokens")
    held = lattice_lm.score_documents(docs).groupBy("held_out").agg((F.sum("score") / per).alias("score"), (F.sum("base_score") / per).alias("base")).collect()
    told = {r.held_out: r for r in held}
    assert told[True].score > -4.75 and told[False].score > told[False].base - 0.3


def test_score_edge_cases(spark, edge):
    assert lattice_lm.score_documents(edge).count() == len(EDGE)
    assert lattice_lm.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lattice_lm.score_documents(edge.filter("doc_id = 0")).first().n_tokens == 1


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_edge_cases(spark, edge):
    got = {r.doc_id: r for r in langid.identify_languages(edge).collect()}
    assert {got[i].lang_pred for i in (0, 1, 2, 11)} == {"und"} and got[3].lang_pred == "en" and got[1].score == 0
    assert {r.lang_pred for r in langid.identify_languages(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got[3].score > 0.5


def test_languages_equal_brute_force(spark):
    vector = lambda c: langid.letter_vectors(np.array([c]), 512)[0].astype(int)

    def profile(text):
        codes = [0]
        for c in text or "":
            code = ord(c.lower()) if c.isalpha() else 0
            if code or codes[-1]:
                codes.append(code)
        if codes[-1]:
            codes.append(0)
        total = np.zeros(512)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            total += vector(a) * np.roll(vector(b), 1) * np.roll(vector(c), 2)
        return total / max(np.linalg.norm(total), 1e-9)

    texts = [*EDGE[:10], *EDGE[11:], "a", "ab", "É", *(prose(i, 12, vocabulary=30 + 40 * (i % 3)) for i in range(30))]
    names = {k: f"l{k % 7}" for k in range(len(texts))}
    v = [profile(t) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))]
    has = [any(c.isalpha() for c in t or "") for t in texts]
    langs = sorted({names[i] for i in range(len(texts)) if has[i] and not held[i]})
    proto = {x: sum(v[i] for i in range(len(texts)) if names[i] == x and has[i] and not held[i]) for x in langs}
    proto = {x: p / np.linalg.norm(p) for x, p in proto.items()}
    common = sum(proto.values()) / len(langs)
    docs = table(spark, texts, langs=names)
    for together in (2000, 2):  # one block of prototypes, or several
        got = {r.doc_id: r for r in langid.identify_languages(docs, together=together).collect()}
        for i in range(len(texts)):
            own = v[i] - common
            scores = {x: (1 + own @ (p - common) / np.linalg.norm(own) / np.linalg.norm(p - common)) / 2 for x, p in proto.items()}
            assert got[i].held_out == held[i]
            if not has[i]:
                assert (got[i].lang_pred, got[i].score) == ("und", 0)
            else:
                assert got[i].score == pytest.approx(max(scores.values()), abs=1e-5) == pytest.approx(scores[got[i].lang_pred], abs=1e-5)


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.score_quality(docs, labels).filter("held_out").join(labels, "doc_id")
    assert held.filter("predicted = quality").count() >= 0.95 * held.count() > 0
    good = held.filter("quality = 1")
    assert good.filter("predicted = 1").count() >= 0.97 * good.count()
    whole = quality.score_quality(docs, labels)
    kept = quality.keep_good(docs, labels)
    assert kept.count() == whole.filter("predicted = 1").count() and kept.columns == docs.columns


def test_quality_edge_cases(spark, edge):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (None, 0, 0), (4, None, 0), (5, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_quality(edge, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(edge, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_densities_are_those_of_the_formula():
    r = np.random.default_rng(3)
    d = quality.FEATURES
    x = [r.normal(0, 1, (300, d)), r.normal(1, 2, (200, d))]
    totals = np.stack([np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)]) for z in x])
    model = quality.Discriminant(totals, 0.3, 0.05)
    cov = [np.cov(z.T, bias=True) for z in x]
    common = (cov[0] * 300 + cov[1] * 200) / 500
    q = r.normal(0, 1, (5, d))
    logs = []
    for z, c in zip(x, cov):
        s = 0.95 * (0.7 * c + 0.3 * common) + 0.05 * np.diag(np.diag(common))
        dev = q - z.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", dev, np.linalg.inv(s), dev) - 0.5 * np.linalg.slogdet(s)[1])
    prior = 201 / 502
    assert model.score(q) == pytest.approx(1 / (1 + np.exp(-(logs[1] - logs[0] + math.log(prior / (1 - prior))))))
