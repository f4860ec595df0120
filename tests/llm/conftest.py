from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, rep bigint, h bigint, row bigint, score double, curve bigint, digest bigint, n int, node bigint, component bigint"


def table(spark, texts, ids=None, langs=None, sources=None):
    """``documents`` and columns whose names the operators use inside."""
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, (langs or {}).get(k, "en"), "src0" if k % 3 else None, len(t) if t is not None else None, "k", 1, 2, 3, 0.5, 4, 5, 6, 7, 8) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu".split()
    bag = ["".join(r.choices(syllables, k=1 + i % 3)) for i in range(vocabulary)]
    return " ".join(r.choice(bag) for _ in range(words))


def edited(text: str, edits: int, seed: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**9)}"
    return " ".join(w)


#: Null, empty, blank, one word, few words, repeated, upper case, beyond ASCII, and one long text.
EDGE = [None, "", "   \n", "one", "two words", "two words", "TWO WORDS", "three little words", "é日本 mixed ñ", "x" * 5000, prose(99, 30_000), "!!! ??? ...", "▁ mark", "<|endoftext|> a"]


@pytest.fixture
def edge(spark):
    return table(spark, EDGE, ids=[*range(len(EDGE) - 2), None, 3])
