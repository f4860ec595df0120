"""The index for long sequences gives what difflib gives."""

from __future__ import annotations

import random
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revdiff.kernels import longest, matching
from revdiff.operators.diff import find_diffs


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


@pytest.fixture
def always_indexed(monkeypatch):
    monkeypatch.setattr(longest, "SMALL", 0)


def edited(r, a, kinds, edits):
    b = list(a)
    for _ in range(edits):
        i = r.randrange(len(b) + 1)
        b[i : i + r.randint(0, 3)] = [r.randrange(kinds) for _ in range(r.randint(0, 3))]
    return b


@pytest.mark.parametrize("kinds", [1, 2, 3, 6, 40])
def test_equals_difflib_on_repeats(always_indexed, kinds):
    r = random.Random(kinds)
    for _ in range(300):
        a = [r.randrange(kinds) for _ in range(r.randint(0, 45))]
        b = edited(r, a, kinds, r.randint(0, 6)) if r.random() < 0.5 else [r.randrange(kinds) for _ in range(r.randint(0, 45))]
        assert longest.opcodes(a, b) == plain(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_equals_difflib_on_any_sequence(a, b):
    had, longest.SMALL = longest.SMALL, 0
    try:
        assert longest.opcodes(a, b) == plain(a, b)
    finally:
        longest.SMALL = had


def test_equals_difflib_where_regions_are_small_at_last():
    r = random.Random(9)
    for kinds in (2, 20, 50, 1000):
        a = [r.randrange(kinds) for _ in range(500)]
        for b in (edited(r, a, kinds, 40), [r.randrange(kinds) for _ in range(450)]):
            assert matching.opcodes(a, b) == plain(a, b)
    words = [r.choice(["the", " ", "of", ", ", "page"]) for _ in range(400)]
    other = words[:100] + words[130:] + words[:20]
    assert matching.opcodes(words, other) == plain(words, other)


def shapes(n):
    r = random.Random(4)
    lines = [r.randrange(50) for _ in range(n)]
    steps = [x for k in range(1, 190) for x in [*((k, i) for i in range(k)), ("old", k)]]
    return {
        "random": (lines, [r.randrange(50) for _ in range(n)]),
        "edited": (lines, [x if r.random() > 0.05 else r.randrange(50) for x in lines]),
        "every other line": ([i if i % 2 else ("old", i) for i in range(n)], [i if i % 2 else ("new", i) for i in range(n)]),
        "one line": ([1] * n, [1] * (n - 5)),
        "reversed": (list(range(n)), list(range(n))[::-1]),
        "a run of each length": (steps, [("new", x[1]) if x[0] == "old" else x for x in steps]),
    }


@pytest.mark.parametrize("name", shapes(10))
def test_long_documents_take_seconds(name):
    old, new = shapes(20_000)[name]
    began = time.process_time()
    got = longest.opcodes(old, new)
    assert time.process_time() - began < 20
    assert got[0][1] == got[0][3] == 0 and (got[-1][2], got[-1][4]) == (len(old), len(new))
    for op, i1, i2, j1, j2 in got:
        assert op != "equal" or old[i1:i2] == new[j1:j2]


def test_a_pair_of_long_documents(spark):
    r = random.Random(5)
    old = [r.randrange(50) for _ in range(6000)]
    new = [x if r.random() > 0.1 else r.randrange(50) for x in old]
    rows = [(d, i, f"line {x}") for d, side in ((1, old), (2, new)) for i, x in enumerate(side)]
    found = find_diffs(spark.createDataFrame([(7, 1, 2)], "pair_id bigint, old_doc bigint, new_doc bigint"), spark.createDataFrame(rows, "doc_id bigint, pos int, text string"))
    got = [(x.opcode, x.i1, x.i2, x.j1, x.j2) for x in found.orderBy("frag_no").collect()]
    assert got == [x for x in longest.opcodes(old, new) if x[0] != "equal"] and len(got) > 400
