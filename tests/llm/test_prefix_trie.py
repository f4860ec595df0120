from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from revdiff.llm import ordering, prefix_trie
from revdiff.llm.queries import op11_conversation_prefix_trie
from revdiff.llm.storage import staged

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos bigint, node bigint, loc int, k1 string, seg double, part int"


def turns_table(spark, rows, parts=3):
    """``conversations`` of (conv, turn, role, text), with columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, "k", 0.5, 4) for r in rows], SCHEMA).repartition(parts)


def sequences(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[0])] for c, x in by.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = seqs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(seqs):
    members, ends = {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    children = {k: [] for k in members}
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(out[x][5] for x in children[k]) if children[k] else 1
        saved = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(out[x][6] for x in children[k])
        count = 1 + sum(out[x][7] for x in children[k])
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out[k] = (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves, saved, count, digest)
    return sorted(out.values(), key=str)


def plain(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.n_nodes, r.ends_sha256) for r in df.collect()), key=str)


def made(seed, convs, longest=12, kinds=4):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]) if t > 2 else "user", f"say {r.randrange(kinds if t < 5 else 2)} é"))
    return rows


EDGE = [
    (None, 1, "user", "no conversation"), (1, None, "user", "first"), (1, 0, None, None), (1, 5, "", ""), (2, None, "user", "first"), (2, 1, None, ""), (3, 7, "user", "x" * 100_000),
    (4, -1, "user", "é日本"), (4, 2, None, None), (5, 1, "user", "alone"), (10**15, 3, "user", "first"), (6, 1, "a", "bc"), (7, 1, "ab", "c"),
]


@pytest.mark.parametrize("segments", [1 << 16, 3])
def test_equals_brute_force(spark, segments):
    rows = made(1, 120) + made(2, 1, 60)[1:] + [(500, t, "user", f"long {t}") for t in range(300)] + [(501, t, "user", f"long {t}") for t in range(250)] + [(600 + i, t, "user", f"copy {t}") for i in range(80) for t in range(3)]
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())
    random.Random(3).shuffle(rows)
    ordered = staged(prefix_trie.ordered_turns(turns_table(spark, rows)))
    want = sequences(rows)
    if segments > 3:
        assert plain(prefix_trie.trie(ordered, segments=segments)) == brute(want)
    assert plain(prefix_trie.trie(*prefix_trie.rebuilt_turns(ordered), segments=segments)) == brute(rebuilt(want))


def test_edges_and_texts_of_nodes(spark):
    rows = EDGE + [(1, 0, None, None)]
    got = prefix_trie.prefix_trie(turns_table(spark, rows))
    seqs = sequences(rows)
    assert plain(got) == brute(seqs)
    for r in got.collect():
        assert (r.role, r.text) == ((None, None) if r.depth == 0 else seqs[r.conv_id][r.depth - 1])
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = prefix_trie.ordered_turns(spark.createDataFrame([], SCHEMA))
    assert plain(prefix_trie.trie(alone, spark.range(2, 4).toDF("conv_id"))) == brute({2: [], 3: []})


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(c, 1, "user", f"tie {i}") for c in range(4) for i in range(6)]
    one = plain(prefix_trie.prefix_trie(turns_table(spark, rows)))
    random.Random(1).shuffle(rows)
    assert plain(prefix_trie.prefix_trie(turns_table(spark, rows, 7))) == one and len(one) == 7


def test_pieces_of_ids_and_batches_of_three_rows(spark, monkeypatch, tmp_path):
    rows = made(5, 200, 4, 2)
    turns_table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    try:
        got = op11_conversation_prefix_trie(spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    want = brute(rebuilt(sequences(rows)))
    assert sorted(got.ends_sha256) == sorted(x[-1] for x in want) and sorted(got.saved_tokens) == sorted(x[6] for x in want)


def test_running_sums_and_followers_over_ranges(spark):
    rows = [(k, i, (k * 7 + i) % 11 + (1 << 61)) for k, n in ((1, 3), (2, 400), (3, 1), (9, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "key bigint, i bigint, x bigint")
    want, total = {}, {}
    for k, i, x in rows:
        total[k] = (total.get(k, 0) + x) % (1 << 62)
        want[k, i] = total[k]
    got = ordering.running(df, "key", [F.col("i").asc()], ["x"]).collect()
    assert {(r.key, r.i): r.x for r in got} == want and len(got) == len(rows)
    after = {(r.key, r.i): r.after for r in ordering.followed(df, ["key"], ["i"], "i").collect()}
    assert after == {(k, i): i + 1 if (k, i + 1) in want else None for k, i, _ in rows}
    numbers = sorted((r.no, r.key, r.i) for r in ordering.numbered(df, [F.col("key"), F.col("i")], "no").collect())
    assert numbers == [(n + 1, k, i) for n, (k, i, _) in enumerate(rows)]
