from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from revdiff.kernels import matching
from revdiff.operators import diff, model, rows
from revdiff.plans import compare

BLOCKS = "doc_id bigint, pos int, text string"
PAIRS = "pair_id bigint, old_doc bigint, new_doc bigint, is_pdf boolean"


def tables(spark, versions, is_pdf=False):
    pairs = spark.createDataFrame([(i, 2 * i, 2 * i + 1, is_pdf) for i in range(len(versions))], PAIRS)
    data = [(2 * i + side, k, t) for i, v in enumerate(versions) for side in (0, 1) for k, t in enumerate(v[side])]
    return pairs, spark.createDataFrame(data, BLOCKS)


def random_versions(n, seed):
    r = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    block = lambda: " ".join(r.choices(words, k=r.randint(1, 9)))
    out = []
    for _ in range(n):
        old = [block() for _ in range(r.randint(0, 12))]
        new = [b if r.random() < 0.6 else b + " more" if r.random() < 0.5 else block() for b in old if r.random() < 0.85]
        out.append((old, new + [block()] * r.randint(0, 2)))
    return out


def test_find_diffs_equals_difflib(spark):
    versions = random_versions(60, 1)
    got = diff.find_diffs(*tables(spark, versions)).orderBy("pair_id", "frag_no").collect()
    want = [(i, op, i1, i2, j1, j2, old[i1:i2], new[j1:j2]) for i, (old, new) in enumerate(versions) for op, i1, i2, j1, j2 in SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if op != "equal"]
    assert [(g.pair_id, g.opcode, g.i1, g.i2, g.j1, g.j2, g.old_blocks, g.new_blocks) for g in got] == want


def test_refined_fragments_tile_their_ranges(spark):
    versions = random_versions(60, 2)
    found = diff.find_diffs(*tables(spark, versions))
    fine = diff.refine_fragments(found).orderBy("pair_id", "frag_no").collect()
    cover = lambda fr: {(f.pair_id, s, k) for f in fr for s, a, b in (("o", f.i1, f.i2), ("n", f.j1, f.j2)) for k in range(a, b)}
    assert cover(fine) == cover(found.collect())
    for f in fine:
        old, new = versions[f.pair_id]
        assert f.old_blocks == old[f.i1 : f.i2] and f.new_blocks == new[f.j1 : f.j2]
        assert (f.opcode == "delete") == (f.j1 == f.j2) and (f.opcode == "insert") == (f.i1 == f.i2)
    ends = {}
    for f in fine:
        assert (f.i1, f.j1) >= ends.get(f.pair_id, (0, 0))
        ends[f.pair_id] = (f.i2, f.j2)


def test_split_of_a_replaced_region():
    old, new = ["the quick brown fox", "gone entirely 12345"], ["zzzz", "the quick brown dog"]
    assert matching.split_replaced(old, new) == [("insert", 0, 0, 0, 1), ("replace", 0, 1, 1, 2), ("delete", 1, 2, 2, 2)]
    assert matching.split_replaced(["a"], ["b"]) == [("delete", 0, 1, 0, 0), ("insert", 1, 1, 0, 1)]


def test_large_replacements_pass(spark):
    old, new = [f"old {i}" for i in range(51)], [f"new {i}" for i in range(50)]
    got = diff.refine_fragments(diff.find_diffs(*tables(spark, [(old, new)]))).collect()
    assert [(g.opcode, g.i1, g.i2, g.j1, g.j2) for g in got] == [("replace", 0, 51, 0, 50)]


def test_monotone_pairs_are_best():
    r = random.Random(3)

    def best(s, i=0, j=0):
        if i == len(s) or j == len(s[0]):
            return 0.0
        here = s[i][j] + best(s, i + 1, j + 1) if s[i][j] else 0.0
        return max(best(s, i + 1, j), best(s, i, j + 1), here)

    for _ in range(60):
        s = [[r.choice([0.0, 0.0, 0.6, 0.75, 1.0]) for _ in range(3)] for _ in range(r.randint(1, 5))]
        pairs = matching.best_monotone_pairs(s)
        assert sum(s[i][j] for i, j in pairs) == pytest.approx(best(s))
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:])) and all(s[i][j] > 0 for i, j in pairs)


def test_similarity_keeps_direction_and_junk(spark):
    r = random.Random(4)
    texts = [("".join(r.choices("abcde ", k=r.choice([0, 5, 250]))), "".join(r.choices("abcde ", k=r.choice([0, 5, 250])))) for _ in range(80)]
    got = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, a string, b string").select("i", diff.block_similarity(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()
    want = [SequenceMatcher(None, a, b).ratio() for a, b in texts]
    assert [g.r for g in got] == pytest.approx(want)
    two = spark.createDataFrame([(i, *t) for i, t in enumerate([*texts, (None, "x")])], "i int, old string, new string")
    got = diff.similar_texts(two, ["i"], 0.6).orderBy("i").collect()
    assert got[-1].ratio is None and [g.ratio for g in got[:-1]] == pytest.approx([r if r >= 0.6 else 0.0 for r in want])


def test_segments_rebuild_their_texts(spark):
    r = random.Random(5)
    texts = [("one two three", "one 2 three"), ("a b", "a b c"), ("a b c", "a c"), ("same", "same"), ("", "x"), ("x", ""), ("", "")]
    texts += [(" ".join(r.choices(["ab", "c,", "д", "1"], k=r.randint(0, 8))), " ".join(r.choices(["ab", "c,", "д", "1"], k=r.randint(0, 8)))) for _ in range(80)]
    got = diff.inline_diff(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, old string, new string"), ["i"]).orderBy("i").collect()
    for (a, b), g in zip(texts, got):
        assert "".join(x.text for x in g.left) == a and "".join(x.text for x in g.right) == b
        for side in (g.left, g.right):
            assert all(x.type != y.type for x, y in zip(side, side[1:]) if x.text and y.text)
    assert [(x.text, x.type) for x in got[0].left] == [("one ", "same"), ("two", "del"), (" three", "same")]
    assert [(x.text, x.type) for x in got[1].left] == [("a b", "same"), ("", "add-mark")]
    assert [(x.text, x.type) for x in got[2].right][1] == ("", "del-mark")
    assert matching.inline_diff("a " * 9, "b " * 9, most=10) is None


def test_cells(spark):
    got = diff.cell_diff(spark.createDataFrame([(1, ["a b", "c"], ["a x", "c", "new"])], "i int, old_cells array<string>, new_cells array<string>"), ["i"]).first()
    assert len(got.left) == len(got.right) == 3
    assert [(x.text, x.type) for x in got.left[2]] == [("", "add-mark")] and [(x.text, x.type) for x in got.right[2]] == [("new", "add")]
    assert [(x.text, x.type) for x in got.left[1]] == [("c", "same")]


def shown(made):
    return [(r.pair_id, r.left.text if r.left else None, r.left.change if r.left else None, r.right.text if r.right else None, r.right.change if r.right else None) for r in made.orderBy("pair_id", "row_no").collect()]


def test_rows_of_a_change_a_removal_and_an_addition(spark):
    old = ["same", "the quick brown fox jumps", "to be removed entirely 99", "end"]
    new = ["same", "the quick brown dog jumps", "end", "zzz new text"]
    c = compare.compare_blocks(*tables(spark, [(old, new)]))
    assert shown(c.rows) == [
        (0, "same", None, "same", None),
        (0, "the quick brown fox jumps", "changed", "the quick brown dog jumps", "changed"),
        (0, "to be removed entirely 99", "removed", None, None),
        (0, "end", None, "end", None),
        (0, None, None, "zzz new text", "added"),
    ]
    row = c.rows.filter("row_no = 1").first()
    assert [(s.text, s.type) for s in row.left.segments] == [("the quick brown ", "same"), ("fox", "del"), (" jumps", "same")]
    assert c.counts.first().asDict() == {"pair_id": 0, "changed": 1, "removed": 1, "added": 1, "unchanged": 2}
    assert c.rows.filter("row_no = 2").first().placeholder == "removed"
    s = c.summary.first()
    assert (s.fragments_count, s.semantic, s.degraded) == (3, False, False)


def test_every_block_is_shown_once(spark):
    versions = random_versions(40, 7)
    pairs, blocks = tables(spark, versions)
    made = compare.compare_blocks(pairs, blocks).rows.orderBy("pair_id", "row_no").collect()
    for i, (old, new) in enumerate(versions):
        own = [r for r in made if r.pair_id == i]
        assert [r.row_no for r in own] == list(range(len(own)))
        assert [r.left.text for r in own if r.left] == old and [r.right.text for r in own if r.right] == new
        assert all(r.left.text == r.right.text for r in own if r.left and r.right and not r.left.change)


def test_rows_do_not_depend_on_partitions_or_order(spark):
    pairs, blocks = tables(spark, random_versions(15, 8))
    one = shown(compare.compare_blocks(pairs, blocks).rows)
    assert one == shown(compare.compare_blocks(pairs.repartition(3), blocks.orderBy(F.rand(1)).repartition(7)).rows)


def test_formatting_fragments_have_no_class(spark):
    versions = [(["- item one", "x"], ["item one", "x"])]
    plain = compare.compare_blocks(*tables(spark, versions, is_pdf=False))
    pdf = compare.compare_blocks(*tables(spark, versions, is_pdf=True))
    assert shown(plain.rows)[0][2] == "changed" and shown(pdf.rows)[0][2] is None
    assert pdf.summary.first().fragments_count == 1
    labelled = compare.compare_blocks(*tables(spark, versions), chat=lambda prompt: '{"label": "formatting"}')
    assert shown(labelled.rows)[0][2] is None and labelled.summary.first().semantic


def test_one_sided_rows_ignore_the_label(spark):
    pairs, blocks = tables(spark, [(["a"], ["a", "completely new"])])
    found = diff.find_diffs(pairs, blocks)
    labels = found.select("pair_id", "frag_no", F.lit("changed").alias("label"))
    assert shown(rows.build_rows(pairs, blocks, found, labels))[1] == (0, None, None, "completely new", "added")


def test_table_rows_differ_by_cells(spark):
    pairs, blocks = tables(spark, [(["| a one | b |", "|---|---|"], ["| a two | b |", "|---|---|"])])
    c = compare.compare_blocks(pairs, blocks)
    row = c.rows.filter("row_no = 0").first()
    assert row.left.cells == ["a one", "b"] and row.left.segments is None and len(row.left.cell_segments) == 2
    assert c.rows.filter("row_no = 1").first().left.sep
    g = rows.table_groups(c.rows).collect()
    assert [(x.first_row, x.last_row, x.n_rows, x.n_columns) for x in g] == [(0, 1, 1, 2)]


def test_image_subrows(spark):
    pairs = spark.createDataFrame([(0, 0, 1, True)], PAIRS)
    image = lambda x: {"sha1": x, "n_bytes": 1, "data_uri": x}
    data = [(0, 0, "t", [image("a"), image("b"), image("c")]), (1, 0, "t", [image("a"), image("x"), image("c"), image("d")]), (0, 1, "| r |", [image("a")]), (1, 1, "| r |", [])]
    blocks = spark.createDataFrame(data, f"doc_id bigint, pos int, text string, images array<{rows.IMAGE}>")
    got = compare.compare_blocks(pairs, blocks).rows.orderBy("row_no").collect()
    uri = lambda s: [i.data_uri for i in s.images] if s else None
    assert [(uri(r.left), uri(r.right), (r.left or r.right).images_changed) for r in got] == [([], [], False), (["a"], ["a"], False), (["b"], ["x"], True), (["c"], ["c"], False), (None, ["d"], False), (["a"], [], True)]
    assert got[4].right.change == "added" and got[2].left.change is None


def test_labels_of_models(spark):
    pairs, blocks = tables(spark, [(["aaa bbb ccc"], ["aaa bbb ddd"]), (["x"], [])])
    fragments = diff.refine_fragments(diff.find_diffs(pairs, blocks))

    def down(prompt):
        raise OSError

    assert {r.semantic for r in model.classify_fragments(fragments, down).collect()} == {False}
    assert {r.label for r in model.classify_fragments(fragments, lambda p: "?").collect()} == {"changed", "removed"}
    good = model.classify_fragments(fragments, lambda p: '{"label": "added"}').collect()
    assert {(r.label, r.semantic) for r in good} == {("added", True)}
    answers = spark.createDataFrame([(0, 0, 1, "?", None), (0, 0, 2, '{"label": "added"}', None), (1, 0, 1, None, "down"), (1, 0, 2, '{"label": "added"}', None)], "pair_id bigint, frag_no int, attempt int, content string, error string")
    got = model.labels_from_responses(fragments, answers).orderBy("pair_id").collect()
    assert [(r.label, r.semantic) for r in got] == [("added", True), ("removed", False)]


def test_arriving_pairs_are_compared_once(spark, tmp_path):
    from revdiff.streaming.arrivals import compare_arrivals

    pairs, blocks = tables(spark, random_versions(6, 9))
    pairs.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pairs.schema).parquet(f"{tmp_path}/in")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    for _ in range(2):  # nothing new arrives the second time
        compare_arrivals(stream, blocks, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, compare.compare_blocks(pairs, blocks).counts.collect()))
    assert before == 0 or len(spark.sparkContext._jsc.getPersistentRDDs()) <= before + 2
