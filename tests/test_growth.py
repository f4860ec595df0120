"""What is moved, held and done by the queries that grew too fast."""

from __future__ import annotations

import contextlib
import io
import random
from difflib import SequenceMatcher

import numpy as np

from revdiff import queries, workloads  # noqa: F401  workloads add their queries
from revdiff.kernels import longest, matching, page, raster
from revdiff.operators import layout, model, rows, summary
from revdiff.plans import compare
from revdiff.sources import runs


def plan_of(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def documents(spark, folder, texts):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_words_are_placed_without_moving_them(spark, tmp_path):
    texts = ["a  bé\n\n ccc d ", "", None, "\U0001f600 x " * 300]
    made = queries.word_layout(spark, documents(spark, tmp_path, texts))
    assert "Exchange" not in plan_of(made)
    want = set()
    for doc, text in enumerate(texts):
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            before = 0
            for i, word in enumerate(line.split(" ")):
                if word:
                    top = 14.0 * pos + 30.0 * (pos // 5)
                    want.add((doc, 1 + pos // 40, pos * 100000 + i, word, 6.0 * before, 6.0 * (before + len(word)), top, top + 12.0))
                before += len(word) + 1
    got = made.select("doc_id", "page", "word_no", "text", "x0", "x1", "top", "bottom").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pages_are_drawn_in_many_tasks_and_each_once(spark, tmp_path):
    texts = [f"line {k}\n" + "word " * 50 * k for k in range(12)] + [None, "", "\n" * 41, "x" * 3201]
    folder = documents(spark, tmp_path, texts)
    drawn = workloads.drawn_pages(spark, folder)
    assert drawn.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = sorted(map(tuple, workloads.drawn_page_numbers(spark, folder).collect()))
    assert numbers == sorted(map(tuple, drawn.select("doc_id", "page").collect()))
    changes = workloads.scanned_changes(spark, folder)
    plan = plan_of(changes).split("Initial Plan")[-1]
    assert plan.count("MapInPandas") == 5  # old and new pages are drawn and read, and met: nothing is made twice
    assert changes.count() == len(numbers)


def test_turned_is_rotated():
    rng = np.random.default_rng(1)
    for h, w, degrees in ((7, 5, 1.0), (300, 64, -2.0), (513, 700, 0.75), (1, 9, 2.0)):
        image = rng.integers(0, 256, (h, w), dtype=np.uint8)
        assert (raster.turned(image, degrees, 255) == raster.rotated(image, degrees, 255)).all()


def test_files_are_made_in_many_tasks_and_small_ones_given_out_together(spark, tmp_path):
    folder = documents(spark, tmp_path, [f"line {k}\nnext\n| a | b" for k in range(400)])
    made = workloads.docx_files(spark, folder)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= runs.BATCH_BYTES
    found = workloads.docx_contents(spark, folder)
    want = {(d, b, k, t, bold) for d in range(400) if d % 17 for b, k, t, bold in ((0, "run", f"line {d}", True), (1, "run", "next", False), (2, "cell", "| a | b", False), (2, "cell", "", False))}
    want |= {(d, None, "error", None, False) for d in range(0, 400, 17)}
    rows = [(r.doc_id, r.block_no, r.kind, r.text, r.bold) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_rows_get_their_blocks_by_one_move(spark, tmp_path):
    folder = documents(spark, tmp_path, ["a b c\nd e f\ng h", "one\ntwo\nthree"])
    plan = plan_of(queries.aligned_rows(spark, folder))
    assert plan.count("REPARTITION_BY_COL") == 1  # parts of lines meet by pair, where lines are numbered, too


def test_unlike_texts_are_settled_without_a_match(monkeypatch):
    rng = random.Random(3)
    two = [("".join(rng.choice("etaoinshr ") for _ in range(n)), "".join(rng.choice("dlucmfw,. ") for _ in range(n))) for n in (50, 150, 700)]
    known = [SequenceMatcher(None, a, b).ratio() for a, b in two]
    monkeypatch.setattr(matching, "SequenceMatcher", None)
    assert all(r < 0.6 for r in known) and [matching.similarity(a, b, 0.6) for a, b in two] == [0.0] * 3


def test_a_changed_end_of_a_long_line_is_found_at_once(monkeypatch):
    line = " ".join(f"w{k % 40} x{k}" for k in range(300)) + "."
    old, new = matching._TOKEN.findall(line), matching._TOKEN.findall(line + " more")
    head = matching._TOKEN.findall(line.replace(" ", ", ", 1))
    want = [SequenceMatcher(None, old, b, autojunk=False).get_opcodes() for b in (new, head)]
    monkeypatch.setattr(longest, "opcodes", None)
    assert [matching.opcodes(old, b) for b in (new, head)] == want


def test_matches_at_the_ends_are_those_of_difflib():
    rng = random.Random(5)
    for _ in range(1500):
        kinds = "abcdefghijklmnopqrst"[: rng.choice([1, 2, 3, 20])]
        a = [rng.choice(kinds) for _ in range(rng.choice([0, 1, 2, 5, 9, 40, 210]))]
        b = list(a)
        for _ in range(rng.choice([1, 1, 2, 4])):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = [rng.choice(kinds) for _ in range(rng.randrange(3))]
        x, y = "".join(a), "".join(b)
        want = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        assert matching.opcodes(a, b) == want and matching.opcodes(x, y) == want
        for junk in (True, False):
            for least in (0.0, 0.6, 0.95):
                r = SequenceMatcher(None, x, y, junk).ratio()
                assert matching.similarity(x, y, least, junk) == (r if r >= least else 0.0)


def test_versions_are_made_in_place(spark, tmp_path):
    assert "Exchange" not in plan_of(queries.versions(spark, documents(spark, tmp_path, ["a b c\nd e f\ng h", "one", None, ""]))[1])


def test_fragments_are_matched_and_refined_once(spark, tmp_path):
    plan = plan_of(queries.refined_fragments(spark, documents(spark, tmp_path, ["a b c\nd e f\ng h", "one\ntwo\nthree"]))).split("Initial Plan")[-1]
    assert plan.count("MapInPandas") == 1 and plan.count("MapInArrow") == 1


def test_a_comparison_stores_what_several_results_read(spark, tmp_path):
    done = compare.compare_blocks(*queries.versions(spark, documents(spark, tmp_path, ["a b c\nd e f\ng h", "one\ntwo\nthree"])))
    before = done.counts.collect(), done.summary.collect(), done.rows.count()
    assert "InMemoryTableScan" not in plan_of(done.summary) and done.fragments.inputFiles() and done.blocks.inputFiles()
    done.release()
    assert not done.kept and not any("/fragments-" in f for f in done.fragments.inputFiles())
    assert sorted(done.counts.collect()) == sorted(before[0]) and sorted(done.summary.collect()) == sorted(before[1]) and done.rows.count() == before[2]


def test_prompts_and_pages_go_to_a_model_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.createDataFrame([(1, 0, "delete", ["a"], [])], "pair_id bigint, frag_no int, opcode string, old_blocks array<string>, new_blocks array<string>")
    pages = spark.createDataFrame([(1, b"x")], "doc_id bigint, content binary")
    for ask in (lambda: model.classify_fragments(rows, str), lambda: model.ask_fragments(rows, str), lambda: model.read_pages(pages, bytes.decode)):
        spark.conf.set(key, str(64 << 20))
        ask()
        assert int(spark.conf.get(key).removesuffix("b")) <= runs.BATCH_BYTES


def test_lines_are_compared_in_place(spark, tmp_path):
    folder = documents(spark, tmp_path, ["a b c\nd e f\ng h", "one", None, ""])
    assert plan_of(queries.similar_lines(spark, folder)).count("Exchange") == 1  # what needs matching is dealt to all tasks
    assert {(r.doc_id, r.pos) for r in queries.similar_lines(spark, folder).collect()} == {(0, 0), (0, 1)}


def test_identical_documents_are_told_without_a_match(spark, tmp_path):
    folder = documents(spark, tmp_path, ["a b c\nd e f\ng h", "one", None, ""])
    spark.createDataFrame([(0, 1), (13, 0)], "vec_id bigint, label int").write.parquet(f"{folder}/embeddings.parquet")
    made = queries.identical_documents(spark, folder)
    assert "MapIn" not in plan_of(made) and "/blocks-" not in plan_of(made)
    assert {r.pair_id: r.identical for r in made.collect()} == {0: False, 1: None, 2: True, 3: None}


def test_identity_is_that_of_a_comparison(spark):
    """Against fragments and rows: texts, blanks, images with and without fingerprints, their order, table rows, documents without blocks, pages."""
    a, b, n = ("a", 1, "u"), ("b", 1, "u"), (None, 1, "u")
    docs = {
        0: [("x  y", [a]), ("z", None)], 1: [("x y ", [a]), ("", []), ("z", [])], 2: [("x y", [b]), ("z", [])], 3: [("x y", [a, b]), ("z", [])], 4: [("x y", [b, a]), ("z", [])], 5: [("x y", [n]), ("z", [])],
        6: [("x y", [n, n]), ("z", [])], 7: [("x y", []), ("z", [a])], 8: [("z", []), ("x y", [a])], 9: [("x y", [a])], 10: [(None, [])], 11: [("| c |", [a])], 12: [("| c |", [b])], 13: [("", [a]), ("z", [])],
        15: [("x y", [None]), ("z", [])], 16: [("x y", [a]), ("z", []), ("z", [])],
    }
    rows = [(d, 3 * k, t, own) for d, blocks in docs.items() for k, (t, own) in enumerate(blocks)]
    blocks = spark.createDataFrame(rows, "doc_id bigint, pos int, text string, images array<struct<sha1:string,n_bytes:bigint,data_uri:string>>")
    ids = [(100 * x + y, x, y, (x + y) % 5 != 4) for x in range(17) for y in range(17)]
    pairs = spark.createDataFrame(ids, "pair_id bigint, old_doc bigint, new_doc bigint, is_pdf boolean")
    alignment = spark.createDataFrame([(0, "changed"), (101, "identical")], "pair_id bigint, kind string")
    degraded = spark.createDataFrame([(202, "old", 1)], "pair_id bigint, side string, page int")
    for own in (blocks, blocks.drop("images")):
        made = compare.compare_blocks(pairs, own, degraded=degraded)
        want = {r.pair_id: r.identical for r in summary.documents_identical(pairs, made.summary, alignment, made.rows).collect()}
        got = {r.pair_id: r.identical for r in compare.identical_documents(pairs, own, alignment, degraded).collect()}
        assert got == want and len(got) == len(ids) and {None, True, False} == set(got.values())
        made.release()


def test_only_promising_pairs_of_a_fragment_are_matched(monkeypatch):
    r = random.Random(8)
    texts = ["".join(chr(200 + r.randrange(400)) for _ in range(230 + 9 * k)) for k in range(20)]
    edited = [t[:40] + "X" + t[40:] for t in texts]
    asked = []
    plain = matching.similarity
    monkeypatch.setattr(matching, "similarity", lambda *x: asked.append(x) or plain(*x))
    assert matching.split_replaced(texts, edited) == [("replace", k, k + 1, k, k + 1) for k in range(20)]
    assert len(asked) <= 40  # of 400


def test_similarity_from_rare_characters_is_that_of_difflib():
    r = random.Random(9)
    for _ in range(400):
        kinds = r.choice("ab abcdefgh abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOP".split())
        new = "".join(r.choice(kinds) for _ in range(r.randrange(190, 400)))
        old = list(new)
        for _ in range(r.randrange(0, 30)):
            at = r.randrange(len(old))
            old[at : at + r.randrange(0, 7)] = new[r.randrange(len(new)) :][: r.randrange(1, 9)]
        for a, b in (("".join(old), new), (new, new), (new[:150], new), (new + new[:50], new)):
            want = SequenceMatcher(None, a, b).ratio()
            for least in (0.0, 0.6, want):
                assert matching.similarity(a, b, least) == (want if want >= least else 0.0)


def test_blocks_are_placed_among_rows_without_a_table_of_lines(spark, tmp_path):
    folder = documents(spark, tmp_path, ["a b c\nd e f\ng h", "one\ntwo\nthree"])
    plan = plan_of(queries.aligned_rows(spark, folder)).split("Initial Plan")[-1]
    assert "sequence(0" not in plan  # no row is made for each line to look its blocks up
    assert "sub#" not in plan  # blocks without images have no sub-rows to be made and sorted


def test_pages_are_laid_out_in_their_rows(spark, tmp_path):
    folder = documents(spark, tmp_path, ["a b c\nd e f\ng h", "one\n\ntwo three", None, ""])
    assert plan_of(queries.layout_paragraphs(spark, folder)).split("Initial Plan")[-1].count("Exchange") == 1  # no word is moved
    spark.createDataFrame([(0, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    moved = [line for line in plan_of(queries.assembled_pages(spark, folder)).split("Initial Plan")[-1].splitlines() if "Exchange" in line]
    assert len(moved) == 2  # documents are dealt to all tasks, and rows go to their document once


def test_laid_out_pages_are_those_of_the_tables(spark):
    """A page in one row gives what the operators on tables of words and cells give."""
    r = random.Random(8)
    words, cells, chars, rows = [], [], [], []
    for doc in range(40):
        own = [page.Word(k, r.choice(["a", "bb", "•", "-", None]), float(r.randint(0, 200)), r.choice([0.0, 0.05, 4.35, 12.0, 14.25, 31.0, 60.0]) + r.randint(0, 2), 0.0, 0.0) for k in range(r.randint(0, 14))]
        own = [w._replace(x1=w.x0 + r.randint(1, 20), bottom=w.top + r.randint(4, 14)) for w in own]
        boxes = [page.Cell(r.randint(0, 1), k // 2, k % 2, float(r.randint(0, 150)), float(r.randint(0, 40)), 0.0, 0.0, r.choice(["t", " ", None, "u"])) for k in range(r.randint(0, 6))]
        boxes = [c._replace(x1=c.x0 + 40, y1=c.y0 + r.randint(1, 30)) if k != 3 else c._replace(x0=None, y0=None, x1=None, y1=None) for k, c in enumerate(boxes)]
        bullets = [page.Word(0, r.choice("•-x"), -40.0 + k + r.randint(0, 2) * 20, r.choice([0.0, 3.0, 13.5, 61.0]), 0.0, 9.0) for k in range(r.randint(0, 4))]
        bullets = [b._replace(x1=b.x0 + 5) for b in bullets]
        rows.append((doc, 1, own, boxes, bullets))
        words += [(doc, 1, *w) for w in own]
        cells += [(doc, 1, *c) for c in boxes]
        chars += [(doc, 1, *b[1:]) for b in bullets]
    box = "x0 double, top double, x1 double, bottom double"
    words_ = spark.createDataFrame(words, f"doc_id bigint, page int, word_no int, text string, {box}")
    cells_ = spark.createDataFrame(cells, "doc_id bigint, page int, table_no int, row_no int, col_no int, x0 double, y0 double, x1 double, y1 double, text string")
    chars_ = spark.createDataFrame(chars, f"doc_id bigint, page int, text string, {box}")
    lines = layout.restore_list_markers(layout.lines_from_words(layout.words_outside_cells(words_, cells_)), chars_)
    want = {tuple(x) for x in layout.paragraphs_from_lines(lines).collect()}
    tables = {(x.doc_id, x.page, x.table_no, x.row_no, x.top, x.text, tuple(x.cells)) for x in layout.table_rows_from_rects(cells_).collect()}
    given = {doc: (own, boxes, bullets) for doc, _, own, boxes, bullets in rows}
    pages_ = spark.createDataFrame([(doc, 1) for doc in given], "doc_id bigint, page int")
    place = lambda row: given[row.doc_id]
    assert {tuple(x) for x in layout.page_paragraphs(pages_, place).collect()} == want and len(want) > 40
    items = layout.page_items(pages_, place).filter("kind = 0").collect()
    assert {(x.doc_id, x.page, x.table_no, x.no, x.top, x.text, tuple(x.cells)) for x in items} == tables and len(tables) > 20


def test_texts_of_fragments_and_documents_are_not_moved_to_be_marked_or_paired(spark, tmp_path):
    ids, lines = queries.versions(spark, documents(spark, tmp_path, ["a b c\nd e f\ng h", "one\ntwo\nthree"]))
    done = compare.compare_blocks(ids, lines)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as said:
            rows._marked(done.pairs, done.fragments, done.labels).explain("formatted")
            rows._placed(done.pairs, rows._whole_blocks(done.blocks), rows._stretches(done.pairs, done.blocks, rows._marked(done.pairs, done.fragments, done.labels))).explain("formatted")
    finally:
        spark.conf.set(key, before)
    moved = [part.split("\n")[1] for part in said.getvalue().split("\n\n") if ") Exchange\n" in part]
    assert len(moved) > 4 and not [x for x in moved if "old_blocks" in x or "b#" in x or "text#" in x]
    # blocks that don't know their pairs find them by a join, with the same rows
    found = sorted(map(repr, done.rows.collect()))
    assert sorted(map(repr, rows.build_rows(done.pairs, done.blocks.drop("in_pairs"), done.fragments, done.labels).collect())) == found
