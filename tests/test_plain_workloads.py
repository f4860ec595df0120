"""Whole comparisons, with tables, images, pages and reads, against one plain comparison, on the smallest tables."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F
from test_whole_queries import DATA, collapsed, masks, plain_fragments, plain_pairing, plain_refined, plain_segments

from revdiff import queries, workloads
from revdiff.functions import text
from revdiff.operators import blocks as block_ops

LABEL = {"replace": "changed", "delete": "removed", "insert": "added"}


def plain_cells(line):
    """(whether it separates, cells) of a table row, None for other lines."""
    if not line.lstrip().startswith("|"):
        return None
    parts = [p.replace("\\|", "|") for p in re.split(r"(?<!\\)\|", line)]
    parts = parts[1:] if parts and not parts[0].strip() else parts
    parts = parts[:-1] if parts and not parts[-1].strip() else parts
    cells = [p.strip() for p in parts]
    return bool(cells) and all(re.fullmatch(":?-{2,}:?", c) for c in cells), cells


def plain_cell_segments(old, new):
    return [list(x) for x in zip(*(plain_segments(a, b) for a, b in zip_longest(old, new, fillvalue="")))] or [[], []]


def prepared(own):
    """Blocks (text, images) with collapsed texts, without those that hold nothing."""
    made = [(collapsed(t), list(images)) for t, images in own]
    return [b for b in made if b[0] or b[1]]


def plain_rows(old, new, is_pdf, key):
    """(fragments, rows): each row (left, right), a side None or a dict of what it shows."""
    fragments = plain_refined([t for t, _ in old], [t for t, _ in new])
    rows = []

    def put(a, b, change, words):
        o, w = (None if x is None else plain_cells(x[0]) for x in (a, b))
        sides = [
            None if x is None else {"text": x[0], "change": c, "images": x[1], "images_changed": False, "sep": bool(t and t[0]), "cells": t[1] if t and not t[0] else None, "segments": None, "cell_segments": None}
            for x, c, t in ((a, change[0], o), (b, change[1], w))
        ]
        rows.append(sides)
        if a is None or b is None:
            return
        if words and sides[0]["cells"] is not None and sides[1]["cells"] is not None:
            sides[0]["cell_segments"], sides[1]["cell_segments"] = plain_cell_segments(o[1], w[1])
        elif words and not sides[0]["sep"] and not sides[1]["sep"]:
            sides[0]["segments"], sides[1]["segments"] = plain_segments(a[0], b[0])
        if a[1] == b[1]:
            return
        if o or w:
            for s in sides:
                s["images_changed"] = True
            return
        for s in sides:
            s["images"] = []

        def image(images, change, changed):
            return None if not images else {"text": "", "change": change, "images": images, "images_changed": changed, "sep": False, "cells": None, "segments": None, "cell_segments": None}

        for op, i1, i2, j1, j2 in SequenceMatcher(None, a[1], b[1], autojunk=False).get_opcodes():
            if op == "replace":
                for k in range(max(i2 - i1, j2 - j1)):
                    x, y = a[1][i1 + k : min(i1 + k + 1, i2)], b[1][j1 + k : min(j1 + k + 1, j2)]
                    rows.append([image(x, None if y else "removed", bool(x and y)), image(y, None if x else "added", bool(x and y))])
            else:
                x, y = a[1][i1:i2], b[1][j1:j2]
                rows.append([image(x, None if y else "removed", False), image(y, None if x else "added", False)])

    i = j = 0
    for op, i1, i2, j1, j2 in [*fragments, ("end", len(old), len(old), len(new), len(new))]:
        for a, b in zip(old[i:i1], new[j:j1]):
            put(a, b, (None, None), False)
        formatting = op != "end" and is_pdf and i2 - i1 == j2 - j1 and all(key[a[0]] == key[b[0]] for a, b in zip(old[i1:i2], new[j1:j2]))
        for k in range(max(i2 - i1, j2 - j1)):
            a, b = (old[i1 + k] if i1 + k < i2 else None), (new[j1 + k] if j1 + k < j2 else None)
            own = (LABEL[op] if op != "insert" else None, LABEL[op] if op != "delete" else None) if a and b else ("removed", "added")
            put(a, b, (None, None) if formatting else own, not formatting and LABEL.get(op) == "changed")
        i, j = i2, j2
    return fragments, rows


def keys_of(spark, documents):
    texts = {t for own in documents for t, _ in own}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.formatting_key(F.col("t")).alias("k"))
    return {r.t: r.k for r in found.collect()}


def blocks_of(frame):
    out = {}
    for r in frame.select("doc_id", "pos", "text", *(["images"] if "images" in frame.columns else [])).collect():
        out.setdefault(r.doc_id, []).append((r.pos, r.text, [x.sha1 for x in r.images] if "images" in frame.columns else []))
    return {d: prepared([x[1:] for x in sorted(own, key=lambda x: x[0])]) for d, own in out.items()}


def compared(spark, ids, frame):
    docs = blocks_of(frame)
    key = keys_of(spark, docs.values())
    return {r.pair_id: plain_rows(docs.get(r.old_doc, []), docs.get(r.new_doc, []), r.is_pdf, key) for r in ids.collect()}


def side_of(r):
    if r is None:
        return None
    words = lambda own: None if own is None else [(s.text, s.type) for s in own]
    return {
        "text": r.text, "change": r.change, "images": [x.sha1 for x in r.images or []], "images_changed": r.images_changed, "sep": r.sep, "cells": r.cells,
        "segments": words(r.segments), "cell_segments": None if r.cell_segments is None else [words(c) for c in r.cell_segments],
    }


def rows_of(frame):
    out = {}
    for r in frame.orderBy("pair_id", "row_no").collect():
        out.setdefault(r.pair_id, []).append([side_of(r.left), side_of(r.right)])
    return out


def classes(rows):
    count = dict.fromkeys(("changed", "removed", "added", None), 0)
    for left, right in rows:
        count[next((s["change"] for s in (left, right) if s and s["change"]), None)] += 1
    return count


def counted(frame):
    return {r.pair_id: {"changed": r.changed, "removed": r.removed, "added": r.added, None: r.unchanged} for r in frame.collect()}


@pytest.fixture(scope="module")
def illustrated(spark):
    return compared(spark, *queries._illustrated(spark, DATA))


def test_rows_with_images(spark, illustrated):
    got = rows_of(queries.QUERIES["image_rows"](spark, DATA))
    assert got == {p: rows for p, (_, rows) in illustrated.items() if rows}
    kinds = {(left is None, right is None, (left or right)["images_changed"]) for _, rows in illustrated.values() for left, right in rows if (left or right)["text"] == ""}
    assert len(kinds) >= 3


def test_identical_documents(spark, illustrated):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label").collect()
    differ = {r.vec_id // 10 for r in e if r.label % 4 == 0 or r.label in (1, 5)}
    want = {}
    for r in queries.versions(spark, DATA)[0].collect():
        fragments, rows = illustrated[r.pair_id]
        images = any((s and s["images_changed"]) or (other is None and s and s["images"]) for left, right in rows for s, other in ((left, right), (right, left)))
        want[r.pair_id] = not fragments and not images and r.pair_id not in differ if r.is_pdf else None
    assert {r.pair_id: r.identical for r in queries.QUERIES["identical_documents"](spark, DATA).collect()} == want


def test_identical_needs_every_condition(spark):
    """One pair for each thing that excludes it, and one with nothing."""
    from revdiff.operators import summary

    side = "struct<images:array<struct<sha1:string>>,images_changed:boolean>"
    plain = (([], False), ([], False))
    rows = {1: plain, 2: plain, 3: plain, 4: plain, 5: (([("a",)], True), ([("b",)], True)), 6: (None, ([("b",)], False)), 7: (([("b",)], False), None), 8: (([("a",)], False), ([("a",)], False)), 9: (None, ([], False)), 10: plain}
    ids = spark.createDataFrame([(p, p != 10) for p in rows], "pair_id bigint, is_pdf boolean")
    told = spark.createDataFrame([(p, int(p == 2), p == 3) for p in rows], "pair_id bigint, fragments_count bigint, degraded boolean")
    alignment = spark.createDataFrame([(4, "only_new"), (1, "identical")], "pair_id bigint, kind string")
    frame = spark.createDataFrame([(p, *x) for p, x in rows.items()], f"pair_id bigint, left {side}, right {side}")
    got = {r.pair_id: r.identical for r in summary.documents_identical(ids, told, alignment, frame).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True, 9: True, 10: None}
    changed = alignment.withColumn("kind", F.lit("changed"))
    assert {r.pair_id: r.identical for r in summary.documents_identical(ids, told, changed, frame).collect()}[1] is False


def plain_tables(rows):
    out, own = [], None
    for no, (left, right) in enumerate([*rows, ({"cells": None, "sep": False}, None)]):
        table = [s is None or s["cells"] is not None or s["sep"] for s in (left, right)]
        if all(table) and (left or right):
            own = [] if own is None else own
            own.append((no, left, right))
        elif own is not None:
            real = [x for x in own if not any(s and s["sep"] for s in x[1:])]
            wide = max(max(len(s["cells"] or []), len(s["cell_segments"] or [])) for x in own for s in x[1:] if s)
            empty = [next((x[2 - k]["change"] for x in own if x[2 - k] and x[2 - k]["change"]), None) if all(x[k + 1] is None for x in own) else None for k in (0, 1)]
            out.append((len(out), own[0][0], own[-1][0], len(real), wide, *empty))
            own = None
    return out


def tables_of(frame):
    out = {}
    for r in frame.orderBy("pair_id", "table_no").collect():
        out.setdefault(r.pair_id, []).append((r.table_no, r.first_row, r.last_row, r.n_rows, r.n_columns, r.left_empty, r.right_empty))
    return out


def test_tables(spark):
    ids, lines = queries.versions(spark, DATA)
    lines = lines.withColumn("text", F.when(F.col("text").contains(" | "), F.concat(F.lit("| "), "text", F.lit(" |"))).otherwise(F.col("text")))
    want = {p: t for p, (_, rows) in compared(spark, ids, lines).items() if (t := plain_tables(rows))}
    assert tables_of(queries.QUERIES["grouped_tables"](spark, DATA)) == want


def test_table_rows_with_images_and_tables_of_all_kinds(spark):
    """Rows of a table are marked where their images differ, and give no sub-rows; tables of one side, with separators, one after another."""
    from revdiff.operators import rows as row_ops
    from revdiff.plans import compare

    old = [("| a | b |", ["1"]), ("|---|:--:|", []), ("| c | d |", []), ("text", ["1", "2"]), ("| lone | row | of | four |", ["7"]), ("end", [])]
    new = [("| a | b |", ["2"]), ("|---|:--:|", []), ("| c | d | more |", ["9"]), ("text", ["2", "3", "4"]), ("end", []), ("| x |", []), ("| y | z |", ["5"])]
    documents = {0: old, 1: new, 2: [], 3: new, 4: old[::-1], 5: new[::-1]}
    image = "array<struct<sha1:string,n_bytes:bigint,data_uri:string>>"
    frame = spark.createDataFrame([(d, k, t, [(s, 1, "") for s in images]) for d, own in documents.items() for k, (t, images) in enumerate(own)], f"doc_id bigint, pos int, text string, images {image}")
    ids = spark.createDataFrame([(p, p * 2, p * 2 + 1, True) for p in range(3)], "pair_id bigint, old_doc bigint, new_doc bigint, is_pdf boolean")
    want = compared(spark, ids, frame)
    made = compare.compare_blocks(ids, frame)
    assert rows_of(made.rows) == {p: rows for p, (_, rows) in want.items()}
    assert tables_of(row_ops.table_groups(made.rows)) == {p: t for p, (_, rows) in want.items() if (t := plain_tables(rows))}
    assert counted(made.counts) == {p: classes(rows) for p, (_, rows) in want.items()}
    assert any(s and s["images_changed"] and s["cells"] for _, rows in want.values() for row in rows for s in row)


def test_cells(spark):
    lines = {(r.doc_id, r.pos): r.text for r in queries.line_blocks(spark, DATA).collect()}
    edits = {k: t + " more" if k[1] % 3 == 0 else re.sub("^([^ ]*) ", r"\1, ", t) if k[1] % 3 == 1 else t for k, t in lines.items()}
    split = lambda t: plain_cells("|" + t)[1] if t.strip() else []  # noqa: E731  the same cells: the first part is blank then
    want = {k: plain_cell_segments(split(t), split(edits[k])) for k, t in lines.items() if "|" in t}
    words = lambda side: [[(s.text, s.type) for s in c] for c in side]
    got = {(r.doc_id, r.pos): [words(r.left), words(r.right)] for r in queries.QUERIES["cell_segments"](spark, DATA).collect()}
    assert got == want and got


def test_results_as_json(spark):
    ids, lines = queries.versions(spark, DATA)
    want = compared(spark, ids, lines)
    for r in queries.QUERIES["result_documents"](spark, DATA).collect():
        made = json.loads(r.result)
        fragments, rows = want[r.pair_id]
        assert made["fragments_count"] == len(fragments) and made["semantic"] is (not fragments) and made["degraded"] is False
        shown = [[None if s is None else (s["text"], s.get("change")) for s in (x.get("left"), x.get("right"))] for x in made.get("rows") or []]
        assert shown == [[None if s is None else (s["text"], s["change"]) for s in row] for row in rows]


def test_changes_of_related_documents(spark):
    want = compared(spark, *workloads.related_versions(spark, DATA))
    assert counted(workloads.related_changes(spark, DATA)) == {p: classes(rows) for p, (_, rows) in want.items()} and want


def test_refined_fragments(spark):
    ids, lines = queries.versions(spark, DATA)
    docs = {}
    for r in lines.collect():
        docs.setdefault(r.doc_id, []).append((r.pos, r.text))
    docs = {d: [t for _, t in sorted(own)] for d, own in docs.items()}
    got = {}
    for r in queries.QUERIES["refined_fragments"](spark, DATA).collect():
        got.setdefault(r.pair_id, []).append((r.frag_no, r.opcode, r.i1, r.i2, r.j1, r.j2))
    for r in ids.collect():
        old, new = docs.get(r.old_doc, []), docs.get(r.new_doc, [])
        assert sorted(got.get(r.pair_id, [])) == [(k, *c) for k, c in enumerate(plain_refined(old, new))]
    assert sum(map(len, got.values())) > len(plain_fragments([], ["x"]))


@pytest.fixture(scope="module")
def paged(spark):
    """Of each pair of mask documents: its two documents, and the pages of each that are identical."""
    docs = masks(spark)
    out = {}
    for p in docs:
        if p + 1 in docs:
            old, new = sorted(docs[p]), sorted(docs[p + 1])
            iou = lambda i, j, p=p, old=old, new=new: len(a & b) / len(a | b) if (a := docs[p][old[i]]) | (b := docs[p + 1][new[j]]) else 1.0
            taken = plain_pairing(len(old), len(new), lambda i, j: s if (s := iou(i, j)) >= 0.35 else 0.0)  # noqa: B023
            same = [(old[i], new[j]) for i, j in taken if iou(i, j) >= 0.999]
            out[p] = (p, p + 1, {a for a, _ in same}, {b for _, b in same})
    return out


def contents(spark):
    return {(r.doc_id, r.page): bytes(r.content).decode() for r in workloads.page_texts(spark, DATA).collect()}


def test_documents_with_a_text_layer(spark, paged):
    pages = contents(spark)
    documents = {(p, k): prepared([(line, []) for (d, page), t in sorted(pages.items()) if d == own[k] and page not in own[2 + k] for line in t.split("\n")]) for p, own in paged.items() for k in (0, 1)}
    key = keys_of(spark, documents.values())
    want = {p: classes(plain_rows(documents[p, 0], documents[p, 1], True, key)[1]) for p in paged}
    assert counted(workloads.text_page_comparison(spark, DATA)) == want and sum(c["changed"] for c in want.values())


def test_scans(spark, paged):
    pages = contents(spark)
    reads = spark.createDataFrame([(d, page, t.strip(), not t.strip()) for (d, page), t in pages.items()], "doc_id bigint, page int, markdown string, unreadable boolean")
    blocks = {}
    for r in block_ops.blocks_from_page_reads(reads).orderBy("doc_id", "pos").collect():
        blocks.setdefault((r.doc_id, r.page), []).append((r.text, []))
    documents = {(p, k): prepared([b for (d, page), b_ in sorted(blocks.items()) if d == own[k] and page not in own[2 + k] for b in b_]) for p, own in paged.items() for k in (0, 1)}
    key = keys_of(spark, documents.values())
    want = {p: classes(plain_rows(documents[p, 0], documents[p, 1], True, key)[1]) for p in paged}
    assert counted(workloads.scan_comparison(spark, DATA)) == want and sum(c["changed"] for c in want.values())
