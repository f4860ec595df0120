"""Whole results of the difference and page queries against plain versions, on the smallest tables."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from revdiff import queries, workloads
from revdiff.functions import text
from revdiff.kernels import raster
from revdiff.plans import compare

DATA = "/root/testdata/sf0.001"
TOKEN = re.compile(r"\w+|\W+")


def collapsed(text):
    return re.sub("[ \t]+", " ", text).strip(" \t")


def by_document(frame):
    out = {}
    for r in frame.select("doc_id", "pos", "text").collect():
        out.setdefault(r.doc_id, []).append((r.pos, r.text))
    made = {d: [collapsed(t) for _, t in sorted(own)] for d, own in out.items()}
    return {d: [t for t in own if t] for d, own in made.items()}


def plain_fragments(old, new):
    """Opcodes but for equal ones."""
    return [c for c in SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if c[0] != "equal"]


def plain_ratio(a, b, least):
    m = SequenceMatcher(None, a, b)
    return r if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (r := m.ratio()) >= least else 0.0


def plain_pairing(n, m, score):
    """Every ordered pairing, by recursion from the end: the best total, a pair before leaving out a row before leaving out a column."""
    known = {}

    def best(i, j):
        if not i or not j:
            return 0.0
        if (i, j) not in known:
            known[i, j] = max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + score(i - 1, j - 1))
        return known[i, j]

    out, i, j = [], n, m
    while i and j:
        s = score(i - 1, j - 1)
        if s > 0 and best(i, j) == best(i - 1, j - 1) + s:
            i, j = i - 1, j - 1
            out.insert(0, (i, j))
        elif best(i, j) == best(i - 1, j):
            i -= 1
        else:
            j -= 1
    return out


def plain_refined(old, new):
    out = []
    for op, i1, i2, j1, j2 in plain_fragments(old, new):
        if op != "replace" or (i2 - i1) * (j2 - j1) > 2500:
            out.append((op, i1, i2, j1, j2))
            continue
        known = {}

        def score(a, b, i1=i1, j1=j1, known=known):
            if (a, b) not in known:
                known[a, b] = plain_ratio(old[i1 + a], new[j1 + b], 0.6)
            return known[a, b]

        i, j = i1, j1
        for a, b in [*((i1 + a, j1 + b) for a, b in plain_pairing(i2 - i1, j2 - j1, score)), (i2, j2)]:
            out += [("delete", i, a, j, j)] * (a > i) + [("insert", a, a, j, b)] * (b > j) + [("replace", a, a + 1, b, b + 1)] * (a < i2 and b < j2)
            i, j = a + 1, b + 1
    return out


def plain_segments(a, b):
    x, y = TOKEN.findall(a), TOKEN.findall(b)
    sides = [[], []]
    for op, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        for k, part in ((0, "".join(x[i1:i2])), (1, "".join(y[j1:j2]))):
            kind = "same" if op == "equal" else ("del", "add")[k]
            if part and sides[k] and sides[k][-1][1] == kind:
                sides[k][-1] = (sides[k][-1][0] + part, kind)
            elif part:
                sides[k].append((part, kind))
        if op in ("delete", "insert"):
            sides[op == "delete"].append(("", "del-mark" if op == "delete" else "add-mark"))
    return sides


def shown(side):
    return [(s.text, s.type) for s in side]


@pytest.fixture(scope="module")
def versions(spark):
    ids, lines = queries.versions(spark, DATA)
    docs = by_document(lines)
    return {r.pair_id: (docs.get(r.old_doc, []), docs.get(r.new_doc, []), r.is_pdf) for r in ids.collect()}


@pytest.fixture(scope="module")
def refined(versions):
    return {p: plain_refined(old, new) for p, (old, new, _) in versions.items()}


def test_block_diffs(spark):
    ids, lines = queries.versions(spark, DATA)
    docs = {}
    for r in lines.collect():
        docs.setdefault(r.doc_id, []).append((r.pos, r.text))
    docs = {d: [t for _, t in sorted(own)] for d, own in docs.items()}
    got = {}
    for r in queries.QUERIES["block_diffs"](spark, DATA).collect():
        got.setdefault(r.pair_id, []).append((r.frag_no, r.opcode, r.i1, r.i2, r.j1, r.j2, r.old_blocks, r.new_blocks))
    for r in ids.collect():
        old, new = docs.get(r.old_doc, []), docs.get(r.new_doc, [])
        want = [(k, *c, old[c[1] : c[2]], new[c[3] : c[4]]) for k, c in enumerate(plain_fragments(old, new))]
        assert sorted(got.get(r.pair_id, [])) == want


def test_rows_counts_and_summaries(spark, versions, refined):
    made = compare.compare_blocks(*queries.versions(spark, DATA))
    key = {}
    texts = {t for old, new, _ in versions.values() for t in (*old, *new)}
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.formatting_key(F.col("t")).alias("k")).collect():
        key[r.t] = r.k
    rows, totals = {}, {}
    for p, (old, new, is_pdf) in versions.items():
        own, i, j, count = [], 0, 0, {"changed": 0, "removed": 0, "added": 0, None: 0}
        for op, i1, i2, j1, j2 in [*refined[p], ("end", len(old), len(old), len(new), len(new))]:
            own += [(old[a], None, new[b], None, None) for a, b in zip(range(i, i1), range(j, j1))]
            count[None] += i1 - i
            formatting = is_pdf and i2 - i1 == j2 - j1 and all(key[a] == key[b] for a, b in zip(old[i1:i2], new[j1:j2]))
            for k in range(max(i2 - i1, j2 - j1)):
                a, b = (old[i1 + k] if i1 + k < i2 else None), (new[j1 + k] if j1 + k < j2 else None)
                kind = None if formatting else "removed" if b is None else "added" if a is None else {"replace": "changed", "delete": "removed", "insert": "added"}[op]
                count[kind] += 1
                words = plain_segments(a, b) if kind == "changed" and not (a.lstrip().startswith("|") or b.lstrip().startswith("|")) else None
                own.append((a, kind if a is not None else None, b, kind if b is not None else None, words))
            i, j = i2, j2
        rows[p], totals[p] = own, count
    got = {}
    for r in made.rows.orderBy("pair_id", "row_no").collect():
        words = [shown(r.left.segments), shown(r.right.segments)] if r.left and r.right and r.left.segments is not None else None
        got.setdefault(r.pair_id, []).append((r.left and r.left.text, r.left and r.left.change, r.right and r.right.text, r.right and r.right.change, words))
    assert got == {p: own for p, own in rows.items() if own}
    counts = {r.pair_id: {"changed": r.changed, "removed": r.removed, "added": r.added, None: r.unchanged} for r in made.counts.collect()}
    assert counts == totals
    assert {r.pair_id: r.fragments_count for r in made.summary.collect()} == {p: len(f) for p, f in refined.items()}


def test_refined_fragments_of_related_documents(spark):
    ids, lines = workloads.related_versions(spark, DATA)
    docs = by_document(lines)
    got = {}
    for r in workloads.related_fragments(spark, DATA).collect():
        got.setdefault((r.old_doc, r.new_doc), []).append((r.frag_no, r.opcode, r.i1, r.i2, r.j1, r.j2, r.old_text, r.new_text))
    pairs = ids.collect()
    assert len(pairs) > 5
    for r in pairs:
        old, new = docs[r.old_doc], docs[r.new_doc]
        want = [(k, *c, "\n".join(old[c[1] : c[2]]), "\n".join(new[c[3] : c[4]])) for k, c in enumerate(plain_refined(old, new))]
        assert sorted(got.get((r.old_doc, r.new_doc), [])) == want


def test_similar_lines_and_segments(spark):
    lines = {}
    for r in queries.line_blocks(spark, DATA).collect():
        lines[r.doc_id, r.pos] = r.text
    got = {(r.doc_id, r.pos): r.ratio for r in queries.QUERIES["similar_lines"](spark, DATA).collect()}
    assert got == pytest.approx({(d, p): 1.0 if t == lines[d, p + 1] else plain_ratio(t, lines[d, p + 1], 0.6) for (d, p), t in lines.items() if (d, p + 1) in lines})
    edits = {r: t + " more" if r[1] % 3 == 0 else re.sub("^([^ ]*) ", r"\1, ", t) if r[1] % 3 == 1 else t for r, t in lines.items()}
    long = {r for r, t in lines.items() if t != edits[r] and len(TOKEN.findall(t)) * len(TOKEN.findall(edits[r])) > 2_000_000}
    found = {(r.doc_id, r.pos): None if r.left is None and r.right is None else [shown(r.left), shown(r.right)] for r in queries.QUERIES["word_segments"](spark, DATA).collect()}
    assert long and found == {r: None if r in long else plain_segments(t, edits[r]) for r, t in lines.items()}


def masks(spark):
    """Each mask document's pages, as sets of ink."""
    out = {}
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect():
        out.setdefault(r.vec_id // 10, {})[1 + r.vec_id % 10] = frozenset(k for k, v in enumerate(r.embedding) if v > 0)
    return out


def test_alignments(spark):
    docs = masks(spark)
    iou = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for name, walk in (("aligned_pages", False), ("walked_pages", True)):
        got = {}
        for r in queries.QUERIES[name](spark, DATA).collect():
            got.setdefault(r.pair_id, set()).add((r.kind, r.old_page, r.new_page, None if r.iou is None else round(r.iou, 12)))
        for p in docs:
            if p + 1 not in docs:
                continue
            old, new = sorted(docs[p]), sorted(docs[p + 1])
            score = lambda i, j, p=p, old=old, new=new: s if (s := iou(docs[p][old[i]], docs[p + 1][new[j]])) >= 0.35 else 0.0
            if walk:
                taken, j = [], 0
                for i in range(len(old)):
                    while j < len(new) and not score(i, j):
                        j += 1
                    if j < len(new):
                        taken.append((i, j))
                        j += 1
            else:
                taken = plain_pairing(len(old), len(new), score)
            want = {("identical" if score(i, j) >= 0.999 else "changed", old[i], new[j], round(score(i, j), 12)) for i, j in taken}
            want |= {("only_old", a, None, None) for i, a in enumerate(old) if i not in {i for i, _ in taken}}
            want |= {("only_new", None, b, None) for j, b in enumerate(new) if j not in {j for _, j in taken}}
            assert got[p] == want


def test_regions_of_changed_pages(spark):
    docs = masks(spark)
    got = queries.QUERIES["page_changes"](spark, DATA).collect()
    assert got
    for r in got:
        apart = docs[r.pair_id][r.old_page] ^ docs[r.pair_id + 1][r.new_page]
        grown = {k + d for k in apart for d in range(-2, 3) if 0 <= k + d < 64}
        closed = {k for k in grown if all(k + d in grown or not 0 <= k + d < 64 for d in range(-2, 3))}
        runs = []
        for k in sorted(closed):
            if runs and k - runs[-1][1] == 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        boxes = [(a, 0, b + 1, 1) for a, b in runs]
        groups = []
        for a, _, b, _ in sorted(boxes, key=lambda x: -(x[2] - x[0])):
            for g in groups:
                if g[0] <= b + 12 and a <= g[1] + 12:
                    g[0], g[1] = min(g[0], a), max(g[1], b)
                    break
            else:
                groups.append([a, b])
        assert [(x.x0, x.x1) for x in r.regions] == [tuple(g) for g in groups]


def test_real_pages_are_set_straight():
    """A page of 1000 by 800 pixels: the turn of its rows is found and taken back."""
    r = np.random.default_rng(2)
    grey = np.full((1000, 800), 255, np.uint8)
    for y in range(60, 940, 24):
        grey[y : y + 10, 60:740] = np.where(np.repeat(r.random(170) < 0.7, 4), 20, 255)
    for turn in (-1.5, 0.0, 0.75):
        assert raster.skew(raster.ink(raster.rotated(grey, turn, 255))) == pytest.approx(-turn, abs=0.26)


def test_budget_of_a_document_pair(spark):
    rows = {}
    for r in queries._boxes(spark, DATA).collect():
        rows.setdefault(r.pair_id, []).append((r.old_page, r.new_page, [(x.x0, x.y0, x.x1, x.y1) for x in r.regions]))
    got = {(r.pair_id, r.old_page, r.new_page): (r.regions, r.truncated) for r in workloads.pages_under_one_budget(spark, DATA).collect()}
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    for p, own in rows.items():
        used = 0
        for old, new, boxes in sorted(own):
            kept, lost = [], False
            for b in sorted(boxes, key=lambda b: -area(b)):
                if used + area(b) <= 20_000:
                    used += area(b)
                    kept.append(" ".join(map(str, b)))
                else:
                    lost = True
            assert got[p, old, new] == (",".join(kept), lost)
