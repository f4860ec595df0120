"""Results, reads and answers that are written before they count."""

from __future__ import annotations

import io
import os
import threading
import time
import tracemalloc
import zipfile

import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from revdiff.kernels import docx
from revdiff.operators import model
from revdiff.plans import compare
from revdiff.sources import files, runs

ROWS, SUMMARY = "pair_id bigint, row_no int, text string", "pair_id bigint, run string"


def results(spark, run, ids, rows=3):
    return spark.createDataFrame([(p, k, f"{run} {p} {k}") for p in ids for k in range(rows)], ROWS), spark.createDataFrame([(p, run) for p in ids], SUMMARY)


def state(spark, path):
    rows, summary = files.read_result(spark, path, ROWS, SUMMARY)
    found = {r.pair_id: (r.run, []) for r in summary.collect()}
    assert summary.count() == len(found)
    for r in rows.orderBy("pair_id", "row_no").collect():
        found[r.pair_id][1].append(r.text)
    return found


def test_a_later_run_replaces_its_own_pairs(spark, tmp_path):
    path = str(tmp_path)
    assert state(spark, path) == {}
    files.write_result(*results(spark, "one", range(6)), path, "one")
    files.write_result(*results(spark, "two", [1, 4, 9], 2), path, "two")
    files.write_result(*results(spark, "three", [4], 0), path, "three")
    want = {p: ("one", [f"one {p} {k}" for k in range(3)]) for p in (0, 2, 3, 5)} | {p: ("two", [f"two {p} {k}" for k in range(2)]) for p in (1, 9)} | {4: ("three", [])}
    assert state(spark, path) == want
    files.compact_result(spark, path, ROWS, SUMMARY)
    assert state(spark, path) == want and len(runs.committed(spark, path)) == 1
    with pytest.raises(ValueError):
        files.write_result(*results(spark, "bad", [1]), path, "../bad")


def test_a_run_that_was_stopped_leaves_nothing_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path)
    files.write_result(*results(spark, "one", range(4)), path, "one")
    rows, summary = results(spark, "two", [2, 3])
    broken = rows.withColumn("text", F.when(F.col("row_no") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.write_result(broken, summary, path, "two")
    assert os.path.isdir(f"{path}/summary/stored_run=two") and {r for r, _ in state(spark, path).values()} == {"one"}
    files.write_result(rows, summary, path, "two")
    assert state(spark, path)[2] == ("two", [f"two 2 {k}" for k in range(3)])
    with pytest.raises(ValueError):
        files.write_result(rows, summary, path, "two")


def test_two_writers_get_two_places(spark, tmp_path):
    path, errors = str(tmp_path), []

    def write(name):
        try:
            files.write_result(*results(spark, name, [1]), path, name)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(runs.committed(spark, path)) == [f"w{i}" for i in range(4)] and len(state(spark, path)) == 1


def counting_reader(log):
    def read(content):
        with open(log, "ab") as f:  # one short line is written at once
            f.write(content + b"\n")
        if content.startswith(b"bad"):
            raise OSError("down")
        return "" if content == b"empty" else f"read {content.decode()}"

    return read


def test_a_reader_is_asked_once_for_each_content_over_two_runs(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "cache")
    table = lambda texts: spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "doc_id bigint, content binary").repartition(3)
    one = model.read_pages_at(table(["a", "b", "a", "bad 1", "empty"]), path, counting_reader(log), "m", "1")
    assert sorted((r.doc_id, r.markdown, r.unreadable) for r in one.collect()) == [(0, "read a", False), (1, "read b", False), (2, "read a", False), (3, "", True), (4, "", True)]
    one.count()
    spark.catalog.clearCache()  # as if executors had lost what they held
    one.collect()
    two = model.read_pages_at(table(["b", "c", "a", "c"]), path, counting_reader(log), "m", "1")
    assert sorted(r.markdown for r in two.collect()) == ["read a", "read b", "read c", "read c"]
    asked = open(log).read().split("\n")[:-1]
    assert sorted(asked) == sorted(["a", "b", "bad 1", "bad 1", "empty", "c"])
    model.compact_reads(spark, path)
    assert sorted(r.markdown for r in two.collect()) == ["read a", "read b", "read c", "read c"]
    again = model.read_pages_at(table(["a", "b", "c"]), path, None, "m", "1")
    assert {r.unreadable for r in again.collect()} == {False}
    other = model.read_pages_at(table(["a"]), path, None, "m", "2")
    assert {r.unreadable for r in other.collect()} == {True}


def fragments(spark, n):
    return spark.createDataFrame([(i, 0, "replace", [f"old {i}"], [f"new {i}"]) for i in range(n)], "pair_id bigint, frag_no int, opcode string, old_blocks array<string>, new_blocks array<string>").coalesce(1)


def test_one_task_waits_for_many_answers_at_once(spark):
    def slow_chat(prompt):
        time.sleep(0.1)
        return '{"label": "formatting"}'

    took = {}
    for at_once in (1, 16):
        began = time.time()
        got = model.classify_fragments(fragments(spark, 200 if at_once > 1 else 20), slow_chat, at_once=at_once).collect()
        took[at_once] = (time.time() - began) / len(got)
        assert [r.pair_id for r in got] == list(range(len(got))) and {r.label for r in got} == {"formatting"}
    assert took[16] < took[1] / 5  # of 20 s, with the start of the worker in both


def test_no_more_than_asked_for_are_open():
    open_, most, lock = [0], [0], threading.Lock()

    def ask(i):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.002)
        with lock:
            open_[0] -= 1
        return i * 2

    batches = (pd.DataFrame({"x": list(range(k, k + 7)) * 2}) for k in range(0, 70, 7))
    got = [a for pdf, answers in model._together(batches, lambda p: p["x"].tolist(), ask, 5) for a in zip(pdf["x"], answers)]
    assert all(b == 2 * a for a, b in got) and len(got) == 140 and most[0] == 5


def test_stored_answers_give_the_labels_of_the_direct_way(spark):
    def moody(prompt):
        kind = len(prompt) % 4
        if kind == 2:
            raise OSError("down")
        return ('{"label": "formatting"}', "?", "", 'Well: {"label": "added"}')[kind]

    rows = spark.createDataFrame([(i, 0, ("replace", "delete", "insert")[i % 3], ["x" * (i % 11)], []) for i in range(40)], fragments(spark, 1).schema)
    answers = model.ask_fragments(rows, moody)
    direct = {(r.pair_id, r.label, r.semantic) for r in model.classify_fragments(rows, moody).collect()}
    assert {(r.pair_id, r.label, r.semantic) for r in model.labels_from_responses(rows, compare.cut(answers)).collect()} == direct
    tried = {(r.pair_id, r.attempt): (r.content, r.error) for r in answers.collect()}
    assert {k[1] for k in tried} == {1, 2} and all(e == "OSError" for c, e in tried.values() if c is None)


def test_a_comparison_asks_its_model_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def chat(prompt):
        with open(log, "a") as f:
            f.write("asked\n")
        return '{"label": "changed"}'

    blocks = spark.createDataFrame([(1, 0, "same"), (1, 1, "one thing"), (2, 0, "same"), (2, 1, "quite another matter here")], "doc_id bigint, pos int, text string")
    done = compare.compare_blocks(spark.createDataFrame([(7, 1, 2, False)], "pair_id bigint, old_doc bigint, new_doc bigint, is_pdf boolean"), blocks, chat)
    done.rows.count(), done.summary.count()
    done.release()
    spark.catalog.clearCache()
    assert done.rows.count() and done.summary.first().semantic
    assert len(open(log).readlines()) == done.fragments.count()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def archive(body, media=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("word/document.xml", "w", force_zip64=True) as f:
            f.write(f"<w:document {W}><w:body>".encode())
            for part in body:
                f.write(part.encode())
            f.write(b"</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{n}" Target="media/{n}"/>' for n, _ in media) + "</Relationships>")
        for n, blob in media:
            z.writestr(f"word/media/{n}", blob)
    return out.getvalue()


def paragraph(text, image=None):
    return f"<w:p><w:r><w:t>{text}</w:t>" + (f'<w:drawing><a:blip r:embed="{image}"/></w:drawing>' if image else "") + "</w:r></w:p>"


def whole(content, limit=10**9):
    return tuple(sum(x, []) for x in zip(*docx.unpack(content, limit)))


def test_pieces_are_those_of_one_parse(monkeypatch):
    row = "<w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge{}/></w:tcPr><w:p><w:r><w:t>down</w:t></w:r></w:p></w:tc></w:tr>"
    table = "<w:tbl><w:tblPr/>" + row.format(" w:val='restart'") + row.format("") * 30 + "</w:tbl>"
    body = [paragraph("a", "i1"), "<w:sectPr/>", table, paragraph("b"), table, "<w:p/>", paragraph("c", "i2")] * 3
    content = archive(body, [("i1", b"12345"), ("i2", b"")])
    once = whole(content)
    monkeypatch.setattr(docx, "PARSED_ONCE", 0)
    monkeypatch.setattr(docx, "PIECE", 7)
    assert len(list(docx.unpack(content, 10**9))) > 20 and whole(content) == once
    runs_, cells, images = once
    assert {c[3] for c in cells if c[0] == 2 and c[2] == 2} == {docx.hash_id(2, 0, 2)} and len(images) == 6 and [r[0] for r in runs_][:3] == [0, 3, 6]
    with pytest.raises(Exception):  # noqa: B017
        next(docx.unpack(archive([*body, "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='x'/></w:tcPr></w:tc></w:tr></w:tbl>"]), 10**9))


@pytest.mark.parametrize(("limit", "kept"), [(100, [0, 1, 2, 4]), (12, [0, 1, 2, 4]), (11, [0, 1, 4]), (9, [0, 4]), (0, [4])])
def test_images_reach_as_far_as_the_budget(limit, kept):
    """After the first image that doesn't fit only empty ones come; a missing one (3) counts nothing."""
    media = [("i0", b"x" * 5), ("i1", b"x" * 5), ("i2", b"xx"), ("i4", b"")]
    got = whole(archive([paragraph("t", f"i{k}") for k in range(5)], media), limit)[2]
    assert [i[0] for i in got] == kept


def test_a_large_file_is_streamed():
    """About 60 MB of XML and an image of 40 MB beyond the budget: a fraction of that is held."""
    body = (paragraph(f"line {k} " + "words and more words " * 12) for k in range(180_000))
    content = archive([*body, paragraph("last", "big")], [("big", b"\0" * 40_000_000)])
    tracemalloc.start()
    n = sum(len(r) for r, _, images in docx.unpack(content, 1000) if not images)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 180_001 and peak < 30e6
