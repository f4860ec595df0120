from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from revdiff.operators import blocks, layout, model, pairs, rows, summary
from revdiff.sources import files


def test_normalize(spark):
    data = [(1, 0, "a  \t b "), (1, 1, " \t"), (1, 2, "  \n\t "), (1, 3, "x\ny"), (2, 5, None)]
    got = blocks.normalize_blocks(spark.createDataFrame(data, "doc_id bigint, pos int, text string")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.text) for r in got] == [(1, 0, "a b"), (1, 1, "\n"), (1, 2, "x\ny")]
    picture = spark.createDataFrame([(1, 0, "", [("s",)])], "doc_id bigint, pos int, text string, images array<struct<sha1:string>>")
    assert blocks.normalize_blocks(picture).count() == 1


def test_markdown(spark):
    md = "# Title\ntext one\ntext two\n\n- item\n3. third\n| a | b |\n|---|---|\n####### no\n   ###### six\n    # deep"
    got = blocks.markdown_blocks(spark.createDataFrame([(1, 1, md), (1, 2, ""), (1, 3, None)], "doc_id bigint, page int, markdown string")).orderBy("page", "pos").collect()
    assert [(r.text, r.tag) for r in got] == [("Title", "h1"), ("text one text two", "p"), ("item", "ul"), ("third", "ol"), ("| a | b |", "tr"), ("|---|---|", "tr"), ("####### no", "p"), ("six", "h6"), ("# deep", "p")]


def test_runs(spark):
    data = [(1, 0, 0, " a ", True, False, False, "Heading 9"), (1, 0, 1, " b<", False, True, True, "Heading 9"), (1, 1, 0, "x", None, None, None, "List Bullet 2"), (1, 2, 0, " ", True, False, False, None), (1, 3, 0, "y ", True, False, False, None)]
    got = blocks.paragraphs_from_runs(spark.createDataFrame(data, "doc_id bigint, block_no int, run_no int, text string, bold boolean, italic boolean, underline boolean, style string")).orderBy("block_no").collect()
    assert [(r.text, r.tag, r.html) for r in got] == [
        ("a b<", "h6", "<h6><strong>a </strong><u><em>b&lt;</em></u></h6>"), ("x", "ul", "<ul><li>x</li></ul>"), ("", "p", "<p></p>"), ("y", "p", "<p><strong>y</strong></p>"),
    ]


def test_merged_cells(spark):
    grid = [[1, 1, 2], [1, 1, 3], [4, 5, 3]]
    data = [(1, 0, r, c, t, f"t{t} |\nx") for r, row in enumerate(grid) for c, t in enumerate(row)]
    got = blocks.table_rows_from_cells(spark.createDataFrame(data, "doc_id bigint, block_no int, row_no int, col_no int, tc_id bigint, text string")).orderBy("row_no").collect()
    assert [r.text for r in got] == ["| t1 \\| x |  | t2 \\| x |", "|  |  | t3 \\| x |", "| t4 \\| x | t5 \\| x |  |"]
    assert got[0].html == "<td>t1 | x</td><td></td><td>t2 | x</td>"


def test_image_budget_and_layer(spark):
    data = [(1, 0, 0, 5), (1, 1, 0, 7), (1, 2, 0, 1), (1, 3, 0, 0), (2, 0, 0, 10)]
    got = blocks.apply_image_budget(spark.createDataFrame(data, "doc_id bigint, pos int, img_no int, n_bytes bigint"), 10).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos) for r in got] == [(1, 0), (1, 3), (2, 0)]
    layer = blocks.has_text_layer(spark.createDataFrame([(1, 1, " "), (1, 2, "x"), (2, 1, None)], "doc_id bigint, page int, text string"))
    assert {r.doc_id: r.has_text for r in layer.collect()} == {1: True, 2: False}


WORD = "doc_id bigint, page int, word_no int, text string, x0 double, top double, x1 double, bottom double"


def words(spark, items):
    return spark.createDataFrame([(1, 1, i, t, float(x), float(y), float(x + 10), float(y + 10)) for i, (t, x, y) in enumerate(items)], WORD)


def test_paragraphs_of_words(spark):
    w = words(spark, [("two", 20, 0), ("one", 5, 0), ("next", 5, 14), ("far", 5, 60)])
    lines = layout.lines_from_words(w)
    got = layout.paragraphs_from_lines(lines).orderBy("par_no").collect()
    assert [(r.text, r.top) for r in got] == [("one two\nnext", 0.0), ("far", 60.0)]
    marks = spark.createDataFrame([(1, 1, "•", -20.0, 1.0, -10.0, 9.0), (1, 1, "-", 4.0, 61.0, 6.0, 69.0)], "doc_id bigint, page int, text string, x0 double, top double, x1 double, bottom double")
    got = layout.paragraphs_from_lines(layout.restore_list_markers(lines, marks)).orderBy("par_no").collect()
    assert [r.text for r in got] == ["• one two\nnext", "far"]
    sizes = spark.createDataFrame([(1, 1, 100.0)], "doc_id bigint, page int, width double")
    boxes = {r.par_no: [b.x0 for b in r.words] for r in layout.paragraph_word_boxes(layout.paragraphs_from_lines(lines), w, sizes).collect()}
    assert boxes == {0: [20.0, 5.0, 5.0], 1: [5.0]}


def test_page_assembly(spark):
    w = words(spark, [("in", 12, 12), ("out", 100, 40)])
    cells = spark.createDataFrame([(1, 1, 0, 0, 0, 10.0, 10.0, 40.0, 30.0, "in"), (1, 1, 0, 0, 1, None, None, None, None, None), (1, 1, 0, 1, 0, 10.0, 31.0, 40.0, 35.0, " ")], "doc_id bigint, page int, table_no int, row_no int, col_no int, x0 double, y0 double, x1 double, y1 double, text string")
    outside = layout.words_outside_cells(w, cells)
    assert [r.text for r in outside.collect()] == ["out"]
    table = layout.table_rows_from_rects(cells)
    assert [(r.text, r.cells, r.top) for r in table.collect()] == [("| in |  |", ["in", ""], 10.0)]
    images = spark.createDataFrame([(1, 1, ["i1"]), (1, 2, ["i2"])], "doc_id bigint, page int, images array<string>")
    got = layout.assemble_page_blocks(layout.paragraphs_from_lines(layout.lines_from_words(outside)), table, images).orderBy("pos").collect()
    assert [(r.page, r.text, r.tag, r.images) for r in got] == [(1, "| in |  |", "tr", ["i1"]), (1, "out", "p", None), (2, "", "p", ["i2"])]
    assert got[0].html == "<td>in</td><td></td>"


AL = "pair_id bigint, kind string, old_page int, new_page int"


def test_page_logic(spark):
    al = spark.createDataFrame([(1, "identical", 1, 1), (1, "changed", 2, 3), (1, "only_old", 3, None), (1, "only_new", None, 2), (1, "identical", 4, 4)], AL)
    wanted = pairs.pages_to_read(al)
    assert {(r.side, r.page) for r in wanted.collect()} == {("old", 2), ("old", 3), ("new", 3), ("new", 2)}
    own = spark.createDataFrame([(1, "old", 1, "a"), (1, "old", 2, "b"), (1, "new", 3, "c"), (1, "new", None, "d")], "pair_id bigint, side string, page int, text string")
    assert {r.text for r in pairs.drop_unchanged_pages(own, al).collect()} == {"b", "c", "d"}
    lost = pairs.unreadable_pages(wanted, own)
    assert {(r.side, r.page) for r in lost.collect()} == {("old", 3), ("new", 2)}
    marks = rows.page_markers(al, lost)
    assert {(r.page, r.last, r.unreadable) for r in marks.collect()} == {(1, 1, False), (4, 4, False), (2, 2, True), (3, 3, True)}
    side = F.struct(F.col("page"))
    made = spark.createDataFrame([(1, 0, 2), (1, 1, None), (1, 2, 3)], "pair_id bigint, row_no int, page int").select("pair_id", "row_no", side.alias("left"), side.alias("right"))
    two = spark.createDataFrame([(1, 1, 1, False), (1, 4, 4, False)], "pair_id bigint, page int, last int, unreadable boolean")
    assert [(r.row_no, r.page) for r in rows.rows_with_markers(made, two).orderBy("place").collect()] == [(None, 1), (0, None), (1, None), (2, None), (None, 4)]
    assert [(r.row_no, r.page) for r in rows.rows_with_markers(made.limit(0), two).orderBy("place").collect()] == [(None, 1), (None, 4)]


def test_collapsed_range_of_a_whole_document(spark):
    al = spark.createDataFrame([(1, "identical", i, i) for i in (1, 2, 3)], AL)
    none = spark.createDataFrame([], "pair_id bigint, side string, page int")
    assert [(r.page, r.last, r.first_old, r.last_old) for r in rows.page_markers(al, none).collect()] == [(1, 3, 1, 3)]
    ids = spark.createDataFrame([(1, 10, 11, True)], "pair_id bigint, old_doc bigint, new_doc bigint, is_pdf boolean")
    counts = spark.createDataFrame([(10, 3), (11, 3)], "doc_id bigint, n_pages int")
    s = summary.page_summary(ids, al, none, counts).first()
    assert len(s.unchanged) == 3 and s.page_count_left == 3 and s.unreadable_left == []


def test_identity(spark):
    ids = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, True)], "pair_id bigint, is_pdf boolean")
    state = spark.createDataFrame([(1, 0, False), (2, 1, False), (3, 0, False), (4, 0, True), (5, 0, False)], "pair_id bigint, fragments_count bigint, degraded boolean")
    al = spark.createDataFrame([(1, "identical", 1, 1), (5, "only_old", 1, None)], AL)
    row = "pair_id bigint, left struct<images:array<string>,images_changed:boolean>, right struct<images:array<string>,images_changed:boolean>"
    none = spark.createDataFrame([(1, ([], False), ([], False))], row)
    got = {r.pair_id: r.identical for r in summary.documents_identical(ids, state, al, none).collect()}
    assert got == {1: True, 2: False, 3: None, 4: False, 5: False}
    images = spark.createDataFrame([(1, None, (["i"], False))], row)
    assert {r.pair_id: r.identical for r in summary.documents_identical(ids, state, al, images).collect()}[1] is False


def test_pairs(spark):
    docs = spark.createDataFrame([(1, ".PDF"), (2, ".pdf"), (3, ".docx")], "doc_id bigint, ext string")
    asked = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 9)], "pair_id bigint, old_doc bigint, new_doc bigint")
    got = pairs.make_pairs(asked, docs)
    assert {r.pair_id: (r.status, r.reason) for r in got.collect()} == {1: ("ok", None), 2: ("rejected", "different formats"), 3: ("rejected", "unknown document")}
    layers = spark.createDataFrame([(1, True), (2, False)], "doc_id bigint, has_text boolean")
    assert pairs.pair_branch(got.filter("status = 'ok'"), layers).first().branch == "read"


def test_reading_with_a_cache(spark):
    pages = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"b"), (4, b"c"), (5, b"d")], "page int, content binary")
    calls = spark.sparkContext.accumulator(0)

    def reader(content):
        calls.add(1)
        if content == b"c":
            raise OSError
        return "" if content == b"d" else f"# {content.decode()}"

    cache = spark.createDataFrame([(pages.filter("page = 3").select(F.sha1("content")).first()[0] + ":m:1", "from cache")], "key string, markdown string")
    out, fresh = model.read_pages_cached(pages, cache, reader, "m", "1")
    assert {r.page: (r.markdown, r.unreadable) for r in out.collect()} == {1: ("# a", False), 2: ("# a", False), 3: ("from cache", False), 4: ("", True), 5: ("", True)}
    assert calls.value == 1 + 2 + 1
    assert [r.markdown for r in fresh.collect()] == ["# a"]
    assert model.read_pages(pages).filter("unreadable").count() == 5


def docx(body: str, images: dict[str, bytes] | None = None) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:a="{a}" xmlns:r="{r}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
        links = "".join(f'<Relationship Id="{k}" Target="media/{k}.png"/>' for k in images or {})
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, v in (images or {}).items():
            z.writestr(f"word/media/{k}.png", v)
    return out.getvalue()


def test_files(spark, tmp_path):
    body = (
        '<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Bold </w:t></w:r><w:r><w:rPr><w:i w:val="0"/></w:rPr><w:t>text</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>"
        "<w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        '<w:p><w:r><a:blip r:embed="i1"/><a:blip r:embed="gone"/></w:r></w:p>'
    )
    (tmp_path / "Ä.DOCX").write_bytes(docx(body, {"i1": b"123"}))
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04 no archive")
    (tmp_path / "fake.pdf").write_bytes(b"hello")
    (tmp_path / "x.txt").write_bytes(b"hello")
    found = files.validate_files(files.read_files(spark, str(tmp_path)), limit=100_000)
    assert sorted((r.ext, r.status, r.reason) for r in found.collect()) == [(".docx", "ok", None), (".docx", "ok", None), (".pdf", "rejected", "signature"), (".txt", "rejected", "extension")]
    assert {r.reason for r in files.validate_files(found, limit=1).filter("ext <> '.txt'").collect()} == {"size"}
    parts = files.read_docx(found.filter("status = 'ok'"))
    assert parts["errors"].count() == 1
    p = blocks.paragraphs_from_runs(parts["runs"]).orderBy("block_no").collect()
    assert (p[0].text, p[0].html) == ("Bold text", "<h2><strong>Bold </strong>text</h2>")
    t = blocks.table_rows_from_cells(parts["cells"]).orderBy("row_no").collect()
    assert [r.text for r in t] == ["| wide |  |", "| a\\|b | c |"]
    assert [(r.n_bytes, r.block_no) for r in parts["images"].collect()] == [(3, 2)]


def test_expanding_pages(spark):
    own = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id bigint, page int, text string")
    asked = spark.createDataFrame([(1, 1, 2, 2), (2, 1, 0, 1), (3, 2, 1, 2), (4, 2, 1, 1)], "request_id bigint, doc_id bigint, first int, last int")
    layers = spark.createDataFrame([(1, True), (2, False)], "doc_id bigint, has_text boolean")
    reads = spark.createDataFrame([(2, 1, False)], "doc_id bigint, page int, unreadable boolean")
    out, errors = pairs.expand_pages(asked, own, layers, reads)
    assert {(r.request_id, r.text) for r in out.collect()} == {(1, "b"), (4, "c")}
    assert {(r.request_id, r.reason, tuple(r.pages)) for r in errors.collect()} == {(2, "bad range", ()), (3, "missing page", (2,))}
