"""Registered queries of whole workloads: files, models, related documents, documents of pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import blocks, diff, model, pages, pairs, summary
from .plans import compare
from .queries import _CELLS_OF_LINE, _PB, ALIGNMENT, LINES, _area, _boxes, _shown, _table, derived_alignment, line_blocks, mask_pairs, page_masks, pages_without_blocks, query
from .sources import files, runs

# ---------------------------------------------------------------- files

_NAME = "'up/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' ELSE '.txt' END"


@query()
def input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the given tables; no content is read."""
    found = files.read_files(spark, f"{sf_dir}/*.parquet")
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "ext")


@query(f"""WITH f AS (SELECT doc_id, lower(regexp_extract({_NAME}, '\\.[a-zA-Z]+$')) AS ext, strlen(text) + 4 AS length, CASE WHEN doc_id % 3 = 0 THEN '%PDF' WHEN doc_id % 3 = 1 THEN 'PK' || chr(3) || chr(4) ELSE 'none' END AS head FROM documents),
r AS (SELECT *, CASE WHEN ext NOT IN ('.docx', '.pdf') THEN 'extension' WHEN length > 1500 THEN 'size' WHEN NOT ((ext = '.pdf' AND head = '%PDF') OR (ext = '.docx' AND head = 'PK' || chr(3) || chr(4))) THEN 'signature' END AS reason FROM f)
SELECT doc_id, ext, length, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason FROM r""")
def validated_files(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, F.encode(F.lit("%PDF"), "utf-8")).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("504B0304"))).otherwise(F.encode(F.lit("none"), "utf-8"))
    content = F.concat(head, F.encode("text", "utf-8"))
    made = _table(spark, sf_dir, "documents").select("doc_id", files.extension(F.expr(_NAME)).alias("ext"), content.alias("content")).withColumn("length", F.octet_length("content").cast("bigint"))
    return files.validate_files(made, limit=1500).select("doc_id", "ext", "length", "status", "reason")


@query("""SELECT coalesce(lang, 'none') AS lang, '.txt' AS ext, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes, CAST(sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS BIGINT) AS n_lines
FROM documents GROUP BY 1""")
def files_of_languages(spark, sf_dir):
    """``documents`` written as text files, one folder a language, and read as files: bytes and lines of each language."""
    path = runs.own_folder(spark, "texts")
    texts = _table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    texts.write.mode("overwrite").partitionBy("lang").text(path, lineSep="\n")
    found = files.read_files(spark, f"{path}/lang=*/*.txt").withColumn("lang", F.regexp_extract("path", "/lang=([^/]*)/", 1))
    lines = F.size(F.split(F.decode("content", "utf-8"), "\n")) - 1
    return found.groupBy("lang", "ext").agg(F.sum("length").alias("n_bytes"), F.sum(lines).cast("bigint").alias("n_lines"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def _docx(lines: list[str]) -> bytes:
    """A word-processor file of one paragraph a line, every third one bold, every fifth with an image, and a table of two cells for lines with a pipe."""
    parts, images = [], {}
    for k, line in enumerate(lines):
        text = f'<w:t xml:space="preserve">{escape(line)}</w:t>'
        if k % 5 == 2 and "|" not in line:
            images[f"r{k}"] = line.encode()
            text += f'<w:drawing><a:blip r:embed="r{k}"/></w:drawing>'
        run = f"<w:r>{'<w:rPr><w:b/></w:rPr>' if k % 3 == 0 else ''}{text}</w:r>"
        parts.append(f"<w:tbl><w:tr><w:tc><w:p><w:r>{text}</w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>" if "|" in line else f"<w:p>{run}</w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{''.join(parts)}</w:body></w:document>")
        for name, blob in images.items():
            z.writestr(f"word/media/{name}.png", blob)
        z.writestr("word/_rels/document.xml.rels", f"<Relationships {_RELS}>" + "".join(f'<Relationship Id="{n}" Target="media/{n}.png"/>' for n in images) + "</Relationships>")
    return out.getvalue()


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as word-processor files; every seventeenth is cut off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_docx(t.split("\n")) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": [c[: len(c) // 2] if d % 17 == 0 else c for d, c in zip(pdf["doc_id"], made)]})

    runs.lean_batches(spark)
    return diff.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).mapInPandas(run, "doc_id bigint, content binary")


@query(f"""WITH {LINES} SELECT doc_id, pos AS block_no, 'run' AS kind, text, pos % 3 = 0 AS bold FROM lines WHERE doc_id % 17 <> 0 AND text NOT LIKE '%|%'
UNION ALL SELECT doc_id, pos, 'cell', x.t, false FROM lines, (VALUES (0), (1)) c(n), LATERAL (SELECT CASE WHEN n = 0 THEN text ELSE '' END AS t) x WHERE doc_id % 17 <> 0 AND text LIKE '%|%'
UNION ALL SELECT doc_id, NULL, 'error', NULL, false FROM documents WHERE doc_id % 17 = 0""")
def docx_contents(spark, sf_dir):
    found = files.read_docx(docx_files(spark, sf_dir))
    null = F.lit(None)
    runs = found["runs"].select("doc_id", "block_no", F.lit("run").alias("kind"), "text", "bold")
    cells = found["cells"].select("doc_id", "block_no", F.lit("cell").alias("kind"), "text", F.lit(False).alias("bold"))
    lost = found["errors"].select("doc_id", null.cast("int").alias("block_no"), F.lit("error").alias("kind"), null.cast("string").alias("text"), F.lit(False).alias("bold"))
    return runs.unionByName(cells).unionByName(lost)


@query(f"""WITH {LINES}, i AS (SELECT doc_id, pos, text, strlen(text) AS n FROM lines WHERE doc_id % 17 <> 0 AND pos % 5 = 2 AND text NOT LIKE '%|%'),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS used FROM i)
SELECT doc_id, pos AS block_no, 0 AS img_no, sha1(text) AS sha1, n AS n_bytes FROM s WHERE used <= 2000 OR n = 0""")
def docx_images(spark, sf_dir):
    """The images of word-processor files, as far as 2000 bytes a document reach."""
    return files.read_docx(docx_files(spark, sf_dir), max_images_bytes=2000)["images"].select("doc_id", "block_no", "img_no", "sha1", "n_bytes")


@query(f"""WITH {LINES} SELECT d.doc_id AS pair_id, CASE WHEN d.doc_id % 7 = 0 THEN 'second' ELSE 'first' END AS run, pos AS row_no, CASE WHEN d.doc_id % 7 = 0 THEN 'again ' || lines.text ELSE lines.text END AS text
FROM documents d LEFT JOIN lines ON lines.doc_id = d.doc_id AND d.doc_id % 14 <> 0""")
def stored_results(spark, sf_dir):
    """Results of all ``documents`` stored in one run, those of every seventh replaced by another: what is read then."""
    path = runs.own_folder(spark, "results")
    rows = line_blocks(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("pos").alias("row_no"), "text")
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"))
    files.write_result(rows, ids.withColumn("run", F.lit("first")), path, "first")
    again = rows.filter("pair_id % 7 = 0 AND pair_id % 14 <> 0").withColumn("text", F.concat(F.lit("again "), "text"))
    files.write_result(again, ids.filter("pair_id % 7 = 0").withColumn("run", F.lit("second")), path, "second")
    kept, summaries = files.read_result(spark, path, "pair_id bigint, row_no int, text string", "pair_id bigint, run string")
    return summaries.join(kept, "pair_id", "left").select("pair_id", "run", "row_no", "text")


@query(_CELLS_OF_LINE)
def enriched_cells(spark, sf_dir):
    given = F.when(F.col("pos") % 5 == 4, F.array(F.lit("own"), F.col("text")))
    made = blocks.enrich_table_cells(line_blocks(spark, sf_dir).withColumn("text", F.concat(F.lit("| "), "text")).withColumn("cells", given))
    return made.select("doc_id", "pos", "sep", F.array_join("cells", "~").alias("cells"))


# ---------------------------------------------------------------- models


def _chat(prompt: str) -> str:
    """A model whose answer follows from the length of the question."""
    kind = len(prompt) % 4
    if kind == 2:
        raise OSError("down")
    return ('{"label": "formatting"}', "?", "", 'Well: {"label": "added"}')[kind]


_OP = "CASE doc_id % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'delete' ELSE 'insert' END"


@query(f"""WITH p AS (SELECT doc_id, {_OP} AS op, length('Operation: ' || {_OP} || chr(10) || chr(10) || 'Old fragment:' || chr(10) || coalesce(nullif(text, ''), '(empty)') || chr(10) || chr(10) || 'New fragment:' || chr(10) || '(empty)') % 4 AS k FROM documents)
SELECT doc_id AS pair_id, 0 AS frag_no, CASE k WHEN 0 THEN 'formatting' WHEN 3 THEN 'added' ELSE CASE op WHEN 'replace' THEN 'changed' WHEN 'delete' THEN 'removed' ELSE 'added' END END AS label, k IN (0, 3) AS semantic FROM p""")
def classified_fragments(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    none = F.array().cast("array<string>")
    return model.classify_fragments(d.select(F.col("doc_id").alias("pair_id"), F.lit(0).alias("frag_no"), F.expr(_OP).alias("opcode"), F.array("text").alias("old_blocks"), none.alias("new_blocks")), _chat)


def _reader(content: bytes) -> str:
    """A reader that fails for one length in five and sees nothing for another."""
    if len(content) % 5 == 0:
        raise OSError("down")
    return "" if len(content) % 5 == 1 else f" {len(content)} bytes\n"


@query("SELECT doc_id, CASE WHEN strlen(text) % 5 IN (0, 1) THEN '' ELSE strlen(text) || ' bytes' END AS markdown, strlen(text) % 5 IN (0, 1) AS unreadable, strlen(text) % 5 IN (0, 1) AS degraded FROM documents")
def read_pages(spark, sf_dir):
    return model.read_pages(_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content")), _reader)


@query("SELECT doc_id, CASE WHEN strlen(text) % 5 IN (0, 1) THEN '' ELSE strlen(text) || ' bytes' END AS markdown, strlen(text) % 5 IN (0, 1) AS unreadable, strlen(text) % 5 IN (0, 1) AS degraded FROM documents")
def pages_read_with_a_stored_cache(spark, sf_dir):
    """``documents`` as pages: half of them read first, then all, from a cache that was compacted in between."""
    path = runs.own_folder(spark, "reads")
    content = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    model.read_pages_at(content.filter("doc_id % 2 = 0"), path, _reader, "m", "1")
    model.compact_reads(spark, path)
    return model.read_pages_at(content, path, _reader, "m", "1")


# ---------------------------------------------------------------- related documents

_RARE = f"""{LINES}, once AS (SELECT DISTINCT doc_id, text FROM lines WHERE length(text) > 20), cnt AS (SELECT text FROM lines WHERE length(text) > 20 GROUP BY text HAVING count(*) BETWEEN 2 AND 6),
rare AS (SELECT once.* FROM once JOIN cnt USING (text)), rel AS (SELECT a.doc_id AS old_doc, b.doc_id AS new_doc, count(*) AS shared FROM rare a JOIN rare b ON a.text = b.text AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query(f"WITH {_RARE} SELECT * FROM rel")
def related_documents(spark, sf_dir):
    """Documents that share at least three rare lines: longer than 20 characters, and met two to six times."""
    own = line_blocks(spark, sf_dir).filter(F.length("text") > 20).select("doc_id", F.xxhash64("text").alias("h"))
    # lines are counted first, so that no list is longer than six, however common a line is
    rare = own.groupBy("h").agg(F.count("*").alias("n")).filter("n BETWEEN 2 AND 6").select("h")
    rare = own.join(rare, "h").groupBy("h").agg(F.sort_array(F.collect_set("doc_id")).alias("docs"))
    two = rare.select(F.explode(F.flatten(F.transform("docs", lambda a: F.transform(F.filter("docs", lambda b: b > a), lambda b: F.struct(a.alias("old_doc"), b.alias("new_doc")))))).alias("p"))
    return two.groupBy("p.old_doc", "p.new_doc").agg(F.count("*").alias("shared")).filter("shared >= 3")


def related_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Related documents as pairs, and their lines: replaced regions of many blocks a side."""
    rel = related_documents(spark, sf_dir)
    ids = rel.select(F.xxhash64("old_doc", "new_doc").alias("pair_id"), "old_doc", "new_doc", F.lit(True).alias("is_pdf"))
    wanted = ids.select(F.explode(F.array("old_doc", "new_doc")).alias("doc_id")).distinct()
    return ids, line_blocks(spark, sf_dir).join(wanted, "doc_id", "left_semi")


@query()
def related_fragments(spark, sf_dir):
    ids, own = related_versions(spark, sf_dir)
    found = diff.refine_fragments(diff.find_diffs(ids, blocks.normalize_blocks(own)))
    return found.join(ids.select("pair_id", "old_doc", "new_doc"), "pair_id").select("old_doc", "new_doc", "frag_no", "opcode", "i1", "i2", "j1", "j2", F.array_join("old_blocks", "\n").alias("old_text"), F.array_join("new_blocks", "\n").alias("new_text"))


@query()
def related_changes(spark, sf_dir):
    return compare.compare_blocks(*related_versions(spark, sf_dir)).counts


# ---------------------------------------------------------------- documents of pages


@query(f"""WITH {ALIGNMENT}, {_PB}, rd AS (SELECT DISTINCT * FROM (SELECT pair_id, 'old' AS side, old_page AS page FROM al WHERE kind IN ('changed', 'only_old') UNION ALL SELECT pair_id, 'new', new_page FROM al WHERE kind IN ('changed', 'only_new'))),
ur AS (SELECT * FROM rd WHERE NOT EXISTS (SELECT 1 FROM pb WHERE pb.pair_id = rd.pair_id AND pb.side = rd.side AND pb.page = rd.page))
SELECT p.pair_id, coalesce(string_agg(page, ',' ORDER BY page) FILTER (side = 'old'), '') AS unreadable_left, coalesce(string_agg(page, ',' ORDER BY page) FILTER (side = 'new'), '') AS unreadable_right
FROM (SELECT DISTINCT vec_id // 10 AS pair_id FROM embeddings) p LEFT JOIN ur USING (pair_id) GROUP BY 1""")
def unreadable_by_side(spark, sf_dir):
    """The pages of each side that couldn't be read, as the summary of a pair shows them."""
    counts = _table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") / 10).cast("bigint").alias("doc_id")).agg(F.count("*").alias("n_pages"))
    ids = counts.select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("old_doc"), F.col("doc_id").alias("new_doc"))
    made = summary.page_summary(ids, derived_alignment(spark, sf_dir), pages_without_blocks(spark, sf_dir), counts)
    return made.select("pair_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("unreadable_left", "unreadable_right")))


@query(f"""WITH {LINES}, r AS (SELECT doc_id, CAST(doc_id % 4 AS INT) AS a, CAST(doc_id % 7 AS INT) AS b, coalesce(lang = 'en', false) AS t FROM documents),
pg AS (SELECT DISTINCT doc_id, 1 + pos // 3 AS page FROM lines), w AS (SELECT doc_id, unnest(range(a, b + 1)) AS page FROM r WHERE a >= 1 AND a <= b AND NOT t),
s AS (SELECT w.doc_id, w.page, CASE WHEN pg.page IS NULL THEN 'missing page' WHEN pg.page % 3 = 0 THEN 'unreadable page' END AS reason FROM w LEFT JOIN pg ON pg.doc_id = w.doc_id AND pg.page = w.page)
SELECT doc_id AS request_id, 'bad range' AS reason, '' AS pages FROM r WHERE NOT (a >= 1 AND a <= b)
UNION ALL SELECT doc_id, reason, string_agg(page, ',' ORDER BY page) FROM s WHERE reason IS NOT NULL GROUP BY 1, 2""")
def expansion_errors(spark, sf_dir):
    """What is wrong with requests for page ranges: the range itself, pages that aren't there, pages that couldn't be read."""
    d = _table(spark, sf_dir, "documents")
    asked = d.select(F.col("doc_id").alias("request_id"), "doc_id", (F.col("doc_id") % 4).cast("int").alias("first"), (F.col("doc_id") % 7).cast("int").alias("last"))
    own = line_blocks(spark, sf_dir).select("doc_id", (1 + F.floor(F.col("pos") / 3)).cast("int").alias("page"), "pos")
    reads = own.select("doc_id", "page").distinct().withColumn("unreadable", F.col("page") % 3 == 0)
    errors = pairs.expand_pages(asked, own, d.select("doc_id", (F.col("lang") == "en").alias("has_text")), reads)[1]
    return errors.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query()
def walked_pages(spark, sf_dir):
    """Alignment by the walk that large documents have."""
    return pages.align_pages(mask_pairs(spark, sf_dir), page_masks(spark, sf_dir), max_pairs=1)


@query(f"""WITH {ALIGNMENT}, {_PB}, p AS (SELECT DISTINCT vec_id // 10 AS pair_id FROM embeddings),
fr AS (SELECT vec_id // 10 AS pair_id, count(*) AS n, bool_and(label <> 2) AS sem FROM embeddings WHERE label < 5 GROUP BY 1),
rd AS (SELECT DISTINCT * FROM (SELECT pair_id, 'old' AS side, old_page AS page FROM al WHERE kind IN ('changed', 'only_old') UNION ALL SELECT pair_id, 'new', new_page FROM al WHERE kind IN ('changed', 'only_new'))),
ur AS (SELECT pair_id, side, page FROM rd WHERE NOT EXISTS (SELECT 1 FROM pb WHERE pb.pair_id = rd.pair_id AND pb.side = rd.side AND pb.page = rd.page)),
bad AS (SELECT DISTINCT * FROM (SELECT rd.* FROM rd JOIN embeddings e ON e.vec_id // 10 = rd.pair_id AND 1 + e.vec_id % 10 = rd.page WHERE e.label IN (4, 8) UNION ALL SELECT * FROM ur)),
bp AS (SELECT pair_id, string_agg(page, ',' ORDER BY page) AS pages FROM (SELECT DISTINCT pair_id, page FROM bad) GROUP BY 1)
SELECT p.pair_id, coalesce(n, 0) AS fragments_count, coalesce(sem, true) AND bp.pages IS NULL AS semantic, bp.pages IS NOT NULL AS degraded, coalesce(bp.pages, '') AS degraded_pages FROM p LEFT JOIN fr USING (pair_id) LEFT JOIN bp USING (pair_id)""")
def degraded_summaries(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").withColumn("pair_id", (F.col("vec_id") / 10).cast("bigint"))
    fragments = e.filter("label < 5").select("pair_id", (F.col("vec_id") % 10).alias("frag_no"), (F.col("label") != 2).alias("semantic"))
    reads = e.select("pair_id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("side"), (1 + F.col("vec_id") % 10).cast("int").alias("page"), (F.col("label") == 4).alias("unreadable"), (F.col("label") == 8).alias("degraded"))
    bad = summary.degraded_pages(pairs.pages_to_read(derived_alignment(spark, sf_dir)), reads, pages_without_blocks(spark, sf_dir))
    made = summary.pair_summary(e.select("pair_id").distinct(), fragments, fragments, bad)
    return made.withColumn("degraded_pages", F.array_join(F.col("degraded_pages").cast("array<string>"), ","))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of text for each page mask: ``doc_id, page, content``, the document of the vector's number; some have none."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") / 10).cast("bigint").alias("mask_doc"), (1 + F.col("vec_id") % 10).cast("int").alias("page"))
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("text", F.lit("")).alias("text"))
    return e.join(d, "vec_id").select(F.col("mask_doc").alias("doc_id"), "page", F.encode("text", "utf-8").alias("content"))


@query()
def text_page_comparison(spark, sf_dir):
    """Documents with a text layer, pages of the same ink left out: rows of each class."""
    lines = page_texts(spark, sf_dir).select("doc_id", "page", F.posexplode(F.split(F.decode("content", "utf-8"), "\n")).alias("line", "text"))
    own = lines.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line")) - 1).drop("line")
    return compare.compare_text_pages(mask_pairs(spark, sf_dir), own, page_masks(spark, sf_dir))[0].counts


def _as_written(content: bytes) -> str:
    return content.decode("utf-8")


@query()
def scan_comparison(spark, sf_dir):
    """Scans, of which only the pages that changed are read: rows of each class."""
    cache = spark.createDataFrame([], "key string, markdown string")
    return compare.compare_scans(mask_pairs(spark, sf_dir), page_texts(spark, sf_dir), page_masks(spark, sf_dir), cache, _as_written, "m", "1")[0].counts


#: Characters of a line, lines of a page, and pixels of a character's cell.
_COLUMNS, _ROWS, _CELL = 80, 40, (16, 8)


#: The characters that aren't drawn.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)])


def drawn_page(lines: list[str], slant: float, spared: int = 0) -> np.ndarray:
    """A grey page of 640 by 640 pixels: a dark box for each character that isn't a space, lines falling by ``slant`` degrees.

    With ``spared``, one character in so many is left out.
    """
    height, width = _ROWS * _CELL[0], _COLUMNS * _CELL[1]
    fall = np.tan(np.deg2rad(slant))
    codes = np.frombuffer("".join(line.ljust(_COLUMNS) for line in lines).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, _COLUMNS)
    j = np.arange(_COLUMNS)
    marks = (codes >= len(_BLANK)) | ~_BLANK[np.minimum(codes, len(_BLANK) - 1)]
    if spared:
        marks &= (31 * np.arange(len(marks))[:, None] + j) % spared != 0
    # ten rows of each line of characters are dark, each column of them moved up or down by its own distance
    dark = np.zeros((_ROWS, _CELL[0], _COLUMNS), bool)
    dark[: len(marks), 3:13] = marks[:, None]
    moved = np.rint((j * _CELL[1] - width / 2) * fall).astype(np.int64)
    most = int(np.abs(moved).max())
    edge = np.zeros((most, _COLUMNS), bool)
    dark = np.concatenate([edge, dark.reshape(height, _COLUMNS), edge])
    shown = dark[np.arange(height)[:, None] + most - moved, j]
    box = np.array([[255] * _CELL[1], [20] * 6 + [255] * (_CELL[1] - 6)], np.uint8).view(np.uint64)[:, 0]
    return box[shown.astype(np.int8)].view(np.uint8)


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` as pages of text, lines cut after 80 characters, 40 lines a page: ``doc_id, page, text``; dealt over all tasks, as drawing takes much longer than moving them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                lines = [line[k : k + _COLUMNS] for line in (text or "").split("\n") for k in range(0, max(len(line), 1), _COLUMNS)]
                made += [(doc, k // _ROWS + 1, "\n".join(lines[k : k + _ROWS])) for k in range(0, len(lines), _ROWS)]
            yield pd.DataFrame(made, columns=["doc_id", "page", "text"])

    return diff.spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).mapInPandas(run, "doc_id bigint, page int, text string")


def _drawing(spared: int = 0) -> pages.Decode:
    """Draws the rows of ``paged_documents``."""
    return lambda row: drawn_page(row.text.split("\n"), (row.doc_id % 5 - 2) * 0.75, spared)


def drawn_pages(spark: SparkSession, sf_dir: str, spared: int = 0) -> DataFrame:
    """``paged_documents`` as scans: ``doc_id, page, height, width, content``."""
    draw = _drawing(spared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 16):
                some = pdf[k : k + 16]
                made = [draw(row) for row in some.itertuples(index=False)]
                yield some[["doc_id", "page"]].assign(height=[p.shape[0] for p in made], width=[p.shape[1] for p in made], content=[p.tobytes() for p in made])

    return paged_documents(spark, sf_dir).mapInPandas(run, "doc_id bigint, page int, height int, width int, content binary")


def drawn_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, page`` of ``drawn_pages``, from the lengths of the lines alone."""
    n = F.aggregate(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0).cast("bigint"), lambda acc, x: acc + F.greatest(F.ceil(F.length(x) / _COLUMNS), F.lit(1)))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.ceil(n / _ROWS).cast("int"))).alias("page"))


@query()
def scanned_skews(spark, sf_dir):
    """The turn that sets each page of the scanned ``documents`` straight."""
    return pages.page_skews(paged_documents(spark, sf_dir), _drawing())


@query()
def scanned_changes(spark, sf_dir):
    """Where the scanned ``documents`` differ from copies with every 997th character missing."""
    old = pages.small_masks(paged_documents(spark, sf_dir), _drawing())
    new = pages.small_masks(paged_documents(spark, sf_dir), _drawing(997)).withColumn("doc_id", -F.col("doc_id") - 1)
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("old_doc"), (-F.col("doc_id") - 1).alias("new_doc"))
    same = drawn_page_numbers(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.lit("changed").alias("kind"), F.col("page").alias("old_page"), F.col("page").alias("new_page"))
    return pages.changed_regions(same, ids, old.unionByName(new)).withColumn("regions", _shown("regions"))


@query()
def pages_under_one_budget(spark, sf_dir):
    """Regions under one budget for each document pair."""
    chosen = pages.select_pair_regions(_boxes(spark, sf_dir), _area, 20_000)
    return chosen.withColumn("regions", _shown("regions"))
