from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from revdiff.functions import markup, text


def ask(spark, rows, **columns):
    frame = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, a string" + (", b string" if rows and isinstance(rows[0], tuple) else ""))
    return [r.asDict() for r in frame.select("i", *(c.alias(n) for n, c in columns.items())).orderBy("i").collect()]


def test_table_rows(spark):
    rows = ["| a | b |", "a", r"| a\|b | c |", "a | b", "|:---|---:|", "|||", "| | |", " | x", ""]
    got = ask(spark, rows, row=text.is_table_row(F.col("a")), cells=text.parse_table_row(F.col("a")), sep=text.is_table_separator(F.col("a")))
    assert [g["row"] for g in got] == [True, False, True, False, True, True, True, True, False]
    assert got[0]["cells"] == ["a", "b"] and got[2]["cells"] == ["a|b", "c"] and got[3]["cells"] == ["a", "b"]
    assert got[4]["sep"] and not got[5]["sep"] and not got[6]["sep"] and not got[1]["sep"]
    assert got[5]["cells"] == ["", ""]


def test_formatting(spark):
    same = [("a..", "a."), ("a…", "a."), ("a b", "a b"), ("- a", "a"), ("• a\n* b", "a\nb"), ("a , b", "a,b"), (" a ", "a"), ("-5", "5"), ("a!!", "a!")]
    other = [("a b", "ab"), ("a.", "a,"), ("ab", "a"), ("--a", "a")]
    got = ask(spark, same + other, same=text.is_formatting_only(F.col("a"), F.col("b")))
    assert [g["same"] for g in got] == [True] * len(same) + [False] * len(other)


def _key(x: str) -> str:
    """The rule in Python's own regular expressions."""
    x = re.sub(r"^[-*•]\s*", "", x.replace(" ", " "), flags=re.M).replace("…", ".")
    x = re.sub(r"""\s*([.,;:!?…«»"()\-—])\s*""", r"\1", x)
    return re.sub("[ \t]+", " ", re.sub(r"([.,;:!?])\1+", r"\1", x)).strip(" \t")


def test_formatting_key_equals_python(spark):
    random.seed(5)
    rows = ["".join(random.choices("ab .,;:!?…«»\"()-—*• \t\n \x1c", k=random.randint(0, 24))) for _ in range(1500)]
    got = ask(spark, rows, key=text.formatting_key(F.col("a")), lines=text.split_lines(F.col("a")))
    assert [g["key"] for g in got] == [_key(r) for r in rows]


def test_lines_equal_python(spark):
    random.seed(6)
    rows = ["".join(random.choices("ab\n\r\x0b\x0c\x1c\x1d\x1e\x85  ", k=random.randint(0, 12))) for _ in range(800)]
    got = ask(spark, rows, lines=text.split_lines(F.col("a")))
    assert [g["lines"] for g in got] == [r.splitlines() for r in rows]


def test_heading(spark):
    rows = ["CHAPTER ONE", "Chapter", "12", "", "A" * 121, " ÄÖÜ x "]
    assert [g["t"] for g in ask(spark, rows, t=text.heading_tag(F.col("a")))] == ["h2", "p", "p", "p", "p", "p"]


def test_labels(spark):
    rows = ['{"label": "changed"}', 'So {"label": "removed", "x": 1}.', '{"label": "deleted"}', "none", '{bad} {"label": "added"}', '{"label": ["added"]}', '{"x": 1}']
    assert [g["l"] for g in ask(spark, rows, l=text.extract_label(F.col("a")))] == ["changed", "removed", None, None, None, None, None]
    ops = ["replace", "delete", "insert"]
    got = ask(spark, ops, l=text.fallback_label(F.col("a")), left=text.side_change(text.fallback_label(F.col("a")), "left"), right=text.side_change(text.fallback_label(F.col("a")), "right"))
    assert [(g["l"], g["left"], g["right"]) for g in got] == [("changed", "changed", "changed"), ("removed", "removed", None), ("added", None, "added")]


def test_prompt_and_page_text(spark):
    none = F.array().cast("array<string>")
    got = ask(spark, ["x"], p=text.fragment_prompt(F.lit("delete"), F.array("a", F.lit("y")), none))[0]["p"]
    assert "x\ny" in got and got.endswith("(empty)") and "delete" in got
    assert ask(spark, ["```md\na\n```\nb"], t=text.page_text(F.col("a")))[0]["t"] == "a\nb"


def test_length_bound(spark):
    got = ask(spark, [("", ""), ("ab", "abcd"), ("", "a")], r=text.length_ratio_bound(F.col("a"), F.col("b")))
    assert [g["r"] for g in got] == [1.0, 4 / 6, 0.0]


def test_html(spark):
    rows = [("<a> & \"b\" 'c'", "p"), ("x", "h3"), ("x", "ul"), ("x", "ol"), ("| a | <b> |", "tr")]
    got = [g["h"] for g in ask(spark, rows, h=markup.block_html(F.col("a"), F.col("b")))]
    assert got == ["<p>&lt;a&gt; &amp; &quot;b&quot; &#x27;c&#x27;</p>", "<h3>x</h3>", "<ul><li>x</li></ul>", "<ol><li>x</li></ol>", "<td>a</td><td>&lt;b&gt;</td>"]
    back = [g["p"] for g in ask(spark, rows[:4], p=markup.plain(markup.block_html(F.col("a"), F.col("b"))))]
    assert back == [r[0] for r in rows[:4]]
    kept = ask(spark, [("<em>a</em>", "a"), ("<em>a</em>", "b<")], h=markup.html_or_plain(F.col("a"), F.col("b")))
    assert [g["h"] for g in kept] == ["<em>a</em>", "b&lt;"]


def test_formatting_only_is_that_of_the_keys(spark):
    pieces = ["a", "b", " ", "\t", "\u00a0", "\u2028", "\u2029", "\x85", "\u3000", "\x1c", "\n", "- ", "\u2022", "*", ".", "..", "\u2026", ",", "(", ")", "\u00ab", "\u2014", "!", '"', "\U0001f600"]
    r = random.Random(4)
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 6))) for _ in range(160)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    both = rows.toDF("a").crossJoin(rows.toDF("b")).withColumns({"got": text.is_formatting_only(F.col("a"), F.col("b")), "want": text.formatting_key(F.col("a")) == text.formatting_key(F.col("b"))})
    assert both.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0 and both.filter("want AND a <> b").count() > 100
