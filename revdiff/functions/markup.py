"""HTML of blocks (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_table_row, parse_table_row

# fixed values: characters that are escaped, in the order of replacement
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def escape(c: Column) -> Column:
    """The five markup characters as entities."""
    for char, entity in ENTITIES:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def plain(html: Column) -> Column:
    """Text of HTML made by this module: tags off, the five entities decoded."""
    c = F.regexp_replace(html, "<[^>]+>", "")
    for char, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def wrap(tag: Column, inner: Column) -> Column:
    """Inner HTML in the elements of a block's tag."""
    heading = tag.startswith("h")
    opened = F.concat(F.lit("<"), tag, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))
    item = lambda kind: F.concat(F.lit(f"<{kind}><li>"), inner, F.lit(f"</li></{kind}>"))
    return F.when(heading, opened).when(tag == "ul", item("ul")).when(tag == "ol", item("ol")).otherwise(F.concat(F.lit("<p>"), inner, F.lit("</p>")))


def cells_html(cells: Column) -> Column:
    """A ``td`` for each cell."""
    return F.array_join(F.transform(cells, lambda x: F.concat(F.lit("<td>"), escape(x), F.lit("</td>"))), "")


def block_html(text: Column, tag: Column, cells: Column | None = None) -> Column:
    """HTML of a block: cells for a table row (given ones first), else the escaped text in its tag."""
    own = parse_table_row(text) if cells is None else F.coalesce(cells, parse_table_row(text))
    return F.when(is_table_row(text), cells_html(own)).otherwise(wrap(tag, escape(text)))


def html_or_plain(inner: Column, text: Column) -> Column:
    """Inner HTML if its text equals ``text``, else the escaped text."""
    return F.when(plain(inner) == text, inner).otherwise(escape(text))
