"""Text, table-row and formatting functions (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.strip`` and ``\s`` have it: Java's Unicode class lacks U+001C to U+001F.
SPACE = r"[\s\x{1c}-\x{1f}]"
#: Where ``str.splitlines`` splits.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# fixed values: punctuation around which spaces don't matter, and punctuation whose repetition doesn't
SPACED_PUNCTUATION = r"""[.,;:!?…«»"()\-—]"""
REPEATED_PUNCTUATION = r"[.,;:!?]"

# fixed values: labels, and the label that an opcode stands for without a model
LABELS = ("changed", "removed", "added", "formatting")
FALLBACK_LABELS = {"replace": "changed", "delete": "removed", "insert": "added"}


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def collapse_blanks(c: Column) -> Column:
    """Runs of spaces and tabs as one space, none at the ends; line breaks stay."""
    one = F.when(c.contains("\t") | c.contains("  "), F.regexp_replace(c, "[ \t]+", " ")).otherwise(c)  # most texts need no rewriting
    return F.btrim(one, F.lit(" \t"))


def split_lines(c: Column) -> Column:
    """Lines of a text as ``str.splitlines`` gives them: no empty last line."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_table_row(c: Column) -> Column:
    """Whether the text begins with a pipe, after white space."""
    return c.rlike(rf"(?U)\A{SPACE}*\|")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def parse_table_row(c: Column) -> Column:
    r"""Cells of ``| a | b |``: split at pipes not written as ``\|``, stripped; a blank first or last part is dropped."""

    def inner(parts: Column) -> Column:
        first = F.when(strip(F.element_at(parts, 1)) == "", 1).otherwise(0)
        return F.slice(parts, first + 1, F.size(parts) - first)

    def cells(rest: Column) -> Column:
        last = F.when((F.size(rest) > 0) & (strip(F.try_element_at(rest, F.lit(-1))) == ""), 1).otherwise(0)
        return F.transform(F.slice(rest, F.lit(1), F.size(rest) - last), lambda x: strip(F.replace(x, F.lit("\\|"), F.lit("|"))))

    return _let(_let(F.split(c, r"(?<!\\)\|", -1), inner), cells)


def is_table_separator(c: Column) -> Column:
    """A table row whose cells are all dashes with optional colons."""
    dashes = lambda cells: (F.size(cells) > 0) & F.forall(cells, lambda x: x.rlike(r"\A:?-{2,}:?\z"))
    return is_table_row(c) & _let(parse_table_row(c), dashes)


def formatting_key(c: Column) -> Column:
    """What is left of a text without the differences that are mere formatting.

    In this order: no-break spaces are spaces; a list marker at a line's start goes,
    with the white space after it; an ellipsis is a full stop; no white space around
    punctuation; repeated punctuation is one; blanks are collapsed.
    """
    c = F.replace(c, F.lit("\u00a0"), F.lit(" "))
    c = F.regexp_replace(c, rf"(?Umd)^[-*•]{SPACE}*", "")
    c = F.replace(c, F.lit("…"), F.lit("."))
    c = F.regexp_replace(c, rf"(?U){SPACE}*({SPACED_PUNCTUATION}){SPACE}*", "$1")
    c = F.regexp_replace(c, rf"({REPEATED_PUNCTUATION})\1+", "$1")
    return F.btrim(F.regexp_replace(c, "[ \t]+", " "), F.lit(" \t"))


#: All that ``formatting_key`` takes away, puts in or replaces: white space, list markers and its punctuation; but for line breaks that would end a line of Spark's event log.
_FORMATTING = "".join(map(chr, (*range(9, 14), *range(28, 33), 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))) + ".,;:!?…«»\"()-—*•"
_OTHER_BREAK = r"[\x{85}\x{2028}\x{2029}]"


def is_formatting_only(old: Column, new: Column) -> Column:
    """Whether two texts differ in formatting at most; keys are made only of those that have all other characters in common."""
    rest = lambda c: F.translate(c, _FORMATTING, "")
    may = (rest(old) == rest(new)) | old.rlike(_OTHER_BREAK) | new.rlike(_OTHER_BREAK)
    return may & (formatting_key(old) == formatting_key(new))


def heading_tag(c: Column) -> Column:
    """``h2`` for a short text (1 to 120 characters) whose letters are upper case by four fifths, else ``p``."""
    text = strip(c)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(text, r"(?U)[^\p{IsUppercase}]|[^\p{L}]", ""))
    fits = (F.length(text) > 0) & (F.length(text) <= 120) & (letters > 0)
    return F.when(fits & (upper * 5 >= letters * 4), "h2").otherwise("p")


def length_ratio_bound(old: Column, new: Column) -> Column:
    """The most that the similarity of two texts can be, by their lengths; 1 for two empty ones."""
    total = F.length(old) + F.length(new)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(old), F.length(new)) / F.greatest(total, F.lit(1)))


def extract_label(c: Column) -> Column:
    """The label in the first braces without nested braces; null unless that is JSON with a known label."""
    found = F.regexp_extract(c, r"(?s)\{[^{}]*\}", 0)
    label = F.from_json(found, "label string", {"mode": "PERMISSIVE"})["label"]
    quoted = F.get_json_object(found, "$.label")
    return F.when((label == quoted) & label.isin(*LABELS), label)


def fallback_label(opcode: Column) -> Column:
    """The label that stands for an opcode where no model answers."""
    out = F.lit(None).cast("string")
    for name, label in FALLBACK_LABELS.items():
        out = F.when(opcode == name, label).otherwise(out)
    return out


def fragment_prompt(opcode: Column, old_blocks: Column, new_blocks: Column, empty: str = "(empty)") -> Column:
    """The question about a fragment: operation, old text and new text."""
    text = lambda blocks: F.coalesce(F.nullif(F.array_join(blocks, "\n"), F.lit("")), F.lit(empty))
    return F.concat(F.lit("Operation: "), opcode, F.lit("\n\nOld fragment:\n"), text(old_blocks), F.lit("\n\nNew fragment:\n"), text(new_blocks))


def side_change(label: Column, side: str) -> Column:
    """The class of a side (``left`` or ``right``) of a row with this label."""
    own = "removed" if side == "left" else "added"
    return F.when(label == "changed", "changed").when(label == own, own)


def page_text(markdown: Column) -> Column:
    """Text of a page's markdown without the lines that are code fences."""
    lines = F.filter(split_lines(markdown), lambda x: ~strip(x).rlike(r"\A```[A-Za-z]*\z"))
    return strip(F.array_join(lines, "\n"))


def page_cache_key(content: Column, model: Column | str, version: Column | str) -> Column:
    """``sha1:model:version``."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws(":", F.sha1(content), as_column(model), as_column(version))
