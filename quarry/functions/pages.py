"""Pages, sections and windows of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import bound, strip

#: The mark before each page's text.
MARK = "=== Page "
#: What a heading looks like, and how long it is at most.
HEADINGS = (
    r"^第[一二三四五六七八九十百千0-9]+[章节条款].*$",
    r"^附件[一二三四五六七八九十0-9]+.*$",
    r"(?iU)^(chapter|section|article|appendix)\b.*$",
    r"(?U)^\d+(?:\.\d+){0,3}\s+\S+.*$",
)
HEADING_LENGTH = 120
#: Line ends as Python's splitlines knows them.
_LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def split_pages(text: Column, marked: bool = True) -> Column:
    """The texts behind the page marks; text before the first one leaves an empty page. Without marks, one page or none."""
    blank = F.array().cast("array<string>")
    whole = F.when(strip(text) != "", F.array(text)).otherwise(blank)
    if not marked:
        return whole
    blocks = F.filter(F.split(text, MARK, -1), lambda b: strip(b) != "")
    behind = F.transform(blocks, lambda b: F.when(F.contains(b, F.lit("===")), strip(F.substring(b, F.instr(b, "===") + 3, F.length(b)))).otherwise(F.lit("")))
    return F.when(F.contains(text, F.lit(MARK)), behind).otherwise(whole)


def join_pages(pages: Column) -> Column:
    each = F.transform(pages, lambda p, i: F.concat(F.lit(MARK), (i + 1).cast("string"), F.lit(" ===\n\n"), strip(p)))
    return strip(F.array_join(each, "\n\n"))


def ensure_marks(text: Column) -> Column:
    """With a mark for page 1 if there is none; an empty text stays as it is."""
    return F.when((text != "") & ~F.contains(text, F.lit(MARK)), F.concat(F.lit(f"{MARK}1 ===\n\n"), text)).otherwise(text)


def is_heading(line: Column) -> Column:
    found = line.rlike(HEADINGS[0])
    for pattern in HEADINGS[1:]:
        found = found | line.rlike(pattern)
    return (line != "") & (F.length(line) <= HEADING_LENGTH) & found


def split_sections(text: Column) -> Column:
    """Sections of stripped lines; a heading opens a new one unless nothing came before.

    A heading's line number is where its section starts, so sections are slices of the lines: linear in their number.
    """
    return bound(F.transform(F.split(text, _LINE_END, -1), strip), _sections)


def _sections(lines: Column) -> Column:
    first = F.coalesce(F.nullif(F.array_position(F.transform(lines, lambda x: x != ""), True), F.lit(0)), F.lit(1)).cast("int")
    starts = F.filter(F.transform(lines, lambda x, i: F.when((i + 1 > first) & is_heading(x), i + 1)), lambda i: i.isNotNull())
    part = lambda edges: lambda k: F.slice(lines, F.element_at(edges, k), F.element_at(edges, k + 1) - F.element_at(edges, k))
    cut = bound(F.concat(F.array(first), starts, F.array(F.size(lines) + 1)), lambda edges: F.transform(F.sequence(F.lit(1), F.size(edges) - 1), part(edges)))
    return F.filter(F.transform(cut, lambda lines: strip(F.array_join(lines, "\n"))), lambda s: s != "")


def split_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters that start every size - overlap while the text lasts; size 0 or less: the whole text."""
    if size <= 0:
        return F.array(text)
    step = max(1, size - max(0, overlap))
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t), F.lit(step)), lambda i: F.substring(t, i, F.lit(size)))
    return bound(text, lambda t: F.when(F.length(t) > 0, cut(t)).otherwise(F.array().cast("array<string>")))
