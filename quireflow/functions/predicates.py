"""Predicates over lines, headings, pages and entries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import caption_key, heading_key, strip

# Headings that are known without looking at their letters.
KNOWN_HEADINGS = [
    "abstract", "acknowledgments", "introduction", "background", "methods", "methodology", "results", "discussion",
    "conclusion", "conclusions", "references", "bibliography", "appendix", "preface", "table of contents",
]
# Headings of front matter.
FRONT_MATTER = [
    "acknowledgments", "acknowledgements", "about this edition", "contributors", "copyright", "foreword", "front matter", "preface", "title page",
]
# Patterns of running headers, captions and page queries.
RUNNING = "^(?:\\d+\\s+[A-Z][A-Z0-9\\s,&/\\-]+|[A-Z][A-Z0-9\\s,&/\\-]+\\s+\\d+)$"
ROMAN = "^[ivxlcdm]{1,8}$"
NUMBERED_CAPTION = "(?i)^\\s*Table\\s+(?:\\d+(?:[.-]\\d+)*[A-Za-z]?|[IVXLCDM]+)(?:[.:])?(?:\\s+.*)?$"
NAMED_CAPTION = "(?i)^\\s*(?:[A-Za-z][A-Za-z'-]*\\s+){1,10}Table\\s+(?:for|of)\\s+\\d[\\d,]*\\s+(?:to|through|[–—-])\\s+\\d[\\d,]*\\s*$"
PRIME_CAPTION = "(?i)^\\s*Prime Numbers\\s+from\\s+\\d[\\d,]*\\s+to\\s+\\d[\\d,]*\\s*$"
LEADING_CAPTION = "(?i)^\\s*((?:(?:[A-Za-z][A-Za-z'-]*\\s+){1,10}Table\\s+(?:for|of)|Prime Numbers\\s+from)\\s+\\d[\\d,]*\\s+(?:to|through|[–—-])\\s+\\d[\\d,]*)(?=\\s|$)"
FIGURE_CAPTION = "(?i)^Fig(?:ure)?\\.?\\s*\\d+[A-Za-z]?(?:[.:\\-–—]|\\s)"
SECTION_LINE = "^([A-Z][A-Z0-9\\s,&/\\-]+?)\\s+(\\d{1,4}|[IVXLCDMivxlcdm]+)$"
CONTENTS_NOTE = "each section includes a detailed table of contents or index"
PAGE_QUERY = "(?i)\\b(?:pages?|p)\\.?\\s*#?\\s*(\\d+)\\b"


def _count(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, ""))


def letters(c: Column) -> Column:
    return _count(c, "[^\\p{L}]")


def alnums(c: Column) -> Column:
    return _count(c, "[^\\p{L}\\p{N}]")


def is_running_header(line: Column) -> Column:
    t = strip(line)
    return (F.length(t) <= 100) & (letters(t) >= 4) & (letters(t) >= 0.5 * alnums(t)) & t.rlike(RUNNING)


def is_display_math(line: Column) -> Column:
    return line.rlike("-{5,}|[=×÷≤≥]")


def is_known_heading(line: Column) -> Column:
    return heading_key(line).isin(KNOWN_HEADINGS)


def is_heading(line: Column) -> Column:
    """Known heading, or mostly capitals with a word of three letters; no sentence end, no formula, at most 80 characters."""
    t = strip(line)
    plain = _count(t, "[^A-Za-z]")
    shouting = (plain > 0) & t.rlike("[A-Za-z]{3}") & (letters(t) >= 0.5 * alnums(t)) & (_count(t, "[^A-Z]") > 0.7 * plain)
    return (t != "") & (F.length(t) <= 80) & ~t.rlike("[.;,]$") & ~is_display_math(t) & (is_known_heading(t) | shouting)


def equation_hint(text: Column) -> Column:
    lines = F.split(text, "\n")
    bars = F.exists(lines, lambda x: x.rlike("-{5,}"))
    equations = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("=")) & x.rlike("[A-Za-z0-9]")))
    return F.when(bars | (equations >= 2), F.lit("equation")).otherwise(F.lit(""))


def is_table_caption(line: Column) -> Column:
    return line.rlike(NUMBERED_CAPTION) | line.rlike(NAMED_CAPTION) | line.rlike(PRIME_CAPTION)


def leading_caption(text: Column) -> Column:
    """A named range caption at the start of flattened text, or null."""
    got = F.regexp_extract(text, LEADING_CAPTION, 1)
    return F.when(got != "", strip(got))


def is_figure_caption(line: Column) -> Column:
    return strip(line).rlike(FIGURE_CAPTION)


def nonblank(lines: Column) -> Column:
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def is_contents_page(lines: Column) -> Column:
    return F.exists(F.slice(nonblank(lines), 1, 5), lambda x: heading_key(x) == "table of contents")


def is_catalog_page(text: Column, lines: Column) -> Column:
    return F.contains(heading_key(text), F.lit(CONTENTS_NOTE)) & F.exists(lines, lambda x: strip(x).rlike(SECTION_LINE))


def is_roman_page(lines: Column) -> Column:
    return F.exists(F.slice(nonblank(lines), 1, 3), lambda x: x.rlike(ROMAN))


def has_figure_caption(lines: Column) -> Column:
    return F.exists(lines, is_figure_caption)


def page_in_range(page: Column | int, start: Column, end: Column) -> Column:
    """Interval stab; string bounds are cast, a null start is false, a null end is the start."""
    s, e = start.try_cast("int"), end.try_cast("int")
    page = page if isinstance(page, Column) else F.lit(page)
    return F.coalesce(page.between(s, F.coalesce(e, s)), F.lit(False))


def names_page(text: Column, page: int) -> Column:
    return text.rlike(f"(?i)\\b(?:pages?|p)\\.?\\s*#?\\s*{int(page)}\\b")


def is_debris_heading(heading: Column) -> Column:
    """Formula fragments and bare ``table`` headings: no word of four letters."""
    return caption_key(heading).isin("", "table", "tables") | ~F.lower(heading).rlike("[a-z]{4,}")


def note_origin(is_generated: Column, parts: Column) -> Column:
    return F.when(F.coalesce(is_generated, F.lit(False)), "generated").when(F.get(parts, F.lit(0)) == "_system", "system").otherwise("manual")
