"""Contents pages: entries, major sections, page offset and hierarchy.

Contents pages are few and their lines are read in order with a small state, so they go through one grouped
Python function per document; all that joins them to the rest of the document stays in DataFrames.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import heading_key, strip
from .pages import lines_of

# Line patterns of contents pages.
NUMBERED = re.compile(r"\s*(\d{1,4})\s+(.+?)\s*")
SECTION = re.compile(r"([A-Z][A-Z0-9\s,&/\-]+?)\s+(\d{1,4}|[IVXLCDMivxlcdm]+)")
REVERSED = re.compile(r"(\d{1,4})([A-Z][A-Z0-9\s,&/\-]+)")
ROMAN = re.compile(r"[ivxlcdm]{1,8}")
MAJOR = "^([A-Z][A-Z0-9\\s,&/\\-]+?)\\s+(\\d{1,4})$"
MAJOR_NOTE = "each section includes a detailed table of contents"
TITLE, MAX_LINE = "table of contents", 100

_BLOCKS = "doc_id string, page_seq int, block_no int, page_number int, heading string, subheading string, running_header string, text string"


def key_of(line: str) -> str:
    return re.sub(r"\s+", " ", line.strip().lower())


def shouts(line: str) -> bool:
    """A category line: letters, all of them capitals, not too long."""
    return len(line) <= MAX_LINE and line.upper() == line and any(map(str.isalpha, line))


def entry_of(line: str) -> tuple[str, int] | None:
    """(title, printed page) of a numbered line with a plausible title; ('', page) if the title is not one."""
    m = NUMBERED.fullmatch(line)
    if not m:
        return None
    title = m[2].strip()
    good = title and len(title) <= MAX_LINE and title[-1] not in ".;," and re.search("[A-Za-z]", title)
    return (title if good else "", int(m[1]))


def major_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, ordinal, title, printed_page) from catalog pages, ordered by printed page; ties keep their order."""
    d = pages.where(F.contains(heading_key(F.col("text")), F.lit(MAJOR_NOTE)))
    d = d.select("doc_id", "page_seq", F.posexplode(F.transform(lines_of(F.col("text")), strip)).alias("i", "line")).where(F.col("line").rlike(MAJOR))
    d = d.withColumn("title", strip(F.regexp_extract("line", MAJOR, 1))).withColumn("printed_page", F.regexp_extract("line", MAJOR, 2).cast("int"))
    w = Window.partitionBy("doc_id").orderBy("printed_page", "page_seq", "i")
    return d.where("title <> 'TABLE OF CONTENTS'").select("doc_id", F.row_number().over(w).alias("ordinal"), "title", "printed_page")


def contents_entries(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, ordinal, toc_page, category, title, printed_page, major_section): the entries of the contents pages.

    Categories may run over several lines and carry over to the next page, but not over a gap between pages.
    """
    toc = pages.where(P.is_contents_page(lines_of(F.col("text")))).select("doc_id", "page_seq", "page_number", "text")
    names = sections.groupBy("doc_id").agg(F.collect_set(heading_key(F.col("title"))).alias("names"))
    toc = toc.join(names, "doc_id", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, category, before = [], None, None
        for r in pdf.sort_values("page_seq").itertuples():
            majors = set() if r.names is None else set(r.names)
            if before is None or r.page_number != before + 1:
                category = None
            before, pending = r.page_number, []
            for line in filter(None, map(str.strip, r.text.splitlines())):
                k = key_of(line)
                if k in (TITLE, "continued", "(continued)") or k in majors and not pending:
                    continue
                entry = entry_of(line)
                if entry is None and shouts(line):
                    pending.append(line)
                    continue
                if pending:
                    category, pending = " ".join(pending), []
                if entry and entry[0]:
                    out.append((r.doc_id, len(out) + 1, r.page_number, category, *entry))
        return pd.DataFrame(out, columns=["doc_id", "ordinal", "toc_page", "category", "title", "printed_page"])

    rows = toc.groupBy("doc_id").applyInPandas(fold, "doc_id string, ordinal int, toc_page int, category string, title string, printed_page int")
    return attach_sections(rows, sections)


def attach_sections(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """As-of join: the last major section that starts at or before the entry's page; of equals the last in order."""
    s = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("printed_page", "ordinal", "title"))).alias("s"))
    d = entries.join(s, "doc_id", "left")
    last = F.array_max(F.filter("s", lambda x: x["printed_page"] <= F.col("printed_page")))
    return d.withColumn("major_section", last["title"]).drop("s")


def page_offset(pages: DataFrame, entries: DataFrame, votes: int = 3) -> DataFrame:
    """(doc_id, page_offset): physical minus printed page, by vote of titles that occur once on both sides.

    A document without ``votes`` agreeing titles, or with two winners, has no row.
    """
    e = entries.select("doc_id", heading_key(F.col("title")).alias("key"), "printed_page")
    e = e.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first("printed_page").alias("printed")).where("n = 1")
    body = pages.where(~P.is_contents_page(lines_of(F.col("text"))))
    lines = body.select("doc_id", "page_number", F.explode(lines_of(F.col("text"))).alias("line")).select("doc_id", "page_number", heading_key(F.col("line")).alias("key"))
    once = lines.join(e.select("doc_id", "key"), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key")
    once = once.agg(F.min("page_number").alias("page"), F.max("page_number").alias("other")).where("page = other")
    count = once.join(e, ["doc_id", "key"]).groupBy("doc_id", (F.col("page") - F.col("printed")).alias("page_offset")).agg(F.count("*").alias("votes"))
    best = count.groupBy("doc_id").agg(F.max("votes").alias("votes"))
    top = count.join(best, ["doc_id", "votes"]).where(F.col("votes") >= votes)
    return top.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("page_offset").alias("page_offset")).where("n = 1").select("doc_id", "page_offset")


def start_candidates(pages: DataFrame, entries: DataFrame, offsets: DataFrame, lag: int = 2) -> DataFrame:
    """(doc_id, page_seq, titles MAP key -> spelling): titles that may start on a page, at most ``lag`` printed pages ago."""
    spelling = entries.groupBy("doc_id", heading_key(F.col("title")).alias("key")).agg(F.max_by("title", "ordinal").alias("spelling"))
    e = entries.select("doc_id", heading_key(F.col("title")).alias("key"), F.explode(F.sequence("printed_page", F.col("printed_page") + lag)).alias("printed")).distinct()
    e = e.join(spelling, ["doc_id", "key"])
    p = pages.select("doc_id", "page_seq", "page_number").join(offsets, "doc_id").withColumn("printed", F.col("page_number") - F.col("page_offset"))
    return p.join(e, ["doc_id", "printed"]).groupBy("doc_id", "page_seq").agg(F.map_from_entries(F.collect_set(F.struct("key", "spelling"))).alias("titles"))


def matched_title(line: Column, titles: Column) -> Column:
    """The key of ``titles`` that a line stands for: itself, or itself less a known ending; else null."""
    k = heading_key(line)
    short = [F.when(F.endswith(k, F.lit(s)), F.substring(k, F.lit(1), F.length(k) - len(s))) for s in (" notation", " of numbers")]
    has = lambda x: F.when(F.coalesce(F.map_contains_key(titles, F.coalesce(x, F.lit(""))), F.lit(False)), x)
    return F.coalesce(has(k), *map(has, short))


def contents_blocks(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks of the catalog and contents pages (``pages`` with lines and kind)."""
    names = sections.groupBy("doc_id").agg(F.collect_set(heading_key(F.col("title"))).alias("names"))
    d = pages.where("kind in ('catalog', 'contents')").select("doc_id", "page_seq", "page_number", "kind", "lines").join(names, "doc_id", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                lines = [x for x in (y.strip() for y in r.lines) if x]
                majors = set() if r.names is None else set(r.names)
                groups, header = catalog_groups(lines) if r.kind == "catalog" else category_groups(lines, majors)
                out += [(r.doc_id, r.page_seq, i, r.page_number, "Table of Contents", title, header, "\n".join(body)) for i, (title, body) in enumerate(groups) if body]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _BLOCKS.split(", ")])

    return d.mapInPandas(run, _BLOCKS)


def _with_preamble(groups: list[tuple[str | None, list[str]]], preamble: list[str]) -> list[tuple[str | None, list[str]]]:
    """Lines before the first group belong to it, or stand alone if there is none."""
    groups = [g for g in groups if g[1]]
    if not preamble:
        return groups
    if not groups:
        return [(None, preamble)]
    return [(groups[0][0], preamble + groups[0][1]), *groups[1:]]


def catalog_groups(lines: list[str]) -> tuple[list[tuple[str | None, list[str]]], str]:
    """Sections of a page that catalogues the whole book, and its running header."""
    groups: list[tuple[str | None, list[str]]] = []
    preamble: list[str] = []
    header = TITLE.upper()
    for line in lines:
        k = key_of(line)
        if k == TITLE:
            continue
        if ROMAN.fullmatch(line):
            header = f"{TITLE.upper()} {line}"
            continue
        section, turned = SECTION.fullmatch(line), REVERSED.fullmatch(line)
        if k.startswith(P.CONTENTS_NOTE):
            preamble.append(line)
        elif section and ROMAN.fullmatch(section[2].lower()):
            if not groups or groups[-1][0] != "Front Matter":
                groups.append(("Front Matter", []))
            groups[-1][1].append(line)
        elif section or turned:
            groups.append(((section[1] if section else turned[2]).strip(), [line]))
        else:
            (groups[-1][1] if groups else preamble).append(line)
    return _with_preamble(groups, preamble), header


def category_groups(lines: list[str], majors: set[str]) -> tuple[list[tuple[str | None, list[str]]], str]:
    """Categories of a detailed contents page, and its running header."""
    groups: list[tuple[str | None, list[str]]] = []
    preamble: list[str] = []
    pending: list[str] = []
    header, open_group = TITLE.upper(), False
    for line in lines:
        k = key_of(line)
        if k in (TITLE, "continued", "(continued)") or line.isdigit():
            continue
        if k in majors:
            header = line
        elif NUMBERED.fullmatch(line):
            if pending:
                groups.append((" ".join(pending), [" ".join(pending)]))
                pending, open_group = [], True
            (groups[-1][1] if open_group else preamble).append(line)
        elif shouts(line):
            open_group = False
            pending.append(line)
        else:
            (groups[-1][1] if open_group else preamble).append(line)
    if pending and not open_group:
        groups.append((" ".join(pending), [" ".join(pending)]))
    return _with_preamble(groups, preamble), header


def resolve_hierarchy(blocks: DataFrame, entries: DataFrame, offsets: DataFrame) -> DataFrame:
    """Equi + as-of join: the entry of the block's heading that starts last at or before its printed page; of equals the first.

    Nothing ahead of the block is taken, and nothing at all without a page offset.
    """
    e = entries.groupBy("doc_id", heading_key(F.col("title")).alias("_key")).agg(
        F.collect_list(F.struct("printed_page", (-F.col("ordinal")).alias("o"), "major_section", "category")).alias("_c")
    )
    d = blocks.join(offsets, "doc_id", "left").withColumn("_key", heading_key(F.coalesce("heading", F.lit("")))).join(e, ["doc_id", "_key"], "left")
    at = F.col("page_number") - F.col("page_offset")
    hit = F.array_max(F.filter("_c", lambda x: x["printed_page"] <= at))
    return d.select(
        *[blocks[c] for c in blocks.columns], hit["major_section"].alias("major_section"), hit["category"].alias("category"),
        hit["printed_page"].alias("section_printed_page"), at.alias("estimated_printed_page"), F.col("page_offset").alias("printed_page_offset"),
    )
