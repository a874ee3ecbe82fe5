"""Marked text to retrieval chunks.

Lines are rows: what a line is, is decided by column expressions; headings, blocks and units come from window
functions over the order of lines and blocks. Only contents pages and source spans, which follow a cursor, run
in Python, per page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import heading_key, pack, paragraphs, sentences, strip
from ..session import materialize
from . import contents
from . import pages as pg

MAX_CHARS = 1200
INLINE = "^(.+?)\\.\\-\\s*(.*)$"


def classify_lines(lines: DataFrame) -> DataFrame:
    """Adds ``what``, ``head``, ``sub`` (null payload means unset) and ``body`` to (.., line, kind, titles)."""
    t = strip(F.col("line"))
    inline = strip(F.regexp_extract(t, INLINE, 1))
    has_inline = t.rlike(INLINE) & (inline != "") & (F.length(inline) <= 100) & inline.rlike("[A-Za-z]")
    title, inline_title = contents.matched_title(t, F.col("titles")), contents.matched_title(inline, F.col("titles"))
    what = (
        F.when(t == "", "blank").when(P.is_running_header(t), "running").when(title.isNotNull(), "title")
        .when(F.startswith(F.lower(t), F.lit("abstract:")), "abstract")
        .when(P.is_heading(t) & ((F.col("kind") != "roman") | P.is_known_heading(t)), "heading").when(has_inline, "inline").otherwise("body")
    )
    d = lines.withColumn("t", t).withColumn("what", what).withColumn("title", title).withColumn("inline", inline).withColumn("inline_title", F.when(F.col("what") == "inline", inline_title))
    w = F.col("what")
    spelled = lambda k: F.try_element_at(F.col("titles"), k)
    head = (
        F.when(w == "title", spelled(F.col("title"))).when(w == "abstract", F.lit("Abstract")).when(w == "heading", F.col("t"))
        .when((w == "inline") & F.col("inline_title").isNotNull(), spelled(F.col("inline_title")))
    )
    none = F.lit(None).cast("string")
    sub = (
        F.when(w == "title", F.struct(F.when(heading_key(F.col("t")) != F.col("title"), F.col("t")).alias("v")))
        .when(w.isin("abstract", "heading"), F.struct(none.alias("v")))
        .when(w == "inline", F.struct(F.when(F.coalesce(heading_key(F.col("inline")) != F.col("inline_title"), F.lit(True)), F.col("inline")).alias("v")))
    )
    rest = F.when(w == "abstract", strip(F.substring(F.col("t"), F.lit(10), F.length("t")))).when(w == "inline", strip(F.regexp_extract("t", INLINE, 2)))
    body = F.when(w == "blank", F.lit("")).when(w == "body", F.col("t")).when(w.isin("abstract", "inline"), F.when(rest != "", rest))
    return d.withColumn("head", head).withColumn("sub", sub).withColumn("body", body).drop("title", "inline", "inline_title", "t")


def body_blocks(page_rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Blocks under one heading within a page. Headings carry over to later pages until a contents page."""
    order = Window.partitionBy("doc_id").orderBy("page_seq")
    reset = F.sum(F.col("kind").isin("catalog", "contents").cast("int")).over(order)
    p = page_rows.withColumn("reset", reset).where("kind in ('body', 'roman')").join(titles, ["doc_id", "page_seq"], "left")
    lines = classify_lines(p.select("doc_id", "page_seq", "page_number", "kind", "reset", "titles", F.posexplode("lines").alias("line_no", "line")))
    state = Window.partitionBy("doc_id", "reset").orderBy("page_seq", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy("doc_id", "page_seq").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("what").isin("running", "title", "abstract", "heading", "inline").cast("int")
    d = lines.select(
        "doc_id", "page_seq", "page_number", "line_no", "body", F.last("head", True).over(state).alias("heading"), F.last("sub", True).over(state)["v"].alias("subheading"),
        F.last(F.when(F.col("what") == "running", strip(F.col("line"))), True).over(page).alias("running_header"), F.sum(starts).over(page).alias("block_no"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), "\n")
    g = d.where("body is not null").groupBy("doc_id", "page_seq", "block_no").agg(
        F.first("page_number").alias("page_number"), F.first("heading").alias("heading"), F.first("subheading").alias("subheading"),
        F.first("running_header").alias("running_header"), strip(joined).alias("text"),
    )
    return g.where("text <> ''").withColumn("block_no", F.col("block_no").cast("int"))


def split_at_captions(blocks: DataFrame) -> DataFrame:
    """Prose before the first table caption, then one table per caption; adds piece_no, content_type and table_caption."""
    lines = F.split("text", "\\R")
    marks = F.filter(F.transform(lines, lambda x, i: F.when(P.is_table_caption(strip(x)), i)), lambda i: i.isNotNull())
    d = blocks.withColumn("_l", lines).withColumn("_m", marks)
    cuts = F.concat(F.array(F.lit(0)), F.col("_m"))
    ends = F.concat(F.col("_m"), F.array(F.size("_l")))
    parts = F.transform(
        F.sequence(F.lit(0), F.size("_m")),
        lambda i: F.struct(
            F.when(i == 0, F.lit("prose")).otherwise("table").alias("content_type"), F.when(i > 0, strip(F.get("_l", F.get(cuts, i)))).alias("table_caption"),
            strip(F.array_join(F.slice("_l", F.get(cuts, i) + 1, F.get(ends, i) - F.get(cuts, i)), "\n")).alias("text"),
        ),
    )
    whole = F.array(F.struct(F.col("content_type"), F.lit(None).cast("string").alias("table_caption"), F.col("text")))
    d = d.withColumn("_p", F.when(F.size("_m") == 0, whole).otherwise(parts))
    keep = [c for c in blocks.columns if c not in ("text", "content_type")]
    return d.select(*keep, F.posexplode("_p").alias("piece_no", "_x")).select(*keep, "piece_no", "_x.*").where("text <> ''")


def unit_key(d: DataFrame) -> Column:
    """What two blocks must share to be one unit; null for blocks without any firm identity."""
    h, s, c = (heading_key(F.coalesce(x, F.lit(""))) for x in ("heading", "subheading", "table_caption"))
    firm = (s != "") | F.col("section_printed_page").isNotNull() | h.isin(P.KNOWN_HEADINGS) | (c != "")
    null = F.lit("\u0000")
    parts = [F.coalesce(F.col(x).cast("string"), null) for x in ("major_section", "category", "section_printed_page")]
    return F.when(firm, F.struct(*parts, h, s, F.col("content_type"), c))


def semantic_units(blocks: DataFrame) -> DataFrame:
    """Adds semantic_unit_index: islands of equal keys over the same or following page."""
    w = Window.partitionBy("doc_id").orderBy("page_seq", "block_no", "piece_no")
    d = blocks.withColumn("_k", unit_key(blocks)).withColumn("_pk", F.lag("_k").over(w)).withColumn("_pp", F.lag("page_number").over(w))
    goes_on = F.coalesce((F.col("_k") == F.col("_pk")) & F.col("page_number").between(F.col("_pp"), F.col("_pp") + 1), F.lit(False))
    d = d.withColumn("_new", (~goes_on).cast("int"))
    return d.withColumn("semantic_unit_index", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_k", "_pk", "_pp", "_new")


def split_oversized(text: Column, content_type: Column, limit: int) -> Column:
    """Pieces of a block: a table by lines, one paragraph by sentences, several by paragraphs; a long sentence stays whole."""
    rows = F.transform(F.split(text, "\\R"), lambda x: F.regexp_replace(x, "(?U)\\s+$", ""))
    by_line = F.filter(F.transform(pack(rows, limit, "\n"), strip), lambda x: x != "")
    parts = paragraphs(text)
    fine = F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > limit, pack(sentences(x), limit, " ")).otherwise(F.array(x))))
    prose = F.when(F.size(parts) <= 1, pack(sentences(text), limit, " ")).otherwise(pack(fine, limit, "\n\n"))
    return F.when(F.length(text) <= limit, F.array(text)).when(content_type == "table", by_line).otherwise(prose)


def source_spans(chunks: DataFrame, page_rows: DataFrame) -> DataFrame:
    """Adds source_char_start/end: each chunk's words searched in its page from the end of the chunk found before."""
    last = page_rows.groupBy("doc_id", "page_number").agg(F.max_by(F.struct("text", "source_char_start"), "page_seq").alias("_src"))
    texts = chunks.groupBy("doc_id", F.col("page_start").alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("_c"))
    # one row per page: its text and its chunks in order
    slim = texts.join(last, ["doc_id", "page_number"]).select(
        "doc_id", F.col("_src.text").alias("page"), F.col("_src.source_char_start").alias("base"), F.transform("_c", lambda x: x["chunk_index"]).alias("at"), F.transform("_c", lambda x: x["text"]).alias("texts"),
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                # the page with single blanks, and where each of its words begins there and in the page
                found = list(re.finditer(r"\S+", r.page))
                flat = " ".join(m[0] for m in found)
                here = list(accumulate((len(m[0]) + 1 for m in found), initial=0))
                place = lambda k: found[(w := bisect_right(here, k) - 1)].start() + k - here[w]  # noqa: B023, E731
                cursor = 0
                for i, t in zip(r.at, r.texts):
                    words = " ".join(t.split())
                    at = flat.find(words, cursor) if words else -1
                    if at >= 0:
                        cursor = at + len(words)
                        out.append((r.doc_id, i, r.base + place(at), r.base + place(cursor - 1) + 1))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "source_char_start", "source_char_end"])

    spans = slim.mapInPandas(find, "doc_id string, chunk_index int, source_char_start long, source_char_end long")
    return chunks.join(spans, ["doc_id", "chunk_index"], "left")


def build_chunks(documents: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """The chunks of cleaned, page-marked documents (doc_id, text), in the archive's chunk schema.

    Documents without markers, and null texts, give no chunks. char_start/char_end run over the chunk lengths;
    source_char_start/end are the span in the document's text, null where the words are not found in order.
    """
    # pages and entries feed several branches of the plan: written once instead of computed in each
    pages = materialize(pg.to_pages(documents, text))
    kinds = materialize(pg.classify_pages(pg.strip_furniture(pages, pg.page_furniture(pages))))
    sections = contents.major_sections(pages)
    entries = materialize(contents.contents_entries(pages, sections))
    offsets = materialize(contents.page_offset(pages, entries))
    titles = contents.start_candidates(pages, entries, offsets)
    plain = body_blocks(kinds, titles).withColumn("content_type", F.lit("prose"))
    listed = contents.contents_blocks(kinds, sections).withColumn("content_type", F.lit("contents"))
    blocks = plain.unionByName(listed.select(plain.columns))
    blocks = blocks.withColumn("heading", F.when(F.col("heading").isNull() & F.startswith(F.lower("text"), F.lit("abstract:")), "Abstract").otherwise(F.col("heading")))
    units = semantic_units(contents.resolve_hierarchy(split_at_captions(blocks), entries, offsets))
    order = ["page_seq", "block_no", "piece_no"]
    pieces = units.select(*[c for c in units.columns if c != "text"], F.posexplode(split_oversized(F.col("text"), F.col("content_type"), max_chars)).alias("part", "text"))
    in_doc, in_unit = Window.partitionBy("doc_id").orderBy(*order, "part"), Window.partitionBy("doc_id", "semantic_unit_index")
    before = Window.partitionBy("doc_id").orderBy(*order, "part").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("text")
    unit_id = F.concat("doc_id", F.lit("_unit_"), _four(F.col("semantic_unit_index")))
    d = pieces.select(
        "*", F.row_number().over(in_doc).alias("chunk_index"), F.row_number().over(in_unit.orderBy(*order, "part")).alias("retrieval_chunk_index"),
        F.count("*").over(in_unit).cast("int").alias("retrieval_chunk_count"),
        F.sum(n).over(in_unit).cast("int").alias("semantic_unit_char_count"), F.max("page_number").over(in_unit).alias("semantic_unit_page_end"),
        F.size(F.collect_set(F.struct(*order)).over(in_unit)).alias("semantic_unit_block_count"), F.sum(n).over(before).cast("long").alias("char_end"),
    )
    chunks = d.select(
        F.concat("doc_id", F.lit("_chunk_"), _four(F.col("chunk_index"))).alias("chunk_id"), "doc_id", "chunk_index", unit_id.alias("semantic_unit_id"), "semantic_unit_index",
        F.min("page_number").over(in_unit).alias("semantic_unit_page_start"), "semantic_unit_page_end", "semantic_unit_char_count", "semantic_unit_block_count",
        "retrieval_chunk_index", "retrieval_chunk_count", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.col("heading").alias("section_heading"),
        "subheading", "content_type", "table_caption", "major_section", "category", F.col("section_printed_page").alias("printed_page"), "section_printed_page",
        "estimated_printed_page", "printed_page_offset", "running_header", P.equation_hint(F.col("text")).alias("layout_hint"), "text", n.alias("char_count"),
        (F.col("char_end") - n).alias("char_start"), "char_end",
    )
    return source_spans(chunks, pages)


def _four(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) >= 4, s).otherwise(F.lpad(s, 4, "0"))
