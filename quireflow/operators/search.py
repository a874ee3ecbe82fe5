"""Weighted, fuzzy, page-aware search over notes and structural index entries."""

from __future__ import annotations

import difflib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from ..functions.text import ASCII_PUNCTUATION, breadcrumb, path_parts, strip

#: Score weights of a term by field, of a page by kind, and the number of hits.
WEIGHTS = {"title": 5, "alias": 4, "tag": 3, "path": 2, "body": 1}
HEADING, CAPTION, CONTENT = 5, 5, 1
PAGE_GENERATED, PAGE_MANUAL, PAGE_ENTRY, PAGE_TABLE, PAGE_FIGURE = 50, 20, 50, 20, 10
TOP, CUTOFF, FUZZY_FROM, ONE_MATCH_TO = 5, 0.9, 5, 7


def parse_page_query(query: str) -> tuple[int | None, str]:
    """(page number or None, the query without the page phrase)."""
    m = re.search(P.PAGE_QUERY.removeprefix("(?i)"), query, re.I)
    if not m:
        return None, query
    return int(m[1]), f"{query[: m.start()]} {query[m.end() :]}".strip()


def parse_terms(query: str) -> list[str]:
    """Words of the query: ASCII punctuation is deleted, one-letter words are dropped. Repeated words stay."""
    return [w for w in query.translate(str.maketrans("", "", ASCII_PUNCTUATION)).split() if len(w) > 1]


def build_vocabulary(notes: DataFrame) -> DataFrame:
    """Distinct words of titles, bodies and paths, with tags and aliases whole."""
    words = lambda c: F.split(strip(F.lower(c)), "(?U)\\s+")
    none = F.array().cast("array<string>")
    path = F.translate(F.lower("relative_path"), "_", " ")
    parts = F.concat(*[F.coalesce(words(c), none) for c in (F.col("title"), F.col("body"), path)], F.coalesce("tags", none), F.coalesce("aliases", none))
    return notes.select(F.explode(F.array_distinct(parts)).alias("word")).where("word <> ''").distinct()


def fuzzy_matches(vocabulary: DataFrame, terms: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """(term, word, ratio, place): for each term of five letters or more its closest words, 1 up to seven letters, else 2.

    The ratio is Ratcliff-Obershelp. Before Python sees a word, a length bound that no word within the cutoff can
    miss thins the vocabulary in the JVM. Ties go to the larger word.
    """
    long = sorted({t for t in terms if len(t) >= FUZZY_FROM})
    schema = "term string, word string, ratio double"
    if not long:
        return vocabulary.sparkSession.createDataFrame([], f"{schema}, place int")
    near = [(F.length("word") * 2 >= F.lit(cutoff) * (F.length("word") + len(t))) & (F.lit(2 * len(t)) >= F.lit(cutoff) * (F.length("word") + len(t))) for t in long]
    words = vocabulary.where(reduce(lambda a, b: a | b, near)).select("word")

    def score(batches):
        for pdf in batches:
            rows = []
            for t in long:
                s = difflib.SequenceMatcher()
                s.set_seq2(t)
                for w in pdf["word"]:
                    s.set_seq1(w)
                    if s.real_quick_ratio() >= cutoff and s.quick_ratio() >= cutoff and (r := s.ratio()) >= cutoff:
                        rows.append((t, w, r))
            yield pd.DataFrame(rows, columns=["term", "word", "ratio"])

    w = Window.partitionBy("term").orderBy(F.desc("ratio"), F.desc("word"))
    ranked = words.mapInPandas(score, schema).withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= F.when(F.length("term") <= ONE_MATCH_TO, 1).otherwise(2))


def expand_terms(terms: list[str], vocabulary: DataFrame | None) -> list[str]:
    """The distinct terms, each followed by its close words. At most two words per term reach the driver."""
    close: dict[str, list[str]] = {}
    if vocabulary is not None:
        for r in fuzzy_matches(vocabulary, terms).orderBy("term", "place").collect():
            close.setdefault(r.term, []).append(r.word)
    out: list[str] = []
    for t in terms:
        for w in (t, *close.get(t, [])):
            if w not in out:
                out.append(w)
    return out


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _points(hit: Column, n: int) -> Column:
    return F.when(hit, n).otherwise(0)


def score_notes(notes: DataFrame, terms: list[str], page: int | None = None, scope: str = "all") -> DataFrame:
    """Notes with origin and score; filters before it scores. Title, body and path match as substrings, tags and aliases whole."""
    d = notes.withColumn("origin", F.coalesce("note_origin", P.note_origin(F.col("is_generated"), F.col("category_parts"))))
    if scope in ("notes", "reference"):
        d = d.where(F.col("origin") == ("manual" if scope == "notes" else "generated"))
    bonus = F.lit(0)
    if page is not None:
        generated = F.col("origin") == "generated"
        in_range = P.page_in_range(page, F.try_element_at("meta", F.lit("page_start")), F.try_element_at("meta", F.lit("page_end")))
        phrase = P.names_page(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))), page)
        d = d.where(F.when(generated, in_range).otherwise(phrase))
        bonus = F.when(generated, PAGE_GENERATED).otherwise(PAGE_MANUAL)
    title, body, path = F.lower("title"), F.lower("body"), F.translate(F.lower("relative_path"), "_", " ")
    scored = [
        _points(F.contains(title, F.lit(t)), WEIGHTS["title"]) + _points(F.array_contains("tags", t), WEIGHTS["tag"]) + _points(F.array_contains("aliases", t), WEIGHTS["alias"])
        + _points(F.contains(body, F.lit(t)), WEIGHTS["body"]) + _points(F.contains(path, F.lit(t)), WEIGHTS["path"])
        for t in terms
    ]
    d = d.withColumn("score", bonus + _sum(scored)).where("score > 0")
    return d.withColumn("score", F.col("score") - F.coalesce(F.col("is_generated"), F.lit(False)).cast("int"))


def demote_sources(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Generated hits of one source lose a point per better hit of that source; ties keep id order.

    Only hits with a source are ranked. With ``top``, hits that ``top`` better ones of their source outdo are left
    out; that limit is applied before the shuffle, so a source with most of the hits sends few of them.
    """
    source = F.coalesce("source_doc_id", F.lit(""))
    counted = F.coalesce(F.col("is_generated"), F.lit(False)) & (source != "")
    w = Window.partitionBy("source_doc_id").orderBy(F.desc("score"), "id")
    ranked = scored.where(counted).withColumn("_r", F.row_number().over(w))
    if top is not None:
        ranked = ranked.where(F.col("_r") <= top)
    ranked = ranked.withColumn("adjusted", F.col("score") - F.col("_r") + 1).drop("_r")
    return ranked.unionByName(scored.where(~counted).withColumn("adjusted", F.col("score")))


def search_notes(notes: DataFrame, query: str, vocabulary: DataFrame | None = None, scope: str = "all", top: int = TOP) -> DataFrame:
    """The best ``top`` notes: (position, score, id, note_id, title, source_doc_id). Ties: score before demotion, then id.

    notes: id, note_id, title, tags, aliases, meta, source_doc_id, body, relative_path, category_parts,
    is_generated, note_origin. Null fields match nothing. Without a vocabulary terms are not expanded.
    """
    page, text = parse_page_query(query)
    hits = demote_sources(score_notes(notes, expand_terms(parse_terms(text), vocabulary), page, scope), top)
    best = hits.orderBy(F.desc("adjusted"), F.desc("score"), "id").limit(top)
    w = Window.orderBy(F.desc("adjusted"), F.desc("score"), "id")
    return best.select(F.row_number().over(w).alias("position"), F.col("adjusted").alias("score"), "id", "note_id", "title", "source_doc_id")


def result_title(entry_title: str = "title") -> Column:
    """Label of an entry: caption, first heading that is not debris, page, document title."""
    heads = F.array(*[strip(F.coalesce(c, F.lit(""))) for c in ("subheading", "section_heading", "category", "major_section")])
    good = F.get(F.filter(heads, lambda x: (x != "") & ~P.is_debris_heading(x)), F.lit(0))
    caption = strip(F.coalesce("table_caption", F.lit("")))
    page = F.concat(F.lit("Page "), F.col("page_start").cast("string"), F.lit(" · Extracted segment"))
    return F.coalesce(F.when(caption != "", caption), good, page, F.col(entry_title))


def artifact_key() -> Column:
    """Key of the table or figure an entry shows a part of; null for entries that are neither."""
    kind = F.coalesce("content_type", F.lit("prose"))
    layout, unit = F.when(F.col("table_layout_id") != "", F.col("table_layout_id")), F.when(F.col("semantic_unit_id") != "", F.col("semantic_unit_id"))
    table = F.when(kind == "table", F.coalesce(F.concat(F.lit("table-layout:"), layout), F.concat(F.lit("table-unit:"), unit)))
    figures = F.array_join(F.array_sort("figure_layout_ids"), "\u0001")
    return F.coalesce(table, F.when(F.size(F.coalesce("figure_layout_ids", F.array().cast("array<string>"))) > 0, F.concat(F.lit("figures:"), figures)))


def with_figures(entries: DataFrame) -> DataFrame:
    """Adds the optional figure columns where a table lacks them."""
    d = entries
    if "figure_layout_ids" not in d.columns:
        d = d.withColumn("figure_layout_ids", F.lit(None).cast(T.ArrayType(T.StringType())))
    if "figure_search_text" not in d.columns:
        d = d.withColumn("figure_search_text", F.lit(None).cast("string"))
    return d


def score_entries(entries: DataFrame, terms: list[str], page: int | None = None) -> DataFrame:
    """Entries with score > 0. A repeated term counts again; captions count on the first chunk of a unit only."""
    d = with_figures(entries)
    bonus = F.lit(0)
    if page is not None:
        d = d.where(P.page_in_range(page, F.col("page_start"), F.col("page_end")))
        figures = F.size(F.coalesce("figure_layout_ids", F.array().cast("array<string>"))) > 0
        bonus = F.when(F.col("content_type") == "table", PAGE_ENTRY + PAGE_TABLE).when(figures, PAGE_ENTRY + PAGE_FIGURE).otherwise(PAGE_ENTRY)
    parts = F.array_distinct(F.filter(F.array(*[strip(F.coalesce(c, F.lit(""))) for c in ("preview", "search_text", "figure_search_text")]), lambda x: x != ""))
    content = F.lower(F.array_join(parts, "\n\n"))
    heading, caption = F.lower(F.coalesce("section_heading", F.lit(""))), F.lower(F.coalesce("table_caption", F.lit("")))
    first = F.coalesce(F.col("retrieval_chunk_index") == 1, F.lit(True))
    scored = [
        _points(F.contains(heading, F.lit(t)), HEADING) + _points(first & F.contains(caption, F.lit(t)), CAPTION) + _points(F.contains(content, F.lit(t)), CONTENT) for t in terms
    ]
    return d.withColumn("body", F.array_join(parts, "\n\n")).withColumn("score", bonus + _sum(scored)).where("score > 0")


def search_structural(entries: DataFrame, registry: DataFrame, query: str, top: int = TOP, mode: str = "structural_only") -> DataFrame:
    """The best ``top`` entries of documents stored structurally: (position, score, id, doc_id, entry_index, title, page_start).

    registry: one row per document (doc_id, title, category_path, chunk_storage_mode, updated_at). Documents rank by
    (updated_at, doc_id) descending, entries by index; of a table or figure only the best part is shown.
    """
    page, text = parse_page_query(query)
    hits = score_entries(entries, parse_terms(text.lower()), page)
    docs = registry.where(F.col("chunk_storage_mode") == mode).select("doc_id", "title", "updated_at", "category_path")
    d = hits.join(docs, "doc_id").withColumn("key", artifact_key())
    order = [F.desc("score"), F.desc_nulls_last("updated_at"), F.desc("doc_id"), F.col("entry_index")]
    parts = d.where("key is not null").withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(*order))).where("_r = 1").drop("_r")
    best = parts.unionByName(d.where("key is null")).orderBy(*order).limit(top)
    return best.select(
        F.row_number().over(Window.orderBy(*order)).alias("position"), "score", F.concat(F.lit("structural:"), "doc_id", F.lit(":"), F.col("entry_index").cast("string")).alias("id"),
        "doc_id", "entry_index", result_title().alias("title"), "page_start", breadcrumb(F.col("category_path")).alias("category"), path_parts(F.col("category_path")).alias("category_parts"),
    )


def federate(notes: DataFrame, structural: DataFrame, top: int = TOP) -> DataFrame:
    """One list of two cut lists; notes go first on ties."""
    n = notes.select(F.lit(0).alias("engine"), "position", "score", F.col("id").cast("string").alias("id"), "title")
    s = structural.select(F.lit(1).alias("engine"), "position", "score", "id", "title")
    order = [F.desc("score"), F.col("engine"), F.col("position")]
    best = n.unionByName(s).orderBy(*order).limit(top)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "score", "id", "title")
