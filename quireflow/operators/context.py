"""Neighbours, units, display groups and segments of structural entries and source notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import caption_key, preview, strip
from ..plans.ordering import along
from .search import artifact_key, with_figures

#: Pages shown to verify a segment.
MAX_PAGES = 8


def chunk_number(path: Column) -> Column:
    """The number in a generated note's file name ``...__chunk_N.md``, or null."""
    n = F.regexp_extract(path, "__chunk_(\\d+)(?:\\.md)?$", 1)
    return F.when(n != "", n).try_cast("int")


def note_chunk_index(notes: DataFrame) -> Column:
    return F.coalesce(F.try_element_at("meta", F.lit("chunk_index")).try_cast("int"), chunk_number(F.col("relative_path")))


def source_context(notes: DataFrame) -> DataFrame:
    """(note_id, doc_id, place, previous_id, next_id): neighbours among the generated notes of one source that have a chunk number, by it."""
    d = notes.where((F.coalesce("source_doc_id", F.lit("")) != "") & F.col("is_generated")).withColumn("_c", note_chunk_index(notes)).where("_c is not null")
    d = d.select("note_id", F.col("source_doc_id").alias("doc_id"), "_c", "relative_path", "id")
    d = along(d, ["doc_id"], ["_c", "relative_path", "id"], sums={"place": F.lit(1)}, lags={"previous_id": F.col("note_id")}, leads={"next_id": F.col("note_id")})
    return d.select("note_id", "doc_id", F.col("place").cast("int").alias("place"), "previous_id", "next_id")


def chunk_context(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, chunk_index, previous_id, next_id): neighbours of each chunk in its document."""
    d = chunks.select("chunk_id", "doc_id", "chunk_index")
    return along(d, ["doc_id"], ["chunk_index", "chunk_id"], lags={"previous_id": F.col("chunk_id")}, leads={"next_id": F.col("chunk_id")})


def preferred_source_note(notes: DataFrame) -> DataFrame:
    """(doc_id, note_id): per source the structural-only note, else the lowest chunk number, else the first path."""
    mode = F.try_element_at("meta", F.lit("chunk_storage_mode"))
    rank = F.struct((F.coalesce(mode, F.lit("")) != "structural_only").alias("a"), F.coalesce(note_chunk_index(notes), F.lit(999999)).alias("b"), F.col("relative_path").alias("c"), F.col("note_id").alias("d"))
    d = notes.where(F.coalesce("source_doc_id", F.lit("")) != "")
    return d.groupBy(F.col("source_doc_id").alias("doc_id")).agg(F.min_by("note_id", rank).alias("note_id"))


def unit_runs(entries: DataFrame) -> DataFrame:
    """(doc_id, entry_index, run, first_entry, last_entry): contiguous runs of one semantic unit, not all rows of its id."""
    d = along(entries.select("doc_id", "entry_index", "semantic_unit_id"), ["doc_id"], ["entry_index"], lags={"_before": F.col("semantic_unit_id")})
    same = F.col("semantic_unit_id").eqNullSafe(F.col("_before")) & F.col("semantic_unit_id").isNotNull() & (F.col("semantic_unit_id") != "")
    d = along(d.select("doc_id", "entry_index", (~F.coalesce(same, F.lit(False))).cast("int").alias("_new")), ["doc_id"], ["entry_index"], sums={"run": F.col("_new")})
    d = d.select("doc_id", "entry_index", F.col("run").cast("int").alias("run"))
    ends = d.groupBy("doc_id", "run").agg(F.min("entry_index").alias("first_entry"), F.max("entry_index").alias("last_entry"))
    return d.join(ends, ["doc_id", "run"]).select("doc_id", "entry_index", "run", "first_entry", "last_entry")


def unit_statistics(chunks: DataFrame) -> DataFrame:
    """Per semantic unit: pages, chunks and characters of its texts."""
    return chunks.groupBy("doc_id", "semantic_unit_id").agg(
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"),
    )


def front_matter_label() -> Column:
    heading = F.coalesce("section_heading", F.lit(""))
    key = caption_key(heading)
    named = F.when(key == "front matter", F.lit("Front Matter")).when(key.isin(P.FRONT_MATTER), F.when(strip(heading) != "", strip(heading)).otherwise(F.initcap(key)))
    return F.when(F.col("content_type") == "contents", F.lit("Table of Contents")).otherwise(named)


def display_items(entries: DataFrame) -> DataFrame:
    """Cards for navigation, one row each: (doc_id, item, label, card, first_entry, chunks, entries_in_item, page_start, page_end, char_count).

    Entries up to the end of the first contents run are front matter: explicit labels carry on, the rest before
    the first one is ``Publication Details``. Afterwards only explicit labels group. Neighbouring groups of one
    label are one item; neighbouring parts of one table or figure are one card.
    """
    d = with_figures(entries).withColumn("_key", artifact_key()).withColumn("_own", front_matter_label())
    d = d.select("doc_id", "entry_index", "page_start", "page_end", "char_count", "_key", "_own", F.coalesce(F.col("content_type") == "contents", F.lit(False)).alias("_is"))
    starts = d.where("_is").groupBy("doc_id").agg(F.min("entry_index").alias("_first"))
    after = d.join(starts, "doc_id").where(~F.col("_is") & (F.col("entry_index") > F.col("_first")))
    bounds = starts.join(after.groupBy("doc_id").agg(F.min("entry_index").alias("_out")), "doc_id", "left")
    d = along(d, ["doc_id"], ["entry_index"], lasts={"_carried": F.col("_own")}).join(bounds, "doc_id", "left")
    front = F.col("_first").isNotNull() & (F.col("entry_index") < F.coalesce("_out", F.lit(2**31 - 1)))
    d = d.withColumn("label", F.when(front, F.coalesce("_carried", F.lit("Publication Details"))).otherwise(F.col("_own"))).drop("_first", "_out", "_carried")
    d = along(d, ["doc_id"], ["entry_index"], lags={"_last_label": F.col("label"), "_last_key": F.col("_key")})
    same_label = F.coalesce(F.col("label") == F.col("_last_label"), F.lit(False))
    same_key = F.coalesce(F.col("_key") == F.col("_last_key"), F.lit(False))
    both_bare = F.col("label").isNull() & F.col("_last_label").isNull()
    d = d.withColumn("_ni", (~(same_label | (both_bare & same_key))).cast("int")).withColumn("_nc", (~((same_label | both_bare) & same_key)).cast("int"))
    d = along(d, ["doc_id"], ["entry_index"], sums={"item": F.col("_ni"), "card": F.col("_nc")})
    d = d.withColumn("item", F.col("item").cast("int")).withColumn("card", F.col("card").cast("int"))
    g = d.groupBy("doc_id", "item", "card").agg(
        F.first("label").alias("label"), F.min("entry_index").alias("first_entry"), F.count("*").alias("chunks"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.sum(F.coalesce("char_count", F.lit(0))).alias("char_count"),
    )
    return g.join(g.groupBy("doc_id", "item").agg(F.sum("chunks").alias("entries_in_item")), ["doc_id", "item"])


def verification_pages(
    entries: DataFrame, layouts: DataFrame | None = None, warning: bool = True, group: tuple[str, ...] = ("doc_id",), most: int = MAX_PAGES,
    current: int | None = None, general: bool = False,
) -> DataFrame:
    """(group, pages): the first ``most`` pages of the source that are worth a look.

    Pages of linked table layouts; else pages of table entries and of entries that begin with a range caption, each
    clipped to ``most`` pages, of which ``current`` is kept whatever its place; else, with a warning, the pages of
    equations; else, if ``general``, those of the entry that begins on ``current``, or of the first one.
    layouts: (group, page_number).
    """
    start, end = F.col("page_start"), F.greatest(F.coalesce("page_end", "page_start"), F.col("page_start"))
    d = entries.where("page_start > 0")
    table = (F.col("content_type") == "table") | P.leading_caption(F.coalesce("preview", F.lit(""))).isNotNull()
    few = F.sequence(start, F.least(end, start + most - 1))
    pages = lambda cond, seq: F.flatten(F.collect_set(F.when(cond, seq)))
    here = F.struct(F.coalesce(start == F.lit(current).cast("int"), F.lit(False)).alias("a"), (-F.col("entry_index")).alias("b"))
    by = d.groupBy(*group).agg(
        pages(table, few).alias("b"), pages(F.col("layout_hint") == "equation", F.sequence(start, end)).alias("c"), F.max_by(few, here).alias("e"),
    )
    none = F.array().cast("array<int>")
    if layouts is not None:
        linked = layouts.where("page_number > 0").groupBy(*group).agg(F.collect_set("page_number").alias("a"))
        by = by.join(linked, list(group), "full")
    else:
        by = by.withColumn("a", none)
    a, b, c, e = (F.array_sort(F.array_distinct(F.coalesce(x, none))) for x in ("a", "b", "c", "e"))
    cut = lambda x: F.slice(x, 1, most)
    kept = cut(b)
    if current is not None:
        kept = F.when(F.array_contains(b, current), F.array_sort(cut(F.array_distinct(F.concat(F.array(F.lit(current)), b))))).otherwise(kept)
    rest = cut(c) if warning else e if general else none
    return by.select(*group, F.when(F.size(a) > 0, cut(a)).when(F.size(b) > 0, kept).otherwise(rest).alias("pages")).where(F.size("pages") > 0)


def segment_bodies(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, entry_index, body): the source span of each entry in its document's text, else its preview."""
    d = entries.join(documents.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    a, b = F.col("source_char_start"), F.col("source_char_end")
    cut = F.substring("_text", (a + 1).cast("int"), (b - a).cast("int"))
    return d.select("doc_id", "entry_index", F.coalesce(F.when(a.isNotNull() & b.isNotNull(), strip(cut)), F.col("preview")).alias("body"))


def index_entries(chunks: DataFrame, preview_chars: int = 220) -> DataFrame:
    """Structural index entries of chunks: previews for all, whole text for tables, no nulls in text columns."""
    texts = ["section_heading", "subheading", "table_caption", "major_section", "category", "running_header", "layout_hint"]
    same = [
        "semantic_unit_id", "semantic_unit_index", "semantic_unit_page_start", "semantic_unit_page_end", "semantic_unit_char_count", "semantic_unit_block_count",
        "retrieval_chunk_index", "retrieval_chunk_count", "page_start", "page_end", "printed_page", "section_printed_page", "estimated_printed_page", "printed_page_offset",
        "char_count", "char_start", "char_end", "source_char_start", "source_char_end",
    ]
    t = strip(F.coalesce("text", F.lit("")))
    kind = F.coalesce("content_type", F.lit("prose"))
    return chunks.select(
        "doc_id", (F.col("chunk_index") - 1).alias("entry_index"), "chunk_index", *same, kind.alias("content_type"), *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
        preview(t, preview_chars).alias("preview"), F.when(kind == "table", t).otherwise(F.lit("")).alias("search_text"),
    )


def storage_mode(chunks: DataFrame, mode: str = "auto", limit: int = 300) -> DataFrame:
    """(doc_id, chunk_count, chunk_storage_mode): small documents keep their chunks, large ones only the index."""
    if mode not in ("auto", "persistent", "structural_only"):
        raise ValueError(f"unknown storage mode {mode!r}")
    n = chunks.groupBy("doc_id").agg(F.countDistinct("chunk_index").alias("chunk_count"))
    pick = F.when(F.col("chunk_count") <= limit, "persistent").otherwise("structural_only") if mode == "auto" else F.lit(mode)
    return n.withColumn("chunk_storage_mode", pick)
