"""Registry and notes as a curator sees them: listings, lookups, counts, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import generated_slug, path_parts, strip
from .context import note_chunk_index

COLLECTIONS = ("general", "public", "private")
MAX_TITLE, LAST = 300, 999999


def latest_documents(registry: DataFrame) -> DataFrame:
    """One row per doc_id: the version updated last (then created last). Withdrawn documents stay, marked by deleted_at."""
    w = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.desc_nulls_last("deleted_at"), F.desc_nulls_last("title"), F.desc_nulls_last("status"))
    return registry.where("doc_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def list_documents(registry: DataFrame, view: str = "general") -> DataFrame:
    """Live documents with defaults for missing fields, newest first; the view ``general`` filters nothing."""
    d = latest_documents(registry).where("deleted_at is null")
    d = d.withColumn("collection", F.coalesce("collection", F.lit("general"))).withColumn("chunk_storage_mode", F.coalesce("chunk_storage_mode", F.lit("persistent")))
    d = d.withColumn("table_layout_count", F.coalesce("table_layout_count", F.lit(0))).withColumn("title", F.coalesce("title", F.lit("")))
    if view != "general":
        d = d.where(F.col("collection") == view)
    return d.orderBy(F.desc_nulls_last("updated_at"), F.desc("doc_id"))


def collection_counts(registry: DataFrame) -> DataFrame:
    """(collection, documents, structural_only) of the live documents."""
    return list_documents(registry).groupBy("collection").agg(F.count("*").alias("documents"), F.count_if(F.col("chunk_storage_mode") == "structural_only").alias("structural_only"))


def get_document(registry: DataFrame, doc_id: str) -> DataFrame:
    return latest_documents(registry.where(F.col("doc_id") == doc_id))


def get_note(notes: DataFrame, note_id: str) -> DataFrame:
    """The first note of an id."""
    w = Window.orderBy("id")
    return notes.where(F.col("note_id") == note_id).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_origin(notes: DataFrame) -> DataFrame:
    return notes.withColumn("origin", F.coalesce("note_origin", P.note_origin(F.col("is_generated"), F.col("category_parts"))))


def list_notes(notes: DataFrame, view: str = "all") -> DataFrame:
    """Notes of one origin (all, manual, generated, system), by category, source, title and chunk number."""
    d = with_origin(notes)
    if view != "all":
        d = d.where(F.col("origin") == view)
    d = d.withColumn("chunk_index", F.coalesce(note_chunk_index(d), F.lit(LAST)))
    return d.orderBy("category", F.coalesce("source_doc_id", F.lit("")), F.lower("title"), "chunk_index", "id")


def origin_counts(notes: DataFrame) -> DataFrame:
    return with_origin(notes).groupBy("origin").agg(F.countDistinct("note_id").alias("notes"))


def titled_notes(notes: DataFrame, registry: DataFrame) -> DataFrame:
    """Generated notes take their document's title (with the chunk number); the old title becomes an alias.

    The registry join is a plain left join on doc_id: the planner broadcasts it only if its size allows.
    """
    docs = latest_documents(registry).select(F.col("doc_id").alias("_d"), F.col("title").alias("_title"))
    d = notes.join(docs, F.trim("source_doc_id") == F.col("_d"), "left")
    n = note_chunk_index(notes)
    new = F.concat(F.col("_title"), F.coalesce(F.concat(F.lit(" - chunk "), n.cast("string")), F.lit("")))
    use = F.coalesce(F.col("is_generated"), F.lit(False)) & (F.coalesce("_title", F.lit("")) != "")
    aliases = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.lower(F.coalesce("title", F.lit(""))))
    return d.select(*[F.when(use, new).otherwise(F.col("title")).alias("title") if c == "title" else F.when(use, aliases).otherwise(F.col("aliases")).alias("aliases") if c == "aliases" else notes[c] for c in notes.columns])


def folder_tree(notes: DataFrame) -> DataFrame:
    """(path, parent, depth, name): every folder above a note."""
    parts = path_parts(F.col("category"))
    d = notes.where("category is not null").select(parts.alias("p")).where(F.size("p") > 0).distinct()
    d = d.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", F.lit(1), i))).alias("p")).distinct()
    n = F.size("p")
    return d.select(F.array_join("p", "/").alias("path"), F.when(n > 1, F.array_join(F.slice("p", F.lit(1), n - 1), "/")).otherwise("").alias("parent"), n.alias("depth"), F.element_at("p", -1).alias("name"))


def clean_title(c: Column) -> Column:
    """A title of 1 to 300 characters without control characters, blanks collapsed; else null."""
    t = F.regexp_replace(strip(c), "(?U)\\s+", " ")
    return F.when((t != "") & (F.length(t) <= MAX_TITLE) & ~t.rlike("\\p{Cntrl}"), t)


def update_details(registry: DataFrame, doc_id: str, title: str, collection: str) -> DataFrame:
    """The registry with a new title and collection for one document; bad values are errors."""
    t = " ".join(title.split())
    if not 1 <= len(t) <= MAX_TITLE or any(ord(x) < 32 for x in t):
        raise ValueError("a title has 1 to 300 printable characters")
    if collection not in COLLECTIONS:
        raise ValueError(f"collection must be one of {COLLECTIONS}")
    it = F.col("doc_id") == doc_id
    new = {"title": F.lit(t), "collection": F.lit(collection), "title_source": F.lit("manual"), "updated_at": F.current_timestamp()}
    return registry.select(*[F.when(it, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in registry.columns])


def backfill_note_ids(notes: DataFrame) -> DataFrame:
    """Notes without an id get one from their path; ids that exist stay."""
    made = F.concat(F.lit("note_"), F.substring(F.sha1(F.col("relative_path").cast("binary")), 1, 12))
    return notes.withColumn("note_id", F.coalesce(F.when(F.col("note_id") != "", F.col("note_id")), made))


# The header lines of generated notes, in their order, with the chunk's fields they hold.
CHUNK_HEADER = [
    "semantic_unit_id", "semantic_unit_index", "semantic_unit_page_start", "semantic_unit_page_end", "semantic_unit_char_count", "semantic_unit_block_count",
    "retrieval_chunk_index", "retrieval_chunk_count", "page_start", "page_end", "section_heading", "content_type", "table_caption", "char_count",
]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _documents(registry: DataFrame) -> DataFrame:
    d = latest_documents(registry)
    base = F.trim(F.replace(F.coalesce("title", F.lit("")), F.lit("_"), F.lit(" ")))
    return d.select("doc_id", base.alias("_base"), generated_slug(F.coalesce("title", F.lit(""))).alias("_slug"), _text(F.col("source_filename")).alias("_file"), path_parts(F.coalesce("category_path", F.lit(""))).alias("_parts"))


def generated_note_text(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, relative_path, text): a Markdown note per chunk with a header of key: value lines.

    A missing caption is written ``None``, as readers of such notes expect.
    """
    d = chunks.join(_documents(registry), "doc_id")
    n = F.col("chunk_index").cast("string")
    n = F.when(F.length(n) >= 4, n).otherwise(F.lpad(n, 4, "0"))
    field = {c: _text(F.col(c)) for c in CHUNK_HEADER} | {"table_caption": F.coalesce("table_caption", F.lit("None")), "content_type": F.coalesce("content_type", F.lit("prose"))}
    head = [
        ("title", F.concat("_base", F.lit(" - chunk "), n)), ("note_id", F.concat(F.lit("note_"), "doc_id", F.lit("_chunk_"), n)),
        ("tags", F.array_join(F.concat(F.array(F.lit("generated"), F.lit("ingested_pdf")), F.col("_parts")), ", ")), ("aliases", F.concat("_base", F.lit(" chunk "), n)),
        ("source_doc_id", F.col("doc_id")), ("source_filename", F.col("_file")), ("chunk_index", _text(F.col("chunk_index"))), *field.items(),
    ]
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in head])
    path = F.concat_ws("/", F.lit("_generated"), F.array_join("_parts", "/"), "doc_id", F.concat("_slug", F.lit("__chunk_"), n, F.lit(".md")))
    return d.select("doc_id", "chunk_index", path.alias("relative_path"), F.concat(lines, F.lit("\n\n"), strip(_text(F.col("text"))), F.lit("\n")).alias("text"))


# The lines of the one note that stands for a document stored structurally.
ANCHOR_BODY = "This document is stored in structural-only mode."
ANCHOR_END = ["Persistent chunk notes were not generated.", "", "Use Structure View to browse the structural index and open transient reconstructed segments."]


def anchor_note_text(registry: DataFrame) -> DataFrame:
    """(doc_id, relative_path, text): one note per structurally stored document, in place of a note per chunk."""
    d = latest_documents(registry).where("chunk_storage_mode = 'structural_only'").join(_documents(registry), "doc_id")
    col = lambda c: _text(F.col(c)) if c in registry.columns else F.lit("")
    tags = F.array_join(F.concat(F.array(*map(F.lit, ("generated", "ingested_pdf", "structural_only"))), F.col("_parts")), ", ")
    head = [
        ("title", F.col("_base")), ("tags", tags), ("note_id", F.concat(F.lit("note_"), "doc_id", F.lit("_structural_anchor"))), ("aliases", F.col("_base")), ("source_doc_id", F.col("doc_id")),
        ("source_filename", F.col("_file")), ("file_type", col("file_type")), ("page_count", col("page_count")), ("chunk_count_estimate", col("chunk_count")),
        ("chunk_storage_mode", col("chunk_storage_mode")), ("structural_index_file", col("structural_index_file")),
    ]
    again = [("title", F.col("_base")), ("source file", F.col("_file")), ("pages", col("page_count")), ("Structural entries", col("chunk_count")), ("Storage mode", col("chunk_storage_mode"))]
    line = lambda kv: F.concat(F.lit(f"{kv[0]}: "), kv[1])
    parts = [*map(line, head), F.lit(""), F.lit(ANCHOR_BODY), F.lit(""), *map(line, again), F.lit(""), *map(F.lit, ANCHOR_END), F.lit("")]
    path = F.concat_ws("/", F.lit("_generated"), F.array_join("_parts", "/"), "doc_id", F.concat("_slug", F.lit("__document.md")))
    return d.select("doc_id", path.alias("relative_path"), F.concat_ws("\n", *parts).alias("text"))
