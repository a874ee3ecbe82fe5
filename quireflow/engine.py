"""The public API: an archive of tables and the operations on it, each returning DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import artifacts, context, curation, figures, nested, references, search
from .plans import ingest as ingestion
from .sources.tables import table


class Archive:
    """Tables ``chunks structural_index table_layout note doc_registry`` below ``root``.

    Tables may hold repeated deliveries; readers take each record once. ``figure_layout`` is optional.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    # tables

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def notes(self) -> DataFrame:
        """Notes once each, generated ones under their document's title."""
        return curation.titled_notes(self.table("note").dropDuplicates(["note_id"]), self.table("doc_registry"))

    def entries(self, doc_id: str | None = None) -> DataFrame:
        d = self.table("structural_index")
        return (d if doc_id is None else d.where(F.col("doc_id") == doc_id)).dropDuplicates(["doc_id", "entry_index"])

    def layouts(self, doc_id: str | None = None) -> DataFrame:
        """Layouts that are not withdrawn, once each."""
        d = self.table("table_layout").where("deleted_at is null").drop("extracted_at", "deleted_at")
        return (d if doc_id is None else d.where(F.col("doc_id") == doc_id)).dropDuplicates(["doc_id", "layout_id"])

    # search

    def search(self, query: str, scope: str = "all", fuzzy: bool = True) -> DataFrame:
        """(rank, score, id, title): notes, generated notes (``reference``), or all with the structural entries."""
        notes = self.notes()
        vocabulary = search.build_vocabulary(notes) if fuzzy else None
        found = search.search_notes(notes, query.lower(), vocabulary, scope)
        if scope == "notes":
            return found.select(F.col("position").alias("rank"), "score", F.col("id").cast("string").alias("id"), "title")
        structural = search.search_structural(self.entries(), curation.latest_documents(self.table("doc_registry")), query)
        return search.federate(found, structural)

    # documents and notes

    def documents(self, view: str = "general") -> DataFrame:
        return curation.list_documents(self.table("doc_registry"), view)

    def document(self, doc_id: str) -> DataFrame:
        return curation.get_document(self.table("doc_registry"), doc_id)

    def collection_counts(self) -> DataFrame:
        return curation.collection_counts(self.table("doc_registry"))

    def note(self, note_id: str) -> DataFrame:
        return curation.get_note(self.table("note"), note_id)

    def curator_notes(self, view: str = "all") -> DataFrame:
        return curation.list_notes(self.table("note").dropDuplicates(["note_id"]), view)

    def origin_counts(self) -> DataFrame:
        return curation.origin_counts(self.table("note"))

    def folders(self) -> DataFrame:
        return curation.folder_tree(self.table("note"))

    def source_note(self, doc_id: str) -> DataFrame:
        """The note that stands for a document."""
        return context.preferred_source_note(self.table("note").where(F.col("source_doc_id") == doc_id))

    def note_context(self, note_id: str) -> DataFrame:
        """Previous and next note of the same source."""
        return context.source_context(self.table("note").dropDuplicates(["note_id"])).where(F.col("note_id") == note_id)

    def updated_registry(self, doc_id: str, title: str, collection: str) -> DataFrame:
        return curation.update_details(self.table("doc_registry"), doc_id, title, collection)

    # structure

    def display_items(self, doc_id: str) -> DataFrame:
        return context.display_items(self.entries(doc_id)).orderBy("item", "card")

    def segment(self, doc_id: str, entry_index: int) -> DataFrame:
        """The entries of the semantic unit run that holds one entry, in order; without a unit the entry and its neighbours."""
        entries = self.entries(doc_id)
        runs = context.unit_runs(entries)
        here = runs.where(F.col("entry_index") == entry_index).select(F.col("first_entry").alias("_a"), F.col("last_entry").alias("_b"))
        unit = entries.where(F.col("entry_index") == entry_index).select((F.coalesce("semantic_unit_id", F.lit("")) == "").cast("int").alias("_wide"))
        span = here.join(unit).select((F.col("_a") - F.col("_wide")).alias("_a"), (F.col("_b") + F.col("_wide")).alias("_b"))
        return entries.join(F.broadcast(span), F.col("entry_index").between(F.col("_a"), F.col("_b"))).drop("_a", "_b").orderBy("entry_index")

    def verification_pages(self, doc_id: str) -> DataFrame:
        entries = self.entries(doc_id)
        linked = self.layouts(doc_id).join(entries.where("table_layout_id <> ''").select("doc_id", F.col("table_layout_id").alias("layout_id")).distinct(), ["doc_id", "layout_id"], "left_semi")
        return context.verification_pages(entries, linked.select("doc_id", "page_number"))

    def table_series(self, doc_id: str, layout_id: str) -> DataFrame:
        """The layouts of one table that goes on over neighbouring pages, in order."""
        series = artifacts.table_series(self.layouts(doc_id))
        here = series.where(F.col("layout_id") == layout_id).select("series_key", "series")
        shown = artifacts.display_layouts(self.layouts(doc_id))
        return series.join(here, ["series_key", "series"], "left_semi").join(shown, ["doc_id", "layout_id"]).orderBy("place")

    def table_cell(self, doc_id: str, layout_id: str, row: int, column: int) -> DataFrame:
        return artifacts.table_cell(self.layouts(doc_id).where(F.col("layout_id") == layout_id), row, column)

    def entries_with_figures(self, doc_id: str) -> DataFrame:
        """Entries with the ids and label texts of the figures linked to them."""
        return figures.apply_figures(self.entries(doc_id), self.table("figure_layout").where(F.col("doc_id") == doc_id))

    # integrity and shape

    def orphans(self) -> tuple[DataFrame, DataFrame]:
        """(orphan references, counts per table and month)."""
        return references.archive_orphans(*[self.table(t) for t in ("structural_index", "table_layout", "note", "doc_registry")])

    def flat_layouts(self) -> dict[str, DataFrame]:
        return nested.flatten_records(self.table("table_layout"), ["doc_id", "layout_id"])

    # ingestion

    def ingest(self, texts: DataFrame, category: str = "general") -> ingestion.Ingested:
        """(path, text) of marked texts to registry rows, chunks, index entries and notes."""
        return ingestion.ingest(ingestion.register(texts, category))


def original_file(base: str, document: str, name: str) -> str:
    """The path of a document's own file below ``base``; names that lead out of its folder are errors."""
    folder = os.path.realpath(os.path.join(base, document))
    full = os.path.realpath(os.path.join(folder, name))
    if os.path.dirname(folder) != os.path.realpath(base) or os.path.commonpath([full, folder]) != folder or not os.path.isfile(full):
        raise FileNotFoundError(name)
    return full


def fresh_preview(preview: str, source: str) -> bool:
    """A cached page preview may be used if it is not older than its source."""
    return os.path.isfile(preview) and os.path.getmtime(preview) >= os.path.getmtime(source)
