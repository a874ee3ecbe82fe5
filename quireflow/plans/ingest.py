"""The ingestion pipeline as DataFrames: registered texts to chunks, index entries and notes, and their tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.context import index_entries, storage_mode
from ..operators.curation import anchor_note_text, generated_note_text
from ..session import materialize
from . import chunker
from .stores import exists, replace_documents


@dataclass
class Ingested:
    registry: DataFrame
    chunks: DataFrame
    structural_index: DataFrame
    notes: DataFrame


def register(documents: DataFrame, category: str = "general") -> DataFrame:
    """Registry rows of new texts (path, text): the id is a hash of the content, so a text registers once."""
    name = F.regexp_replace("path", "^.*/", "")
    return documents.select(
        F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 24).alias("doc_id"), F.regexp_replace(name, "\\.[^.]*$", "").alias("title"), F.lit("filename").alias("title_source"),
        F.lit("general").alias("collection"), name.alias("source_filename"), F.lit(category).alias("category_path"), F.regexp_extract(name, "\\.([^.]*)$", 1).alias("file_type"),
        F.lit("registered").alias("status"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"), "text",
    ).dropDuplicates(["doc_id"])


def ingest(registered: DataFrame, max_chars: int = chunker.MAX_CHARS, mode: str = "auto", limit: int = 300) -> Ingested:
    """Clean, chunk and index registered documents; large ones keep the index only and get one anchor note."""
    cleaned = registered.withColumn("text", clean_text(F.col("text")))
    chunks = materialize(chunker.build_chunks(cleaned, max_chars=max_chars))
    modes = storage_mode(chunks, mode, limit)
    docs = registered.drop("text").join(modes, "doc_id", "left").withColumn("status", F.when(F.col("chunk_count") > 0, "chunked").otherwise("registered"))
    docs = docs.withColumn("page_count", F.lit(None).cast("int"))
    kept = chunks.join(modes.where("chunk_storage_mode = 'persistent'").select("doc_id"), "doc_id", "left_semi")
    notes = generated_note_text(kept, docs).drop("chunk_index").unionByName(anchor_note_text(docs))
    return Ingested(docs, kept, index_entries(chunks), notes)


TABLES = ("registry", "chunks", "structural_index", "notes")


def write(result: Ingested, root: str) -> None:
    """Replace the rows of the ingested documents in every table; the tables lie in hash buckets of doc_id."""
    for name in TABLES:
        replace_documents(getattr(result, name), os.path.join(root, name), result.registry)


def delete_document(spark: SparkSession, root: str, doc_id: str, table: str | None = None) -> None:
    """Drop the rows of one document, in one table or in all that are generated (chunks, index, notes)."""
    gone = spark.range(1).select(F.lit(doc_id).alias("doc_id"))
    for name in (table,) if table else TABLES[1:]:
        path = os.path.join(root, name)
        if exists(spark, path):
            replace_documents(spark.read.parquet(path).limit(0), path, gone)
