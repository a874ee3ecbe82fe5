"""Jobs that bring extracted table layouts into the index, and the layout store."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import leading_caption
from ..functions.text import strip
from ..operators.artifacts import link_tables, replace_pages
from ..session import materialize
from .stores import exists, replace_documents


def table_pages(entries: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """(doc_id, page_number): pages to extract: those selected, else those of table and captioned entries."""
    caption = F.coalesce(F.when(F.col("table_caption") != "", F.col("table_caption")), leading_caption(F.col("preview")), leading_caption(F.col("search_text")))
    d = entries.where(((F.col("content_type") == "table") | caption.isNotNull()) & F.col("page_start").isNotNull())
    d = d.select("doc_id", F.col("page_start").alias("page_number"))
    return (d.where(F.col("page_number").isin(pages)) if pages else d).distinct()


def apply_layouts(entries: DataFrame, layouts: DataFrame) -> DataFrame:
    """Entries linked to layouts: captioned prose becomes a table, and the layout's text becomes searchable once."""
    links = link_tables(entries, layouts).join(layouts.select("doc_id", "layout_id", F.col("caption").alias("_c"), strip(F.coalesce("reading_order_text", F.lit(""))).alias("_t")).distinct(), ["doc_id", "layout_id"])
    d = entries.drop("table_layout_id").join(links.withColumnRenamed("layout_id", "table_layout_id"), ["doc_id", "entry_index"], "left")
    hit, old = F.col("table_layout_id").isNotNull(), strip(F.coalesce("search_text", F.lit("")))
    more = F.concat_ws("\n\n", F.when(old != "", old), F.col("_t"))
    new = {
        "table_caption": F.when(hit & (F.col("content_type") != "table"), F.coalesce("_c", F.lit(""))).otherwise(F.col("table_caption")),
        "search_text": F.when(hit & (F.col("_t") != "") & ~F.contains(old, F.col("_t")), more).otherwise(F.col("search_text")),
        "content_type": F.when(hit, F.lit("table")).otherwise(F.col("content_type")),
    }
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in d.columns if c not in ("_c", "_t")])


def store_layouts(old: DataFrame | None, new: DataFrame, path: str, pages: list[int] | None = None) -> None:
    """Replace the layouts of ``new``'s documents (of the selected pages only, if given) in the store."""
    kept = new
    if old is not None and pages:
        same = old.join(new.select("doc_id").distinct(), "doc_id", "left_semi")
        kept = replace_pages(same, new, pages)
    replace_documents(materialize(kept), path, new)


def manifest(layouts: DataFrame) -> DataFrame:
    """The compact record of each layout: no grid, cells or lines, and no caption key."""
    return layouts.select("doc_id", "layout_id", "page_number", "table_index", "caption", "bbox", "row_count", "column_count")


def migrate_documents(spark: SparkSession, source: str, schema: str, path: str) -> int:
    """Move inline layouts of JSON documents (doc_id, storage_mode, layouts) to the store; sharded ones are left, so a second run moves nothing new.

    ``schema`` is the DDL of one layout. Returns the number of layouts moved.
    """
    docs = spark.read.schema(f"doc_id string, storage_mode string, layouts array<struct<{schema}>>").option("multiLine", True).option("mode", "PERMISSIVE").json(source)
    rows = docs.where("doc_id is not null and coalesce(storage_mode, '') <> 'sharded'").select("doc_id", F.explode("layouts").alias("l")).select("doc_id", "l.*")
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("doc_id").distinct(), "doc_id", "left_anti")
    n = rows.count()
    if n:
        replace_documents(rows, path)
    return n


def read_json_tables(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One JSON document (object or array) per folder below ``root``, unreadable files skipped."""
    raw = spark.read.text(os.path.join(root, "*", name), wholetext=True)
    many = F.from_json("value", f"array<struct<{schema}>>")
    one = F.array(F.from_json("value", f"struct<{schema}>"))
    rows = F.when(F.startswith(F.ltrim("value"), F.lit("[")), many).otherwise(one)
    return raw.select(F.explode(rows).alias("x")).where(F.to_json("x") != "{}").select("x.*")


def verify_prime_layouts(layouts: DataFrame, limit: int, spark: SparkSession) -> DataFrame:
    """(number, problem): primes up to ``limit`` missing from the grids, and numbers in them that are no primes."""
    from ..operators.artifacts import primes

    cells = layouts.select(F.explode(F.flatten("grid")).alias("v")).where(F.col("v").rlike("^\\d+$")).select(F.col("v").cast("long").alias("number")).distinct()
    true = primes(limit, spark).select(F.col("n").alias("number"))
    return true.exceptAll(cells).select("number", F.lit("missing").alias("problem")).unionByName(cells.exceptAll(true).select("number", F.lit("extra").alias("problem")))
