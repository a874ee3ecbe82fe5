"""PDF sources: one row per page, word or box. They need pdfplumber or pypdf, which are imported only when used."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAGES = "path string, page_number int, text string"
WORDS = "path string, page_number int, text string, x0 double, x1 double, top double, bottom double, size double"
TABLES = "path string, page_number int, table_index int, bbox array<double>, grid array<array<string>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def _plumber(content: bytes):
    import pdfplumber

    return pdfplumber.open(io.BytesIO(content))


def page_text(page) -> str:
    """Text in geometric order; in text flow where a line says that the page is a table of contents."""
    text = page.extract_text(x_tolerance=1, y_tolerance=3) or ""
    if any(" ".join(x.split()).lower() == "table of contents" for x in text.splitlines()):
        text = page.extract_text(x_tolerance=1, y_tolerance=3, use_text_flow=True) or text
    return text


def extract_pages(files: DataFrame, extractor: str = "pdfplumber") -> DataFrame:
    """(path, page_number, text) of each page."""
    if extractor not in ("pdfplumber", "pypdf"):
        raise ValueError(f"unknown extractor {extractor!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                if extractor == "pypdf":
                    from pypdf import PdfReader

                    texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
                else:
                    with _plumber(content) as doc:
                        texts = [page_text(p) for p in doc.pages]
                yield pd.DataFrame({"path": path, "page_number": range(1, len(texts) + 1), "text": texts})

    return files.select("path", "content").mapInPandas(run, PAGES)


def extract_words(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """(path, page_number, text, x0, x1, top, bottom, size) of the words of all or some pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with _plumber(content) as doc:
                    for n in pages or range(1, len(doc.pages) + 1):
                        words = doc.pages[n - 1].extract_words(extra_attrs=["size"])
                        cols = ("text", "x0", "x1", "top", "bottom", "size")
                        yield pd.DataFrame({"path": path, "page_number": n, **{c: [w[c] for w in words] for c in cols}})

    return files.select("path", "content").mapInPandas(run, WORDS)


def extract_tables(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """(path, page_number, table_index, bbox, grid) of the ruled tables of all or some pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with _plumber(content) as doc:
                    for n in pages or range(1, len(doc.pages) + 1):
                        found = doc.pages[n - 1].find_tables()
                        yield pd.DataFrame(
                            {"path": path, "page_number": n, "table_index": range(1, len(found) + 1), "bbox": [[round(float(x), 3) for x in t.bbox] for t in found], "grid": [t.extract() for t in found]}
                        )

    return files.select("path", "content").mapInPandas(run, TABLES)


def render_pages(files: DataFrame, pages: list[int], resolution: int = 144) -> DataFrame:
    """(path, page_number, png) previews."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with _plumber(content) as doc:
                    out = []
                    for n in pages:
                        buffer = io.BytesIO()
                        doc.pages[n - 1].to_image(resolution=resolution).save(buffer, format="PNG")
                        out.append(buffer.getvalue())
                    yield pd.DataFrame({"path": path, "page_number": pages, "png": out})

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, png binary")


def suggest_titles(words: DataFrame) -> DataFrame:
    """(path, title): the prominent words of the first five pages' first prominent page, with an edition if one is named.

    Prominent: at least 14 points and 0.85 of the largest size of the page. Titles have 3 to 180 characters.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    d = words.where("page_number <= 5").withColumn("_max", F.max("size").over(Window.partitionBy("path", "page_number")))
    edition = F.regexp_extract(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda w: w["text"]), " "), "(?i)\\b((?:\\d+(?:st|nd|rd|th)?|[A-Za-z-]+)\\s+edition)\\b", 1)
    eds = d.groupBy("path", "page_number").agg(edition.alias("_e"))
    big = d.where((F.col("_max") >= 14) & (F.col("size") >= 0.85 * F.col("_max")))
    row = F.struct(F.round(F.col("top") / 5).alias("r"), "x0", "text")
    titles = big.groupBy("path", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda w: w["text"]), " ").alias("t"))
    titles = titles.where(F.length("t").between(3, 180)).join(eds, ["path", "page_number"])
    first = titles.groupBy("path").agg(F.min_by(F.struct("t", "_e"), "page_number").alias("x"))
    return first.select("path", F.concat("x.t", F.when(F.col("x._e") != "", F.concat(F.lit(" — "), F.col("x._e"))).otherwise("")).alias("title"))
