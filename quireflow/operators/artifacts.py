"""Table and figure layouts: geometry, links to entries, series, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import caption_key, math_glyphs, series_key, strip

#: Vertical tolerance of a text line; reach of a caption above a table; least columns and lines of packed rows.
LINE_TOLERANCE, CAPTION_BAND, PACKED_COLUMNS, PACKED_LINES = 2.0, 42.0, 3, 5
# Numeric token of packed tables; caption inside flattened text.
NUMERIC = "(?i)^(?:[+-]?\\d+(?:[.,]\\d+)?|P)$"
CAPTION = "(?i)\\bTable\\s+\\d+[A-Za-z]?(?:[.:-]|\\s)"


def contains_box(outer: str, inner: str) -> Column:
    o, i = (lambda k: F.get(F.col(outer), F.lit(k))), (lambda k: F.get(F.col(inner), F.lit(k)))
    return (o(0) <= i(0)) & (o(1) <= i(1)) & (o(2) >= i(2)) & (o(3) >= i(3))


def drop_nested(layouts: DataFrame) -> DataFrame:
    """Layouts that lie in no other, different box of the same page: an anti join keyed by page."""
    outer = layouts.select(F.col("doc_id").alias("_d"), F.col("page_number").alias("_n"), F.col("bbox").alias("_b")).where("_b is not null").distinct()
    inside = (F.col("doc_id") == F.col("_d")) & (F.col("page_number") == F.col("_n")) & (F.col("bbox") != F.col("_b")) & contains_box("_b", "bbox")
    return layouts.join(outer, inside, "left_anti")


def baseline_lines(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Words (doc_id, page_number, text, x0, x1, top, bottom) to lines: a word joins a line while it is within
    ``tolerance`` of the mean top of the line so far. A fold over the sorted words of a page."""
    start = F.struct(F.array().cast("array<array<struct<top:double,x0:double,x1:double,bottom:double,text:string>>>").alias("done"), F.array().cast("array<struct<top:double,x0:double,x1:double,bottom:double,text:string>>").alias("now"), F.lit(0.0).alias("sum"))

    def step(a: Column, w: Column) -> Column:
        n = F.size(a["now"])
        joins = (n == 0) | (F.abs(w["top"] - a["sum"] / F.greatest(n, F.lit(1))) <= tolerance)
        return F.when(joins, F.struct(a["done"].alias("done"), F.array_append(a["now"], w).alias("now"), (a["sum"] + w["top"]).alias("sum"))).otherwise(
            F.struct(F.array_append(a["done"], a["now"]).alias("done"), F.array(w).alias("now"), w["top"].alias("sum"))
        )

    word = F.struct(*[F.col(c).cast("double").alias(c) for c in ("top", "x0", "x1", "bottom")], "text")
    g = words.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(word)).alias("w"))
    lines = F.aggregate("w", start, step, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"]))
    d = g.select("doc_id", "page_number", F.posexplode(lines).alias("line_index", "_l"))
    by_x = F.array_sort(F.transform("_l", lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text"))))
    return d.select(
        "doc_id", "page_number", "line_index", F.round(F.array_min(F.transform("_l", lambda w: w["top"])), 3).alias("top"), F.round(F.array_max(F.transform("_l", lambda w: w["bottom"])), 3).alias("bottom"),
        F.array_join(F.transform(by_x, lambda w: w["text"]), " ").alias("text"), by_x.alias("tokens"),
    )


def caption_above(lines: DataFrame, tables: DataFrame, band: float = CAPTION_BAND) -> DataFrame:
    """(doc_id, page_number, table_index, caption): the last caption line within ``band`` points above each table."""
    t = tables.select("doc_id", "page_number", "table_index", F.get("bbox", F.lit(1)).alias("_top"))
    hit = lines.where(F.col("text").rlike(CAPTION)).join(t, ["doc_id", "page_number"]).where((F.col("bottom") <= F.col("_top")) & (F.col("bottom") >= F.col("_top") - band))
    return hit.groupBy("doc_id", "page_number", "table_index").agg(F.max_by(strip(F.col("text")), "top").alias("caption"))


def link_tables(entries: DataFrame, layouts: DataFrame) -> DataFrame:
    """(doc_id, entry_index, layout_id): the table layout of each captioned or table entry.

    On the entry's page the first layout whose caption key contains the entry's, or lies in it; else the page's
    only layout.
    """
    key = caption_key(F.coalesce("table_caption", F.lit("")))
    e = entries.where((F.col("content_type") == "table") | (F.coalesce("table_caption", F.lit("")) != "")).select("doc_id", "entry_index", F.col("page_start").alias("page_number"), key.alias("k"))
    x = layouts.select("doc_id", "page_number", "layout_id", F.coalesce("table_index", F.lit(0)).alias("i"), caption_key(F.coalesce("caption", F.lit(""))).alias("c")).distinct()
    x = x.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page_number")))
    d = e.join(x, ["doc_id", "page_number"])
    match = (F.col("k") != "") & (F.col("c") != "") & (F.contains("k", "c") | F.contains("c", "k"))
    w = Window.partitionBy("doc_id", "entry_index").orderBy(F.desc("m"), "i", "layout_id")
    d = d.withColumn("m", match.cast("int")).where((F.col("m") == 1) | (F.col("n") == 1))
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "entry_index", "layout_id")


def link_figures(entries: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, layout_id, entry_index): per figure the first entry of its page whose body holds the caption key, else the page's first."""
    body = caption_key(F.coalesce(*[c for c in ("body", "preview") if c in entries.columns], F.lit("")))
    e = entries.select("doc_id", "entry_index", F.col("page_start").alias("page_number"), body.alias("_body")).where("page_number is not null")
    f = figures.select("doc_id", "page_number", "layout_id", caption_key(F.coalesce("caption", F.lit(""))).alias("k"))
    d = f.join(e, ["doc_id", "page_number"]).withColumn("m", ((F.col("k") != "") & F.contains("_body", "k")).cast("int"))
    w = Window.partitionBy("doc_id", "layout_id").orderBy(F.desc("m"), "entry_index")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "layout_id", "entry_index")


def figures_of_entries(links: DataFrame) -> DataFrame:
    """(doc_id, entry_index, figure_layout_ids), ids distinct and sorted."""
    return links.groupBy("doc_id", "entry_index").agg(F.array_sort(F.collect_set("layout_id")).alias("figure_layout_ids"))


def table_series(layouts: DataFrame) -> DataFrame:
    """(doc_id, layout_id, series_key, series, place): tables of one caption on neighbouring pages belong together.

    A gap of more than one page starts a new series; layouts without caption stand alone.
    """
    d = layouts.select("doc_id", "layout_id", "page_number", F.coalesce("table_index", F.lit(0)).alias("table_index"), series_key(F.coalesce("caption", F.lit(""))).alias("series_key")).distinct()
    group = F.when(F.col("series_key") == "", F.concat(F.lit("\u0000"), "layout_id")).otherwise(F.col("series_key"))
    d = d.withColumn("_g", group)
    w = Window.partitionBy("doc_id", "_g").orderBy("page_number", "table_index", "layout_id")
    d = d.withColumn("_new", F.coalesce((F.col("page_number") - F.lag("page_number").over(w) > 1).cast("int"), F.lit(0)))
    d = d.withColumn("series", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("doc_id", "_g", "series").orderBy("page_number", "table_index", "layout_id"))
    return d.select("doc_id", "layout_id", "series_key", "series", place.alias("place"))


def table_cell(layouts: DataFrame, row: int, column: int) -> DataFrame:
    """(doc_id, layout_id, value): one cell of each grid by 1-based position; layouts without it have no row."""
    if row < 1 or column < 1:
        raise ValueError("row and column count from 1")
    d = layouts.select("doc_id", "layout_id", F.get("grid", F.lit(row - 1)).alias("_r")).where(F.size("_r") >= column)
    return d.select("doc_id", "layout_id", F.get("_r", F.lit(column - 1)).alias("value")).distinct()


def display_layouts(layouts: DataFrame) -> DataFrame:
    """Layouts with the glyphs of symbol fonts made readable in caption, text and every grid cell."""
    grid = F.transform("grid", lambda r: F.transform(r, math_glyphs))
    return layouts.withColumn("caption", math_glyphs(F.col("caption"))).withColumn("reading_order_text", math_glyphs(F.col("reading_order_text"))).withColumn("grid", grid)


def recover_packed_rows(layouts: DataFrame) -> DataFrame:
    """(doc_id, layout_id, grid): tables whose physical rows pack several logical rows of numbers.

    layouts: doc_id, layout_id, boxes ARRAY<ARRAY<STRUCT<x0, x1>>> (columns of each physical row), lines
    ARRAY<ARRAY<ARRAY<STRUCT<x0, x1, text>>>> (tokens of each text line of each physical row), cells
    ARRAY<ARRAY<STRING>> (text of each physical row). A token belongs to the one column whose half-open span
    holds its middle. Any ambiguity rejects the whole table; one without an expanded row has no result.
    """

    mid = lambda t: (t["x0"] + t["x1"]) / 2
    inside = lambda t, b: (mid(t) >= b["x0"]) & (mid(t) < b["x1"])

    def clear(line: Column, boxes: Column) -> Column:
        """Every token is numeric and in one column, every column holds one token."""
        tokens = F.forall(line, lambda t: t["text"].rlike(NUMERIC) & (F.size(F.filter(boxes, lambda b: inside(t, b))) == 1))
        return tokens & F.forall(boxes, lambda b: F.size(F.filter(line, lambda t: inside(t, b))) == 1)

    def values(line: Column, boxes: Column) -> Column:
        return F.transform(boxes, lambda b: F.get(F.filter(line, lambda t: inside(t, b)), F.lit(0))["text"])

    sound = lambda z: z["boxes"].isNotNull() & (F.size(z["boxes"]) >= PACKED_COLUMNS) & ~F.exists(z["boxes"], lambda b: b.isNull())
    packed = lambda z: F.size(z["lines"]) >= PACKED_LINES
    good = lambda z: sound(z) & (~packed(z) | F.forall(z["lines"], lambda x: clear(x, z["boxes"])))
    rows = lambda z: F.when(packed(z), F.transform(z["lines"], lambda x: values(x, z["boxes"]))).otherwise(F.array(z["cells"]))
    d = layouts.select("doc_id", "layout_id", F.arrays_zip("boxes", "lines", "cells").alias("_z"))
    d = d.where(F.forall("_z", good) & F.exists("_z", packed))
    return d.select("doc_id", "layout_id", F.flatten(F.transform("_z", rows)).alias("grid"))


def expand_page_spec(spec: str) -> list[int]:
    """``754,760-762`` to sorted distinct pages; pages below 1 and descending ranges are errors."""
    pages: set[int] = set()
    for part in filter(None, (x.strip() for x in spec.split(","))):
        a, _, b = part.partition("-")
        lo, hi = int(a), int(b or a)
        if lo < 1 or hi < lo:
            raise ValueError(f"bad page range {part!r}")
        pages.update(range(lo, hi + 1))
    return sorted(pages)


def replace_pages(old: DataFrame, new: DataFrame, pages: list[int]) -> DataFrame:
    """Layouts of other pages stay, those of ``pages`` are replaced by ``new``."""
    return old.where(~F.col("page_number").isin(pages)).unionByName(new, allowMissingColumns=True)


def primes(limit: int, spark) -> DataFrame:
    """Primes up to ``limit`` by anti-joining the composites."""
    n = spark.range(2, limit + 1).withColumnRenamed("id", "n")
    root = int(limit**0.5)
    composites = spark.range(2, max(root, 2) + 1).select(F.explode(F.when(F.col("id") * F.col("id") <= limit, F.sequence(F.col("id") * F.col("id"), F.lit(limit), F.col("id")))).alias("n"))
    return n.join(composites.distinct(), "n", "left_anti")
