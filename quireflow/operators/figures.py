"""Figures: regions between captions, labels, links and their searchable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import caption_key, strip
from .artifacts import link_figures

#: Margins of a figure's crop (sides, top, bottom) and slack of the word band (top, bottom) and of the object band.
SIDE, ABOVE, BELOW, BAND_TOP, BAND_BOTTOM, SLACK = 10, 8, 5, 2, 1, 1


def figure_regions(lines: DataFrame, words: DataFrame, objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Figure layouts: the graphics between one caption and the one before it on the page.

    lines: doc_id, page_number, line_index, top, bottom, text, tokens ARRAY<STRUCT<x0, x1, text>>; words: doc_id,
    page_number, x0, x1, top, bottom; objects: doc_id, page_number, kind (line, rect, curve, image), x0, top, x1,
    bottom; pages: doc_id, page_number, bbox. A caption without graphics gives no figure, but counts and still ends
    the band of the next one. Objects with a missing side are left out. All joins are keyed by page.
    """
    page = ["doc_id", "page_number"]
    w = Window.partitionBy(*page).orderBy("line_index")
    caps = lines.where(P.is_figure_caption(F.col("text"))).join(pages.select(*page, "bbox"), page)
    caps = caps.select(
        *page, F.row_number().over(w).alias("figure_index"), strip(F.col("text")).alias("caption"), F.col("top").alias("_ct"), F.col("bottom").alias("_cb"), F.col("bbox").alias("_page"),
        F.coalesce(F.lag("bottom").over(w), F.get("bbox", F.lit(1))).alias("_from"), F.array_min(F.transform("tokens", lambda t: t["x0"])).alias("_x0"), F.array_max(F.transform("tokens", lambda t: t["x1"])).alias("_x1"),
    )
    o = objects.where("x0 is not null and x1 is not null and top is not null and bottom is not null")
    band = caps.join(o, page).where((F.col("top") >= F.col("_from") - SLACK) & (F.col("bottom") <= F.col("_ct") + SLACK))
    regions = band.groupBy(*page, "figure_index", "caption", "_cb", "_page", "_x0", "_x1").agg(
        F.min("top").alias("_top"), F.min("x0").alias("_gx0"), F.max("x1").alias("_gx1"), F.count_if(F.col("kind").isin("line", "rect", "curve")).alias("vector_object_count"),
        F.count_if(F.col("kind") == "image").alias("embedded_image_count"),
    )
    key = [*page, "figure_index"]
    inside = (F.col("top") >= F.col("_top") - BAND_TOP) & (F.col("bottom") <= F.col("_cb") + BAND_BOTTOM)
    near = regions.select(*key, "_top", "_cb").join(words, page).where(inside).groupBy(*key).agg(F.min("x0").alias("_wx0"), F.max("x1").alias("_wx1"))
    text = regions.select(*key, "_top", "_cb").join(lines, page).where(inside & (strip(F.col("text")) != ""))
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", strip(F.col("text")).alias("t")))), lambda x: x["t"]), "\n")
    labels = text.groupBy(*key).agg(label.alias("label_text"))
    d = regions.join(near, key, "left").join(labels, key, "left")
    at = lambda i: F.get("_page", F.lit(i))
    box = F.array(
        F.greatest(at(0), F.least("_gx0", "_x0", F.coalesce("_wx0", "_gx0")) - SIDE), F.greatest(at(1), F.col("_top") - ABOVE),
        F.least(at(2), F.greatest("_gx1", "_x1", F.coalesce("_wx1", "_gx1")) + SIDE), F.least(at(3), F.col("_cb") + BELOW),
    )
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    layout = F.concat(F.lit("page_"), number("page_number", 4), F.lit("_figure_"), number("figure_index", 2))
    return d.select(
        "doc_id", layout.alias("layout_id"), "page_number", "figure_index", "caption", caption_key(F.col("caption")).alias("caption_key"), F.transform(box, lambda x: F.round(x, 3)).alias("bbox"),
        F.coalesce("label_text", F.lit("")).alias("label_text"), "vector_object_count", "embedded_image_count",
    )


def label_text(label: Column, caption: Column) -> Column:
    """The label text through its caption; what follows the caption is prose."""
    t, c = strip(F.coalesce(label, F.lit(""))), strip(F.coalesce(caption, F.lit("")))
    at = F.instr(t, c)
    return F.when((t != "") & (c != "") & (at > 0), strip(F.substring(t, F.lit(1), at + F.length(c) - 1))).otherwise(t)


def remove_labels(body: Column, labels: Column) -> Column:
    """``body`` without the first occurrence of each label, white space between its words aside; blank lines collapse."""

    def cut(acc: Column, label: Column) -> Column:
        words = F.filter(F.split(label, "(?U)\\s+"), lambda x: x != "")
        pattern = F.array_join(F.transform(words, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "(?U:\\s+)")
        hit = F.when(F.size(words) > 0, F.regexp_substr(acc, pattern))
        at = F.instr(acc, hit)
        return F.when(hit.isNull(), acc).otherwise(F.concat(F.substring(acc, F.lit(1), at - 1), F.substring(acc, at + F.length(hit), F.length(acc))))

    return strip(F.regexp_replace(F.aggregate(labels, body, cut), "\\n(?:[ \\t]*\\n){2,}", "\n\n"))


def apply_figures(entries: DataFrame, figures: DataFrame) -> DataFrame:
    """Entries with figure_layout_ids and figure_search_text of the figures linked to them, in figure order."""
    links = link_figures(entries, figures).join(figures.select("doc_id", "layout_id", "page_number", "figure_index", "label_text"), ["doc_id", "layout_id"])
    one = F.array_sort(F.collect_list(F.struct("page_number", "figure_index", "layout_id", strip(F.coalesce("label_text", F.lit(""))).alias("t"))))
    per = links.groupBy("doc_id", "entry_index").agg(one.alias("_f"))
    texts = F.filter(F.array_distinct(F.transform("_f", lambda x: x["t"])), lambda x: x != "")
    per = per.select("doc_id", "entry_index", F.transform("_f", lambda x: x["layout_id"]).alias("figure_layout_ids"), F.array_join(texts, "\n\n").alias("figure_search_text"))
    base = entries.drop("figure_layout_ids", "figure_search_text")
    return base.join(per, ["doc_id", "entry_index"], "left")
