"""Marked text to pages, page furniture, and the classes of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import heading_key, strip

MARKER = "(?md)^--- PAGE (\\d+) ---[^\\S\\r\\n]*$"
MARGIN_LINES, MIN_PAGES, MIN_FRACTION, MAX_KEY = 3, 3, 0.10, 160


def to_pages(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page_seq, page_number, text, source_char_start, source_char_end) by the page markers.

    Text before the first marker is ignored. ``text`` of a page is stripped; its source span is exact.
    """
    t = F.col(text)
    d = documents.select(
        "doc_id", F.regexp_extract_all(t, F.lit(MARKER), F.lit(0)).alias("m"), F.regexp_extract_all(t, F.lit(MARKER), F.lit(1)).alias("n"), F.split(t, MARKER).alias("b")
    )
    d = d.where(F.size("m") > 0).withColumn("head", F.length(F.get("b", F.lit(0))))
    # where each page's marker begins, added up inside the row: no page text is shuffled for it
    sizes = F.transform("m", lambda x, i: F.length(x) + F.length(F.get("b", i + 1)))
    begins = F.slice(F.aggregate(sizes, F.array("head"), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(1), F.size("m"))
    d = d.withColumn("o", begins)
    zipped = F.arrays_zip(F.col("m"), F.col("n"), F.slice("b", F.lit(2), F.size("m")).alias("b"), F.col("o"))
    d = d.select("doc_id", F.posexplode(zipped).alias("i", "z")).select("doc_id", "i", F.col("z.m").alias("m"), F.col("z.n").alias("n"), F.col("z.b").alias("b"), F.col("z.o").alias("o"))
    start = F.col("o") + F.length("m") + F.length("b") - F.length(F.regexp_replace("b", "(?U)^\\s+", ""))
    body = strip(F.col("b"))
    d = d.withColumn("start", start).withColumn("body", body)
    return d.select(
        "doc_id", (F.col("i") + 1).alias("page_seq"), F.col("n").cast("int").alias("page_number"), F.col("body").alias("text"),
        F.col("start").cast("long").alias("source_char_start"), (F.col("start") + F.length("body")).cast("long").alias("source_char_end"),
    )


def join_pages(pages: DataFrame) -> DataFrame:
    """Pages back to one marked text per document."""
    part = F.concat(F.lit("\n--- PAGE "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", part.alias("t")))).alias("p"))
    return rows.select("doc_id", strip(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("text"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\\R")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: the planner does not copy it into the lambdas that use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_margins(pages: DataFrame, lines: str, count: int = MARGIN_LINES) -> DataFrame:
    """Adds ``margin``: the 0-based indexes of the first and last non-blank lines of a page."""
    d = once(pages, "_filled", F.filter(F.transform(lines, lambda x, i: F.when(strip(x) != "", i)), lambda i: i.isNotNull()))
    n = F.size("_filled")
    m = F.least(F.lit(count), F.greatest(F.lit(1), F.floor(n / 4))).cast("int")
    edge = F.concat(F.slice("_filled", F.lit(1), m), F.slice("_filled", F.greatest(n - m + 1, F.lit(1)), m))
    return once(d, "margin", F.when(n > 0, F.array_distinct(edge)).otherwise(F.array().cast("array<int>"))).drop("_filled")


def page_furniture(pages: DataFrame, count: int = MARGIN_LINES, min_pages: int = MIN_PAGES, fraction: float = MIN_FRACTION) -> DataFrame:
    """(doc_id, key): margin lines that recur on a share of a document's pages."""
    p = with_margins(pages.select("doc_id", lines_of(F.col("text")).alias("lines")), "lines", count)
    marginal = F.transform("margin", lambda i: F.get("lines", i))
    wanted = F.filter(marginal, lambda x: (F.length(strip(x)) <= MAX_KEY) & x.rlike("[A-Za-z]"))
    keys = p.select("doc_id", F.explode(F.array_distinct(F.transform(wanted, heading_key))).alias("key")).groupBy("doc_id", "key").count()
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * fraction))
    return keys.join(sizes, "doc_id").where(F.col("count") >= need).select("doc_id", "key")


def strip_furniture(pages: DataFrame, furniture: DataFrame, count: int = MARGIN_LINES) -> DataFrame:
    """``pages`` with ``lines``: furniture removed at the page's edges (everywhere, if the page is nothing else).

    A document has at most some sixty keys, since each stands on a tenth of the pages and a page has six margin lines.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("n"), "key"))), lambda x: x["key"])
    keys = furniture.groupBy("doc_id").agg(order.alias("keys"))
    p = pages.join(keys, "doc_id", "left").withColumn("raw", lines_of(F.col("text")))
    p = once(p, "folded", F.when(F.col("keys").isNotNull(), F.transform("raw", heading_key)))
    only = F.forall("folded", lambda k: (k == "") | F.array_contains("keys", k))
    every = F.sequence(F.lit(0), F.greatest(F.size("raw") - 1, F.lit(0)))
    p = once(with_margins(p, "raw", count), "at", F.when(only, every).otherwise(F.col("margin")))
    # the longest key that ends a line of the margin, by line
    p = once(p, "cuts", F.transform("folded", lambda k, i: F.when(F.array_contains("at", i) & (k != ""), F.get(F.filter("keys", lambda x: F.endswith(k, x)), F.lit(0)))))

    def cut(x: Column, i: Column) -> Column:
        key = F.get("cuts", i)
        pattern = F.concat(F.lit("(?iU)\\s*\\Q"), F.replace(key, F.lit(" "), F.lit("\\E\\s+\\Q")), F.lit("\\E\\s*$"))
        return F.when(key.isNull(), x).otherwise(F.regexp_replace(F.regexp_replace(x, pattern, F.lit("")), "(?U)\\s+$", ""))

    lines = F.when(F.col("keys").isNull(), F.col("raw")).otherwise(F.transform("raw", cut))
    return p.withColumn("lines", lines).drop("raw", "folded", "margin", "at", "cuts", "keys")


def classify_pages(pages: DataFrame) -> DataFrame:
    """Adds ``kind``: catalog, contents, roman or body; a roman page loses its page label."""
    text = F.array_join("lines", "\n")
    kind = (
        F.when(P.is_catalog_page(text, F.col("lines")), "catalog").when(P.is_contents_page(F.col("lines")), "contents")
        .when(P.is_roman_page(F.col("lines")), "roman").otherwise("body")
    )
    d = pages.withColumn("kind", kind)
    labels = F.filter(F.transform("lines", lambda x, i: F.when(strip(x).rlike(P.ROMAN), i)), lambda i: i.isNotNull())
    label = F.get(labels, F.lit(0))
    unlabelled = F.transform("lines", lambda x, i: F.when(i == label, F.lit("")).otherwise(x))
    return d.withColumn("lines", F.when(F.col("kind") == "roman", unlabelled).otherwise(F.col("lines")))
