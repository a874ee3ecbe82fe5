"""Problem 1: lines repeated across the chunks of one source document.

Lines are normalised and hashed; distinct chunks are counted per document and hash (a partial count on
the map side, so a hot document sends one row per line kind and map task); hashes above the share
threshold are joined back to the lines, and each text is rebuilt without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .normalize import fold

#: A line must stand in this many records and this share of the records of its document.
MIN_RECORDS, MIN_SHARE = 5, 0.1


def line_keys(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``k``: the line without case, spacing, look-alikes and a page number at either end.

    Each step is a projection of its own, and the patterns that rebuild a string run only on lines that need them.
    """
    d = lines.withColumn("k", F.lower(fold(F.col(line))))
    loose = F.contains("k", F.lit("  ")) | F.col("k").rlike("[\\x00-\\x1f]")
    d = d.withColumn("k", F.trim(F.when(loose, F.regexp_replace("k", "[\\s\\x00-\\x1f]+", " ")).otherwise(F.col("k"))))
    d = d.withColumn("k", F.when(F.col("k").rlike("^[\\[(|\\-. ]*\\d"), F.regexp_replace("k", "^[\\[(|\\-. ]*\\d+\\b[\\])|\\-.: ]*", "")).otherwise(F.col("k")))
    return d.withColumn("k", F.when(F.col("k").rlike("\\d[\\])|\\-. ]*$"), F.regexp_replace("k", "[\\[(|\\-.: ]*\\b\\d+[\\])|\\-. ]*$", "")).otherwise(F.col("k")))


def _lines(records: DataFrame, doc: str, pos: str, text: str, split: bool) -> DataFrame:
    """(d, p, n, h), written once: a row per line that has a letter; n is 0 for an unsplit value."""
    d = records.select(F.col(doc).alias("d"), F.col(pos).alias("p"), F.col(text).alias("t")).where("t is not null and d is not null and p is not null")
    if split:
        d = d.select("d", "p", F.posexplode(F.split("t", "\n")).alias("i", "line")).select("d", "p", (F.col("i") + 1).alias("n"), "line")
    else:
        d = d.select("d", "p", F.lit(0).alias("n"), F.col("t").alias("line"))
    d = line_keys(d.where(F.col("line").rlike("\\p{L}")))
    return materialize(d.where(F.col("k").rlike("\\p{L}")).select("d", "p", "n", F.xxhash64("k").alias("h")))


def _frequent(lines: DataFrame, records: DataFrame, doc: str, pos: str, min_records: int, min_share: float) -> DataFrame:
    """(d, h): the lines repeated in ``min_records`` and ``min_share`` of a document's records."""
    counts = lines.select("d", "h", "p").distinct().groupBy("d", "h").count().where(F.col("count") >= min_records)
    sizes = (
        records.select(F.col(doc).alias("d"), F.col(pos).alias("p")).where("d is not null and p is not null")
        .distinct().groupBy("d").agg(F.count("*").alias("records"))
    )
    return counts.join(sizes, "d").where(F.col("count") >= F.col("records") * F.lit(min_share) - 1e-9).select("d", "h")


def find_repeated_lines(
    records: DataFrame, doc: str = "doc_id", pos: str = "chunk_index", text: str = "text", split: bool = True,
    min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """(doc, pos, line_no): where a repeated line stands. line_no counts from 1, or is 0 if ``split`` is off.

    Rows delivered twice count once. Null documents, positions and texts, empty tables and lines without
    letters give no row. Extra columns are ignored. A tie with either threshold counts as repeated.
    """
    lines = _lines(records, doc, pos, text, split)
    frequent = _frequent(lines, records, doc, pos, min_records, min_share)
    hit = lines.join(frequent, ["d", "h"], "left_semi")
    return hit.select(F.col("d").alias(doc), F.col("p").alias(pos), F.col("n").alias("line_no")).distinct()


def remove_repeated_lines(
    records: DataFrame, doc: str = "doc_id", pos: str = "chunk_index", text: str = "text", split: bool = True,
    min_records: int = MIN_RECORDS, min_share: float = MIN_SHARE, only: DataFrame | None = None,
) -> DataFrame:
    """``records`` with ``text`` rebuilt without its repeated lines; all rows and columns are kept.

    Lines are counted over ``records``; with ``only``, the rows of that table (of the same columns) are rebuilt.
    A header (``split`` off) that is repeated becomes ''. A text of repeated lines only becomes ''. Null
    texts stay null. Extra columns may have any names.
    """
    hit = find_repeated_lines(records, doc, pos, text, split, min_records, min_share)
    per = hit.groupBy(F.col(doc).alias("__lines_d"), F.col(pos).alias("__lines_p")).agg(F.collect_set("line_no").alias("__lines_gone"))
    rows = records if only is None else only
    both = rows.join(per, (rows[doc] == F.col("__lines_d")) & (rows[pos] == F.col("__lines_p")), "left")
    if split:
        kept = F.array_join(F.filter(F.split(rows[text], "\n"), lambda x, i: ~F.array_contains(F.col("__lines_gone"), i + 1)), "\n")
        new = F.when(F.col("__lines_gone").isNull(), rows[text]).otherwise(kept)
    else:
        new = F.when(F.col("__lines_gone").isNull() | rows[text].isNull(), rows[text]).otherwise(F.lit(""))
    return both.select(*[new.alias(c) if c == text else rows[c] for c in rows.columns])
