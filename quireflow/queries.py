"""Registered queries of the core: name -> function(spark, root) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive_queries, text_queries
from .operators import nested, references
from .sources.tables import table


def _archive(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return references.archive_orphans(*[table(spark, root, t) for t in ("structural_index", "table_layout", "note", "doc_registry")])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Records whose reference has no live target in time."""
    return _archive(spark, root)[0].select("table_name", "record_key").distinct()


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    """References and orphans per table and month."""
    return _archive(spark, root)[1].withColumn("period", F.date_format("period", "yyyy-MM"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Every child row of every layout with its positions."""
    t = nested.flatten_records(table(spark, root, "table_layout"), ["doc_id", "layout_id"])
    keys = ["doc_id", "layout_id"]
    one = lambda name, path, child: t[name].where(F.col("path") == path).select(*keys, F.lit(child).alias("child"), "pos1", F.lit(0).alias("pos2"))
    two = lambda name, path, child: t[name].where(F.col("path") == path).select(*keys, F.lit(child).alias("child"), "pos1", "pos2")
    rows = two("grid_item", "grid.item", "grid").unionByName(one("cells", "cells", "cell"))
    rows = rows.unionByName(one("positioned_lines", "positioned_lines", "line")).unionByName(two("positioned_lines_tokens", "positioned_lines.tokens", "token"))
    return rows.distinct()


def p5_cells(spark: SparkSession, root: str) -> DataFrame:
    """The flat cell table (cells and ruled cells) with its link to the layout."""
    return nested.flatten_records(table(spark, root, "table_layout"), ["doc_id", "layout_id"])["cells"]


def p5_tokens(spark: SparkSession, root: str) -> DataFrame:
    """The flat token table with its links to line and layout."""
    return nested.flatten_records(table(spark, root, "table_layout"), ["doc_id", "layout_id"])["positioned_lines_tokens"]


#: The query of the smoke check.
FLAGSHIP = "search_federated"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found, "p5_cells": p5_cells, "p5_tokens": p5_tokens,
    **text_queries.QUERIES,
    **archive_queries.QUERIES,
}

_REFS = """
WITH s AS (SELECT DISTINCT doc_id, doc_id || ':' || entry_index AS record_key, trim(table_layout_id) AS ref, indexed_at AS t FROM structural_index
           WHERE doc_id IS NOT NULL AND trim(table_layout_id) <> ''),
n AS (SELECT DISTINCT note_id AS record_key, trim(source_doc_id) AS ref, created_at AS t FROM note WHERE trim(source_doc_id) NOT IN ('', 'None')),
o AS (SELECT 'structural_index' AS table_name, record_key, t FROM s WHERE NOT EXISTS (
        SELECT 1 FROM table_layout l WHERE l.doc_id = s.doc_id AND trim(l.layout_id) = s.ref AND l.deleted_at IS NULL AND (l.extracted_at <= s.t OR s.t IS NULL))
      UNION ALL
      SELECT 'note', record_key, t FROM n WHERE NOT EXISTS (
        SELECT 1 FROM doc_registry d WHERE trim(d.doc_id) = n.ref AND d.deleted_at IS NULL AND (d.created_at <= n.t OR n.t IS NULL)))
"""

ORACLES: dict[str, str] = {
    "p4_found": _REFS + "SELECT DISTINCT table_name, record_key FROM o",
    "p4_counts": _REFS
    + """, r AS (SELECT 'structural_index' AS table_name, record_key, strftime(t, '%Y-%m') AS period FROM s UNION SELECT 'note', record_key, strftime(t, '%Y-%m') FROM n),
b AS (SELECT table_name, strftime(t, '%Y-%m') AS period, count(DISTINCT record_key) AS orphans FROM o GROUP BY ALL),
a AS (SELECT table_name, period, count(*) AS "references" FROM r GROUP BY ALL)
SELECT a.table_name, a.period, a."references", coalesce(b.orphans, 0) AS orphans
FROM a LEFT JOIN b ON a.table_name = b.table_name AND a.period IS NOT DISTINCT FROM b.period""",
    "p5_found": """
WITH g AS (SELECT doc_id, layout_id, unnest(grid) AS r, unnest(range(1, len(grid) + 1)) AS pos1 FROM table_layout),
l AS (SELECT doc_id, layout_id, unnest(positioned_lines) AS r, unnest(range(1, len(positioned_lines) + 1)) AS pos1 FROM table_layout)
SELECT DISTINCT doc_id, layout_id, 'grid' AS child, CAST(pos1 AS INTEGER) AS pos1, CAST(pos2 AS INTEGER) AS pos2
  FROM (SELECT doc_id, layout_id, pos1, unnest(r) AS v, unnest(range(1, len(r) + 1)) AS pos2 FROM g) WHERE v IS NOT NULL
UNION SELECT DISTINCT doc_id, layout_id, 'cell', CAST(pos1 AS INTEGER), 0
  FROM (SELECT doc_id, layout_id, unnest(cells) AS v, unnest(range(1, len(cells) + 1)) AS pos1 FROM table_layout) WHERE v IS NOT NULL
UNION SELECT DISTINCT doc_id, layout_id, 'line', CAST(pos1 AS INTEGER), 0 FROM l WHERE r IS NOT NULL
UNION SELECT DISTINCT doc_id, layout_id, 'token', CAST(pos1 AS INTEGER), CAST(pos2 AS INTEGER)
  FROM (SELECT doc_id, layout_id, pos1, unnest(r.tokens) AS v, unnest(range(1, len(r.tokens) + 1)) AS pos2 FROM l) WHERE v IS NOT NULL""",
    "p5_cells": """
SELECT DISTINCT doc_id, layout_id, CAST(pos1 AS INTEGER) AS pos1, path, v.cell_index, v.row_index, v.column_index, v.text FROM (
  SELECT doc_id, layout_id, 'cells' AS path, unnest(cells) AS v, unnest(range(1, len(cells) + 1)) AS pos1 FROM table_layout
  UNION ALL SELECT doc_id, layout_id, 'ruled_cells', unnest(ruled_cells), unnest(range(1, len(ruled_cells) + 1)) FROM table_layout) WHERE v IS NOT NULL""",
    "p5_tokens": """
WITH l AS (SELECT doc_id, layout_id, unnest(positioned_lines) AS r, unnest(range(1, len(positioned_lines) + 1)) AS pos1 FROM table_layout)
SELECT DISTINCT doc_id, layout_id, CAST(pos1 AS INTEGER) AS pos1, CAST(pos2 AS INTEGER) AS pos2, 'positioned_lines.tokens' AS path, v.x0, v.x1, v.text
  FROM (SELECT doc_id, layout_id, pos1, unnest(r.tokens) AS v, unnest(range(1, len(r.tokens) + 1)) AS pos2 FROM l) WHERE v IS NOT NULL""",
    **text_queries.ORACLES,
    **archive_queries.ORACLES,
}
