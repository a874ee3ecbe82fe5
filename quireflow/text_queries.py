"""Queries for text functions and page plans, with their DuckDB statements.

The archive's tables hold finished chunks, so texts are decorated with the artefacts the functions repair; both
engines build the same decoration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import predicates as P
from .functions import text as X
from .plans import chunker, contents
from .plans import pages as pg
from .sources.tables import table


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").where("text <> ''").select("doc_id", "text")


def decorated(spark: SparkSession, root: str) -> DataFrame:
    t = F.replace(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n\n\n ")), F.lit("fi"), F.lit("ﬁ")), F.lit(" the "), F.lit("  the\t"))
    t = F.replace(F.replace(t, F.lit("ea"), F.lit("e­a")), F.lit(" is "), F.lit(" i s "))
    return _docs(spark, root).select("doc_id", F.concat(t, F.lit(" wasn ' t “so” – the micro-\ncontroller ")).alias("text"))


_DECORATED = r"""(SELECT doc_id, replace(replace(replace(replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || ' '), 'fi', 'ﬁ'), ' the ', '  the' || chr(9)),
  'ea', 'e' || chr(173) || 'a'), ' is ', ' i s ') || ' wasn '' t “so” – the micro-' || chr(10) || 'controller ' AS text FROM documents WHERE text <> '')"""


def clean_text(spark: SparkSession, root: str) -> DataFrame:
    return decorated(spark, root).select("doc_id", X.clean_text(F.col("text")).alias("clean"))


def heading_keys(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "chunks").where("section_heading is not null").select("section_heading").distinct()
    h = F.col("section_heading")
    return d.select("section_heading", X.heading_key(h).alias("key"), P.is_debris_heading(h).alias("debris"), P.is_known_heading(h).alias("known"))


def caption_keys(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "table_layout").where("caption is not null").select("caption").distinct()
    c = F.concat("caption", F.lit(" (Continued)"))
    return d.select("caption", X.caption_key(F.col("caption")).alias("key"), X.series_key(c).alias("series"), P.is_table_caption(F.col("caption")).alias("is_caption"))


def slugs(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("title")
    return table(spark, root, "note").where("title is not null").select("title").distinct().select("title", X.note_slug(t).alias("note_slug"), X.generated_slug(t).alias("generated_slug"))


def categories(spark: SparkSession, root: str) -> DataFrame:
    c = F.concat(F.lit(" \\"), F.upper("category"), F.lit("//New - Part! "))
    d = table(spark, root, "note").where("category is not null").select("category").distinct()
    return d.select("category", X.category_path(c).alias("path"), X.breadcrumb(F.col("category")).alias("crumbs"))


def glyphs(spark: SparkSession, root: str) -> DataFrame:
    t = F.replace(F.replace(F.col("text"), F.lit(" a "), F.lit("  a ")), F.lit(" in "), F.lit("in"))
    return _docs(spark, root).select("doc_id", X.math_glyphs(t).alias("text"))


def packed_sentences(spark: SparkSession, root: str) -> DataFrame:
    """Sentences packed greedily to 300 characters; checked in tests against a plain loop."""
    d = _docs(spark, root).select("doc_id", F.posexplode(X.pack(X.sentences(F.col("text")), 300, " ")).alias("place", "part"))
    return d.select("doc_id", "place", "part")


def paragraph_counts(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "chunks").where("text is not null").select("chunk_id", "text").distinct()
    return d.select("chunk_id", F.size(X.paragraphs(F.col("text"))).alias("paragraphs"), F.size(X.sentences(F.col("text"))).alias("sentences"))


def line_kinds(spark: SparkSession, root: str) -> DataFrame:
    """How often lines of each kind stand in the chunks."""
    lines = table(spark, root, "chunks").where("text is not null").select("chunk_id", "text").distinct().select(F.explode(F.split("text", "\n")).alias("line"))
    x = F.col("line")
    d = lines.select(P.is_running_header(x).alias("running"), P.is_heading(x).alias("heading"), P.is_table_caption(x).alias("caption"), P.is_display_math(x).alias("math"))
    return d.groupBy("running", "heading", "caption", "math").agg(F.count("*").alias("lines"))


def equation_hints(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "chunks").where("text is not null").select("chunk_id", "text").distinct()
    return d.select("chunk_id", P.equation_hint(F.col("text")).alias("hint"))


def marked_documents(spark: SparkSession, root: str) -> DataFrame:
    """Each archive document as one page-marked text, rebuilt from its chunks (doc_id, text)."""
    c = table(spark, root, "chunks").where("text is not null and page_start is not null").select("doc_id", "chunk_index", "page_start", "section_heading", "text").dropDuplicates(["doc_id", "chunk_index"])
    body = F.concat(F.coalesce(F.concat(F.upper("section_heading"), F.lit("\n")), F.lit("")), "text")
    per = c.groupBy("doc_id", "page_start").agg(F.array_sort(F.collect_list(F.struct("chunk_index", body.alias("t")))).alias("x"))
    return pg.join_pages(per.select("doc_id", F.col("page_start").alias("page_number"), F.array_join(F.transform("x", lambda v: v["t"]), "\n").alias("text")))


def page_spans(spark: SparkSession, root: str) -> DataFrame:
    return pg.to_pages(marked_documents(spark, root)).select("doc_id", "page_number", F.length("text").alias("chars"), "source_char_start", "source_char_end")


def page_furniture(spark: SparkSession, root: str) -> DataFrame:
    return pg.page_furniture(pg.to_pages(marked_documents(spark, root)))


def contents_entries(spark: SparkSession, root: str) -> DataFrame:
    pages = pg.to_pages(marked_documents(spark, root))
    return contents.contents_entries(pages, contents.major_sections(pages))


def built_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunker.build_chunks(marked_documents(spark, root))


def smallest_factors(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "chunks").where("page_start > 1").select(F.col("page_start").alias("n")).distinct()
    return n.select("n", X.smallest_factor(F.col("n")).alias("factor"))


QUERIES = {
    "clean_text": clean_text, "heading_keys": heading_keys, "caption_keys": caption_keys, "slugs": slugs, "categories": categories, "math_glyphs": glyphs,
    "packed_sentences": packed_sentences, "paragraph_counts": paragraph_counts, "line_kinds": line_kinds, "equation_hints": equation_hints, "page_spans": page_spans,
    "page_furniture": page_furniture, "contents_entries": contents_entries, "build_chunks": built_chunks, "smallest_factors": smallest_factors,
}

_WS = "[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}\\x0b\\x{0085}\\x{2028}\\x{2029}\\x{205F}\\x{1680}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _hkey(x: str) -> str:
    return f"regexp_replace(lower({_strip(x)}), '{_WS}+', ' ', 'g')"


def _ckey(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


def _trim_(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"


def _n(x: str, keep: str) -> str:
    return f"length(regexp_replace({x}, '[^{keep}]', '', 'g'))"


_KNOWN = ", ".join(f"'{h}'" for h in P.KNOWN_HEADINGS)
_CAPTION = " OR ".join(f"regexp_matches(line, '{p}')" for p in (P.NUMBERED_CAPTION, P.NAMED_CAPTION.replace("'", "''"), P.PRIME_CAPTION))
_MARKED = """
m0 AS (SELECT DISTINCT ON (doc_id, chunk_index) doc_id, chunk_index, page_start, section_heading, text FROM chunks WHERE text IS NOT NULL AND page_start IS NOT NULL),
m1 AS (SELECT doc_id, page_start AS p, string_agg(coalesce(upper(section_heading) || chr(10), '') || text, chr(10) ORDER BY chunk_index) AS t FROM m0 GROUP BY ALL)
"""

ORACLES = {
    "clean_text": f"""
WITH a AS (SELECT doc_id, replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), chr(173), '') AS t FROM {_DECORATED}),
b AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(t, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'ft'), 'ﬆ', 'st') AS t FROM a),
c AS (SELECT doc_id, translate(t, '‘’“”–—−' || chr(160), '''''""--- ') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '([A-Za-z])-\\n([A-Za-z])', '\\1\\2', 'g') AS t FROM c),
e0 AS (SELECT doc_id, regexp_replace(t, '(^|[^\\p{{L}}\\p{{N}}_])([a-z]) ([a-z])($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2\\3\\4', 'g') AS t FROM d),
e AS (SELECT doc_id, regexp_replace(t, '(^|[^\\p{{L}}\\p{{N}}_])([a-z]) ([a-z])($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2\\3\\4', 'g') AS t FROM e0),
f AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z]+)\\s+''\\s+([A-Za-z]+)', '\\1''\\2', 'g'), '([A-Za-z]+)''\\s+([A-Za-z]+)', '\\1''\\2', 'g'), '([A-Za-z]+)\\s+''([A-Za-z]+)', '\\1''\\2', 'g') AS t FROM e)
SELECT doc_id, {_strip("regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+\\n', chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean FROM f""",
    "heading_keys": f"""
SELECT DISTINCT section_heading, {_hkey("section_heading")} AS key, {_ckey("section_heading")} IN ('', 'table', 'tables') OR NOT regexp_matches(lower(section_heading), '[a-z]{{4,}}') AS debris,
  {_hkey("section_heading")} IN ({_KNOWN}) AS known FROM chunks WHERE section_heading IS NOT NULL""",
    "caption_keys": f"""
SELECT DISTINCT caption, {_ckey("caption")} AS key, {_ckey("regexp_replace(caption || ' (Continued)', '(?i)\\(\\s*continued\\s*\\)', ' ', 'g')")} AS series, {_CAPTION.replace("line", "caption")} AS is_caption
FROM table_layout WHERE caption IS NOT NULL""",
    "slugs": f"""
WITH t AS (SELECT DISTINCT title, {_trim_("regexp_replace(replace(lower(title), ' ', '_'), '[^a-z0-9_-]', '', 'g')")} AS a,
  {_trim_(f"regexp_replace(regexp_replace(lower({_strip('title')}), '[\\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g')")} AS b FROM note WHERE title IS NOT NULL)
SELECT title, CASE WHEN a = '' THEN 'untitled_note' ELSE a END || '.md' AS note_slug, CASE WHEN b = '' THEN 'untitled' ELSE b END AS generated_slug FROM t""",
    "categories": f"""
WITH c AS (SELECT DISTINCT category, string_split(replace(lower({_strip("' ' || chr(92) || upper(category) || '//New - Part! '")}), chr(92), '/'), '/') AS p FROM note WHERE category IS NOT NULL)
SELECT category, array_to_string(list_filter(list_transform(p, lambda x: {_trim_(f"regexp_replace(regexp_replace({_strip('x')}, '[\\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g')")}), lambda x: x <> ''), '/') AS path,
  array_to_string(list_filter(string_split(category, '/'), lambda x: x <> ''), ' > ') AS crumbs FROM c""",
    "math_glyphs": """
SELECT doc_id, replace(replace(text, ' a ', ' (a)'), ' in ', '{in}') AS text FROM documents WHERE text <> ''""",
    "paragraph_counts": f"""
WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL)
SELECT chunk_id, CAST(len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {_strip('x')} <> '')) AS INTEGER) AS paragraphs,
  CAST(len(list_filter(regexp_split_to_array(regexp_replace({_strip('text')}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS INTEGER) AS sentences FROM c""",
    "line_kinds": f"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL)),
t AS (SELECT line, {_strip("line")} AS s FROM l),
k AS (SELECT length(s) <= 100 AND {_n("s", "\\p{L}")} >= 4 AND {_n("s", "\\p{L}")} >= 0.5 * {_n("s", "\\p{L}\\p{N}")} AND regexp_matches(s, '{P.RUNNING}') AS running,
  s <> '' AND length(s) <= 80 AND NOT regexp_matches(s, '[.;,]$') AND NOT regexp_matches(s, '-{{5,}}|[=×÷≤≥]') AND ({_hkey("s")} IN ({_KNOWN}) OR ({_n("s", "A-Za-z")} > 0 AND regexp_matches(s, '[A-Za-z]{{3}}')
    AND {_n("s", "\\p{L}")} >= 0.5 * {_n("s", "\\p{L}\\p{N}")} AND {_n("s", "A-Z")} > 0.7 * {_n("s", "A-Za-z")})) AS heading,
  {_CAPTION} AS caption, regexp_matches(line, '-{{5,}}|[=×÷≤≥]') AS math FROM t)
SELECT running, heading, caption, math, count(*) AS lines FROM k GROUP BY ALL""",
    "equation_hints": """
SELECT DISTINCT chunk_id, CASE WHEN regexp_matches(text, '-{5,}') OR len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '=') AND regexp_matches(x, '[A-Za-z0-9]'))) >= 2
  THEN 'equation' ELSE '' END AS hint FROM chunks WHERE text IS NOT NULL""",
    "page_spans": f"""
WITH {_MARKED}, s AS (SELECT doc_id, p, t, {_strip("t")} AS b, chr(10) || '--- PAGE ' || p || ' ---' || chr(10) || t || chr(10) AS part FROM m1),
o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS before FROM s),
q AS (SELECT *, before + length(chr(10) || '--- PAGE ' || p || ' ---' || chr(10)) + length(t) - length(regexp_replace(t, '^{_WS}+', '')) AS a FROM o)
SELECT doc_id, p AS page_number, CAST(length(b) AS INTEGER) AS chars, CAST(a AS BIGINT) AS source_char_start, CAST(a + length(b) AS BIGINT) AS source_char_end FROM q""",
    "page_furniture": f"""
WITH {_MARKED}, l AS (SELECT doc_id, p, i, line FROM (SELECT doc_id, p, unnest(string_split({_strip("t")}, chr(10))) AS line, generate_subscripts(string_split({_strip("t")}, chr(10)), 1) AS i FROM m1) WHERE {_strip("line")} <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS f, row_number() OVER (PARTITION BY doc_id, p ORDER BY i DESC) AS g, count(*) OVER (PARTITION BY doc_id, p) AS n FROM l),
k AS (SELECT DISTINCT doc_id, p, {_hkey("line")} AS key FROM r WHERE least(f, g) <= least(3, greatest(1, n // 4)) AND length({_strip("line")}) <= 160 AND regexp_matches(line, '[A-Za-z]')),
z AS (SELECT doc_id, count(*) AS pages FROM m1 GROUP BY doc_id)
SELECT doc_id, key FROM k JOIN z USING (doc_id) GROUP BY doc_id, key, pages HAVING count(*) >= greatest(3, ceil(pages * CAST(0.10 AS DOUBLE)))""",
    "smallest_factors": """
WITH n AS (SELECT DISTINCT page_start AS n FROM chunks WHERE page_start > 1)
SELECT n, CAST((SELECT min(d) FROM range(2, 100000) r(d) WHERE d <= n.n AND n.n % d = 0) AS INTEGER) AS factor FROM n""",
}
