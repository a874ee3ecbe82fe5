"""Queries for search, context, artifacts and curation over the archive's tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import FRONT_MATTER
from .functions.text import highlight, search_window
from .operators import artifacts, context, curation, search
from .sources.notes import parse_notes
from .sources.tables import table
from .text_queries import _strip

QUERY, PAGE_QUERY, FUZZY_QUERY = "relief valve pump", "gauge page 100", "bearng calibrat regulatr"


def _notes(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "note")
    return d.dropDuplicates(["note_id"]).withColumn("id", F.col("id").cast("long"))


def _entries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "structural_index").dropDuplicates(["doc_id", "entry_index"])


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").drop("ingested_at").dropDuplicates(["chunk_id"])


def _registry(spark: SparkSession, root: str) -> DataFrame:
    return curation.latest_documents(table(spark, root, "doc_registry"))


def _layouts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "table_layout").drop("extracted_at", "deleted_at").dropDuplicates(["doc_id", "layout_id"])


def vocabulary(spark: SparkSession, root: str) -> DataFrame:
    return search.build_vocabulary(_notes(spark, root))


def fuzzy_expand(spark: SparkSession, root: str) -> DataFrame:
    return search.fuzzy_matches(vocabulary(spark, root), search.parse_terms(FUZZY_QUERY))


def note_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every note that the query hits, with its score before and after demotion: no cut, so ties cannot hide rows."""
    d = search.demote_sources(search.score_notes(_notes(spark, root), search.parse_terms(QUERY)))
    return d.select("note_id", "origin", F.col("score").cast("int").alias("score"), F.col("adjusted").cast("int").alias("adjusted"))


def search_notes(spark: SparkSession, root: str) -> DataFrame:
    return search.search_notes(_notes(spark, root), QUERY)


def search_notes_scope(spark: SparkSession, root: str) -> DataFrame:
    return search.search_notes(_notes(spark, root), QUERY, scope="notes")


def search_notes_page(spark: SparkSession, root: str) -> DataFrame:
    return search.search_notes(_notes(spark, root), PAGE_QUERY)


def search_structural(spark: SparkSession, root: str) -> DataFrame:
    """Documents of more than 30 chunks count as stored structurally, so that small test tables have some."""
    mode = F.when(F.col("chunk_count") > 30, "structural_only").otherwise("persistent")
    return search.search_structural(_entries(spark, root), _registry(spark, root).withColumn("chunk_storage_mode", mode), QUERY).drop("category_parts")


def search_stored(spark: SparkSession, root: str) -> DataFrame:
    """The structural search over the documents whose registry row says that they are stored structurally."""
    return search.search_structural(_entries(spark, root), _registry(spark, root), QUERY).drop("category_parts")


def search_expanded(spark: SparkSession, root: str) -> DataFrame:
    """The whole search of a misspelt query: terms expanded by the vocabulary of all notes, titles of generated notes, stored modes."""
    notes = curation.titled_notes(_notes(spark, root), table(spark, root, "doc_registry"))
    words = search.expand_terms(search.parse_terms(FUZZY_QUERY), vocabulary(spark, root))
    return search.federate(search.search_notes(notes, " ".join(words)), search.search_structural(_entries(spark, root), _registry(spark, root), " ".join(words)))


def verification_pages_at(spark: SparkSession, root: str) -> DataFrame:
    """Pages of linked layouts, else of tables with page 40 kept, else of the entry that begins there or of the first one."""
    linked = artifacts.link_tables(_entries(spark, root), _layouts(spark, root)).join(_layouts(spark, root).select("doc_id", "layout_id", "page_number"), ["doc_id", "layout_id"])
    d = context.verification_pages(_entries(spark, root), linked.select("doc_id", "page_number"), warning=False, current=40, general=True)
    return d.select("doc_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def leading_captions(spark: SparkSession, root: str) -> DataFrame:
    """Named range captions at the start of the previews, and of the same previews behind a caption of primes."""
    from .functions.predicates import leading_caption

    d = _entries(spark, root).select("doc_id", "entry_index", F.coalesce("preview", F.lit("")).alias("p"), (F.col("entry_index") % 3).alias("k"))
    n = F.col("entry_index").cast("string")
    text = F.when(F.col("k") == 0, F.concat(F.lit("Prime Numbers from 2 to "), n, F.lit(" "), "p")).when(F.col("k") == 1, F.concat(F.lit("Gear Table for 1 to "), n, "p")).otherwise(F.col("p"))
    return d.select("doc_id", "entry_index", leading_caption(text).alias("caption")).where("caption is not null")


def entry_scores(spark: SparkSession, root: str) -> DataFrame:
    page, text = search.parse_page_query(PAGE_QUERY)
    return search.score_entries(_entries(spark, root), search.parse_terms(text), page).select("doc_id", "entry_index", F.col("score").cast("int").alias("score"))


def search_federated(spark: SparkSession, root: str) -> DataFrame:
    return search.federate(search_notes(spark, root), search_structural(spark, root))


def result_titles(spark: SparkSession, root: str) -> DataFrame:
    d = _entries(spark, root).join(_registry(spark, root).select("doc_id", "title"), "doc_id")
    return d.select("doc_id", "entry_index", search.result_title().alias("label"))


def previews(spark: SparkSession, root: str) -> DataFrame:
    terms = search.parse_terms(QUERY)
    d = _notes(spark, root).where("body is not null")
    window = search_window(F.col("body"), F.lower("body"), terms, 20, 40, 50)
    return d.select("note_id", window.alias("preview"), highlight(F.col("body"), terms).alias("marked"))


def index_entries(spark: SparkSession, root: str) -> DataFrame:
    cols = ["doc_id", "entry_index", "chunk_index", "content_type", "section_heading", "table_caption", "layout_hint", "preview", "search_text"]
    return context.index_entries(_chunks(spark, root)).select(*cols)


def storage_modes(spark: SparkSession, root: str) -> DataFrame:
    return context.storage_mode(table(spark, root, "chunks"))


def chunk_context(spark: SparkSession, root: str) -> DataFrame:
    return context.chunk_context(_chunks(spark, root))


def _generated(spark: SparkSession, root: str) -> DataFrame:
    """The notes generated from the chunks, read back as notes."""
    d = parse_notes(curation.generated_note_text(_chunks(spark, root), table(spark, root, "doc_registry")))
    return d.withColumn("id", F.xxhash64("relative_path"))


def source_context(spark: SparkSession, root: str) -> DataFrame:
    return context.source_context(_generated(spark, root))


def parsed_notes(spark: SparkSession, root: str) -> DataFrame:
    d = _generated(spark, root)
    return d.select("note_id", "title", F.array_join("tags", "|").alias("tags"), F.array_join("aliases", "|").alias("aliases"), F.col("meta")["page_start"].alias("page_start"), "note_origin", F.md5("body").alias("body_md5"))


def preferred_notes(spark: SparkSession, root: str) -> DataFrame:
    return context.preferred_source_note(_notes(spark, root))


def unit_runs(spark: SparkSession, root: str) -> DataFrame:
    return context.unit_runs(_entries(spark, root))


def unit_statistics(spark: SparkSession, root: str) -> DataFrame:
    return context.unit_statistics(_chunks(spark, root))


def display_items(spark: SparkSession, root: str) -> DataFrame:
    return context.display_items(_entries(spark, root))


def verification_pages(spark: SparkSession, root: str) -> DataFrame:
    return context.verification_pages(_entries(spark, root)).select("doc_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def table_links(spark: SparkSession, root: str) -> DataFrame:
    return artifacts.link_tables(_entries(spark, root), _layouts(spark, root))


def figure_links(spark: SparkSession, root: str) -> DataFrame:
    """Table boxes stand in for figures, which the archive's test tables do not have."""
    return artifacts.link_figures(_entries(spark, root), _layouts(spark, root))


def table_series(spark: SparkSession, root: str) -> DataFrame:
    return artifacts.table_series(_layouts(spark, root))


def table_cells(spark: SparkSession, root: str) -> DataFrame:
    return artifacts.table_cell(_layouts(spark, root), 2, 3)


def outer_layouts(spark: SparkSession, root: str) -> DataFrame:
    return artifacts.drop_nested(_layouts(spark, root)).select("doc_id", "layout_id")


def display_layouts(spark: SparkSession, root: str) -> DataFrame:
    d = artifacts.display_layouts(_layouts(spark, root))
    return d.select("doc_id", "layout_id", "caption", F.size("grid").alias("grid_rows"))


def baseline_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines rebuilt from the layouts' loose tokens."""
    d = _layouts(spark, root).where("doc_id is not null and page_number is not null").select(F.concat_ws(":", "doc_id", "layout_id").alias("doc_id"), "page_number", F.explode("positioned_lines").alias("l"))
    d = d.where("l is not null").select("doc_id", "page_number", F.col("l.top").alias("top"), F.col("l.bottom").alias("bottom"), F.explode("l.tokens").alias("t")).where("t is not null and top is not null and t.x0 is not null")
    words = d.select("doc_id", "page_number", F.col("t.text").alias("text"), F.col("t.x0").alias("x0"), F.col("t.x1").alias("x1"), "top", "bottom")
    return artifacts.baseline_lines(words).select("doc_id", "page_number", "line_index", "top", "bottom", "text")


def prime_numbers(spark: SparkSession, root: str) -> DataFrame:
    return artifacts.primes(10_000, spark)


def page_spec(spark: SparkSession, root: str) -> DataFrame:
    """Chunks on the pages of a specification, by semi join."""
    pages = spark.createDataFrame([(p,) for p in artifacts.expand_page_spec("3,7-9,20-24")], "page_start int")
    return _chunks(spark, root).join(F.broadcast(pages), "page_start", "left_semi").select("chunk_id", "page_start")


def curator_documents(spark: SparkSession, root: str) -> DataFrame:
    return curation.list_documents(table(spark, root, "doc_registry"), "public").select("doc_id", "title", "collection", "chunk_storage_mode", "table_layout_count")


def collection_counts(spark: SparkSession, root: str) -> DataFrame:
    return curation.collection_counts(table(spark, root, "doc_registry"))


def curator_notes(spark: SparkSession, root: str) -> DataFrame:
    return curation.list_notes(_notes(spark, root), "manual").select("note_id", "category", "title", "chunk_index")


def origin_counts(spark: SparkSession, root: str) -> DataFrame:
    return curation.origin_counts(table(spark, root, "note"))


def folder_tree(spark: SparkSession, root: str) -> DataFrame:
    return curation.folder_tree(table(spark, root, "note"))


def titled_notes(spark: SparkSession, root: str) -> DataFrame:
    d = curation.titled_notes(_notes(spark, root), table(spark, root, "doc_registry"))
    return d.select("note_id", "title", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "|").alias("aliases"))


def note_ids(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "note").select("relative_path", F.lit(None).cast("string").alias("note_id")).distinct()
    return curation.backfill_note_ids(d)


def generated_notes(spark: SparkSession, root: str) -> DataFrame:
    d = curation.generated_note_text(_chunks(spark, root), table(spark, root, "doc_registry"))
    return d.select("doc_id", "chunk_index", "relative_path", F.md5("text").alias("text_md5"))


def page_filter(spark: SparkSession, root: str) -> DataFrame:
    """Index entries on page 12, as an interval stab."""
    from .functions.predicates import page_in_range

    return _entries(spark, root).where(page_in_range(12, F.col("page_start"), F.col("page_end"))).select("doc_id", "entry_index")


QUERIES = {
    f.__name__: f
    for f in (
        vocabulary, fuzzy_expand, note_scores, search_notes, search_notes_scope, search_notes_page, search_structural, search_stored, search_expanded, verification_pages_at, leading_captions, entry_scores, search_federated, result_titles, previews,
        index_entries, storage_modes, chunk_context, source_context, parsed_notes, preferred_notes, unit_runs, unit_statistics, display_items, verification_pages, table_links, figure_links,
        table_series, table_cells, outer_layouts, display_layouts, baseline_lines, prime_numbers, page_spec, curator_documents, collection_counts, curator_notes, origin_counts,
        folder_tree, titled_notes, note_ids, generated_notes, page_filter,
    )
}

_N = "n AS (SELECT DISTINCT ON (note_id) * FROM note)"
_E = "e AS (SELECT DISTINCT ON (doc_id, entry_index) * FROM structural_index)"
_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_L = "l AS (SELECT DISTINCT ON (doc_id, layout_id) * FROM table_layout)"
_R = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, deleted_at DESC NULLS LAST,
  title DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM doc_registry WHERE doc_id IS NOT NULL) WHERE rn = 1)"""


def _note_score(terms: list[str], scope: str = "", page: int | None = None) -> str:
    s = " + ".join(
        f"""CASE WHEN contains(lower(title), '{t}') THEN 5 ELSE 0 END + CASE WHEN list_contains(tags, '{t}') THEN 3 ELSE 0 END + CASE WHEN list_contains(aliases, '{t}') THEN 4 ELSE 0 END
        + CASE WHEN contains(lower(body), '{t}') THEN 1 ELSE 0 END + CASE WHEN contains(replace(lower(relative_path), '_', ' '), '{t}') THEN 2 ELSE 0 END"""
        for t in terms
    )
    bonus, where = "0", "true"
    if page is not None:
        bonus = "CASE WHEN origin = 'generated' THEN 50 ELSE 20 END"
        a, b = "TRY_CAST(meta['page_start'] AS INTEGER)", "TRY_CAST(meta['page_end'] AS INTEGER)"
        where = f"""CASE WHEN origin = 'generated' THEN coalesce({page} BETWEEN {a} AND coalesce({b}, {a}), false)
          ELSE regexp_matches(coalesce(title, '') || chr(10) || coalesce(body, ''), '(?i)\\b(?:pages?|p)\\.?\\s*#?\\s*{page}\\b') END"""
    if scope:
        where += f" AND origin = '{scope}'"
    return f"""
WITH {_N}, o AS (SELECT *, coalesce(note_origin, CASE WHEN is_generated THEN 'generated' WHEN category_parts[1] = '_system' THEN 'system' ELSE 'manual' END) AS origin FROM n),
s AS (SELECT *, {bonus} + {s} AS points FROM o WHERE {where}),
a AS (SELECT *, points - CAST(coalesce(is_generated, false) AS INTEGER) AS score, coalesce(is_generated, false) AND coalesce(source_doc_id, '') <> '' AS counted FROM s WHERE points > 0),
d AS (SELECT *, CASE WHEN counted THEN score - row_number() OVER (PARTITION BY counted, source_doc_id ORDER BY score DESC, id) + 1 ELSE score END AS adjusted FROM a)
"""


def _top_notes(terms: list[str], scope: str = "", page: int | None = None) -> str:
    return _note_score(terms, scope, page) + """SELECT CAST(row_number() OVER (ORDER BY adjusted DESC, score DESC, id) AS INTEGER) AS position, adjusted AS score, id, note_id, title, source_doc_id
FROM (SELECT * FROM d ORDER BY adjusted DESC, score DESC, id LIMIT 5)"""


def _entry_score(terms: list[str], page: int | None = None) -> str:
    content = "lower(array_to_string(list_filter([trim(coalesce(preview, '')), CASE WHEN trim(coalesce(search_text, '')) = trim(coalesce(preview, '')) THEN '' ELSE trim(coalesce(search_text, '')) END], lambda x: x <> ''), chr(10) || chr(10)))"
    s = " + ".join(
        f"""CASE WHEN contains(lower(coalesce(section_heading, '')), '{t}') THEN 5 ELSE 0 END + CASE WHEN coalesce(retrieval_chunk_index = 1, true) AND contains(lower(coalesce(table_caption, '')), '{t}') THEN 5 ELSE 0 END
        + CASE WHEN contains({content}, '{t}') THEN 1 ELSE 0 END"""
        for t in terms
    )
    bonus = "0" if page is None else "CASE WHEN content_type = 'table' THEN 70 ELSE 50 END"
    where = "true" if page is None else f"coalesce({page} BETWEEN page_start AND coalesce(page_end, page_start), false)"
    return f"{_E}, es AS (SELECT *, {bonus} + {s} AS score FROM e WHERE {where})"


_DEBRIS = "(regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), '^tables?$', '') = '' OR NOT regexp_matches(lower(x), '[a-z]{4,}'))"
_LABEL = f"""coalesce(nullif(trim(coalesce(table_caption, '')), ''), list_filter([trim(coalesce(subheading, '')), trim(coalesce(section_heading, '')), trim(coalesce(category, '')), trim(coalesce(major_section, ''))],
  lambda x: x <> '' AND NOT {_DEBRIS})[1], 'Page ' || page_start || ' · Extracted segment', doc_title)"""
_TERMS = search.parse_terms(QUERY)
_PAGE, _REST = search.parse_page_query(PAGE_QUERY)
_STRUCTURAL = f"""
{_entry_score(_TERMS)}, {_R},
j AS (SELECT es.*, r.title AS doc_title, r.updated_at, r.category_path FROM es JOIN r ON es.doc_id = r.doc_id WHERE r.chunk_count > 30 AND score > 0),
k AS (SELECT *, CASE WHEN coalesce(content_type, 'prose') = 'table' THEN coalesce('table-layout:' || nullif(table_layout_id, ''), 'table-unit:' || nullif(semantic_unit_id, '')) END AS key FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY score DESC, entry_index) AS rn FROM k),
t AS (SELECT * FROM b WHERE key IS NULL OR rn = 1 ORDER BY score DESC, updated_at DESC NULLS LAST, doc_id DESC, entry_index LIMIT 5),
hits AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, updated_at DESC NULLS LAST, doc_id DESC, entry_index) AS INTEGER) AS position, CAST(score AS INTEGER) AS score, 'structural:' || doc_id || ':' || entry_index AS id,
  doc_id, entry_index, {_LABEL} AS title, page_start, array_to_string(list_filter(string_split(category_path, '/'), lambda x: x <> ''), ' > ') AS category,
  list_filter(string_split(category_path, '/'), lambda x: x <> '') AS category_parts FROM t)
"""
_NCI = "coalesce(TRY_CAST(meta['chunk_index'] AS INTEGER), TRY_CAST(nullif(regexp_extract(relative_path, '__chunk_(\\d+)(?:\\.md)?$', 1), '') AS INTEGER))"

_HEADER = " || chr(10) || ".join(
    f"'{c}: ' || " + ("coalesce(table_caption, 'None')" if c == "table_caption" else "coalesce(content_type, 'prose')" if c == "content_type" else f"coalesce(CAST({c} AS VARCHAR), '')") for c in curation.CHUNK_HEADER
)
_GENERATED = f"""{_C}, {_R}, g0 AS (SELECT c.*, trim(replace(coalesce(r.title, ''), '_', ' ')) AS base, lpad(CAST(c.chunk_index AS VARCHAR), 4, '0') AS n, coalesce(r.source_filename, '') AS file,
  list_filter(string_split(coalesce(r.category_path, ''), '/'), lambda x: x <> '') AS parts, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_strip("coalesce(r.title, '')")}), '[\\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
  FROM c JOIN r ON c.doc_id = r.doc_id),
g AS (SELECT * EXCLUDE (text), text AS body, array_to_string(list_filter(['_generated', array_to_string(parts, '/'), doc_id, CASE WHEN slug = '' THEN 'untitled' ELSE slug END || '__chunk_' || n || '.md'], lambda x: x IS NOT NULL), '/') AS relative_path,
  'title: ' || base || ' - chunk ' || n || chr(10) || 'note_id: note_' || doc_id || '_chunk_' || n || chr(10) || 'tags: ' || array_to_string(list_concat(['generated', 'ingested_pdf'], parts), ', ') || chr(10)
  || 'aliases: ' || base || ' chunk ' || n || chr(10) || 'source_doc_id: ' || doc_id || chr(10) || 'source_filename: ' || file || chr(10) || 'chunk_index: ' || chunk_index || chr(10) || {_HEADER}
  || chr(10) || chr(10) || {_strip("coalesce(text, '')")} || chr(10) AS text FROM g0)"""

ORACLES = {
    "vocabulary": f"""WITH {_N}, w AS (SELECT unnest(list_concat(list_concat(list_concat(coalesce(regexp_split_to_array(lower(title), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+'), []), coalesce(regexp_split_to_array(lower(body), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+'), [])),
      coalesce(regexp_split_to_array(replace(lower(relative_path), '_', ' '), '\\s+'), [])), list_concat(coalesce(tags, []), coalesce(aliases, [])))) AS word FROM n) SELECT DISTINCT word FROM w WHERE word <> ''""",
    "note_scores": _note_score(_TERMS) + "SELECT note_id, origin, CAST(score AS INTEGER) AS score, CAST(adjusted AS INTEGER) AS adjusted FROM d",
    "search_notes": _top_notes(_TERMS),
    "search_notes_scope": _top_notes(_TERMS, "manual"),
    "search_notes_page": _top_notes(search.parse_terms(_REST), page=_PAGE),
    "search_structural": f"WITH {_STRUCTURAL} SELECT * EXCLUDE (category_parts) FROM hits",
    "search_stored": f"WITH {_STRUCTURAL.replace('r.chunk_count > 30', "r.chunk_storage_mode = 'structural_only'")} SELECT * EXCLUDE (category_parts) FROM hits",
    "leading_captions": f"""WITH {_E}, t AS (SELECT doc_id, entry_index, CASE entry_index % 3 WHEN 0 THEN 'Prime Numbers from 2 to ' || entry_index || ' ' || coalesce(preview, '')
  WHEN 1 THEN 'Gear Table for 1 to ' || entry_index || coalesce(preview, '') ELSE coalesce(preview, '') END || ' ' AS p FROM e),
g AS (SELECT doc_id, entry_index, trim(regexp_extract(p, '(?i)^\\s*((?:(?:[a-z][a-z''-]*\\s+){{1,10}}table\\s+(?:for|of)|prime numbers\\s+from)\\s+[0-9][0-9,]*\\s+(?:to|through|[–—-])\\s+[0-9][0-9,]*)\\s', 1)) AS caption FROM t)
SELECT * FROM g WHERE caption <> ''""",
    "verification_pages_at": f"""WITH {_E}, {_L}, ek AS (SELECT doc_id, entry_index, page_start AS page_number, trim(regexp_replace(lower(coalesce(table_caption, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM e WHERE content_type = 'table' OR coalesce(table_caption, '') <> ''),
lk AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_number) AS n FROM (SELECT DISTINCT doc_id, page_number, layout_id, coalesce(table_index, 0) AS i, trim(regexp_replace(lower(coalesce(caption, '')), '[^a-z0-9]+', ' ', 'g')) AS c FROM l)),
j AS (SELECT ek.doc_id, entry_index, page_number, layout_id, i, n, k <> '' AND c <> '' AND (contains(k, c) OR contains(c, k)) AS m FROM ek JOIN lk USING (doc_id, page_number)),
a AS (SELECT DISTINCT doc_id, page_number AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entry_index ORDER BY m DESC, i, layout_id) AS rn FROM j WHERE m OR n = 1) WHERE rn = 1 AND page_number > 0),
x AS (SELECT doc_id, entry_index, page_start AS s, greatest(coalesce(page_end, page_start), page_start) AS t, content_type = 'table' OR
  regexp_matches(coalesce(preview, '') || ' ', '(?i)^\\s*(?:(?:[a-z][a-z''-]*\\s+){{1,10}}table\\s+(?:for|of)|prime numbers\\s+from)\\s+[0-9][0-9,]*\\s+(?:to|through|[–—-])\\s+[0-9][0-9,]*\\s') AS tab FROM e WHERE page_start > 0),
b AS (SELECT DISTINCT doc_id, unnest(range(s, least(t, s + 7) + 1)) AS p FROM x WHERE tab),
g AS (SELECT doc_id, unnest(range(s, least(t, s + 7) + 1)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s = 40 DESC, entry_index) AS rn FROM x) WHERE rn = 1),
u AS (SELECT doc_id, p, 0 AS kind, false AS top FROM a UNION ALL SELECT doc_id, p, 1, p = 40 FROM b UNION ALL SELECT doc_id, p, 2, false FROM g),
f AS (SELECT u.* FROM u JOIN (SELECT doc_id, min(kind) AS kind FROM u GROUP BY 1) USING (doc_id, kind)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY top DESC, p) AS rn FROM f)
SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM c WHERE rn <= 8 GROUP BY doc_id""",
    "display_items": f"""WITH {_E}, h AS (SELECT *, coalesce(content_type = 'contents', false) AS c, {_strip("coalesce(section_heading, '')")} AS heading,
  trim(regexp_replace(replace(lower(coalesce(section_heading, '')), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) AS k FROM e),
a AS (SELECT *, CASE WHEN coalesce(content_type, 'prose') = 'table' THEN coalesce('table-layout:' || nullif(table_layout_id, ''), 'table-unit:' || nullif(semantic_unit_id, '')) END AS key,
  CASE WHEN c THEN 'Table of Contents' WHEN k = 'front matter' THEN 'Front Matter' WHEN k IN ({', '.join(f"'{x}'" for x in FRONT_MATTER)}) THEN heading END AS own FROM h),
f AS (SELECT *, min(entry_index) FILTER (WHERE c) OVER (PARTITION BY doc_id) AS first FROM a),
o AS (SELECT *, min(entry_index) FILTER (WHERE NOT c AND entry_index > first) OVER (PARTITION BY doc_id) AS gone FROM f),
l AS (SELECT *, CASE WHEN first IS NOT NULL AND entry_index < coalesce(gone, 2147483647) THEN coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY entry_index ROWS UNBOUNDED PRECEDING), 'Publication Details') ELSE own END AS label FROM o),
b AS (SELECT *, lag(label) OVER w AS ll, lag(key) OVER w AS lk FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY entry_index)),
s AS (SELECT *, coalesce(label = ll, false) AS sl, coalesce(key = lk, false) AS sk, label IS NULL AND ll IS NULL AS bare FROM b),
n AS (SELECT *, CAST(sum(CASE WHEN sl OR (bare AND sk) THEN 0 ELSE 1 END) OVER w AS INTEGER) AS item, CAST(sum(CASE WHEN (sl OR bare) AND sk THEN 0 ELSE 1 END) OVER w AS INTEGER) AS card
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY entry_index ROWS UNBOUNDED PRECEDING)),
g AS (SELECT doc_id, item, card, any_value(label) AS label, min(entry_index) AS first_entry, count(*) AS chunks, min(page_start) AS page_start, max(page_end) AS page_end, CAST(sum(coalesce(char_count, 0)) AS BIGINT) AS char_count FROM n GROUP BY 1, 2, 3)
SELECT *, CAST(sum(chunks) OVER (PARTITION BY doc_id, item) AS BIGINT) AS entries_in_item FROM g""",
    "entry_scores": f"WITH {_entry_score(search.parse_terms(_REST), _PAGE)} SELECT doc_id, entry_index, CAST(score AS INTEGER) AS score FROM es WHERE score > 0",
    "search_federated": _note_score(_TERMS)
    + f""", nh AS (SELECT 0 AS engine, row_number() OVER (ORDER BY adjusted DESC, score DESC, id) AS position, adjusted AS score, CAST(id AS VARCHAR) AS id, title FROM (SELECT * FROM d ORDER BY adjusted DESC, score DESC, id LIMIT 5)),
{_STRUCTURAL}, u AS (SELECT engine, position, score, id, title FROM nh UNION ALL SELECT 1, position, score, id, title FROM hits)
SELECT CAST(row_number() OVER (ORDER BY score DESC, engine, position) AS INTEGER) AS rank, score, id, title FROM (SELECT * FROM u ORDER BY score DESC, engine, position LIMIT 5)""",
    "result_titles": f"WITH {_E}, {_R}, j AS (SELECT e.*, r.title AS doc_title FROM e JOIN r ON e.doc_id = r.doc_id) SELECT doc_id, entry_index, {_LABEL} AS label FROM j",
    "previews": f"""WITH {_N}, f AS (SELECT note_id, body, list_filter([{', '.join(f"'{t}'" for t in _TERMS)}], lambda t: contains(lower(body), t))[1] AS t FROM n WHERE body IS NOT NULL),
g AS (SELECT *, greatest(instr(lower(body), t) - 21, 0) AS a, least(instr(lower(body), t) + 39, length(body)) AS b FROM f)
SELECT note_id, CASE WHEN t IS NULL THEN substring(body, 1, 50) || CASE WHEN length(body) > 50 THEN '...' ELSE '' END
  ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || substring(body, a + 1, b - a) || CASE WHEN b < length(body) THEN '...' ELSE '' END END AS preview,
  {"replace(" * len(_TERMS)}replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'){"".join(f", '{t}', '<mark>{t}</mark>')" for t in _TERMS)} AS marked FROM g""",
    "index_entries": f"""WITH {_C}, s AS (SELECT *, {_strip("coalesce(text, '')")} AS t FROM c)
SELECT doc_id, chunk_index - 1 AS entry_index, chunk_index, coalesce(content_type, 'prose') AS content_type, coalesce(section_heading, '') AS section_heading, coalesce(table_caption, '') AS table_caption,
  coalesce(layout_hint, '') AS layout_hint, CASE WHEN length(t) > 220 THEN substring(t, 1, 220) || '...' ELSE t END AS preview, CASE WHEN content_type = 'table' THEN t ELSE '' END AS search_text FROM s""",
    "storage_modes": "SELECT doc_id, count(DISTINCT chunk_index) AS chunk_count, CASE WHEN count(DISTINCT chunk_index) <= 300 THEN 'persistent' ELSE 'structural_only' END AS chunk_storage_mode FROM chunks GROUP BY doc_id",
    "chunk_context": f"WITH {_C} SELECT chunk_id, doc_id, chunk_index, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, chunk_id)",
    "generated_notes": f"WITH {_GENERATED} SELECT doc_id, chunk_index, relative_path, md5(text) AS text_md5 FROM g",
    "parsed_notes": f"""WITH {_GENERATED} SELECT 'note_' || doc_id || '_chunk_' || n AS note_id, base || ' - chunk ' || n AS title, lower(array_to_string(list_concat(['generated', 'ingested_pdf'], parts), '|')) AS tags,
  array_to_string(list_filter(list_transform(string_split(lower(base || ' chunk ' || n), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS aliases, coalesce(CAST(page_start AS VARCHAR), '') AS page_start, 'generated' AS note_origin,
  md5({_strip("array_to_string(list_transform(string_split(" + _strip("coalesce(body, '')") + ", chr(10)), lambda x: " + _strip("x") + "), chr(10))")}) AS body_md5 FROM g""",
    "source_context": f"""WITH {_C}, {_R}, j AS (SELECT c.doc_id, c.chunk_index, 'note_' || c.doc_id || '_chunk_' || lpad(CAST(c.chunk_index AS VARCHAR), 4, '0') AS note_id FROM c JOIN r ON c.doc_id = r.doc_id)
SELECT note_id, doc_id, CAST(row_number() OVER w AS INTEGER) AS place, lag(note_id) OVER w AS previous_id, lead(note_id) OVER w AS next_id FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
    "preferred_notes": f"""WITH {_N}, x AS (SELECT *, row_number() OVER (PARTITION BY source_doc_id ORDER BY coalesce(meta['chunk_storage_mode'], '') <> 'structural_only', coalesce({_NCI}, 999999), relative_path, note_id) AS rn FROM n WHERE coalesce(source_doc_id, '') <> '')
SELECT source_doc_id AS doc_id, note_id FROM x WHERE rn = 1""",
    "unit_runs": f"""WITH {_E}, f AS (SELECT doc_id, entry_index, CASE WHEN semantic_unit_id <> '' AND semantic_unit_id = lag(semantic_unit_id) OVER (PARTITION BY doc_id ORDER BY entry_index) THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY entry_index) AS INTEGER) AS run FROM f)
SELECT doc_id, entry_index, run, min(entry_index) OVER (PARTITION BY doc_id, run) AS first_entry, max(entry_index) OVER (PARTITION BY doc_id, run) AS last_entry FROM g""",
    "unit_statistics": f"WITH {_C} SELECT doc_id, semantic_unit_id, min(page_start) AS page_start, max(page_end) AS page_end, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY ALL",
    "verification_pages": f"""WITH {_E}, x AS (SELECT doc_id, page_start AS a, greatest(coalesce(page_end, page_start), page_start) AS b,
  content_type = 'table' OR regexp_matches(coalesce(preview, ''), '(?i)^\\s*(?:[A-Za-z][A-Za-z''-]*\\s+){{1,10}}Table\\s+(?:for|of)\\s+\\d[\\d,]*\\s+(?:to|through|[–—-])\\s+\\d[\\d,]*') AS tab, layout_hint = 'equation' AS eq FROM e WHERE page_start > 0),
k AS (SELECT DISTINCT doc_id, unnest(range(a, least(b, a + 7) + 1)) AS p, 0 AS kind FROM x WHERE tab UNION SELECT DISTINCT doc_id, unnest(range(a, b + 1)), 1 FROM x WHERE eq), m AS (SELECT doc_id, min(kind) AS kind FROM k GROUP BY doc_id)
SELECT doc_id, array_to_string(list(p ORDER BY p)[1:8], ',') AS pages FROM k JOIN m USING (doc_id, kind) GROUP BY doc_id""",
    "table_links": f"""WITH {_E}, {_L}, ek AS (SELECT doc_id, entry_index, page_start AS page_number, trim(regexp_replace(lower(coalesce(table_caption, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM e WHERE content_type = 'table' OR coalesce(table_caption, '') <> ''),
lk AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_number) AS n FROM (SELECT DISTINCT doc_id, page_number, layout_id, coalesce(table_index, 0) AS i, trim(regexp_replace(lower(coalesce(caption, '')), '[^a-z0-9]+', ' ', 'g')) AS c FROM l)),
j AS (SELECT ek.doc_id, entry_index, layout_id, i, n, k <> '' AND c <> '' AND (contains(k, c) OR contains(c, k)) AS m FROM ek JOIN lk USING (doc_id, page_number)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entry_index ORDER BY m DESC, i, layout_id) AS rn FROM j WHERE m OR n = 1) SELECT doc_id, entry_index, layout_id FROM r WHERE rn = 1""",
    "figure_links": f"""WITH {_E}, {_L}, b AS (SELECT doc_id, entry_index, page_start AS page_number, trim(regexp_replace(lower(replace(coalesce(preview, ''), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g')) AS t FROM e WHERE page_start IS NOT NULL),
f AS (SELECT doc_id, page_number, layout_id, trim(regexp_replace(lower(coalesce(caption, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM l),
r AS (SELECT f.doc_id, layout_id, entry_index, row_number() OVER (PARTITION BY f.doc_id, layout_id ORDER BY (k <> '' AND contains(t, k)) DESC, entry_index) AS rn FROM f JOIN b USING (doc_id, page_number))
SELECT doc_id, layout_id, entry_index FROM r WHERE rn = 1""",
    "table_series": f"""WITH {_L}, k AS (SELECT DISTINCT doc_id, layout_id, page_number, coalesce(table_index, 0) AS ti, trim(regexp_replace(lower(regexp_replace(coalesce(caption, ''), '(?i)\\(\\s*continued\\s*\\)', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS series_key FROM l),
g AS (SELECT *, CASE WHEN series_key = '' THEN '|' || layout_id ELSE series_key END AS g FROM k),
n AS (SELECT *, CASE WHEN page_number - lag(page_number) OVER (PARTITION BY doc_id, g ORDER BY page_number, ti, layout_id) > 1 THEN 1 ELSE 0 END AS new FROM g),
s AS (SELECT *, CAST(1 + sum(new) OVER (PARTITION BY doc_id, g ORDER BY page_number, ti, layout_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS series FROM n)
SELECT doc_id, layout_id, series_key, series, CAST(row_number() OVER (PARTITION BY doc_id, g, series ORDER BY page_number, ti, layout_id) AS INTEGER) AS place FROM s""",
    "table_cells": f"WITH {_L} SELECT DISTINCT doc_id, layout_id, grid[2][3] AS value FROM l WHERE len(grid[2]) >= 3",
    "outer_layouts": f"""WITH {_L} SELECT doc_id, layout_id FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.bbox <> a.bbox
  AND b.bbox[1] <= a.bbox[1] AND b.bbox[2] <= a.bbox[2] AND b.bbox[3] >= a.bbox[3] AND b.bbox[4] >= a.bbox[4])""",
    "display_layouts": f"WITH {_L} SELECT doc_id, layout_id, caption, CAST(len(grid) AS INTEGER) AS grid_rows FROM l",
    "prime_numbers": "SELECT n FROM range(2, 10001) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 101) d(d) WHERE d < n AND n % d = 0)",
    "page_spec": f"WITH {_C} SELECT chunk_id, page_start FROM c WHERE page_start IN (3, 7, 8, 9, 20, 21, 22, 23, 24)",
    "curator_documents": f"""WITH {_R} SELECT doc_id, coalesce(title, '') AS title, coalesce(collection, 'general') AS collection, coalesce(chunk_storage_mode, 'persistent') AS chunk_storage_mode, coalesce(table_layout_count, 0) AS table_layout_count
FROM r WHERE deleted_at IS NULL AND coalesce(collection, 'general') = 'public'""",
    "collection_counts": f"""WITH {_R} SELECT coalesce(collection, 'general') AS collection, count(*) AS documents, count(*) FILTER (WHERE chunk_storage_mode = 'structural_only') AS structural_only FROM r WHERE deleted_at IS NULL GROUP BY 1""",
    "curator_notes": f"""WITH {_N} SELECT note_id, category, title, coalesce({_NCI}, 999999) AS chunk_index FROM n
WHERE coalesce(note_origin, CASE WHEN is_generated THEN 'generated' WHEN category_parts[1] = '_system' THEN 'system' ELSE 'manual' END) = 'manual'""",
    "origin_counts": "SELECT coalesce(note_origin, CASE WHEN is_generated THEN 'generated' WHEN category_parts[1] = '_system' THEN 'system' ELSE 'manual' END) AS origin, count(DISTINCT note_id) AS notes FROM note GROUP BY 1",
    "folder_tree": """WITH p AS (SELECT DISTINCT list_filter(string_split(category, '/'), lambda x: x <> '') AS p FROM note WHERE category IS NOT NULL),
q AS (SELECT DISTINCT p[1:i] AS p FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p))
SELECT array_to_string(p, '/') AS path, CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], '/') ELSE '' END AS parent, CAST(len(p) AS INTEGER) AS depth, p[len(p)] AS name FROM q""",
    "titled_notes": f"""WITH {_N}, {_R}, j AS (SELECT n.*, r.title AS dt, coalesce(n.is_generated, false) AND coalesce(r.title, '') <> '' AS use FROM n LEFT JOIN r ON trim(n.source_doc_id) = r.doc_id)
SELECT note_id, CASE WHEN use THEN dt || coalesce(' - chunk ' || {_NCI}, '') ELSE title END AS title,
  CASE WHEN use THEN array_to_string(list_filter(list_append(coalesce(aliases, []), lower(coalesce(title, ''))), lambda x: true), '|') ELSE array_to_string(coalesce(aliases, []), '|') END AS aliases FROM j""",
    "note_ids": "SELECT DISTINCT relative_path, 'note_' || substring(sha1(relative_path), 1, 12) AS note_id FROM note",
    "page_filter": f"WITH {_E} SELECT doc_id, entry_index FROM e WHERE coalesce(12 BETWEEN page_start AND coalesce(page_end, page_start), false)",
}
