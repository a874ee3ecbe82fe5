"""DuckDB statements for the queries of this package that SQL can state."""

from __future__ import annotations

import unicodedata

# Fixed values, written down apart from the operator's table: letters of other scripts and the Latin letters they look like.
_FROM = "ЅІЈАВЕКМНОРСТУХҮӀԁԌԚԜаеорсухѕіјүһӏԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿοϲϳՕսօ"
_TO = "SIJABEKMHOPCTYXYIdGQWaeopcyxsijyhlqwABEZHIKMNOPTYXJocjOuo"
_SIGNS = {"µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å"}
_SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
_DASHES = "\u2010\u2011\u2012\u2013\u2043\u2212\ufe63"
_NOTHING = "\u00ad\u034f\u061c" + "".join(map(chr, (*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)))) + "\ufeff"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}


def _one_to_one() -> tuple[str, str]:
    wide = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}
    m = wide | dict(zip(_FROM, _TO)) | _SIGNS | dict.fromkeys(_SPACES, " ") | dict.fromkeys(_DASHES, "-")
    return "".join(m) + _NOTHING, "".join(m.values())


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fold(x: str) -> str:
    src, dst = _one_to_one()
    e = f"translate({x}, {_q(src)}, {_q(dst)})"
    for a, b in LIGATURES.items():
        e = f"replace({e}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize({e})"


def _line_key(x: str) -> str:
    k = f"trim(regexp_replace(lower({sql_fold(x)}), '[\\s\\x00-\\x1f]+', ' ', 'g'))"
    k = f"regexp_replace({k}, '^[\\[(|\\-. ]*\\d+\\b[\\])|\\-.: ]*', '')"
    return f"regexp_replace({k}, '[\\[(|\\-.: ]*\\b\\d+[\\])|\\-. ]*$', '')"


_P1 = f"""
WITH c AS (SELECT DISTINCT doc_id, chunk_index AS p, text FROM chunks WHERE text IS NOT NULL),
l AS (SELECT 'text' AS field, doc_id, p, n, {_line_key("line")} AS k FROM (
        SELECT doc_id, p, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM c)
      UNION ALL
      SELECT DISTINCT 'running_header', doc_id, chunk_index, 0, {_line_key("running_header")} FROM structural_index WHERE running_header IS NOT NULL),
lk AS (SELECT * FROM l WHERE regexp_matches(k, '\\p{{L}}')),
f AS (SELECT field, doc_id, k, count(DISTINCT p) AS n FROM lk GROUP BY ALL HAVING count(DISTINCT p) >= 5),
s AS (SELECT 'text' AS field, doc_id, count(DISTINCT chunk_index) AS m FROM chunks GROUP BY doc_id
      UNION ALL SELECT 'running_header', doc_id, count(DISTINCT chunk_index) FROM structural_index GROUP BY doc_id),
hit AS (SELECT DISTINCT lk.field, lk.doc_id, lk.p AS chunk_index, CAST(lk.n AS INTEGER) AS line_no
        FROM lk JOIN f USING (field, doc_id, k) JOIN s USING (field, doc_id) WHERE f.n >= 0.1 * s.m)
"""

_TEXTS = """
t AS (SELECT DISTINCT 'chunks.text' AS field, chunk_id AS key, text FROM chunks WHERE text IS NOT NULL
      UNION SELECT DISTINCT 'note.body', note_id, body FROM note WHERE body IS NOT NULL
      UNION SELECT DISTINCT 'structural_index.search_text', doc_id || ':' || entry_index, search_text FROM structural_index WHERE search_text <> '')
"""

_WORDS = "list_filter(regexp_split_to_array(lower(f), '\\s+'), lambda x: x <> '')"
_EDGE = ".,;:!?\"''()[]{}<>«»“”‘’*_-–—/|#"


def _form(x: str) -> str:
    t = f"lower({sql_fold(f'regexp_replace({x}, {_q(chr(0xAD))} || {_q("[ \\t]*\\r?\\n[> \\t]*")}, {_q("")}, {_q("g")})')})"
    t = f"regexp_replace({t}, '(\\p{{L}})-[ \\t]*\\r?\\n[> \\t]*(\\p{{L}})', '\\1\\2', 'g')"
    return f"trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'))"


ORACLES: dict[str, str] = {
    "p1_found": _P1 + "SELECT * FROM hit",
    "p1_rebuilt": _P1
    + """, g AS (SELECT doc_id, chunk_index, list(line_no) AS gone FROM hit WHERE field = 'text' GROUP BY ALL),
r AS (SELECT DISTINCT chunk_id, CASE WHEN g.gone IS NULL THEN text ELSE
        array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(g.gone, CAST(i AS INTEGER))), chr(10)) END AS text
      FROM (SELECT DISTINCT chunk_id, doc_id, chunk_index, text FROM chunks) LEFT JOIN g USING (doc_id, chunk_index))
SELECT chunk_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM r""",
    "p1_headers": _P1
    + """SELECT DISTINCT e.doc_id, e.entry_index, CASE WHEN hit.doc_id IS NULL OR e.running_header IS NULL THEN e.running_header ELSE '' END AS running_header
FROM structural_index e LEFT JOIN hit ON hit.field = 'running_header' AND hit.doc_id = e.doc_id AND hit.chunk_index = e.chunk_index""",
    "p2_found": f"WITH {_TEXTS}, k AS (SELECT field, key, text, {sql_fold('text')} AS f FROM t WHERE text <> '')"
    " SELECT DISTINCT a.field, a.key AS key_a, b.key AS key_b FROM k a JOIN k b ON a.field = b.field AND a.f = b.f AND a.key < b.key AND a.text <> b.text",
    "p2_canonical": f"WITH {_TEXTS} SELECT DISTINCT field, key, md5({sql_fold('text')}) AS canonical_md5 FROM t WHERE key IS NOT NULL",
    "p3_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 1200",
    "p6_statistics": f"""
WITH c AS (SELECT DISTINCT chunk_id, text, {sql_fold("text")} AS f FROM chunks),
w AS (SELECT chunk_id, f, {_WORDS} AS words, list_filter(string_split(f, chr(10)), lambda x: regexp_matches(x, '\\S')) AS lines FROM c),
common AS (SELECT list(DISTINCT lower(word)) AS ws FROM common_words WHERE word IS NOT NULL)
SELECT chunk_id, CAST(len(words) AS BIGINT) AS word_count,
  CASE WHEN len(words) > 0 THEN round(list_sum(list_transform(words, lambda x: length(x))) / len(words), 6) END AS mean_word_length,
  CASE WHEN len(words) > 0 THEN round(length(regexp_replace(f, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(f), 6) END AS symbol_ratio,
  CASE WHEN len(words) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;…]["''”’)»\\]]*\\s*$'))) / len(lines), 6) END AS punctuated_line_share,
  CASE WHEN len(words) > 0 THEN round(len(list_filter(words, lambda x: list_contains(ws, trim(x, '{_EDGE}')))) / len(words), 6) END AS common_word_share
FROM w, common""",
    "p7_found": f"""
WITH i AS (SELECT DISTINCT item_id, string_split({_form("text")}, ' ') AS w FROM eval_items WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[s : s + least(15, len(w)) - 1], ' ') || ' ' AS passage
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(15, len(w)) + 2)) AS s FROM i)),
d AS (SELECT doc_id, ' ' || {_form("text")} || ' ' AS f FROM documents WHERE text <> '')
SELECT DISTINCT doc_id, item_id FROM d JOIN win ON contains(d.f, win.passage)""",
}
