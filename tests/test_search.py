import difflib

import pytest

from quireflow.operators import search

NOTE = "id long, note_id string, title string, tags array<string>, aliases array<string>, meta map<string,string>, source_doc_id string, body string, relative_path string, category_parts array<string>, is_generated boolean, note_origin string"


def note(i, title="", body="", tags=(), aliases=(), source=None, pages=None, parts=("shop",), origin=None):
    generated = source is not None
    meta = {} if pages is None else {"page_start": str(pages[0]), "page_end": str(pages[1])}
    return (i, f"n{i}", title, list(tags), list(aliases), meta, source, body, f"shop/n_{i}.md", list(parts), generated, origin)


def ids(d):
    return [r.id for r in d.orderBy("position").collect()]


def test_title_beats_body_and_alias_is_whole(spark):
    d = spark.createDataFrame([note(0, "x", "The compass requires calibration."), note(1, "Compass Calibration"), note(2, "y", "z", aliases=["magnetometer"])], NOTE)
    hits = search.search_notes(d, "compass").orderBy("position").collect()
    assert [(r.id, r.score) for r in hits] == [(1, 5), (0, 1)]
    assert ids(search.search_notes(d, "magnetometer")) == [2] and ids(search.search_notes(d, "magneto")) == []


def test_sources_do_not_swamp(spark):
    d = spark.createDataFrame([note(i, body="battery", source="s") for i in range(5)] + [note(9, body="battery")], NOTE)
    hits = search.search_notes(d, "battery").orderBy("position").collect()
    assert [(r.id, r.score) for r in hits] == [(9, 1), (0, 0), (1, -1), (2, -2), (3, -3)]


def test_scopes_and_system_notes(spark):
    d = spark.createDataFrame([note(0, "gear"), note(1, "gear", source="s"), note(2, "gear", parts=("_system",))], NOTE)
    assert ids(search.search_notes(d, "gear", scope="notes")) == [0]
    assert ids(search.search_notes(d, "gear", scope="reference")) == [1]
    assert ids(search.search_notes(d, "gear")) == [0, 2, 1]


def test_pages(spark):
    d = spark.createDataFrame([note(0, source="s", pages=(17, 17)), note(1, source="s", pages=(262, 264)), note(2, body="see page 263 there"), note(3, body="page 2634")], NOTE)
    hits = search.search_notes(d, "page 263").orderBy("position").collect()
    assert [(r.id, r.score) for r in hits] == [(1, 49), (2, 20)]


def test_parse():
    assert search.parse_page_query("gears p. 12 teeth") == (12, "gears   teeth") and search.parse_page_query("no page") == (None, "no page")
    assert search.parse_terms("a-b c! don't x") == ["ab", "dont"]


@pytest.mark.parametrize("term", ["compas", "calibratoin", "batteri", "rotor", "xy"])
def test_fuzzy_as_the_library_does(spark, term):
    words = ["compass", "compas", "calibration", "calibrations", "battery", "batteries", "rotors", "motor", "rotor", "xyz"]
    v = spark.createDataFrame([(w,) for w in words], "word string")
    want = difflib.get_close_matches(term, words, n=1 if len(term) <= 7 else 2, cutoff=0.9) if len(term) >= 5 else []
    assert [r.word for r in search.fuzzy_matches(v, [term]).orderBy("place").collect()] == want
    assert search.expand_terms([term, term], v)[0] == term


def test_vocabulary(spark):
    d = spark.createDataFrame([note(0, "Two Words", "body here.", ["tag one"], ["alias"])], NOTE)
    assert {r.word for r in search.build_vocabulary(d).collect()} == {"two", "words", "body", "here.", "tag one", "alias", "shop/n", "0.md"}


ENTRY = "doc_id string, entry_index int, content_type string, section_heading string, subheading string, category string, major_section string, table_caption string, preview string, search_text string, semantic_unit_id string, retrieval_chunk_index int, table_layout_id string, page_start int, page_end int"
DOC = "doc_id string, title string, chunk_storage_mode string, updated_at string, category_path string"


def entry(i, kind="prose", heading="", preview="", caption="", unit="u", r=1, layout=None, page=1, doc="d", text=""):
    return (doc, i, kind, heading, "", "", "", caption, preview, text, unit, r, layout, page, page)


def test_structural_search(spark):
    docs = spark.createDataFrame([("d", "Book", "structural_only", "2024", "shop/keys"), ("p", "Other", "persistent", "2025", "x")], DOC)
    rows = [
        entry(0, heading="Woodruff keys", preview="the woodruff key", page=42), entry(1, "table", caption="Woodruff Table", unit="t1", r=1, text="woodruff 1"),
        entry(2, "table", caption="Woodruff Table", unit="t1", r=2, text="woodruff 2"), entry(3, preview="WOODRUFF woodruff"), entry(0, heading="woodruff", doc="p"), entry(4, heading="Tables", preview="none"),
    ]
    e = spark.createDataFrame(rows, ENTRY)
    hits = search.search_structural(e, docs, "Woodruff").orderBy("position").collect()
    assert [(r.entry_index, r.score) for r in hits] == [(0, 6), (1, 6), (3, 1)]
    assert hits[0].category == "shop > keys" and hits[1].title == "Woodruff Table" and hits[2].title == "Page 1 · Extracted segment"
    twice = search.search_structural(e, docs, "woodruff woodruff").orderBy("position").collect()
    assert twice[0].score == 12
    pages = search.search_structural(e, docs, "page 42").collect()
    assert [(r.entry_index, r.score) for r in pages] == [(0, 50)]


def test_federation_prefers_notes_on_ties(spark):
    n = spark.createDataFrame([(1, 6, 7, "n"), (2, 1, 8, "m")], "position int, score int, id long, title string")
    s = spark.createDataFrame([(1, 6, "structural:d:1", "s"), (2, 5, "structural:d:2", "t")], "position int, score int, id string, title string")
    assert [r.id for r in search.federate(n, s, 3).orderBy("rank").collect()] == ["7", "structural:d:1", "structural:d:2"]
