import pytest

from quireflow.operators.context import index_entries, storage_mode, unit_runs
from quireflow.plans import chunker, contents, ingest
from quireflow.plans import pages as pg

BOOK = """front
--- PAGE 1 ---
TABLE OF CONTENTS
NUMBERS AND
FRACTIONS
10 Logarithms
20 Factorial
30 Prime Numbers
40 Gears
--- PAGE 2 ---
PREFACE
This is the preface text. It has two sentences.

Second para.
--- PAGE 22 ---
Logarithms
12 MAIN HEADER
Body about logs. More.
Roots.-Taking roots of numbers.
Table 5. Sizes of things
1 2 3
4 5 6
--- PAGE 32 ---
Factorial Notation
Body about factorials.
--- PAGE 42 ---
Prime Numbers
x = 5
y = 6
--- PAGE 52 ---
Gears
gear text continues here
"""


@pytest.fixture(scope="module")
def chunks(spark):
    d = spark.createDataFrame([("d1", BOOK), ("d2", "no markers"), ("d3", None), ("d4", "--- PAGE 1 ---\nABSTRACT\n" + "One two three. " * 200)], "doc_id string, text string")
    return chunker.build_chunks(d).persist()


def of(chunks, doc):
    return [r.asDict() for r in chunks.where(f"doc_id = '{doc}'").orderBy("chunk_index").collect()]


def test_headings_tables_and_hierarchy(chunks):
    c = of(chunks, "d1")
    assert [x["section_heading"] for x in c] == ["Table of Contents", "PREFACE", "Logarithms", "Logarithms", "Logarithms", "Factorial", "Prime Numbers", "Gears"]
    assert [x["subheading"] for x in c] == ["NUMBERS AND FRACTIONS", None, None, "Roots", "Roots", "Factorial Notation", None, None]
    assert [x["content_type"] for x in c] == ["contents", "prose", "prose", "prose", "table", "prose", "prose", "prose"]
    assert c[4]["table_caption"] == "Table 5. Sizes of things" and c[2]["running_header"] == "12 MAIN HEADER" and c[5]["running_header"] is None
    assert {x["printed_page_offset"] for x in c} == {12} and [x["printed_page"] for x in c[2:]] == [10, 10, 10, 20, 30, 40]
    assert c[2]["category"] == "NUMBERS AND FRACTIONS" and c[6]["layout_hint"] == "equation"


def test_ids_offsets_and_spans(chunks):
    c = of(chunks, "d1")
    assert c[0]["chunk_id"] == "d1_chunk_0001" and c[0]["semantic_unit_id"] == "d1_unit_0001"
    end = 0
    for x in c:
        assert x["char_start"] == end and x["char_end"] - end == len(x["text"]) == x["char_count"]
        end = x["char_end"]
        if x["source_char_start"] is not None:
            assert BOOK[x["source_char_start"] : x["source_char_end"]].split() == x["text"].split()


def test_oversized_sentences(chunks):
    c = of(chunks, "d4")
    assert len(c) == 3 and all(x["char_count"] <= 1200 for x in c) and {x["semantic_unit_index"] for x in c} == {1}
    assert [x["retrieval_chunk_index"] for x in c] == [1, 2, 3] and c[0]["retrieval_chunk_count"] == 3 and c[0]["semantic_unit_char_count"] == sum(x["char_count"] for x in c)


def test_documents_without_markers_give_nothing(chunks):
    assert chunks.where("doc_id in ('d2', 'd3')").count() == 0


def test_heading_state_resets_at_contents_pages(spark):
    text = "--- PAGE 1 ---\nRESULTS\nalpha beta\n--- PAGE 2 ---\nplain goes on\n--- PAGE 3 ---\nTABLE OF CONTENTS\n1 Some Title\n--- PAGE 4 ---\nno heading here"
    c = of(chunker.build_chunks(spark.createDataFrame([("d", text)], "doc_id string, text string")), "d")
    assert [(x["page_start"], x["section_heading"]) for x in c] == [(1, "RESULTS"), (2, "RESULTS"), (3, "Table of Contents"), (4, None)]
    assert c[0]["semantic_unit_index"] == c[1]["semantic_unit_index"] and c[0]["semantic_unit_page_end"] == 2 and c[0]["semantic_unit_block_count"] == 2


def test_offset_vote(spark):
    def offset(pages, entries):
        p = spark.createDataFrame([("d", i, n, t, 0, 0) for i, (n, t) in enumerate(pages)], "doc_id string, page_seq int, page_number int, text string, source_char_start long, source_char_end long")
        e = spark.createDataFrame([("d", i, t, n) for i, (t, n) in enumerate(entries)], "doc_id string, ordinal int, title string, printed_page int")
        return [r.page_offset for r in contents.page_offset(p, e).collect()]

    assert offset([(22, "Aa"), (32, "Bb"), (42, "Cc")], [("Aa", 10), ("Bb", 20), ("Cc", 30)]) == [12]
    assert offset([(22, "Aa"), (32, "Bb")], [("Aa", 10), ("Bb", 20)]) == []
    tie = [(i, chr(65 + i) * 2) for i in range(6)]
    assert offset(tie, [(t, n - (1 if n < 3 else 2)) for n, t in tie]) == []


def test_hierarchy_takes_the_last_section_before(spark):
    e = spark.createDataFrame([("d", 1, "Introduction", 1128, "A", "x"), ("d", 2, "Introduction", 2667, "B", "y")], "doc_id string, ordinal int, title string, printed_page int, major_section string, category string")
    b = spark.createDataFrame([("d", "introduction", 2679), ("d", "Introduction", 1141), ("d", "Introduction", 100), ("d", None, 2679)], "doc_id string, heading string, page_number int")
    o = spark.createDataFrame([("d", 12)], "doc_id string, page_offset int")
    got = {(r.heading, r.page_number): r.major_section for r in contents.resolve_hierarchy(b, e, o).collect()}
    assert got == {("introduction", 2679): "B", ("Introduction", 1141): "A", ("Introduction", 100): None, (None, 2679): None}


def test_catalog_and_categories():
    groups, header = contents.catalog_groups(["TABLE OF CONTENTS", "vii", "Each section includes a detailed table of contents or index", "LICENSE v", "PREFACE vi", "MATHEMATICS 1", "• algebra", "803TOOLING"])
    assert header == "TABLE OF CONTENTS vii"
    assert [g[0] for g in groups] == ["Front Matter", "MATHEMATICS", "TOOLING"] and groups[0][1][0].startswith("Each") and groups[1][1] == ["MATHEMATICS 1", "• algebra"]
    groups, header = contents.category_groups(["MATHEMATICS", "TABLE OF CONTENTS", "stray", "NUMBERS", "AND MORE", "3 Fractions", "wrapped", "GEOMETRY"], {"mathematics"})
    assert header == "MATHEMATICS" and groups == [("NUMBERS AND MORE", ["stray", "NUMBERS AND MORE", "3 Fractions", "wrapped"]), ("GEOMETRY", ["GEOMETRY"])]


def test_index_and_modes(spark, chunks):
    e = index_entries(chunks).where("doc_id = 'd1'").orderBy("entry_index").collect()
    assert e[0].entry_index == 0 and e[4].search_text.startswith("Table 5") and e[3].search_text == "" and e[1].subheading == ""
    assert {r.doc_id: r.chunk_storage_mode for r in storage_mode(chunks, limit=5).collect()} == {"d1": "structural_only", "d4": "persistent"}
    with pytest.raises(ValueError):
        storage_mode(chunks, "often")
    runs = unit_runs(index_entries(chunks).where("doc_id = 'd4'")).collect()
    assert {(r.run, r.first_entry, r.last_entry) for r in runs} == {(1, 0, 2)}


def test_ingest_writes_only_its_documents(spark, tmp_path):
    texts = spark.createDataFrame([("/x/a.txt", BOOK), ("/x/b.txt", "--- PAGE 1 ---\nRESULTS\nshort text"), ("/x/copy.txt", BOOK)], "path string, text string")
    r = ingest.ingest(ingest.register(texts, "shop"), limit=3)
    ingest.write(r, str(tmp_path))
    assert r.registry.count() == 2
    assert spark.read.parquet(str(tmp_path / "structural_index")).count() == 9
    kept = spark.read.parquet(str(tmp_path / "chunks"))
    assert kept.count() == 1
    more = ingest.ingest(ingest.register(spark.createDataFrame([("/x/c.txt", "--- PAGE 1 ---\nMETHODS\nother")], "path string, text string")))
    ingest.write(more, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "structural_index")).count() == 10
    doc = kept.first().doc_id
    ingest.delete_document(spark, str(tmp_path), doc, "chunks")
    assert spark.read.parquet(str(tmp_path / "chunks")).where(f"doc_id = '{doc}'").count() == 0
