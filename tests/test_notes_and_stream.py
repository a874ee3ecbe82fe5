import os

import pytest

from quireflow.operators import curation
from quireflow.sources import notes
from quireflow.streaming import ingest as stream


def test_scan_and_crud(spark, tmp_path):
    root = str(tmp_path / "archive")
    rel = notes.create_note(root, "Gear Notes", ["gear", "Shop"], "Body  line \nsecond", "shop/gears", ["Cog", "cog", "Wheel"])
    assert rel == "shop/gears/gear_notes.md"
    with pytest.raises(FileExistsError):
        notes.create_note(root, "Gear Notes", [], "", "shop/gears")
    for bad in ("../x", "/x", "_generated", "a/.b", ""):
        with pytest.raises(ValueError):
            notes.create_note(root, "t", [], "", bad)
    path = os.path.join(root, rel)
    with open(path) as f:
        text = f.read()
    with open(path, "w") as f:
        f.write(text.replace("tags:", "custom: kept:value\ntags:"))
    notes.update_note(root, rel, "New Title", ["x"], "new body", ["A"])
    os.makedirs(os.path.join(root, "_generated", "d"))
    with open(os.path.join(root, "_generated", "d", "n__chunk_0003.md"), "w") as f:
        f.write("title: G\nsource_doc_id: d\nno header line\nbody: x\n")
    got = {r.relative_path: r for r in notes.scan_notes(spark, root).collect()}
    n = got[rel]
    assert (n.title, n.tags, n.aliases, n.body, n.category, n.meta["custom"], n.note_origin) == ("New Title", ["x"], ["a"], "new body", "shop/gears", "kept:value", "manual")
    assert n.note_id.startswith("note_") and n.category_parts == ["shop", "gears"]
    g = got["_generated/d/n__chunk_0003.md"]
    assert (g.id, g.is_generated, g.note_origin, g.source_doc_id, g.meta) == (0, True, "generated", "d", {"source_doc_id": "d"})
    with pytest.raises(ValueError):
        notes.delete_note(root, "_generated/d/n__chunk_0003.md")
    with pytest.raises(ValueError):
        notes.delete_note(root, "../archive2/x.md")
    notes.delete_note(root, rel)
    assert not os.path.exists(path)


def test_round_trip(spark):
    d = spark.createDataFrame([("a/b.md", "T", ["x", "y"], ["Q", "q"], {"note_id": "n1", "k": "v"}, "one\ntwo")], "relative_path string, title string, tags array<string>, aliases array<string>, meta map<string,string>, body string")
    r = notes.parse_notes(notes.note_text(d)).first()
    assert (r.title, r.tags, r.aliases, r.meta, r.body, r.note_id) == ("T", ["x", "y"], ["q"], {"note_id": "n1", "k": "v"}, "one\ntwo", "n1")


def test_registry(spark):
    kind = "doc_id string, title string, title_source string, collection string, source_filename string, category_path string, status string, page_count int, chunk_count int, chunk_storage_mode string, table_layout_count int, created_at timestamp, updated_at timestamp, deleted_at timestamp"
    import datetime as dt

    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    rows = [("a", "Old", None, "public", "f", "c", "chunked", 1, 1, None, None, t[0], t[1], None), ("a", "New", None, None, "f", "c", "chunked", 1, 1, None, None, t[0], t[2], None), ("b", "Gone", None, "public", "f", "c", "deleted", 1, 1, None, 2, t[0], t[3], t[4]), ("c", None, None, "private", "f", "c", "chunked", 1, 1, "structural_only", 3, t[0], None, None)]
    reg = spark.createDataFrame(rows, kind)
    assert [(r.doc_id, r.title, r.collection) for r in curation.list_documents(reg).collect()] == [("a", "New", "general"), ("c", "", "private")]
    assert [r.doc_id for r in curation.list_documents(reg, "private").collect()] == ["c"]
    assert {r.collection: (r.documents, r.structural_only) for r in curation.collection_counts(reg).collect()} == {"general": (1, 0), "private": (1, 1)}
    new = curation.update_details(reg, "c", "  Fine   Title ", "public").where("doc_id = 'c'").first()
    assert (new.title, new.collection, new.title_source) == ("Fine Title", "public", "manual")
    for title, coll in (("", "public"), ("x" * 301, "public"), ("ok", "secret")):
        with pytest.raises(ValueError):
            curation.update_details(reg, "c", title, coll)
    assert curation.anchor_note_text(reg).first().text.startswith("title: \ntags: generated, ingested_pdf, structural_only, c\nnote_id: note_c_structural_anchor\n")


def test_stream_ingests_each_file_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    os.makedirs(src)
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("--- PAGE 1 ---\nRESULTS\nsome text here")
    stream.start(spark, src, out, cp).awaitTermination()
    with open(os.path.join(src, "b.txt"), "w") as f:
        f.write("--- PAGE 1 ---\nMETHODS\nother text")
    stream.start(spark, src, out, cp).awaitTermination()
    got = spark.read.parquet(os.path.join(out, "structural_index"))
    assert sorted(r.section_heading for r in got.collect()) == ["METHODS", "RESULTS"]


def test_positions(spark):
    from quireflow.plans.ordering import numbered

    d = spark.range(5000).selectExpr("(id * 7919) % 5000 AS v", "'x' AS w").repartition(7)
    got = numbered(d, "place", "v").collect()
    assert len(got) == 5000 and all(r.v == r.place for r in got)
    assert numbered(d.limit(0), "place", "v").count() == 0
