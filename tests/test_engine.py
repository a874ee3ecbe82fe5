import os

import pytest

from quireflow import cli, engine

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(ROOT), reason="test tables not here")


def test_archive(spark, capsys):
    a = engine.Archive(spark, ROOT)
    hits = a.search("valve pump", fuzzy=False).collect()
    assert 0 < len(hits) <= 5 and [h.rank for h in hits] == list(range(1, len(hits) + 1))
    assert a.search("valve", "notes", fuzzy=False).count() <= 5
    doc = a.documents().first().doc_id
    assert a.document(doc).count() == 1 and a.collection_counts().count() >= 1 and a.folders().count() > 0 and a.origin_counts().count() >= 1
    e = a.entries().orderBy("doc_id", "entry_index").first()
    seg = a.segment(e.doc_id, e.entry_index).collect()
    assert e.entry_index in [s.entry_index for s in seg] and len({s.semantic_unit_id for s in seg}) == 1
    assert a.display_items(e.doc_id).count() > 0
    lay = a.layouts().where("size(grid) > 1").first()
    assert a.table_cell(lay.doc_id, lay.layout_id, 1, 1).count() == 1
    assert lay.layout_id in [s.layout_id for s in a.table_series(lay.doc_id, lay.layout_id).collect()]
    assert a.verification_pages(lay.doc_id).count() <= 1
    n = a.table("note").first()
    assert a.note(n.note_id).count() == 1 and a.note_context(n.note_id).count() <= 1
    assert a.orphans()[0].count() >= 0 and "cells" in a.flat_layouts()
    cli.main([ROOT, "documents"])
    assert "doc_id" in capsys.readouterr().out


def test_safe_paths(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_text("x")
    (tmp_path / "secret").write_text("x")
    assert engine.original_file(str(tmp_path), "d", "a.pdf").endswith("d/a.pdf")
    for doc, name in (("d", "../secret"), ("..", "x"), ("d", "b.pdf")):
        with pytest.raises(FileNotFoundError):
            engine.original_file(str(tmp_path), doc, name)
    old, new = tmp_path / "p.png", tmp_path / "d" / "a.pdf"
    assert not engine.fresh_preview(str(old), str(new))
    old.write_text("x")
    os.utime(old, (2e9, 2e9))
    assert engine.fresh_preview(str(old), str(new))
