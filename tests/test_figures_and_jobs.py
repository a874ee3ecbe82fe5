import json
import os

from pyspark.sql import functions as F

from quireflow.operators import figures
from quireflow.plans import layout_jobs


def test_regions(spark):
    tok = lambda a, b: [(a, b, "w")]
    lines = spark.createDataFrame([("d", 1, 0, 5.0, 9.0, "label A", tok(1.0, 9.0)), ("d", 1, 1, 50.0, 55.0, "Fig. 1. Pump", tok(20.0, 60.0)), ("d", 1, 2, 80.0, 85.0, "Figure 2. Nothing here", tok(5.0, 9.0)), ("d", 1, 3, 120.0, 125.0, "Fig. 3. Last", tok(5.0, 9.0))],
                                  "doc_id string, page_number int, line_index int, top double, bottom double, text string, tokens array<struct<x0:double,x1:double,text:string>>")
    words = spark.createDataFrame([("d", 1, 2.0, 200.0, 20.0, 30.0)], "doc_id string, page_number int, x0 double, x1 double, top double, bottom double")
    objects = spark.createDataFrame([("d", 1, "line", 30.0, 12.0, 40.0, 48.0), ("d", 1, "image", 25.0, 90.0, 70.0, 110.0), ("d", 1, "rect", None, 1.0, 2.0, 3.0)], "doc_id string, page_number int, kind string, x0 double, top double, x1 double, bottom double")
    pages = spark.createDataFrame([("d", 1, [0.0, 0.0, 150.0, 200.0])], "doc_id string, page_number int, bbox array<double>")
    got = {r.layout_id: r for r in figures.figure_regions(lines, words, objects, pages).collect()}
    assert set(got) == {"page_0001_figure_01", "page_0001_figure_03"}
    a, c = got["page_0001_figure_01"], got["page_0001_figure_03"]
    assert a.bbox == [0.0, 4.0, 150.0, 60.0] and (a.vector_object_count, a.embedded_image_count) == (1, 0) and a.label_text == "Fig. 1. Pump"
    assert c.bbox == [0.0, 82.0, 80.0, 130.0] and c.embedded_image_count == 1 and c.caption_key == "fig 3 last"


def test_labels(spark):
    d = spark.createDataFrame([("A B Fig. 1. Pump later prose", "Fig. 1. Pump", "text A\n B   Fig. 1. Pump\n\n\n\nmore A B Fig. 1. Pump")], "label string, caption string, body string")
    t = figures.label_text(F.col("label"), F.col("caption"))
    r = d.select(t.alias("t"), figures.remove_labels(F.col("body"), F.array(t, F.lit(""), F.lit("absent (x"))).alias("b")).first()
    assert r.t == "A B Fig. 1. Pump" and r.b == "text \n\nmore A B Fig. 1. Pump"


def test_apply(spark):
    e = spark.createDataFrame([("d", 0, "prose", "", "see", "", 5, None), ("d", 1, "prose", "Table 2. X", "p", "old", 6, "stale"), ("d", 2, "table", "", "p", "12 rows", 7, None)], "doc_id string, entry_index int, content_type string, table_caption string, preview string, search_text string, page_start int, table_layout_id string")
    lay = spark.createDataFrame([("d", "t6", 6, 1, "TABLE 2 x", "1 2"), ("d", "t7", 7, 1, "other", "12")], "doc_id string, layout_id string, page_number int, table_index int, caption string, reading_order_text string")
    got = {r.entry_index: r for r in layout_jobs.apply_layouts(e, lay).collect()}
    assert (got[1].content_type, got[1].table_caption, got[1].search_text, got[1].table_layout_id) == ("table", "TABLE 2 x", "old\n\n1 2", "t6")
    assert (got[2].search_text, got[2].table_layout_id, got[0].table_layout_id) == ("12 rows", "t7", None)
    assert {(r.page_number) for r in layout_jobs.table_pages(e).collect()} == {6, 7} and layout_jobs.table_pages(e, [7, 9]).count() == 1
    fig = spark.createDataFrame([("d", "f1", 5, 1, "Fig. 1", "one"), ("d", "f2", 5, 2, "Fig. 2", "one"), ("d", "f3", 5, 3, "Fig. 3", "two")], "doc_id string, layout_id string, page_number int, figure_index int, caption string, label_text string")
    r = figures.apply_figures(e, fig).where("entry_index = 0").first()
    assert r.figure_layout_ids == ["f1", "f2", "f3"] and r.figure_search_text == "one\n\ntwo"


def test_store_and_migration(spark, tmp_path):
    src, out = tmp_path / "docs", str(tmp_path / "store")
    for doc, mode in (("a", None), ("b", "sharded")):
        os.makedirs(src / doc)
        (src / doc / "layout.json").write_text(json.dumps({"doc_id": doc, "storage_mode": mode, "layouts": [{"layout_id": "x", "page_number": 1, "grid": [["2", "3"], ["4", "5"]]}]}))
    (src / "c").mkdir()
    (src / "c" / "layout.json").write_text("{broken")
    schema = "layout_id string, page_number int, grid array<array<string>>"
    assert layout_jobs.migrate_documents(spark, str(src / "*" / "layout.json"), schema, out) == 1
    assert layout_jobs.migrate_documents(spark, str(src / "*" / "layout.json"), schema, out) == 0
    assert layout_jobs.read_json_tables(spark, str(src), "layout.json", "doc_id string, storage_mode string").count() == 2
    got = {(r.number, r.problem) for r in layout_jobs.verify_prime_layouts(spark.read.parquet(out), 10, spark).collect()}
    assert got == {(7, "missing"), (4, "extra")}
    new = spark.createDataFrame([("a", "y", 2, None)], f"doc_id string, {schema}")
    layout_jobs.store_layouts(spark.read.parquet(out), new, out + "2", [2])
    assert {r.layout_id for r in spark.read.parquet(out + "2").collect()} == {"x", "y"}
