import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quireflow.operators import artifacts, context, nested, references

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def test_orphans_against_brute_force(spark):
    rng = random.Random(5)
    kids = [(f"r{i}", rng.choice(["a", "b", " c ", "x", "", None, "None", "hot", "hot", "hot"]), T0 + DAY * rng.randint(0, 90) if rng.random() < 0.95 else None, 1) for i in range(300)]
    kids += kids[:5]
    par = [("a", T0 + DAY * 40, None), ("a", T0 + DAY * 20, None), ("b", T0, T0 + DAY), ("c", T0 + DAY * 10, None), ("hot", T0 + DAY * 50, None), (None, T0, None), ("b", None, None)]
    k = spark.createDataFrame(kids, "id string, ref string, t timestamp, table_name int")
    p = spark.createDataFrame(par, "key string, born timestamp, gone timestamp")
    args = ("kids", F.col("id"), [references.clean_reference(F.col("ref"), ("None",))], F.col("t"))
    got = {r.record_key for r in references.find_orphans(k, p, *args, [F.col("key")], F.col("born"), F.col("gone").isNull()).collect()}
    live = {}
    for key, born, gone in par:
        if key and gone is None and born:
            live[key] = min(live.get(key, born), born)
    want = {i for i, r, t, _ in kids if r and r.strip() not in ("", "None") and (r.strip() not in live or t is not None and t < live[r.strip()])}
    assert got == want and 20 < len(want) < 250
    orphans = references.find_orphans(k, p, *args, [F.col("key")], F.col("born"), F.col("gone").isNull())
    counts = references.count_orphans(orphans, k, *args).collect()
    assert sum(r.orphans for r in counts) == len(want) and sum(r.references for r in counts) == len({i for i, r, *_ in kids if r and r.strip() not in ("", "None")})
    assert references.find_orphans(k.limit(0), p, *args, [F.col("key")], F.col("born"), F.col("gone").isNull()).count() == 0
    assert references.find_orphans(k, p.limit(0), *args, [F.col("key")], F.col("born"), F.col("gone").isNull()).count() == len({i for i, r, *_ in kids if r and r.strip() not in ("", "None")})


SCHEMA = "id string, pos1 int, one struct<a:int,deep:struct<b:string>>, items array<struct<n:int,tags:array<string>,kids:array<struct<v:int>>>>, more array<struct<n:int,tags:array<string>,kids:array<struct<v:int>>>>, grid array<array<string>>, m map<string,int>"


def test_flatten(spark):
    row = ("r", 9, (1, ("b",)), [(1, ["x", None, "y"], [(5,), None, (6,)]), None, (3, None, [])], [(7, [], None)], [["a", None], None, ["c"]], {"k": 1})
    d = spark.createDataFrame([row, row, ("e", None, None, [], None, None, None), (None, None, None, [(8, None, None)], None, None, None)], SCHEMA)
    t = nested.flatten_records(d, ["id"])
    assert {(r.id, r.one_a, r.one_deep_b) for r in t["root"].collect()} == {("r", 1, "b"), ("e", None, None), (None, None, None)} and "f_pos1" not in t["root"].columns
    assert {(r.id, r.pos1, r.path, r.n) for r in t["items"].collect()} == {("r", 1, "items", 1), ("r", 3, "items", 3), ("r", 1, "more", 7), (None, 1, "items", 8)}
    assert {(r.pos1, r.pos2, r.value) for r in t["items_tags"].collect()} == {(1, 1, "x"), (1, 3, "y")}
    assert {(r.path, r.pos1, r.pos2, r.v) for r in t["items_kids"].collect()} == {("items.kids", 1, 1, 5), ("items.kids", 1, 3, 6)}
    assert {(r.pos1, r.pos2, r.value) for r in t["grid_item"].collect()} == {(1, 1, "a"), (3, 1, "c")}
    assert {(r.key, r.value) for r in t["m"].collect()} == {("k", 1)}
    assert all(x.count() == 0 for x in nested.flatten_records(d.limit(0), ["id"]).values())


LAYOUT = "doc_id string, layout_id string, page_number int, table_index int, caption string, bbox array<double>, grid array<array<string>>"


def test_series_links_cells(spark):
    rows = [("d", "a", 658, 1, "Table 3. X", [0.0, 0.0, 9.0, 9.0], [["1", "2", "3"], ["4", "5", "3"]]), ("d", "b", 659, 1, "TABLE 3 x (continued)", [1.0, 1.0, 2.0, 2.0], None),
            ("d", "c", 900, 1, "Table 3. X", None, []), ("d", "e", 659, 2, "", [0.0, 0.0, 5.0, 5.0], [["only"]]), ("d", "f", 659, 3, None, [1.0, 1.0, 2.0, 2.0], None)]
    lay = spark.createDataFrame(rows, LAYOUT)
    s = {r.layout_id: (r.series_key, r.series, r.place) for r in artifacts.table_series(lay).collect()}
    assert s["a"] == ("table 3 x", 1, 1) and s["b"] == ("table 3 x", 1, 2) and s["c"] == ("table 3 x", 2, 1) and s["e"][0] == ""
    assert [(r.layout_id, r.value) for r in artifacts.table_cell(lay, 2, 3).collect()] == [("a", "3")] and artifacts.table_cell(lay, 20, 1).count() == 0
    with pytest.raises(ValueError):
        artifacts.table_cell(lay, 0, 1)
    # b and f are equal boxes inside e: nested in a different one, so both go
    assert {r.layout_id for r in artifacts.drop_nested(lay).collect()} == {"a", "c", "e"}
    e = spark.createDataFrame([("d", 0, "table", "table 3 X", 658, 658), ("d", 1, "table", "", 900, 900), ("d", 2, "table", "Other", 659, 659), ("d", 3, "prose", "", 658, 658)], "doc_id string, entry_index int, content_type string, table_caption string, page_start int, page_end int")
    assert {(r.entry_index, r.layout_id) for r in artifacts.link_tables(e, lay).collect()} == {(0, "a"), (1, "c")}
    f = spark.createDataFrame([("d", 0, "nothing", 5, 5), ("d", 1, "see Fig. 3. A pump here", 5, 5)], "doc_id string, entry_index int, body string, page_start int, page_end int")
    fig = spark.createDataFrame([("d", "x", 5, "Fig. 3. A Pump"), ("d", "y", 5, "Fig. 9")], "doc_id string, layout_id string, page_number int, caption string")
    assert {(r.layout_id, r.entry_index) for r in artifacts.link_figures(f, fig).collect()} == {("x", 1), ("y", 0)}


def test_baseline_lines(spark):
    w = spark.createDataFrame([("d", 1, "20", 30.0, 40.0, 10.5, 15.0), ("d", 1, "Width", 0.0, 20.0, 1.0, 6.0), ("d", 1, "10", 0.0, 9.0, 10.0, 15.0)], "doc_id string, page_number int, text string, x0 double, x1 double, top double, bottom double")
    assert [(r.text, r.top) for r in artifacts.baseline_lines(w, 1.0).orderBy("line_index").collect()] == [("Width", 1.0), ("10 20", 10.0)]


def test_packed_rows(spark):
    boxes = [(0.0, 10.0), (10.0, 20.0), (20.0, 30.0)]
    line = lambda k: [(1.0, 3.0, "P"), (11.0, 13.0, str(k)), (21.0, 23.0, str(k * 2))]
    kind = "doc_id string, layout_id string, boxes array<array<struct<x0:double,x1:double>>>, lines array<array<array<struct<x0:double,x1:double,text:string>>>>, cells array<array<string>>"
    head = [[(1.0, 2.0, "h")]]
    bad = [line(k) for k in range(4)] + [[(1.0, 3.0, "word"), (11.0, 12.0, "1"), (21.0, 22.0, "2")]]
    rows = [("d", "ok", [boxes, boxes], [head, [line(k) for k in range(6)]], [["a", "b", "c"], ["x"]]), ("d", "bad", [boxes], [bad], [["x"]]), ("d", "same", [boxes], [head], [["a", "b", "c"]]), ("d", "few", [boxes[:2]], [head], [["a"]])]
    got = {r.layout_id: r.grid for r in artifacts.recover_packed_rows(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {"ok"} and len(got["ok"]) == 7 and got["ok"][0] == ["a", "b", "c"] and got["ok"][3] == ["P", "2", "4"]


def test_page_spec_and_primes(spark):
    assert artifacts.expand_page_spec("754, 760-762,754") == [754, 760, 761, 762]
    for bad in ("0", "5-3"):
        with pytest.raises(ValueError):
            artifacts.expand_page_spec(bad)
    assert [r.n for r in artifacts.primes(30, spark).orderBy("n").collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]


ENTRY = "doc_id string, entry_index int, content_type string, section_heading string, semantic_unit_id string, table_layout_id string, page_start int, page_end int, char_count int, table_caption string, layout_hint string, preview string"


def test_display_items(spark):
    e = lambda i, kind="prose", head="", unit=None, layout=None, n=10: ("d", i, kind, head, unit, layout, i + 1, i + 1, n, "", "", "")
    rows = [e(0), e(1, head="Preface"), e(2), e(3, "contents"), e(4, "contents"), e(5), e(6, "table", unit="t"), e(7, "table", unit="t"), e(8, "table", unit="v"), e(9, head="COPYRIGHT"), e(10, "contents")]
    got = [(r.label, r.first_entry, r.chunks, r.entries_in_item) for r in context.display_items(spark.createDataFrame(rows, ENTRY)).orderBy("card").collect()]
    assert got == [
        ("Publication Details", 0, 1, 1), ("Preface", 1, 1, 2), ("Preface", 2, 1, 2), ("Table of Contents", 3, 1, 2), ("Table of Contents", 4, 1, 2), (None, 5, 1, 1),
        (None, 6, 2, 2), (None, 8, 1, 1), ("COPYRIGHT", 9, 1, 1), ("Table of Contents", 10, 1, 1),
    ]


def test_verification_pages(spark):
    rows = [("d", 0, "table", "", None, None, 3, 20, 1, "", "", ""), ("d", 1, "prose", "", None, None, 2, None, 1, "", "", "Gear Table for 1 to 90 and"), ("q", 0, "prose", "", None, None, 7, 7, 1, "", "equation", None), ("z", 0, "prose", "", None, None, 7, 7, 1, "", "", "")]
    got = {r.doc_id: r.pages for r in context.verification_pages(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {"d": [2, 3, 4, 5, 6, 7, 8, 9], "q": [7]}
