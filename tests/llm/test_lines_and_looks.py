"""Problems 1 and 2: repeated lines, look-alike text."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.llm import normalize, repeated_lines

SCHEMA = "chunk_id string, doc_id string, chunk_index int, text string, h string, p int"


def rows(texts, doc="d"):
    return [(f"{doc}{i}", doc, i, t, None, 7) for i, t in enumerate(texts, 1)]


def test_repeated_lines_count_chunks_not_rows(spark):
    texts = ["Back to TOP 3\nalpha", "  bаck  to top\nbeta", "4 BACK TO TOP\ngamma", "Ba​ck to top - 9\ndelta", "body\nback to ｔｏｐ", "x\n12\n12"]
    d = spark.createDataFrame(rows(texts) + rows(texts)[:2], SCHEMA)
    got = {(r.chunk_index, r.line_no) for r in repeated_lines.find_repeated_lines(d).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)}


def test_share_threshold_and_ties(spark):
    # 5 of 50 chunks is exactly a tenth and counts; 5 of 51 does not
    fifty = ["same line here\nz"] * 5 + [f"only {chr(97 + i % 26)}{chr(97 + i // 26)} q" for i in range(45)]
    d = spark.createDataFrame(rows(fifty, "a") + rows([*fifty, "one more"], "b"), SCHEMA)
    got = repeated_lines.find_repeated_lines(d).collect()
    # 7 of 70, where 70 * 0.1 is a little more than 7 in binary
    seventy = ["same line here"] * 7 + [f"only {chr(97 + i % 26)}{chr(97 + i // 26)} q" for i in range(63)]
    assert repeated_lines.find_repeated_lines(spark.createDataFrame(rows(seventy, "c"), SCHEMA)).count() == 7
    # the line 'z' stands in the same five chunks
    assert {(r.doc_id, r.line_no) for r in got} == {("a", 1), ("a", 2)} and len(got) == 10


def test_repeated_lines_nulls_and_empties(spark):
    d = spark.createDataFrame([("a", None, 1, "x", None, 1), ("b", "d", None, "x", None, 1), ("c", "d", 2, None, None, 1), ("e", "d", 3, "", None, 1)], SCHEMA)
    assert repeated_lines.find_repeated_lines(d).count() == 0
    assert repeated_lines.find_repeated_lines(d.limit(0)).count() == 0
    out = repeated_lines.remove_repeated_lines(d)
    assert out.columns == d.columns and out.count() == 4


def test_rebuild_keeps_other_lines_and_columns(spark):
    d = spark.createDataFrame(rows([f"Issued by the School\nline {chr(97 + i)} stays\nPage {i}" for i in range(6)]), SCHEMA)
    out = {r.chunk_index: r for r in repeated_lines.remove_repeated_lines(d).collect()}
    assert out[3].text == "line c stays" and out[3].p == 7
    headers = repeated_lines.remove_repeated_lines(d.withColumn("text", F.lit("3 HEAD")), split=False)
    assert {r.text for r in headers.collect()} == {""}


def test_very_long_line_counts(spark):
    long = "word " * 30_000
    d = spark.createDataFrame(rows([long + "\nother " + chr(97 + i) for i in range(5)]), SCHEMA)
    assert repeated_lines.find_repeated_lines(d).count() == 5


def plain_fold(s: str) -> str:
    src, dst = normalize._one_to_one()
    m = {c: dst[i] if i < len(dst) else "" for i, c in enumerate(src)}
    s = "".join(m.get(c, c) for c in s)
    for a, b in normalize.LIGATURES.items():
        s = s.replace(a, b)
    return unicodedata.normalize("NFC", s)


LOOKS = [
    ("Ｗｉｄｔｈ", "Width"), ("ﬁlter", "filter"), ("pаge", "page"), ("a​b", "ab"), ("a b", "a b"), ("re‐use", "re-use"),
    ("über", "über"), ("garçon", "garçon"), ("ế", "ế"), ("5 µm", "5 μm"), ("3 Ω", "3 Ω"), ("so­ft", "soft"),
]
DIFFERENT = [("Width", "width"), ("uber", "über"), ("m2", "m²"), ("a b", "ab"), ("a  b", "a b"), ("a-b", "ab"), ("10", "1O")]


@pytest.mark.parametrize("a,b", LOOKS)
def test_same_looks(spark, a, b):
    assert len({r.c for r in normalize.canonical_forms(spark.createDataFrame([(a,), (b,)], "text string")).selectExpr("canonical c").collect()}) == 1


#: Marks with a second code point, signs, letter styles, numerals, half-width kana, letters of other scripts.
FURTHER = [
    ("wa\u0340s", "w\u00e0s"), ("u\u0344x", "\u01d8x"), ("a \u2212 b", "a - b"), ("3\u20135", "3-5"), ("a\u2043b", "a-b"), ("\U0001d408n \U0001d5ba", "In a"), ("\u2163.", "IV."),
    ("\uff8a\uff9f", "\u30d1"), ("\u0451l", "\u00ebl"), ("\u03f2at", "cat"), ("\u212b", "\u00c5"), ("\u2126", "\u03a9"), ("\uac00", "\u1100\u1161"),
]


def test_further_looks_come_from_the_collation(spark):
    d = spark.createDataFrame([("f", f"{i}{s}", x) for i, p in enumerate(FURTHER) for s, x in zip("ab", p)], "field string, key string, text string")
    got = {(r.key_a, r.key_b) for r in normalize.look_alike_pairs(d).collect()}
    assert got == {(f"{i}a", f"{i}b") for i in range(len(FURTHER))}


def test_outline_is_the_same_for_texts_equal_under_the_collation(spark):
    """The outline may not part what the collation joins: every composed letter against its decomposed and its ignorable-laden form."""
    letters = [chr(c) for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x900, 0x980), *range(0x1E00, 0x2000), *range(0xAC00, 0xAC80), *range(0xF900, 0xF920)) if unicodedata.decomposition(chr(c)) or chr(c).isalpha()]
    rows = [(x, y) for x in letters for y in (unicodedata.normalize("NFD", x), x + "\u0001", unicodedata.normalize("NFC", x)) if y != x]
    d = spark.createDataFrame(rows, "a string, b string").select(normalize.fold(F.col("a")).alias("a"), normalize.fold(F.col("b")).alias("b"))
    bad = d.where(F.expr("(a COLLATE UNICODE) = (b COLLATE UNICODE)") & (normalize._outline(F.col("a")) != normalize._outline(F.col("b"))))
    assert bad.count() == 0


def test_different_looks(spark):
    d = spark.createDataFrame([(i, x) for i, p in enumerate(DIFFERENT) for x in p], "i int, text string")
    out = normalize.canonical_forms(d)
    assert out.groupBy("i").agg(F.countDistinct("canonical").alias("n")).where("n <> 2").count() == 0


def test_classes_under_collation_beyond_the_fold(spark):
    """A control character that the collation ignores, and marks in another order, are one class; the least member stands for it."""
    d = spark.createDataFrame([("ab",), ("a\u0001b",), ("q̣̇",), ("q̣̇",), (None,), ("",)], "text string")
    got = {r.text: r.canonical for r in normalize.canonical_forms(d).collect()}
    assert got["ab"] == got["a\u0001b"] == "a\u0001b" and got[None] is None and got[""] == ""


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abAеоＡｂﬁ́̈​  é-‑2²", max_size=8), min_size=1, max_size=12))
def test_fold_matches_plain_python(spark, texts):
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", normalize.fold(F.col("t")).alias("f")).collect():
        assert r.f == plain_fold(r.t)


def test_pairs_against_brute_force(spark):
    vals = ["abc", "аbc", "a​bc", "Abc", "abc", "xyz", None, "", "ｘyz", "xyz"]
    data = [("f", f"k{i:02}", v) for i, v in enumerate(vals)] + [("g", "k00", "abc"), ("f", "k01", "аbc"), ("f", None, "abc")]
    d = spark.createDataFrame(data, "field string, key string, text string")
    got = {(r.field, r.key_a, r.key_b) for r in normalize.look_alike_pairs(d).collect()}
    recs = sorted({x for x in data if x[1] and x[2]})
    want = {(f, a, b) for f, a, s in recs for g, b, t in recs if f == g and a < b and s != t and plain_fold(s) == plain_fold(t)}
    assert got == want and len(want) == 7
    assert normalize.look_alike_pairs(d.limit(0)).count() == 0


def test_many_copies_of_one_text_do_not_meet(spark):
    """3,000 copies and two variants: 2 x 3,000 + 1 pairs, and no join over the 9 million pairs of copies."""
    d = spark.range(3000).selectExpr("'f' AS field", "concat('k', id) AS key", "'same text' AS text")
    d = d.unionByName(spark.createDataFrame([("f", "v1", "sаme text"), ("f", "v2", "same​ text")], "field string, key string, text string"))
    assert normalize.look_alike_pairs(d).count() == 6001
