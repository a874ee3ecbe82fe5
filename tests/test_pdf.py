import pytest

from quireflow.sources import pdf


class Page:
    def __init__(self, plain, flow=""):
        self.plain, self.flow = plain, flow

    def extract_text(self, use_text_flow=False, **_):
        return self.flow if use_text_flow else self.plain


def test_text_flow_only_for_contents_pages():
    assert pdf.page_text(Page("a b", "flow")) == "a b"
    assert pdf.page_text(Page("Table  of Contents\nx", "flow")) == "flow"
    assert pdf.page_text(Page("table of contents", "")) == "table of contents"
    assert pdf.page_text(Page(None)) == ""


def test_unknown_extractor(spark):
    with pytest.raises(ValueError):
        pdf.extract_pages(spark.createDataFrame([], "path string, content binary"), "other")


def test_titles(spark):
    w = lambda path, page, text, x0, top, size: (path, page, text, x0, x0 + 5, top, top + size, size)
    rows = [
        w("a", 1, "Handbook", 10.0, 100.0, 24.0), w("a", 1, "Gear", 1.0, 100.5, 24.0), w("a", 1, "small", 1.0, 300.0, 9.0), w("a", 1, "Third", 1.0, 400.0, 9.0), w("a", 1, "edition", 20.0, 400.0, 9.0),
        w("a", 2, "Later", 1.0, 10.0, 30.0), w("b", 1, "tiny", 1.0, 10.0, 9.0), w("b", 6, "Late", 1.0, 10.0, 40.0),
    ]
    d = spark.createDataFrame(rows, pdf.WORDS)
    assert [(r.path, r.title) for r in pdf.suggest_titles(d).collect()] == [("a", "Gear Handbook — Third edition")]
