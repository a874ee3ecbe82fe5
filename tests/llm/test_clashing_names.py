"""Extra columns whose names are those of results or of inner steps."""

import os

import pytest
from pyspark.sql import functions as F

from quireflow.llm import leakage, mixing, normalize, quality, repeated_lines, residue, split

NAMES = ["d", "p", "h", "k", "t", "n", "c1", "c2", "gone", "_d", "_gone", "_h", "_t", "key", "member", "chosen", "look", "canonical", "line_no", "piece_index", "overlap_chars", "word_count",
         "is_prose", "item_id", "score", "exact", "gram", "_doc", "_items", "tokens", "rate", "copies", "kind", "template", "value", "one", "count", "records", "_fold", "_bad"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"c{i}", "d1", i, f"The same line\nnote {chr(97 + i)} here {{{{batch}}}}" if i else None, "src", "Head", 1) for i in range(6)]
    d = spark.createDataFrame([*rows, rows[2]], "doc_id long, chunk_id string, doc string, chunk_index int, text string, source string, section_heading string, page_start int")
    return d.select("*", *[F.lit("x").alias(n) for n in NAMES if n not in d.columns])


def test_all(spark, docs):
    names = docs.columns
    assert repeated_lines.find_repeated_lines(docs, "doc").count() == 5
    assert repeated_lines.remove_repeated_lines(docs, "doc").columns == names
    out = normalize.canonical_forms(docs)
    assert out.count() == 7 and set(out.columns) == set(names)
    assert normalize.look_alike_pairs(docs, "source", "chunk_id", "text").count() == 0
    assert split.split_oversized(docs, max_chars=20, min_chars=5, overlap=4).where("chunk_id = 'c1'").count() > 1
    common = spark.createDataFrame([("en", "the"), (None, None)], "lang string, word string")
    assert quality.text_quality(docs, common, ("chunk_id",)).count() == 7
    assert leakage.find_leaks(docs, spark.createDataFrame([(1, "the same line note a here batch", 5)], "item_id long, text string, gram int")).count() >= 0
    assert {r.doc_id for r in residue.find_residue(docs).collect()} == {1, 2, 3, 4, 5}
    assert residue.without_residue(docs).columns == names


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="public tokenizer files not here")
def test_mixing(spark, docs):
    t = spark.createDataFrame([("SRC", 1.0, 2, "x")], "source string, target_share double, max_repeats int, key string")
    for key in ("doc_id", "chunk_id"):
        assert mixing.mix_sources(docs, t, key=key).count() == 5
    assert mixing.mix_sources(docs.drop("key").withColumn("key", F.col("chunk_id")), t, key="key").count() == 5
