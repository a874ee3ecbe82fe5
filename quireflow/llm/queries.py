"""Queries over the test tables, one function per registered name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import leakage, mixing, normalize, quality, repeated_lines, residue, split


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Occurrences of lines and headers repeated within one document."""
    lines = repeated_lines.find_repeated_lines(table(spark, root, "chunks"), text="text")
    headers = repeated_lines.find_repeated_lines(table(spark, root, "structural_index"), text="running_header", split=False)
    return lines.select(F.lit("text").alias("field"), "*").unionByName(headers.select(F.lit("running_header").alias("field"), "*"))


def p1_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """Each chunk's text without the repeated lines of its document."""
    # repeated deliveries are told apart by their short results, so that no text is shuffled for it
    chunks = table(spark, root, "chunks").select("chunk_id", "doc_id", "chunk_index", "text")
    out = repeated_lines.remove_repeated_lines(chunks)
    return out.select("chunk_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5")).distinct()


def p1_headers(spark: SparkSession, root: str) -> DataFrame:
    """Each entry's running header without those repeated in its document."""
    entries = table(spark, root, "structural_index").select("doc_id", "entry_index", "chunk_index", "running_header")
    return repeated_lines.remove_repeated_lines(entries, text="running_header", split=False).select("doc_id", "entry_index", "running_header").distinct()


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """(field, key, text) of the three text columns; repeated deliveries of a record once."""
    c = table(spark, root, "chunks").select(F.lit("chunks.text").alias("field"), F.col("chunk_id").alias("key"), "text")
    n = table(spark, root, "note").select(F.lit("note.body").alias("field"), F.col("note_id").alias("key"), F.col("body").alias("text"))
    s = table(spark, root, "structural_index").where("search_text <> ''").select(
        F.lit("structural_index.search_text").alias("field"),
        F.concat("doc_id", F.lit(":"), F.col("entry_index").cast("string")).alias("key"), F.col("search_text").alias("text"),
    )
    return c.unionByName(n).unionByName(s)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of records of one table whose texts differ in characters but not in looks."""
    return normalize.look_alike_pairs(_texts(spark, root))


def p2_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Every text in its consistent form."""
    out = normalize.canonical_forms(_texts(spark, root).where("key is not null and text is not null"))
    return out.select("field", "key", F.md5("canonical").alias("canonical_md5")).distinct()


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that the splitter cuts into several pieces."""
    return split.split_oversized(table(spark, root, "chunks")).where("piece_count > 1").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of the oversized chunks."""
    return split.split_oversized(table(spark, root, "chunks"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Chunks whose index entry says prose or table although the text, furniture aside, is not."""
    at = ["doc_id", "chunk_index"]
    chunks = table(spark, root, "chunks").select(*at, "text")
    plain = (F.col("content_type") == "prose") & (F.coalesce("layout_hint", F.lit("")) == "")
    marks = table(spark, root, "structural_index").where(plain | (F.col("content_type") == "table")).select(*at, (F.col("content_type") == "table").alias("as_table")).distinct()
    marked = chunks.join(marks, at)
    texts = repeated_lines.remove_repeated_lines(chunks, only=marked)
    common = table(spark, root, "common_words")
    model = quality.fit_line_model(chunks, quality.common_set(common), F.concat_ws(":", *at), "text")
    scored = quality.text_quality(texts, common, (*at, "as_table"), model=model)
    return scored.where(F.col("as_table") == F.col("is_prose")).select(*at).distinct()


def p6_labels(spark: SparkSession, root: str) -> DataFrame:
    """Statistics, label shares and the verdict on prose of every chunk's text without page furniture, by the fitted model."""
    at = ["doc_id", "chunk_index"]
    chunks = table(spark, root, "chunks").select("chunk_id", *at, "text")
    common = table(spark, root, "common_words")
    model = quality.fit_line_model(chunks, quality.common_set(common), F.concat_ws(":", *at), "text")
    return quality.text_quality(repeated_lines.remove_repeated_lines(chunks), common, ("chunk_id",), model=model).distinct()


def p6_statistics(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of each chunk's text as stored (furniture included), rounded for comparison."""
    chunks = table(spark, root, "chunks").select("chunk_id", "text").distinct()
    q = quality.text_quality(chunks, table(spark, root, "common_words"), ("chunk_id",), labels=False)
    r = lambda c: F.round(c, 6).alias(c)
    return q.select("chunk_id", "word_count", *map(r, ("mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with a passage of an evaluation item."""
    leaks = leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), least=leakage.EDITED_SHARE)
    return leaks.where("exact").select("doc_id", "item_id").distinct()


def p7_edited(spark: SparkSession, root: str) -> DataFrame:
    """Documents with an edited or partial copy: the alignment reaches half of the item's best score."""
    leaks = leakage.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), least=leakage.EDITED_SHARE)
    return leaks.where(F.col("score_share") >= leakage.EDITED_SHARE)


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The documents taken, with their copies."""
    return mixing.mix_sources(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(p8_mixture(spark, root), table(spark, root, "mix_targets"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with template residue, filler or error-page text."""
    return residue.find_residue(table(spark, root, "documents")).select("doc_id").distinct()


def p9_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Kinds of residue of each document, and whether alignment, a template, filler vocabulary or nothing but itself shows it."""
    return residue.residue_evidence(table(spark, root, "documents"))


def p9_kept(spark: SparkSession, root: str) -> DataFrame:
    """The corpus without them."""
    return residue.without_residue(table(spark, root, "documents").select("doc_id", "source", "text")).select("doc_id", "source", F.length("text").alias("text_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_rebuilt": p1_rebuilt, "p1_headers": p1_headers, "p2_found": p2_found, "p2_canonical": p2_canonical,
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p6_found": p6_found, "p6_statistics": p6_statistics, "p6_labels": p6_labels,
    "p7_found": p7_found, "p7_edited": p7_edited, "p8_mixture": p8_mixture, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_evidence": p9_evidence, "p9_kept": p9_kept,
}
