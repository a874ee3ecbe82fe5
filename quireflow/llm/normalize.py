"""One consistent form for text that looks the same but is stored in other characters.

``fold`` maps look-alike letters, full-width and other compatibility forms, ligatures, kinds of blanks and hyphens
and invisible characters onto one spelling and composes combining accents. Its table follows from the Unicode
confusables data of the ICU library that Spark carries, and from Unicode's own decompositions. It is a JVM
expression; ASCII rows skip it altogether.

``canonical_forms`` and ``look_alike_pairs`` group the mapped values under Spark's accent- and case-sensitive UNICODE
collation, choose one member per class and join it back; the collation decides which texts are equal.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Ligatures, digraphs and Roman numerals with their letters, by Unicode's compatibility decompositions.
LIGATURES = {
    chr(c): unicodedata.normalize("NFKC", chr(c))
    for c in (0x132, 0x133, *range(0x1C7, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18))
    if 1 < len(unicodedata.normalize("NFKC", chr(c))) and "<compat>" in unicodedata.decomposition(chr(c))
}

BLANKS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0x2012, 0x2013, 0x2043, 0x2212, 0x2796, 0xFE63]
INVISIBLE = [
    0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010),
    *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0,
]


@lru_cache(maxsize=1)
def _skeletons() -> dict[str, str]:
    """The look-alike letter of ASCII of each cased letter of another script than Latin, by ICU's confusables.

    ICU maps I, l, 1 and | to one shape; the letter of the same case is taken. Accented letters follow their base.
    """
    jvm = SparkContext._active_spark_context._jvm
    checker = getattr(jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    letters = [chr(c) for c in range(0x80, 0x1E000) if unicodedata.category(chr(c)) in ("Lu", "Ll") and not unicodedata.name(chr(c), "LATIN").startswith(("LATIN", "FULLWIDTH"))]
    ascii_ = [chr(c) for c in range(0x21, 0x7F)]
    bare = [x for x in letters if unicodedata.decomposition(x)[:1] in ("", "<")]
    shapes = checker.getSkeleton("\ue000".join([*ascii_, *bare])).split("\ue000")
    same: dict[tuple[str, str], str] = {}
    for x, shape in zip(ascii_, shapes):
        if x.isalpha():
            same.setdefault((unicodedata.category(x), shape), x)
    m = {x: same[key] for x, shape in zip(bare, shapes[len(ascii_) :]) if (key := (unicodedata.category(x), shape)) in same}
    for x in letters:
        d = unicodedata.normalize("NFD", x)
        if len(d) > 1 and d[0] in m and len(whole := unicodedata.normalize("NFC", m[d[0]] + d[1:])) == 1:
            m[x] = whole
    return m


@lru_cache(maxsize=1)
def _one_to_one() -> tuple[str, str]:
    """Arguments of ``translate``; the characters without a partner (at the end) are deleted."""
    m = {}
    for c in range(0x80, 0x1F000):
        x, d = chr(c), unicodedata.decomposition(chr(c))
        if d and unicodedata.category(x)[0] in "LNPS" and c not in (0xA8, 0xAF, 0xB4, 0xB8):
            tag = d.split(">")[0][1:] if d[0] == "<" else ""
            to = unicodedata.normalize("NFKC" if tag else "NFC", x)
            # full and half width, letter styles, compatibility letters, and signs with a second code point; raised and lowered figures stay
            if len(to) == 1 and to != x and (tag in ("wide", "narrow", "font", "") or tag == "compat" and to.isalpha()):
                m[x] = to
    m |= _skeletons()
    m = {x: m.get(y, y) for x, y in m.items()} | {chr(c): " " for c in BLANKS} | {chr(c): "-" for c in HYPHENS}
    gone = [chr(c) for c in INVISIBLE if chr(c) not in m]
    return "".join(m) + "".join(gone), "".join(m.values())


@lru_cache(maxsize=1)
def _compositions() -> tuple[str, str]:
    """Letter + combining mark pairs in one string, their composed letters in another, from Unicode's own data."""
    pairs, composed = "", ""
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.decomposition(chr(c)).split()
        if len(d) == 2 and not d[0].startswith("<") and chr(int(d[0], 16)).isalpha():
            pairs += chr(int(d[0], 16)) + chr(int(d[1], 16))
            composed += chr(c)
    return pairs, composed


def _compose(c: Column) -> Column:
    """Compose letter + mark; two passes, for letters with two marks. Only rows with a mark get here.

    No letter of the pairs is a mark, so a pair can only be found at an even place.
    """
    pairs, composed = _compositions()

    def one(acc: Column, p: Column) -> Column:
        at = F.instr(F.lit(pairs), p)
        return F.when(at > 0, F.replace(acc, p, F.substring(F.lit(composed), ((at + 1) / 2).cast("int"), F.lit(1)))).otherwise(acc)

    for _ in range(2):
        c = F.aggregate(F.array_distinct(F.regexp_extract_all(c, F.lit("(\\p{L}[\\u0300-\\u036f])"), F.lit(1))), c, one)
    return c


def _class(points: list[int]) -> str:
    """Character ranges of a regular expression."""
    ranges: list[list[int]] = []
    for c in sorted(points):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


@lru_cache(maxsize=1)
def _foldable() -> str:
    """A pattern that finds any character ``fold`` changes; ASCII fails its first test."""
    return "[\\x{80}-\\x{10FFFF}&&[" + _class([*{*map(ord, _one_to_one()[0]), *map(ord, LIGATURES), *range(0x300, 0x370)}]) + "]]"


def fold(text: Column) -> Column:
    """The look-alike form of ``text``; null stays null, letter case and accents stay apart."""
    src, dst = _one_to_one()
    t = F.translate(text, src, dst)
    for lig, letters in LIGATURES.items():
        t = F.replace(t, F.lit(lig), F.lit(letters))
    wide = F.when(t.rlike("[\\u0300-\\u036f]"), _compose(t)).otherwise(t)
    return F.when(F.length(text) == F.octet_length(text), text).when(~text.rlike(_foldable()), text).otherwise(wide)


@lru_cache(maxsize=1)
def _unstable() -> str:
    """A pattern of all that the collation may take as equal to something else: letters with marks, composed or not, and all that is no letter."""
    composed = [c for c in (*range(0xC0, 0xAC00), *range(0xF900, 0xFB50), *range(0x11000, 0x12000), *range(0x2F800, 0x2FA20)) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    return "[\\p{L}\\p{N}]\\p{C}*\\p{M}[\\p{M}\\p{C}]*|[\\x{80}-\\x{10FFFF}&&[" + _class(composed) + "\\p{IsHangul}]]|[^\\p{L}\\p{N}]+"


def _outline(folded: Column) -> Column:
    """A hash of the letters and digits that neither have nor could have an accent: the same for all texts that are equal under the collation.

    Such texts differ only in how accents are composed and in characters the collation ignores. Korean is left out,
    where syllables stand for several letters.
    """
    plain = F.length(folded) == F.octet_length(folded)
    return F.xxhash64(F.when(plain, F.regexp_replace(folded, "[^A-Za-z0-9]+", "")).otherwise(F.regexp_replace(folded, _unstable(), "")))


def _texts(records: DataFrame, text: str, *keep: Column) -> DataFrame:
    """keep, t: the stored text; k: its outline; written once."""
    d = records.where(F.col(text).isNotNull()).select(*keep, F.xxhash64(text).alias("t"), F.explode(F.array(fold(F.col(text)))).alias("_f"))
    return materialize(d.select(*[c for c in d.columns if c != "_f"], _outline(F.col("_f")).alias("k")).distinct())


def _classes(records: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(t, member, chosen): the texts of which another has the outline, their mapped value and the one that stands for its class.

    Classes are those of the accent- and case-sensitive UNICODE collation; the smallest member (by code points) is chosen.
    Texts alone with their outline have no partner under the collation and stay where they are.
    """
    mixed = texts.groupBy("k").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("k")
    several = texts.join(mixed, "k", "left_semi").select("t").distinct()
    stored = records.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("t"), F.col(text).alias("stored")).join(several, "t", "left_semi")
    members = materialize(stored.distinct().select("t", fold(F.col("stored")).alias("member")))
    classes = members.select(F.expr("member COLLATE UNICODE").alias("look"), "member").groupBy("look").agg(F.min("member").alias("chosen"))
    return materialize(members.join(classes, F.expr("member COLLATE UNICODE") == F.col("look")).select("t", "member", "chosen"))


def canonical_forms(records: DataFrame, text: str = "text") -> DataFrame:
    """``records`` with ``canonical``: equal for two texts exactly if they look the same.

    Look-alike-mapped values are grouped under the accent- and case-sensitive UNICODE collation; the smallest
    member (by code points) of a class stands for it and is joined back. Null gives null, '' gives ''. Rows,
    repeated ones too, and all other columns are kept; a column ``canonical`` is replaced.
    """
    mapping = _classes(records, _texts(records, text), text).where("member <> chosen")
    names = [c for c in records.columns if c != "canonical"]
    base = records.select(*names, F.xxhash64(text).alias("__looks_t"))
    out = base.join(mapping.select(F.col("t").alias("__looks_t"), F.col("chosen").alias("__looks_chosen")), "__looks_t", "left")
    return out.select(*names, F.coalesce("__looks_chosen", fold(F.col(text))).alias("canonical"))


def look_alike_pairs(records: DataFrame, field: str = "field", key: str = "key", text: str = "text") -> DataFrame:
    """(field, key_a, key_b), key_a < key_b: records of one field whose texts differ as strings but look the same.

    Equality is that of ``canonical_forms``: the class under the collation. Only texts of which another has the
    outline travel, once each. Null or empty texts and null keys give no pair; repeated rows count once.
    """
    rows = records.where(F.col(key).isNotNull() & (F.col(text) != ""))
    hashed = _texts(rows, text, F.col(field).alias("field"), F.col(key).alias("key"))
    classes = _classes(rows, hashed, text).select("t", F.xxhash64("chosen").alias("c1"), F.xxhash64(F.lit(1), "chosen").alias("c2"))
    hashed = hashed.select("field", "key", "t").join(classes, "t")
    look = ["field", "c1", "c2"]
    mixed = hashed.groupBy(*look).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").drop("lo", "hi")
    kept = hashed.join(mixed, look, "left_semi").select(*look, "key", "t")
    # texts are paired first and records after, so that copies of one text never meet each other
    texts = kept.select(*look, "t").distinct()
    other = texts.withColumnRenamed("t", "tb")
    pairs = texts.withColumnRenamed("t", "ta").join(other, look).where("ta <> tb")
    a = kept.select(*look, F.col("key").alias("key_a"), F.col("t").alias("ta"))
    b = kept.select(*look, F.col("key").alias("key_b"), F.col("t").alias("tb"))
    return a.join(pairs, [*look, "ta"]).join(b, [*look, "tb"]).where("key_a < key_b").select("field", "key_a", "key_b").distinct()
