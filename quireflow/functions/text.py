"""Text functions as column expressions: cleaning, keys, slugs, splitting. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
# Punctuation characters mapped one to one.
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", "\u00a0": " "}
# Runs of private-use glyphs of a symbol font and the delimiter they draw.
MATH_GLYPHS = {"\\x{F0E6}-\\x{F0E8}": "(", "\\x{F0F6}-\\x{F0F8}": ")", "\\x{F0E9}-\\x{F0EB}": "[", "\\x{F0F9}-\\x{F0FB}": "]", "\\x{F0EC}-\\x{F0EF}": "{", "\\x{F0FC}-\\x{F0FE}": "}"}
# Edges of words: letters, digits and underscores make words, combining marks do not.
BEGIN, END = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def line_endings(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def tabs_to_blanks(c: Column) -> Column:
    return F.translate(c, "\t", " ")


def drop_soft_hyphens(c: Column) -> Column:
    return F.translate(c, "\u00ad", "")


def expand_ligatures(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), c)


def plain_punctuation(c: Column) -> Column:
    return F.translate(c, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))


def join_broken_words(c: Column) -> Column:
    return F.regexp_replace(c, "([A-Za-z])-\\n([A-Za-z])", "$1$2")


def join_single_letters(c: Column) -> Column:
    """``a n d`` to ``an d``: neighbouring single letters are joined in one pass, which is the fixpoint."""
    return F.regexp_replace(c, f"{BEGIN}([a-z]) ([a-z]){END}", "$1$2")


# The three spaced-apostrophe patterns, in their order.
APOSTROPHES = (f"{BEGIN}([A-Za-z]+)(?U:\\s)+'(?U:\\s)+([A-Za-z]+){END}", f"{BEGIN}([A-Za-z]+)'(?U:\\s)+([A-Za-z]+){END}", f"{BEGIN}([A-Za-z]+)(?U:\\s)+'([A-Za-z]+){END}")


def tighten_apostrophes(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, "$1'$2"), APOSTROPHES, c)


def collapse_blanks(c: Column) -> Column:
    c = F.regexp_replace(c, "[ \\t]+\\n", "\n")
    c = F.regexp_replace(c, "[ \\t]{2,}", " ")
    return strip(F.regexp_replace(c, "\\n{3,}", "\n\n"))


def join_letter_prefix(c: Column) -> Column:
    """Optional repair of ``i ndicate``; not part of ``clean_text``."""
    return F.regexp_replace(c, f"{BEGIN}([a-z]) ([a-z]{{2,}}){END}", "$1$2")


def clean_text(c: Column) -> Column:
    """The cleaning pipeline in its fixed order. Null stays null."""
    steps = (
        line_endings, tabs_to_blanks, drop_soft_hyphens, expand_ligatures, plain_punctuation,
        join_broken_words, join_single_letters, tighten_apostrophes, collapse_blanks,
    )
    return reduce(lambda x, f: f(x), steps, c)


def heading_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "(?U)\\s+", " ")


def caption_key(c: Column) -> Column:
    """Letters and digits of the caption in lower case, words apart by one blank."""
    folded = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def series_key(c: Column) -> Column:
    """``caption_key`` without a mark of continuation."""
    return caption_key(F.regexp_replace(c, "(?i)\\(\\s*continued\\s*\\)", " "))


def math_glyphs(c: Column) -> Column:
    return reduce(lambda x, kv: F.regexp_replace(x, f"(?:[{kv[0]}](?U:\\s)*)+", "\\" + kv[1]), MATH_GLYPHS.items(), c)


def _underscores(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "_+", "_"), "^_+|_+$", "")


def note_slug(c: Column) -> Column:
    """File name of a hand-written note: blanks become underscores, hyphens stay."""
    s = _underscores(F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), "[^a-z0-9_-]", ""))
    return F.concat(F.when(s == "", F.lit("untitled_note")).otherwise(s), F.lit(".md"))


def generated_slug(c: Column) -> Column:
    """File name part of a generated note: white space and hyphens become underscores."""
    s = _underscores(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "(?U:[\\s-]+)", "_"), "[^a-z0-9_]", ""))
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def category_path(c: Column) -> Column:
    """Lower-case path of cleaned parts; a path without parts is null."""
    parts = F.split(F.lower(F.replace(strip(c), F.lit("\\"), F.lit("/"))), "/")
    part = lambda x: _underscores(F.regexp_replace(F.regexp_replace(strip(x), "(?U:[\\s-]+)", "_"), "[^a-z0-9_]", ""))
    kept = F.filter(F.transform(parts, part), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "/"))


def breadcrumb(c: Column) -> Column:
    return F.array_join(path_parts(c), " > ")


def path_parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda x: x != "")


def query_terms(c: Column) -> Column:
    """Words of a query: ASCII punctuation is deleted, words of one character are dropped."""
    words = F.split(F.translate(c, ASCII_PUNCTUATION, ""), "(?U)\\s+")
    return F.filter(words, lambda x: F.length(x) > 1)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "(?U)\\n\\s*\\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), "(?U)(?<=[.!?])\\s+"), lambda x: x != "")


def pack(parts: Column, limit: Column | int, joiner: str) -> Column:
    """Greedy packing: a part joins the open group while the joined length stays within ``limit``.

    The first part of a group is always taken, so a part longer than the limit stays whole.
    """
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("open"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.length(acc["open"]) + len(joiner) + F.length(x) <= limit
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), x.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(joiner), x).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), x.alias("open")))
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>", escape: bool = True) -> Column:
    """Each term marked, one after the other, case-sensitive. ``escape`` makes the text safe for HTML first."""
    if escape:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(a), F.lit(b))
    return reduce(lambda x, t: F.replace(x, F.lit(t), F.lit(f"{before}{t}{after}")), terms, text)


def preview(text: Column, chars: int = 220) -> Column:
    """The first ``chars`` characters of the stripped text, with dots if there is more."""
    t = strip(text)
    return F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("..."))).otherwise(t)


def search_window(text: Column, lowered: Column, terms: list[str], left: int = 120, right: int = 220, fallback: int = 360) -> Column:
    """The part of ``text`` around the first term found in ``lowered``, with dots at cut ends; else its beginning."""
    found = F.get(F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(lowered, t)), F.lit(0))
    at = F.instr(lowered, found) - 1
    begin, end = F.greatest(at - left, F.lit(0)), F.least(at + right, F.length(text))
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(text, begin + 1, end - begin), F.when(end < F.length(text), "...").otherwise(""))
    head = F.concat(F.substring(text, 1, fallback), F.when(F.length(text) > fallback, "...").otherwise(""))
    return F.when(found.isNull(), head).otherwise(cut)


def smallest_factor(n: Column) -> Column:
    """Smallest divisor above 1, n itself for a prime; null below 2."""
    d = F.array_min(F.filter(F.sequence(F.lit(2), F.greatest(F.floor(F.sqrt(n)), F.lit(2)).cast("int")), lambda x: (n % x == 0) & (x < n)))
    return F.when(n >= 2, F.coalesce(d, n))


def rounded_box(c: Column) -> Column:
    return F.transform(c, lambda x: F.round(x, 3))
