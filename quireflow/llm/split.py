"""Problem 3: splitting oversized texts at content-defined, natural boundaries.

A rolling hash over the characters marks landmarks. A cut snaps to the nearest natural boundary (paragraph,
line, sentence, then word end) around the first landmark that lies between the minimum and the maximum size;
since landmarks depend on the characters around them only, an edit moves the cuts near it and no others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, MIN_CHARS, OVERLAP = 1200, 480, 120
#: Characters in the hashed window; one position in LANDMARK_EVERY is a landmark; reach of the snap.
WINDOW, LANDMARK_EVERY, SNAP = 16, 128, 160

_ENDS = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n"), re.compile(r"[.!?…][\"'”’)\]]*\s"), re.compile(r"\s"))


def landmarks(text: str, window: int = WINDOW, every: int = LANDMARK_EVERY) -> np.ndarray:
    """Positions (cut before the character) whose last ``window`` characters hash to 0."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(cp) < window:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(len(cp) - window + 1, dtype=np.uint64)
    mul = np.uint64(1)
    for k in range(window):
        h += cp[window - 1 - k : len(cp) - k] * mul
        mul = np.uint64((int(mul) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(32)) % np.uint64(every) == 0) + window


def _near(ends: np.ndarray, at: int, lo: int, hi: int) -> int | None:
    """The element of sorted ``ends`` nearest to ``at`` within [lo, hi]; the earlier of two."""
    i, j = np.searchsorted(ends, [lo, hi + 1])
    if i == j:
        return None
    k = min(max(int(np.searchsorted(ends, at)), i), j - 1)
    best = int(ends[k])
    return int(ends[k - 1]) if k > i and at - int(ends[k - 1]) <= abs(best - at) else best


def cut_positions(text: str, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, body_start, end) of each piece: text[start:body_start] repeats the end of the piece before.

    Every piece has at most ``max_chars`` characters; the bodies cover the text without gap.
    """
    n = len(text)
    if n <= max_chars:
        return [(0, 0, n)]
    ends = [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in _ENDS]
    marks = landmarks(text)
    out: list[tuple[int, int, int]] = []
    start = body = 0
    while True:
        limit = start + max_chars
        if n <= limit:
            out.append((start, body, n))
            return out
        lo = min(max(body + 1, start + min_chars), limit)
        i = int(np.searchsorted(marks, lo))
        target = int(marks[i]) if i < len(marks) and marks[i] <= limit else limit
        cut = None
        for reach in (SNAP, max_chars):  # around the landmark first, then anywhere in the range
            for e in ends:
                cut = _near(e, target, max(lo, target - reach), min(limit, target + reach))
                if cut is not None:
                    break
            if cut is not None:
                break
        if cut is None:
            cut = target
            while cut > lo and unicodedata.combining(text[cut]):
                cut -= 1
        out.append((start, body, cut))
        room = min(overlap, cut - start)
        w = ends[3]
        i = int(np.searchsorted(w, cut - room))
        begin = int(w[i]) if i < len(w) and w[i] < cut else cut - room
        start, body = begin, cut


def split_oversized(
    records: DataFrame, key: str = "chunk_id", text: str = "text", keep: tuple[str, ...] = ("section_heading", "page_start"),
    max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS, overlap: int = OVERLAP,
) -> DataFrame:
    """(key, piece_index, piece_count, char_start, char_end, overlap_chars, text, *keep) of texts over ``max_chars``.

    The stored text's length in code points decides, not any stored count. A piece is the characters
    [char_start, char_end) of its text, its first ``overlap_chars`` repeat the end of the piece before;
    concatenating the pieces without them gives the text back. Rows delivered twice give their pieces once.
    Null and short texts give no row; a text without any boundary is cut at ``max_chars`` (never before a
    combining mark). Columns of ``records`` that are neither key, text nor in ``keep`` are left out, so their
    names cannot clash.
    """
    if not 0 <= overlap < min_chars <= max_chars:
        raise ValueError("need 0 <= overlap < min_chars <= max_chars")
    rows = records.where(F.length(text) > max_chars).select(F.col(key).alias("_key"), F.col(text).alias("_text"), *keep).distinct()
    fields = {f.name: f for f in records.schema.fields}
    schema = T.StructType(
        [T.StructField(key, fields[key].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("piece_index", "piece_count", "char_start", "char_end", "overlap_chars")]
        + [T.StructField("text", T.StringType())]
        + [T.StructField(c, fields[c].dataType) for c in keep]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols: dict[str, list] = {f.name: [] for f in schema.fields}
            rest = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in keep]
            for r, (k, t) in enumerate(zip(pdf["_key"], pdf["_text"])):
                cuts = cut_positions(t, max_chars, min_chars, overlap)
                for i, (a, b, e) in enumerate(cuts):
                    for c, v in zip(schema.names, (k, i + 1, len(cuts), a, e, b - a, t[a:e], *(x[r] for x in rest))):
                        cols[c].append(v)
            yield pd.DataFrame(cols)

    return rows.mapInPandas(run, schema)
