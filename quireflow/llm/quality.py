"""Problem 6: per-document text statistics and a hidden Markov model that labels lines.

Each non-blank line becomes a vector of small categorical features. A four-state model (prose, list, table,
junk) with one categorical emission table per feature is fitted by Viterbi training from a stated prior on a
bounded sample, then decodes every line of every text. Label shares, weighted by characters, say whether a
text is natural prose.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import fold

LABELS = ("prose", "list", "table", "junk")
#: Texts (those with the smallest key hashes) the model is fitted on, and lines used of them in all.
FIT_TEXTS, FIT_LINES, FIT_ROUNDS = 3000, 60_000, 4
#: Prior counts per emission row and transition row; share of characters in prose lines that makes a text prose.
PRIOR_WEIGHT, PROSE_SHARE = 2000.0, 0.5

_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’*_-–—/|#"
_DIGITS, _SYMBOL = re.compile(r"\S*\d\S*"), re.compile(r"[^\w\s]|_")
_MARKER = re.compile(r"\s*(?:[•▪◦‣*+\-–]\s+\S|\(?[a-zA-Z0-9]{1,3}[.)]\s+\S)")
_LEADER = re.compile(r"\.{4,}\s*\d*\s*$|(?:,\s*\d+){2,}\s*$|×\s*\d+\s*$")
_COLUMNS = re.compile(r"\S(?:\t|\s*\|\s*| {3,}|  )\S")
_VOWEL = re.compile(r"[aeiouyäöüéèêàâîôûáíóúœæ]")
_END = re.compile(r"[.!?:;…][\"'”’)»\]]*\s*$")
#: Features and their number of values.
FEATURES = {"common": 4, "digits": 4, "marker": 3, "symbols": 3, "length": 4, "ends": 2, "words": 3, "odd": 3, "columns": 2}

# Prior emission tables, one row per label in the order of LABELS.
_PRIOR = {
    # share of common words: none, under 0.12, under 0.25, more
    "common": ((0.05, 0.10, 0.22, 0.63), (0.70, 0.10, 0.18, 0.02), (0.90, 0.07, 0.02, 0.01), (0.94, 0.04, 0.01, 0.01)),
    # share of words with a digit: none, under 0.25, under 0.5, more
    "digits": ((0.60, 0.36, 0.03, 0.01), (0.40, 0.30, 0.20, 0.10), (0.25, 0.10, 0.30, 0.35), (0.50, 0.14, 0.06, 0.30)),
    # no marker, list marker at the start, leader or page numbers at the end
    "marker": ((0.97, 0.02, 0.01), (0.15, 0.55, 0.30), (0.96, 0.02, 0.02), (0.90, 0.08, 0.02)),
    # symbols by characters: under 0.08, under 0.25, more
    "symbols": ((0.95, 0.045, 0.005), (0.55, 0.35, 0.10), (0.70, 0.28, 0.02), (0.45, 0.20, 0.35)),
    # mean word length: under 2, under 9, under 14, more
    "length": ((0.01, 0.97, 0.015, 0.005), (0.02, 0.95, 0.02, 0.01), (0.03, 0.95, 0.015, 0.005), (0.30, 0.40, 0.05, 0.25)),
    # ends like a sentence: no, yes
    "ends": ((0.45, 0.55), (0.80, 0.20), (0.97, 0.03), (0.85, 0.15)),
    # words: 1 or 2, 3 to 6, more
    "words": ((0.03, 0.12, 0.85), (0.05, 0.75, 0.20), (0.10, 0.70, 0.20), (0.25, 0.10, 0.65)),
    # nothing odd, few different words, words without vowels or letters
    "odd": ((0.975, 0.015, 0.01), (0.95, 0.02, 0.03), (0.93, 0.03, 0.04), (0.10, 0.25, 0.65)),
    # cells apart by bars, tabs or runs of blanks: no, yes
    "columns": ((0.98, 0.02), (0.95, 0.05), (0.45, 0.55), (0.90, 0.10)),
}


@dataclass(frozen=True)
class LineModel:
    """log start (4), log transition (4, 4) and log emission tables by feature (4, values)."""

    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]


def prior_model() -> LineModel:
    move = np.full((4, 4), 0.03)
    np.fill_diagonal(move, 0.91)
    return LineModel(np.log(np.full(4, 0.25)), np.log(move), tuple(np.log(np.array(_PRIOR[f])) for f in FEATURES))


def line_features(line: str, common: frozenset[str]) -> tuple[int, ...]:
    """The values of FEATURES for one non-blank line."""
    words = line.lower().split()
    n = len(words)
    bare = [w.strip(_EDGE) for w in words]
    share = sum(map(common.__contains__, bare)) / n
    digits = len(_DIGITS.findall(line)) / n
    symbols = len(_SYMBOL.findall(line)) / len(line)
    mean = sum(map(len, words)) / n
    letters = [w for w in bare if len(w) > 1 and w.isalpha()]
    odd = 0
    if n >= 8 and len(set(words)) < 0.45 * n:
        odd = 1
    elif len(letters) >= 3 and sum(1 for w in letters if not _VOWEL.search(w)) > 0.5 * len(letters):
        odd = 2
    elif n >= 3 and len(letters) < 0.15 * n and digits < 0.5 or mean > 30:
        odd = 2
    elif n >= 5 and sum(1 for w in words if len(w) > 2 and not w[0].isalnum() or w[-1] in "_&%#") > 0.4 * n:
        odd = 2
    return (
        0 if not share else 1 if share < 0.12 else 2 if share < 0.25 else 3,
        0 if not digits else 1 if digits < 0.25 else 2 if digits < 0.5 else 3,
        2 if _LEADER.search(line) else 1 if _MARKER.match(line) else 0,
        0 if symbols < 0.08 else 1 if symbols < 0.25 else 2,
        0 if mean < 2 else 1 if mean < 9 else 2 if mean < 14 else 3,
        1 if _END.search(line) else 0,
        0 if n < 3 else 1 if n < 7 else 2,
        odd,
        1 if len(_COLUMNS.findall(line)) > 1 else 0,
    )


def _decode(model: LineModel, feats: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Viterbi labels of all lines; ``sizes`` lines belong to each text, in order. All texts advance together."""
    n = len(feats)
    emit = np.zeros((n, 4))
    for k, table in enumerate(model.emit):
        emit += table.T[feats[:, k]]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    first, left = first[order], sizes[order]
    active = int((left > 0).sum())
    score = np.zeros((len(order), 4))
    back = np.zeros((n, 4), dtype=np.int8)
    score[:active] = model.start + emit[first[:active]]
    for t in range(1, int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left, -t, side="left"))
        both = score[:active, :, None] + model.move
        back[first[:active] + t] = both.argmax(1)
        score[:active] = both.max(1) + emit[first[:active] + t]
    out = np.zeros(n, dtype=np.int8)
    state = score.argmax(1).astype(np.int8)
    for t in range((int(left[0]) if len(left) else 0) - 1, -1, -1):
        active = int(np.searchsorted(-left, -t, side="left"))
        rows = first[:active] + t
        out[rows] = state[:active]
        state[:active] = back[rows, state[:active]]
    return out


def train(feats: np.ndarray, sizes: np.ndarray, rounds: int = FIT_ROUNDS, weight: float = PRIOR_WEIGHT) -> LineModel:
    """Viterbi training: decode, count, re-estimate with the prior tables as pseudo-counts."""
    prior = model = prior_model()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    starts = starts[sizes > 0]
    inner = np.ones(len(feats), dtype=bool)
    inner[starts] = False
    for _ in range(rounds):
        lab = _decode(model, feats, sizes)
        begin = np.exp(prior.start) * weight + np.bincount(lab[starts], minlength=4)
        move = np.exp(prior.move) * weight
        to = np.flatnonzero(inner)
        np.add.at(move, (lab[to - 1], lab[to]), 1)
        emit = []
        for k, table in enumerate(prior.emit):
            c = np.exp(table) * weight
            np.add.at(c, (lab, feats[:, k]), 1)
            emit.append(np.log(c / c.sum(1, keepdims=True)))
        model = LineModel(np.log(begin / begin.sum()), np.log(move / move.sum(1, keepdims=True)), tuple(emit))
    return model


def _featurize(texts: list[str | None], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    feats, chars, sizes = [], [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            for line in t.split("\n"):
                if line and not line.isspace():
                    feats.append(line_features(line, common))
                    chars.append(len(line))
                    sizes[i] += 1
    return np.array(feats, dtype=np.int8).reshape(-1, len(FEATURES)), np.array(chars, dtype=np.int64), sizes


def common_set(common_words: DataFrame) -> frozenset[str]:
    """The words of all languages, lower case. The table is a fixed word list; more than 100,000 rows is an error."""
    rows = common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words is not a short word list")
    return frozenset(r.w for r in rows)


def fit_line_model(records: DataFrame, common: frozenset[str], key: Column, text: str, texts: int = FIT_TEXTS) -> LineModel:
    """Fit on about ``texts`` texts, those whose key hashes lie below a bound set from the number of rows.

    The sample is the same in every run, and no more than it reaches the driver; at most 400 lines of a text are used.
    """
    rows = records.where(F.col(text).isNotNull())
    share = min(1.0, texts / max(1, records.count()))
    rows = rows.select(F.xxhash64(key).alias("_h"), F.col(text).alias("_s")).where(F.pmod("_h", F.lit(2**31)) < F.lit(math.ceil(share * 2**31))).select("_h", fold(F.col("_s")).alias("_t"))
    lines = rows.select("_h", F.xxhash64("_t").alias("_g"), F.slice(F.filter(F.split("_t", "\n"), lambda x: F.trim(x) != ""), 1, 400).alias("lines")).orderBy("_h", "_g").limit(2 * texts)
    sample = [list(r.lines) for r in lines.collect()]
    feats, sizes, total = [], [], 0
    for ls in sample:
        f = [line_features(x, common) for x in ls if x.strip()]
        if total + len(f) > FIT_LINES:
            break
        feats += f
        sizes.append(len(f))
        total += len(f)
    if not feats:
        return prior_model()
    return train(np.array(feats, dtype=np.int8), np.array(sizes, dtype=np.int64))


_STATS = T.StructType(
    [T.StructField("word_count", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")]
    + [T.StructField(f"{c}_share", T.DoubleType()) for c in LABELS]
    + [T.StructField("is_prose", T.BooleanType())]
)


def text_quality(
    records: DataFrame, common_words: DataFrame, keep: tuple[str, ...], text: str = "text", key: str = "chunk_id",
    model: LineModel | None = None, prose_share: float = PROSE_SHARE, labels: bool = True,
) -> DataFrame:
    """``keep`` columns of ``records`` with statistics, label shares and ``is_prose`` for every row.

    word_count: words apart by white space. mean_word_length: their mean length. symbol_ratio: characters that
    are neither letter, digit nor blank, by all characters. punctuated_line_share: of the non-blank lines, those
    that end in ``. ! ? : ; …`` (closing quotes and brackets aside). common_word_share: words that are in
    ``common_words`` of any language, case and edge punctuation aside. The shares of prose, list, table and junk
    count characters of non-blank lines. Look-alike characters count as what they look like. A null text gives
    nulls, an empty or blank one 0 words and null for all else. Very long texts are processed whole. Without
    ``labels`` no line is labelled; the shares and ``is_prose`` are left out.
    """
    common = common_set(common_words)
    if model is None and labels:
        model = fit_line_model(records, common, F.col(key), text)
    stats = T.StructType([f for f in _STATS.fields if labels or f.name not in (*[f"{c}_share" for c in LABELS], "is_prose")])
    fields = {f.name: f for f in records.schema.fields}
    schema = T.StructType([T.StructField(c, fields[c].dataType) for c in keep] + stats.fields)
    rows = records.select(*keep, fold(F.col(text)).alias("_folded"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["_folded"]]
            feats, chars, sizes = _featurize(texts, common)
            owner = np.repeat(np.arange(len(texts)), sizes)
            shares = np.zeros((len(texts), 4))
            if labels and len(feats):
                np.add.at(shares, (owner, _decode(model, feats, sizes)), chars)
            total = shares.sum(1)
            ends = np.bincount(owner, weights=feats[:, 5], minlength=len(texts)) if len(feats) else np.zeros(len(texts))
            cols: dict[str, list] = {c: [] for c in _STATS.names}
            for i, t in enumerate(texts):
                words = t.lower().split() if t else []
                n = len(words)
                cols["word_count"].append(None if t is None else n)
                cols["mean_word_length"].append(sum(map(len, words)) / n if n else None)
                cols["symbol_ratio"].append(len(_SYMBOL.findall(t)) / len(t) if n else None)
                cols["punctuated_line_share"].append(ends[i] / sizes[i] if n else None)
                cols["common_word_share"].append(sum(w.strip(_EDGE) in common for w in words) / n if n else None)
                for k, c in enumerate(LABELS if labels else ()):
                    cols[f"{c}_share"].append(shares[i, k] / total[i] if n else None)
                cols["is_prose"].append(labels and bool(shares[i, 0] >= prose_share * total[i]) if n else None)
            out = pdf[list(keep)].copy()
            for c in stats.names:
                out[c] = pd.Series(cols[c], index=out.index, dtype=object)
            yield out

    return rows.mapInPandas(run, schema)
