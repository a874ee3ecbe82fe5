"""Problem 7: passages of evaluation items inside corpus documents.

Every word n-gram of an item is a seed, however many documents hold it, so that the pairs found do not depend
on the size of the corpus. In one pass over the corpus, documents that hold a seed are scored against the item by
Smith-Waterman on words, which also finds edited copies; an exact check says whether a run of the item's words
stands in the document whole; the place of the alignment is worked out for the pairs that are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import fold

#: Words of a seed; words of a passage that counts.
SEED_WORDS, PASSAGE_WORDS = 5, 15
#: Smith-Waterman scores by word, and the least score of an edited copy by the item's best possible one.
MATCH, MISMATCH, GAP, EDITED_SHARE = 2, -1, -1, 0.5
#: Items are held by every task, so many characters at a time; larger sets are taken in blocks of items.
MAX_ITEM_CHARS = 20_000_000

_P = np.uint64(0x9E3779B97F4A7C15)


def word_form(text: Column) -> Column:
    """Lower-case words with single blanks: no punctuation, look-alikes folded, words broken over line ends joined."""
    plain = F.length(text) == F.octet_length(text)
    soft = F.when(F.contains(text, F.lit("\u00ad")), F.regexp_replace(text, "\\u00ad[ \\t]*\\r?\\n[> \\t]*", "")).otherwise(text)
    t = F.lower(F.when(plain, text).otherwise(fold(soft)))
    broken = t.rlike("-[ \\t]*\\r?\\n")
    t = F.when(broken, F.regexp_replace(t, "(?<=\\p{L})-[ \\t]*\\r?\\n[> \\t]*(?=\\p{L})", "")).otherwise(t)
    return F.trim(F.when(plain, F.regexp_replace(t, "[^a-z0-9]+", " ")).otherwise(F.regexp_replace(t, "[^\\p{L}\\p{N}\\p{M}]+", " ")))


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word ids (uint64)."""
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        h = h * _P + ids[k : len(ids) - n + 1 + k] + np.uint64(1)
        h ^= h >> np.uint64(31)
    return h


class Text(NamedTuple):
    """A text's words as ids of the items' vocabulary (0: none), run together, and one by one."""

    ids: np.ndarray
    squeezed: str
    words: list[str]


class Items:
    """The evaluation items with their words, n-grams and exact passages."""

    def __init__(self, rows: list[tuple[int, str, str]], n: int = SEED_WORDS, passage: int = PASSAGE_WORDS):
        """rows: (item_id, words in ``word_form``, white-space words each in ``word_form`` joined by \\x1f)."""
        self.n, self.passage = n, passage
        self.vocabulary: dict[str, int] = {}
        self.words: dict[int, np.ndarray] = {}
        self.tokens: dict[int, list[str]] = {}
        self.anchors: dict[int, list[str]] = {}
        for item, form, tokens in rows:
            words = form.split()
            if not words:
                continue
            self.words[item] = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
            t = [x for x in (re.sub(r"\s", "", y) for y in tokens.split("\x1f")) if x]
            k = min(passage, len(t))
            self.tokens[item] = t
            b = (k + 1) // 2  # k words in a row hold one of these blocks whole
            self.anchors[item] = list(dict.fromkeys("".join(t[i : i + b]) for i in range(0, len(t) - b + 1, max(1, b))))
        self.by_item = {i: _grams(w, min(n, len(w))) for i, w in self.words.items()}
        self.sizes = sorted({min(n, len(w)) for w in self.words.values()})
        self.keys = {s: np.unique(np.concatenate([g for i, g in self.by_item.items() if min(n, len(self.words[i])) == s])) for s in self.sizes}
        # seeds in order, and whose they are
        self.ids = list(self.by_item)
        grams = np.concatenate([*self.by_item.values(), np.empty(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.seeds, self.owners = grams[order], np.repeat(np.arange(len(self.ids)), [len(g) for g in self.by_item.values()])[order]

    @property
    def exact(self) -> dict[int, list[str]]:
        """The passages of every item; built when asked for, as together they are many times the items' text."""
        return {i: list(self.passages(i)) for i in self.tokens}

    def passages(self, item: int) -> Iterator[str]:
        """The runs of ``passage`` words of an item, or all of it, without blanks."""
        t = self.tokens[item]
        k = min(self.passage, len(t))
        return ("".join(t[i : i + k]) for i in range(len(t) - k + 1))

    def hits(self, form: str) -> np.ndarray:
        """The distinct item n-grams in a text."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in form.split()], dtype=np.uint64)
        known = ids > 0
        out = []
        for s in self.sizes:
            if len(ids) < s:
                continue
            whole = np.convolve(known, np.ones(s, dtype=np.int8), "valid") == s
            g = _grams(ids, s)[whole]
            keys = self.keys[s]
            at = np.searchsorted(keys, g)
            at[at == len(keys)] = 0
            out.append(g[keys[at] == g])
        return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64)

    def candidates(self, form: str) -> list[int]:
        """The items that have a seed in common with a text."""
        g = self.hits(form)
        at, to = np.searchsorted(self.seeds, g, "left"), np.searchsorted(self.seeds, g, "right")
        return [self.ids[k] for k in np.unique(np.concatenate([*(self.owners[a:b] for a, b in zip(at, to)), np.empty(0, np.int64)]))]

    def align(self, item: int, texts: list[Text], least: float = 0.0) -> list[tuple[int, int, int, int, bool]]:
        """(position in ``texts``, score, first and last word of the best local alignment, an exact passage is there).

        Texts that score below ``least`` of the item's best and hold no exact passage are left out.
        """
        words = self.words[item].astype(np.int32)
        scores = smith_waterman_scores([t.ids for t in texts], words)
        whole = [self._whole(item, t) for t in texts]
        kept = [k for k, (s, x) in enumerate(zip(scores, whole)) if x or s >= least * MATCH * len(words)]
        return [(k, *x, whole[k]) for k, x in zip(kept, smith_waterman_many([texts[k].ids for k in kept], words))]

    def text(self, form: str) -> Text:
        words, get = form.split(), self.vocabulary.get
        return Text(np.array([get(w, 0) for w in words], dtype=np.int32), "".join(words), words)

    def _whole(self, item: int, text: Text) -> bool:
        """Some passage of the item stands in the text, from the start of a word to the end of one."""
        squeezed = text.squeezed
        if not any(x in squeezed for x in self.anchors[item]):
            return False
        edges: set[int] | None = None
        for x in self.passages(item):
            at = squeezed.find(x)
            while at >= 0:
                if edges is None:
                    edges = {0, *np.cumsum([len(w) for w in text.words]).tolist()}
                if at in edges and at + len(x) in edges:
                    return True
                at = squeezed.find(x, at + 1)
        return False


#: Cells of one block of texts that are aligned together, and of one diagonal of texts that are scored together.
BLOCK_CELLS, DIAGONAL_CELLS = 400_000, 16_000


def smith_waterman_scores(docs: list[np.ndarray], item: np.ndarray) -> list[int]:
    """The scores of ``smith_waterman_many`` without the places: all texts of a block advance by one diagonal at a time."""
    size = len(item)
    kind = np.int16 if MATCH * size < 30_000 else np.int32
    known, own = np.unique(item, return_inverse=True)
    own = own.astype(kind)[:, None]
    out = [0] * len(docs)
    order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: len(docs[i]))
    while order:
        width = len(docs[order[-1]])
        rows = [order.pop() for _ in range(min(len(order), max(1, DIAGONAL_CELLS // size)))]
        # last word first, with size - 1 words that match nothing on both sides
        block = np.full((width + 2 * size - 2, len(rows)), -1, dtype=kind)
        for k, i in enumerate(rows):
            at = np.searchsorted(known, docs[i])
            at[at == len(known)] = 0
            block[size - 1 + width - len(docs[i]) : size - 1 + width, k] = np.where(known[at] == docs[i], at, -1)[::-1]
        # row r + 1 of a diagonal: the item's word r against the text's word d - r
        before, last, new = (np.zeros((size + 1, len(rows)), dtype=kind) for _ in range(3))
        best = np.zeros((size, len(rows)), dtype=kind)
        for d in range(width + size - 1):
            begin = size - 1 + width - 1 - d
            cell = np.where(block[begin : begin + size] == own, kind(MATCH), kind(MISMATCH))
            cell += before[:-1]
            gap = np.maximum(last[:-1], last[1:])
            gap += kind(GAP)
            np.maximum(cell, gap, out=cell)
            np.maximum(cell, 0, out=new[1:])
            np.maximum(best, new[1:], out=best)
            before, last, new = last, new, before
        for i, s in zip(rows, best.max(0).tolist()):
            out[i] = s
    return out


def smith_waterman_many(docs: list[np.ndarray], item: np.ndarray) -> list[tuple[int, int, int]]:
    """``smith_waterman`` of one item against many texts: texts of similar length advance together, padded."""
    out: list[tuple[int, int, int]] = [(0, 0, -1)] * len(docs)
    order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: len(docs[i]))
    while order:
        width = len(docs[order[-1]])
        rows = [order.pop() for _ in range(min(len(order), max(1, BLOCK_CELLS // width)))]
        block = np.full((len(rows), width), -1, dtype=np.int32)
        for k, i in enumerate(rows):
            block[k, : len(docs[i])] = docs[i]
        for i, x in zip(rows, _align_block(block, item)):
            out[i] = x
    return out


def _align_block(block: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    m, n = block.shape
    pos = np.arange(n + 1, dtype=np.int32)
    h = np.zeros((m, n + 1), dtype=np.int32)
    origin = np.broadcast_to(pos, h.shape).copy()
    best, first, last = np.zeros(m, np.int32), np.zeros(m, np.int32), np.full(m, -1, np.int32)
    rows = np.arange(m)
    for w in item:
        diag = h[:, :-1] + np.where(block == w, np.int32(MATCH), np.int32(MISMATCH))
        up = h[:, 1:] + np.int32(GAP)
        new = np.zeros_like(h)
        begin = np.broadcast_to(pos, h.shape).copy()
        np.maximum(diag, up, out=new[:, 1:])
        alive = new[:, 1:] > 0
        begin[:, 1:] = np.where(alive, np.where(diag >= up, origin[:, :-1], origin[:, 1:]), pos[1:])
        np.maximum(new, 0, out=new)
        run = new - np.int32(GAP) * pos  # gaps in the item: the best of all positions to the left
        top = np.maximum.accumulate(run, axis=1)
        gapped = top + np.int32(GAP) * pos
        better = gapped > new
        if better.any():
            source = np.maximum.accumulate(np.where(run == top, pos, 0), axis=1)
            begin = np.where(better, np.take_along_axis(begin, source, 1), begin)
            new = np.where(better, gapped, new)
        h, origin = new, begin
        k = h.argmax(1)
        s = h[rows, k]
        gain = s > best
        best[gain], first[gain], last[gain] = s[gain], origin[rows, k][gain], k[gain] - 1
    return list(zip(best.tolist(), first.tolist(), last.tolist()))


def smith_waterman(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score and its first and last position in ``doc``."""
    return smith_waterman_many([doc], item)[0]


def load_items(items: DataFrame, key: str = "item_id", text: str = "text", n: int = SEED_WORDS, passage: int = PASSAGE_WORDS) -> Items:
    """One block of items, on the driver."""
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    form = rows.select(
        F.col(key).alias("k"), word_form(F.col(text)).alias("form"),
        F.array_join(F.transform(F.split(F.col(text), "\\s+"), word_form), "\x1f").alias("tokens"),
    ).distinct().orderBy("k", "form")
    return Items([(r.k, r.form, r.tokens) for r in form.collect()], n, passage)


def find_leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", n: int = SEED_WORDS, passage: int = PASSAGE_WORDS, least: float = 0.0,
) -> DataFrame:
    """(doc_id, item_id, score, score_share, first_word, last_word, exact), one row per document and item with a seed in common.

    score: Smith-Waterman score of the best local alignment; score_share: by the best score the item allows;
    exact: ``passage`` consecutive words of the item (all of them, if it has fewer) stand in the document.
    least: rows of a smaller score_share are left out unless they are exact.
    Null keys, null or empty texts and items without words give no row; documents delivered twice count once;
    two items of one text both get rows. Whole texts are read, however long.
    """
    chars = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    if chars > MAX_ITEM_CHARS:
        blocks = 2 * math.ceil(chars / MAX_ITEM_CHARS)
        part = [items.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == k) for k in range(blocks)]
        return reduce(DataFrame.unionByName, [_leaks(documents, p, key, text, item_key, item_text, n, passage, least) for p in part])
    return _leaks(documents, items, key, text, item_key, item_text, n, passage, least)


def _leaks(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, n: int, passage: int, least: float) -> DataFrame:
    held = load_items(items, item_key, item_text, n, passage)
    fields = {f.name: f for f in documents.schema.fields}
    ifields = {f.name: f for f in items.schema.fields}
    docs = documents.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("_doc"), word_form(F.col(text)).alias("_form"))
    out = T.StructType(
        [T.StructField(key, fields[key].dataType), T.StructField(item_key, ifields[item_key].dataType)]
        + [T.StructField("score", T.LongType()), T.StructField("score_share", T.DoubleType())]
        + [T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("exact", T.BooleanType())]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, docs, by_item = [], [], {}
            for doc, form in zip(pdf["_doc"].tolist(), pdf["_form"]):
                its = held.candidates(form)
                if its:
                    t = held.text(form)
                    docs.append(doc)
                    for i in its:
                        by_item.setdefault(i, []).append((len(docs) - 1, t))
            for i, at in sorted(by_item.items()):
                most = MATCH * len(held.words[i])
                for k, s, a, b, exact in held.align(i, [t for _, t in at], least):
                    rows.append((docs[at[k][0]], i, s, s / most, a, b, exact))
            yield pd.DataFrame(rows, columns=out.names)

    return docs.mapInPandas(score, out).distinct()
