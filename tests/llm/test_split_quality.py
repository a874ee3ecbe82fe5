"""Problems 3 and 6: splitting and quality."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import quality, split


def check(text, cuts, limit=split.MAX_CHARS, overlap=split.OVERLAP):
    assert "".join(text[b:e] for _, b, e in cuts) == text
    for i, (a, b, e) in enumerate(cuts):
        assert e - a <= limit and 0 <= b - a <= overlap and b < e
        assert (a, b) == (0, 0) if i == 0 else cuts[i - 1][2] == b


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é.\ńß", min_size=1201, max_size=6000))
def test_pieces_cover_the_text(text):
    check(text, split.cut_positions(text))


@pytest.mark.parametrize("text", ["x" * 5000, "word " * 2000, "Line of text.\n" * 700, "\n" * 3000, "é́" * 2000, " " * 1201])
def test_odd_texts(text):
    check(text, split.cut_positions(text))


def test_cuts_are_natural_where_possible():
    text = ("The pump is seen. It runs well and long. " * 12 + "\n\n") * 12
    for _, _, e in split.cut_positions(text)[:-1]:
        assert text[:e].rstrip(" ").endswith(("\n\n", ".")) and text[e - 1].isspace()


def test_an_edit_moves_only_near_cuts():
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 6000)]
    text = " ".join(w + ("." if i % 11 == 0 else "") for i, w in enumerate(words))
    a = {text[b:e] for _, b, e in split.cut_positions(text)}
    b = {x for x in (lambda t: [t[b:e] for _, b, e in split.cut_positions(t)])(text[:20000] + "zzzz " + text[20000:])}
    assert len(a - b) <= 0.2 * len(a)


def test_split_operator(spark):
    long = "A sentence that is short. " * 100
    data = [("c1", long, "H", 3, "x"), ("c1", long, "H", 3, "x"), ("c2", "short", "H", 3, "x"), ("c3", None, None, None, None), ("c4", "y" * 1200, "H", None, "x"), ("c5", "y" * 1201, None, None, "x")]
    d = spark.createDataFrame(data, "chunk_id string, text string, section_heading string, page_start int, piece_index string")
    out = split.split_oversized(d).collect()
    assert {r.chunk_id for r in out} == {"c1", "c5"}
    first = sorted((r for r in out if r.chunk_id == "c1"), key=lambda r: r.piece_index)
    assert [r.piece_index for r in first] == list(range(1, first[0].piece_count + 1)) and {r.section_heading for r in first} == {"H"}
    assert "".join(r.text[r.overlap_chars :] for r in first) == long
    for x, y in zip(first, first[1:]):
        assert x.text.endswith(y.text[: y.overlap_chars])
    assert split.split_oversized(d.limit(0)).count() == 0


PROSE = "The older pump was heated by hand, while the new one is\ncounted against a return coupling. Each pump has its own mark, and the\nmark should face the plug when it is wrapped."
LIST = "- polished intake tray\n- straight feed roller\n- steady die tray\n- bright brush block\n- painted coil drum"
TABLE = "Table 2-72. Feed valve sizes\nRadius    Load    Clearance\nBrush Switch    793.9    920\nPulley Chamber    M14    40.03\nHeader Vane    261.3    0.24"
JUNK = "vgjjjw xkbgb xfhxbqwh ckf gvvczbzbx dfkkg jvgcqvx vqbxjfvcd xcvdxxfk zvcwhd\n=#` \", *` \\:#'='1 '|;I }|^:#=\"/^ *1/#/.#|1+I#_+/.+.;,#"
GERMAN = "Man prüft zuerst, ob die Fläche auf der Bühne richtig geöffnet ist, und misst dann noch einmal.\nDie Männer in der Werkstatt sagen, es sei schon mehr als sonst."


def test_labels(spark):
    common = spark.createDataFrame([("en", w) for w in "the of and a to in is was it that on by be when has its while one each against own".split()] + [("de", w) for w in "man die und dann es sei der in ist noch einmal schon mehr ob".split()], "lang string, word string")
    data = [("p", PROSE), ("l", LIST), ("t", TABLE), ("j", JUNK), ("g", GERMAN), ("u", PROSE.upper()), ("e", ""), ("b", " \n "), ("n", None)]
    d = spark.createDataFrame(data, "chunk_id string, text string")
    got = {r.chunk_id: r for r in quality.text_quality(d, common, ("chunk_id",)).collect()}
    assert {k for k, r in got.items() if r.is_prose} == {"p", "g", "u"}
    assert max(quality.LABELS, key=lambda c: got["l"][f"{c}_share"]) == "list" and max(quality.LABELS, key=lambda c: got["t"][f"{c}_share"]) == "table"
    assert max(quality.LABELS, key=lambda c: got["j"][f"{c}_share"]) == "junk"
    assert got["n"].word_count is None and got["e"].word_count == 0 and got["b"].is_prose is None
    assert quality.text_quality(d.limit(0), common, ("chunk_id",)).count() == 0


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(1)
    model = quality.prior_model()
    sizes = np.array([3, 0, 4, 1])
    feats = np.stack([rng.integers(0, n, sizes.sum()) for n in quality.FEATURES.values()], 1).astype(np.int8)
    got, at = quality._decode(model, feats, sizes), 0
    for n in sizes:
        f = feats[at : at + n]
        def score(p):
            s = sum(t[p[i], f[i, k]] for i in range(n) for k, t in enumerate(model.emit))
            return s + (model.start[p[0]] if n else 0) + sum(model.move[a, b] for a, b in zip(p, p[1:]))
        best = max(product(range(4), repeat=int(n)), key=score)
        assert abs(score(best) - score(tuple(got[at : at + n]))) < 1e-9
        at += n


def test_training_keeps_probabilities():
    feats = np.array([quality.line_features(x, frozenset({"the", "and"})) for x in (PROSE + "\n" + TABLE).split("\n")], dtype=np.int8)
    m = quality.train(feats, np.array([3, len(feats) - 3]))
    assert np.allclose(np.exp(m.move).sum(1), 1) and all(np.allclose(np.exp(t).sum(1), 1) for t in m.emit)
