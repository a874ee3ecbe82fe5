"""Problems 7, 8 and 9: leakage, mixing, residue."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import leakage, mixing, residue

WORDS = "pump valve rotor seal bolt anchor relay trim brush feed needle kiln vane spool hinge cam die gate idler flue".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, sentence(rng, n)) for i, n in enumerate([30, 40, 12, 15, 60, 3])] + [(6, None), (7, ""), (8, "... !!")]
    docs = []
    for d in range(60):
        t = sentence(rng, 80)
        if d % 3 == 0:
            w = items[d % 6][1].split()
            k = rng.choice([10, 14, 15, 20])
            t += " " + " ".join(w[:k]) + " " + sentence(rng, 20)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, items[1][1].upper().replace(" ", ",  ")), (103, items[0][1].replace("valve", "val-\n> ve").replace("pump", "рumр")), (102, items[1][1].upper().replace(" ", ",  "))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e).where("exact").collect()}

    def words(t):
        import re

        t = t.replace("р", "p").lower().replace("-\n> ", "")
        return re.findall(r"\w+", t)

    want = set()
    for i, t in items:
        w = words(t or "")
        k = min(15, len(w))
        if w:
            grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            want |= {(a, i) for a, x in docs if x and any(tuple(words(x)[j : j + k]) in grams for j in range(len(words(x)) - k + 1))}
    assert got == want and len(want) > 12
    assert leakage.find_leaks(d.limit(0), e).count() == 0
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 600)  # items in blocks give the same rows
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e).where("exact").collect()} == want


def test_smith_waterman_against_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(0, 4, rng.integers(1, 10))
        h = np.zeros((len(b) + 1, len(a) + 1), dtype=int)
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, first, last = leakage.smith_waterman(a, b)
        assert score == h.max() and (score == 0 or 0 <= first <= last < len(a))


def test_edited_copy_scores(spark):
    item = sentence(random.Random(1), 40).split()
    edited = [w if i % 9 else "changed" for i, w in enumerate(item)]
    d = spark.createDataFrame([(1, "before " + " ".join(edited) + " after"), (2, sentence(random.Random(7), 60))], "doc_id long, text string")
    e = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    r = {x.doc_id: x for x in leakage.find_leaks(d, e).collect()}
    assert r[1].score_share > 0.6 and not r[1].exact and (2 not in r or r[2].score_share < 0.5)


def test_scores_against_alignment():
    rng = np.random.default_rng(3)
    for _ in range(40):
        item = rng.integers(1, 6, rng.integers(1, 14)).astype(np.int32)
        docs = [rng.integers(0, 8, n).astype(np.int32) for n in rng.integers(0, 30, 7)]
        assert leakage.smith_waterman_scores(docs, item) == [x[0] for x in leakage.smith_waterman_many(docs, item)]


def test_edited_copies_with_common_seeds(spark):
    """Copies that keep only n-grams which many documents hold are aligned like any other."""
    item = sentence(random.Random(5), 30).split()
    edited = [*item[:10], *["changed"] * 2, *item[12:18], "changed", *item[19:28]]
    docs = [(k, f"unit {k} " + " ".join(item[a:b])) for k, (a, b) in enumerate([(0, 10), (12, 18), (19, 28)] * 40)] + [(999, " ".join(edited))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rare = [(k, f"unit {k} " + " ".join(item[8:15])) for k in range(2000, 2003)]  # the item's rarest n-grams, cut by the edit
    e = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    leaks = leakage.find_leaks(d.union(spark.createDataFrame(rare, d.schema)), e)
    got = {r.doc_id: r for r in leaks.where(F.col("score_share") >= leakage.EDITED_SHARE).collect()}
    assert set(got) == {999} and got[999].score_share > 0.7 and not got[999].exact


def test_recall_of_planted_edited_copies(spark):
    """Copies of an item of 40 words with every n-th word replaced: all are found from n = 6 on, where five words in a row stay."""
    rng = random.Random(11)
    items = [(i, sentence(rng, 40)) for i in range(20)]
    docs, want = [], {}
    for every in (6, 7, 8, 10):
        for i, t in items:
            words = [f"zz{k}" if k % every == every - 1 else w for k, w in enumerate(t.split())]
            docs.append((len(docs), sentence(rng, 60) + ". " + " ".join(words) + ". " + sentence(rng, 60)))
            want[docs[-1][0]] = i
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = leakage.find_leaks(d, spark.createDataFrame(items, "item_id long, text string"), least=leakage.EDITED_SHARE).where(F.col("score_share") >= leakage.EDITED_SHARE)
    assert {(k, i) for k, i in want.items()} <= {(r.doc_id, r.item_id) for r in found.collect()}


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="public tokenizer files not here")
def test_mixture_reaches_targets(spark):
    rng = random.Random(3)
    docs, n = [], 0
    for src, count in (("Big_Source", 900), ("mid-source ", 300), ("small source", 60), ("other", 50)):
        for _ in range(count):
            docs.append((n, sentence(rng, rng.randint(5, 200)), src if n % 5 else src.upper(), n * 2))
            n += 1
    docs += [(n, None, "Big_Source", 1), (n + 1, "", "Big_Source", 1), (n + 2, "x", None, 1), (None, "x", "Big_Source", 1), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    t = spark.createDataFrame([("big_source", 0.5, 1), ("MID SOURCE", 0.3, 2), ("small-source", 0.15, 3), ("absent", 0.05, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(d, t)
    rows = mix.collect()
    caps = {"bigsource": 1, "midsource": 2, "smallsource": 3}
    assert rows and all(1 <= r.copies <= caps[r.source_key] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    got = {r.source_key: r for r in mixing.shares(mix, t).collect()}
    for k, share in (("bigsource", 0.5), ("midsource", 0.3), ("smallsource", 0.15)):
        assert abs(got[k].actual_share - share / 0.95) < 0.01
    assert got["absent"].tokens == 0 and len(got) == 4
    assert mixing.mix_sources(d.limit(0), t).count() == 0
    half = mixing.mix_sources(d, t, total_tokens=5000.0)
    assert abs(half.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] - 5000) < 500


RESIDUE = [
    "Dear {{customer_name}},\n\nthe pump is ready.", "The pump {% include due_date %} is ready.", "We found that\n#{owner_ref} the needle was bright.", "Turn [INSERT part name] the arm.",
    "The seal «UNIT_CODE» was cold.", "The seal &lt;due_date&gt; was cold.", "Section 1: (description to be supplied)", "Lorem ipsum dolor sit amet, quisque morbi semper ligula.",
    "xxx xxx xxx xxx xxx xxx xxx xxx", "A line.\n\nAccess denied. Your account has no permission for this shelf. Incident 5bee369a", "HTTP/1.1 503 Service Unavailable\nconnection: close",
    "Menu | Contents\nPlease enable JavaScript to see this page.\nThe pump is warm.", "Bitte aktivieren Sie JavaScript, um dieses Blatt anzuzeigen.", "ERROR 404: NOT FOUND. GO BACK TO THE START PAGE.",
    "Traceback (most recent call last):\n  File \"a.py\", line 3, in x\nKeyError: 'b'", "Hier steht ein Blindtext. Bitte durch den richtigen Text ersetzen.", "Name: ________ Date: 3 May",
    "Your session has expired. Please sign in again.", "The pump. [TODO: add model] It is warm.", "The flange bracket <<DEPT>> was replaced.", "LEFT &LT;FIGURE_CAPTION&GT; IN THE HALL.", "Texte provisoire. Merci de saisir ici la description définitive.", "Ρlеasе enable cookies to go on.",
]
CLEAN = [
    "In the form letters a mark such as {{customer_name}} stood for the value that the clerk filled in later.", "Set the shell variable ${HOME_DIR} as shown in the appendix.",
    "The gain is 40 % at the socket and 60 % at the ring <see the note below>.", "The set {a, b} holds the two ends, and [c] is the point between them.", "Insert the drum only then [see sheet 52].",
    "Printers often fill an empty column with lorem ipsum; the lecturer showed why.", "The chapter on web servers explains that code 404 means that no page was found.",
    "The controller shows error 404 when the chamber is not found on the bus.", "Readers who write their own viewer may use JavaScript, but none is needed.",
    "A notice on the door said that the room was closed for maintenance of the die.", "Access to the hinge is denied to the apprentice unless the operator has signed.",
    "Index of terms\nBallast Filter ........ 886\nHeader Spool ........ 455", "pawl carriage, 69, 401\npunch plug, 127, 500", "", None,
]


def test_residue_cases(spark):
    data = [(i, t, "t") for i, t in enumerate(RESIDUE + CLEAN)]
    d = spark.createDataFrame(data + data[:3], "doc_id long, text string, kind string")
    found = {r.doc_id for r in residue.find_residue(d).collect()}
    assert found == set(range(len(RESIDUE))), [data[i][1] for i in found ^ set(range(len(RESIDUE)))]
    kept = residue.without_residue(d)
    assert kept.columns == d.columns and kept.count() == len(CLEAN)
    assert residue.find_residue(d.limit(0)).count() == 0


def test_weak_slots_need_a_known_name(spark):
    strong = [(i, f"Dear {{{{batch}}}}, pump {i} is ready.") for i in range(3)]
    d = spark.createDataFrame([*strong, (10, "Dear {batch}, it is ready."), (11, "The set {alpha} is empty."), (None, "Dear {{batch}}"), (12, sentence(random.Random(2), 150_000))], "doc_id long, text string")
    assert {r.doc_id for r in residue.find_residue(d).collect()} == {0, 1, 2, 10}


def test_weak_messages_by_records_and_paragraphs(spark):
    pages = ["Une erreur est survenue.", "Ein Fehler ist\naufgetreten.\n\nZur Startseite"]
    data = [(10 * p + k, x) for p, x in enumerate(pages) for k in range(3)]  # one page under three keys
    data += [(40 + k, f"Text of unit {k} and {sentence(random.Random(k), 30)}\n\nan error kept this\nsheet from view") for k in range(3)]  # wrapped
    clean = [(50, "Es gab einen Fehler."), (51, "Es gab einen Fehler."), (50, "Es gab einen Fehler.")]  # two keys only
    clean += [(60 + k, sentence(random.Random(9), 60) + "\n\nthe reading error is small") for k in range(4)]  # copies of a real text
    d = spark.createDataFrame(data + clean, "doc_id long, text string")
    assert {r.doc_id for r in residue.find_residue(d).collect()} == {k for k, _ in data}


def test_slots_that_other_records_fill(spark):
    """Names, defaults and blanks in markup no list knows, at a position where same-template records vary."""
    def letter(who):
        return f"Dear {who},\n\nthank you for the order. Our driver {who} will bring it on Monday."

    filled = [(k, letter(n)) for k, n in enumerate(["Anna", "Otto Berg", "Ines", "Paul"])]
    left = [(10 + k, letter(x)) for k, x in enumerate(["{client}", "client_name", "[name]", "TBD", "__", "???"])]
    form = [(30 + k, f"Model: {v}\nDate: {k} May") for k, v in enumerate(["Lark", "Wren", "Tern"])] + [(40, "Model: undefined\nDate: 7 May")]
    clean = [(50, "The set {alpha} is empty."), (51, "Set the field order_id before you start."), (52, "The pointer is null in both cases."), (53, None)]
    clean += [(60 + k, "Turn the [handle] to the left.") for k in range(4)]  # always the same word: no slot
    d = spark.createDataFrame(filled + left + form + clean, "doc_id long, text string")
    assert {r.doc_id for r in residue.find_residue(d).collect()} == {*range(10, 16), 40}
