"""Toxicity: the automaton against plain edit distance, learning, context, and edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import toxicity as tox

TERMS = [("idiot", True), ("worthless", True), ("scum", True), ("lowei", False), ("chón", False), ("stupid", True)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def plain(word):
    """0 exact, 1 misspelled, None: by trying each term and each beginning of the word."""
    best = None
    for text, whole in TERMS:
        for stop in [len(word)] if whole else range(len(word) + 1):
            d = distance(word[:stop], text)
            if d == 0 or (d == 1 and len(text) >= tox.FUZZY):
                best = d if best is None else min(best, d)
    return best


@pytest.fixture(scope="module")
def matcher():
    return tox.Matcher(TERMS)


@given(st.lists(st.text("idotwrhlescumpnó1", min_size=1, max_size=10), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_automaton(matcher, words):
    text = " ".join(words)
    found = {text[a:b]: edits for a, b, _, edits in matcher.find(text)}
    assert found == {w: plain(w) for w in words if plain(w) is not None}


@pytest.mark.parametrize("word,edits", [("idiot", 0), ("IDIOT", 0), ("idiott", 1), ("idot", 1), ("id1ot", 1), ("id*ot", 1), ("idiots", 1), ("idea", None), ("scun", None), ("loweischaft", 0), ("lowischaft", 1), ("chónda", 0), ("worthles", 1), ("ordinary", None)])
def test_words(matcher, word, edits):
    found = matcher.find(f"a {word}, b")
    assert [f[3] for f in found] == ([] if edits is None else [edits])


def test_context():
    said = 'they wrote "you idiot" there'
    at = said.index("idiot")
    assert tox.quoted(said, at, at + 5) and not tox.quoted("you idiot go", 4, 9)
    assert tox.quoted("he called me an idiot", 16, 21) and not tox.quoted('"a" idiot b', 4, 9)


def corpus(n=900, seed=2):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(["an", "re", "ti", "on", "ka", "mo", "lu"]) for _ in range(draw.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(80)], i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(80), draw.choice(["idiot", "worthless", "zwebra" + word(), "scumbag"]))
        docs.append((i, " ".join(words), 0.5, "x"))
        if i % 5 < 4:
            labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, held_out string")
    return tox.train(df, spark.createDataFrame(labels, "doc_id long, toxic int")), df, dict(labels)


def test_learns_and_holds_out(model):
    made, df, labels = model
    assert {t for t, _ in made.matcher.terms} >= {"idiot", "worthless", "scumbag"} and ("zwebra", False) in made.matcher.terms
    rows = tox.score(df, made).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert held and all(a == b for a, b in held)


def test_misspelled_and_quoted(model):
    made, _, _ = model
    clean = "anre tion kamo lure " * 20
    s = made.score(pa.array([clean + "you idiot idiot worthless scumbag", clean + "you idiiot worthles scumbaag zwebra", clean, "", None]))
    assert s[0] > 0.5 > s[2] and s[1] > s[2] and np.allclose(s[2:], s[2])


def test_edges(spark, model):
    made, df, _ = model
    accepted = tox.accepted(df, made)
    assert accepted.columns == df.columns and accepted.count() == 750
    odd = spark.createDataFrame([(None, "idiot", 1.0, ""), (1, None, 1.0, ""), (1, "", 1.0, ""), (2, "idiot worthless scumbag " * 20_000, 1.0, "")], df.schema)
    rows = tox.score(odd, made).collect()
    assert len(rows) == 4 and not next(r for r in rows if r.doc_id is None).held_out
    assert tox.score(odd.limit(0), made).count() == 0
    nothing = tox.train(df, spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in tox.score(df, nothing).collect()} == {0.01}


def test_real_rows(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in tox.score(docs, tox.train(docs, labels)).collect() if r.doc_id in known]
    right = sum(r.predicted == known[r.doc_id] for r in rows)
    assert right >= 0.94 * len(rows) and not any(r.predicted for r in rows if not known[r.doc_id])


def test_lexicons_of_any_size_and_script():
    """Several automata find what each term would, in any script; no term is dropped."""
    import random

    draw = random.Random(4)
    terms = [("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(5, 9))), draw.random() < 0.5) for _ in range(450)]
    terms = sorted(set(terms)) + [("ばかやろう", True), ("ругань", True), ("𐐨𐐩𐐪𐐫", True)]
    many, found = tox.Matchers(terms), 0
    assert len(many.parts) == 3
    for text, whole in terms:
        got = many.find(f"x {text}{'' if whole else 'q'}, y")
        assert any(many.terms[k][0] == text and e == 0 for _, _, k, e in got) or got[0][3] == 0
        found += bool(got)
    assert found == len(terms)
    assert [many.terms[k][0] for _, _, k, _ in many.find("「ばかやろう」、РУГАНЬ")] == ["ばかやろう", "ругань"]
    counts = [(f"{a}{b}{c}word ", 50, 0) for a in "abcdefgh" for b in "abcdefgh" for c in "abcde"]
    assert len(tox.choose(counts, 400, 4000, 1000)) == 320


def test_word_beginnings_are_counted_in_bounded_parts():
    batch = pa.RecordBatch.from_pydict({"toxic": pa.array([k % 2 for k in range(1000)], pa.int32()), "text": [f"word{k} common" for k in range(1000)]})
    parts = list(tox._beginnings(iter([batch])))
    assert len(parts) > 1 and max(len(p) for p in parts) < 2000
    common = [r for p in parts for r in p.to_pylist() if r["term"] == "common "]
    assert (sum(r["toxic"] for r in common), sum(r["clean"] for r in common)) == (500, 500)
