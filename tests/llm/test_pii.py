"""Surrogates: detection, format, distinctness, coreference, and edge cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import pii

KEY = b"a key of the tests"
TEXT = "Mail Foo.Bar+1@Mail7.Example.com, call (212) 555-1234 or +49 30 1234567; ssn 123-45-6789; card 4111 1111 1111 1111; token = \"0a1b2c3d4e5f60718293\" Mr. John Smith, Frau Müller; host 10.20.30.40."


def test_detects():
    assert [k for *_, k, _ in pii.detect(TEXT)] == ["email", "phone", "phone", "ssn", "card", "secret", "given", "last", "last", "ip"]
    for clean in ("", "No data here: 12 apples, 3.14, 2024-01-02 and v1.2.3", "a@b", "@", "ratio 1:2 = half", "Mrsmith went", "123456789012", "1.2.3.4.5", "4111 1111 1111 1112", "9807915762804491"):
        assert pii.detect(clean) == []


def test_format_is_kept():
    new, _ = pii.replace(TEXT, KEY)
    shape = lambda t: re.sub(r"[A-Za-zÀ-ÿ]+", "a", re.sub(r"\d+", lambda m: "0" * len(m[0]), t.split("; host")[0].split(" Mr.")[0]))
    assert shape(new).startswith(shape(TEXT)[:60])
    card = re.search(r"card ([\d ]+);", new)[1]
    assert card != "4111 1111 1111 1111" and card[0] == "4" and pii.luhn(card.replace(" ", "")) and card[4] == " "
    assert "10.20.30.40" not in new and re.search(r"host 10\.\d+\.\d+\.\d+\.", new) and "Mr. " in new and "Frau " in new
    assert re.search(r'token = "[0-9a-f]{20}"', new) and "John" not in new and new.count("@") == 1


def test_coreference_across_spellings():
    a, _ = pii.replace("x +1 (017) 555-7713 y FOO@bar.org", KEY)
    b, _ = pii.replace("x +1 017 555 7713 y foo@bar.org", KEY)
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(a) == digits(b) and a.split()[-1].lower() == b.split()[-1].lower() and a.split()[-1][:3].isupper()
    assert pii.replace("Mr John Smith", KEY)[0] == pii.replace("Mr JOHN SMITH", KEY)[0].title()
    assert pii.surrogate("email", "a@x.org", b"k1") != pii.surrogate("email", "a@x.org", b"k2")


@given(st.integers(0, 9999), st.integers(0, 9999))
@settings(max_examples=100, deadline=None)
def test_permutation(a, b):
    sizes = [10, 10, 10, 10]
    spots = lambda n: [int(c) for c in f"{n:04d}"]
    x, y = pii.permute(spots(a), sizes, b"k", "t"), pii.permute(spots(b), sizes, b"k", "t")
    assert (x == y) == (a == b) and all(0 <= d < 10 for d in x)


def test_permutation_is_onto():
    made = {tuple(pii.permute([i // 26, i % 26], [10, 26], b"k", "t")) for i in range(260)}
    assert len(made) == 260


def test_scripts():
    for word in ("δοκιμή", "привет", "日本", "naïve", "ไทย", "हिन्दी", "ÉCOLE"):
        new = pii.shuffled(word, b"k", "t")
        assert len(new) == len(word) and new != word
        assert [pii._alphabet(c) for c in new] == [pii._alphabet(c) for c in word]


def parts(text):
    return re.sub(r"[^\w ]", "", text).split()


def test_names_agree_whatever_the_title():
    text = "Mr Smith met Dr Smith and Dr John Smith. Later Smith and John Smith left; SMITH came back to Smithville."
    new, kinds = pii.replace(text, KEY)
    words = parts(new)
    assert words[1] == words[4] == words[8] == words[10] == words[13] and words[7] == words[12] and words[15] == words[1].upper()
    assert words[-1] == "Smithville" and "Smith " not in new and kinds.count("given") == 2
    assert words[7].lower() in pii.GIVEN["m"].lower().split() and words[7] != "John"
    assert pii.surrogate("given", "maria", KEY) in pii.GIVEN["f"].lower().split()


def test_key_is_required(spark):
    docs = spark.createDataFrame([(1, "a@b.org")], "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(docs)
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        assert pii.pseudonymise(docs).first().text != "a@b.org"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_gender_comes_from_the_corpus(spark):
    """A name that no list holds has the gender that titles give it, in every document; a listed one can differ."""
    rows = [(1, "Frau Noorje Bakker"), (2, "Dr Noorje Bakker"), (3, "Mr Taiko Lund, Mr Taiko Lind"), (4, "Prof Taiko Lund"), (5, "Mrs Karl Stone"), (6, "Dr Xo Stone")]
    out = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert parts(out[1])[1:] == parts(out[2])[1:] and parts(out[1])[1].endswith("a")
    assert parts(out[3])[1:3] == parts(out[4])[1:] and parts(out[4])[1].endswith("o")
    assert parts(out[5])[1].endswith("a") and parts(out[6])[1].endswith("e") and parts(out[5])[2] == parts(out[6])[2]


def test_many_surnames(spark):
    """300,000 different surnames keep different surrogates, none of which is a real one."""
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu ra re ri ro ru sa se si so su ta te ti to tu va ve vi vo vu wa we wi".split()
    name = lambda n: "".join(syllables[n // 53**k % 53] for k in range(2 + (n >= 2809) + (n >= 148_877))).title()
    rows = [(i, "; ".join(f"Mr {name(100 * i + k)}" for k in range(100))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = pii.pseudonymise(docs, KEY)
    pairs = docs.join(out.select("doc_id", F.col("text").alias("new")), "doc_id").select(F.explode(F.arrays_zip(F.split("text", "; ").alias("old"), F.split("new", "; ").alias("new"))).alias("p")).select("p.*")
    pairs = pairs.persist()
    assert pairs.select("old").distinct().count() == pairs.select("new").distinct().count() == pairs.distinct().count()
    assert pairs.select("old").intersect(pairs.select("new")).count() == 0
    pairs.unpersist()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i} mail user{i % 40}@host{i % 7}.example.org from 10.0.{i % 4}.{i % 50} Mr. {'John' if i % 2 else 'Karl'} Name{chr(97 + i % 20)}", "en", ["old"], i) for i in range(300)]
    rows += [(1000, None, "en", [], 1), (1001, "", "en", [], 2), (None, "card 4111111111111111", "de", None, 3), (1002, "word " * 50_000 + "a@b.org", "en", None, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, pii_kinds array<string>, row int")


def test_distinct_over_the_corpus(spark, docs):
    out = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    assert len(out) == 304 and out[1000].text is None and out[1001].text == "" and out[1000].pii_kinds == []
    real, new = {}, {}
    for r in docs.collect():
        for (*_, k, w), (*_, k2, w2) in zip(pii.detect(r.text or ""), pii.detect(out[r.doc_id].text or ""), strict=True):
            assert k == k2 and w != w2
            assert real.setdefault((k, w), w2) == w2 and new.setdefault((k, w2), w) == w
    assert not {w for _, w in real} & {w for _, w in new}
    assert out[1002].text.startswith("word word")


def test_redraws_until_free(spark, docs, monkeypatch):
    """Surrogates of one letter's worth of names collide, and are drawn again; joined redraws give the same texts."""
    monkeypatch.setattr(pii, "LOOKED_UP", 1_000)
    plain = sorted(map(tuple, pii.pseudonymise(docs, KEY).select("doc_id", "text").collect()), key=str)
    monkeypatch.setattr(pii, "LOOKED_UP", -1)
    out = pii.pseudonymise(docs, KEY)
    assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == plain
    assert out.where("doc_id < 300 AND row <> doc_id").count() == 0


def test_empty(docs):
    out = pii.pseudonymise(docs.limit(0), KEY)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "row", "pii_kinds"]


def test_real_rows_leave_clean_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    new = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    for r in docs.collect():
        assert (new[r.doc_id].text == r.text) == (not pii.detect(r.text))
        assert not any(w in new[r.doc_id].text for *_, k, w in pii.detect(r.text) if k != "phone")
