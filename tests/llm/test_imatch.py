"""I-Match against a plain version of its contract, and its edge cases."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from sluice.llm import imatch

SCHEMA = "doc_id long, text string, place int, term string, mask long"


def check(rows, got):
    """Sizes and edited texts, given rows in their order."""
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t)
        edited = t[: n - n // 4] + following[: n // 4]
        assert (by[i].n_chars, by[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())


@pytest.fixture(scope="module")
def result(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return docs.collect(), imatch.fingerprints(docs).collect()


def test_contract(result):
    docs, got = result
    check(sorted((r.doc_id, r.text) for r in docs), got)


def words(text):
    return {w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def parts(text, slots):
    """The distinct lexicon terms of each subset, or all terms where no subset holds any."""
    held = [set() for _ in range(imatch.SUBSETS)]
    for w in words(text):
        for j in slots.get(w, ()):
            held[j].add(w)
    return [frozenset(x) for x in held] if any(held) else [frozenset(words(text))]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if len(a) < imatch.SUBSETS or len(b) < imatch.SUBSETS:
        return 0.0
    best = 0.0
    for k in range(len(imatch.LEVELS)):
        pairs = [(x, y) for x, y in zip(a[k * 10 : k * 10 + 10], b[k * 10 : k * 10 + 10], strict=True) if x or y]
        if len(pairs) >= 4:
            best = max(best, sum(x == y for x, y in pairs) / len(pairs))
    return best


def test_against_plain_imatch(spark, result):
    """Fingerprints name the sets of terms in each subset, and likenesses are shares of equal ones."""
    docs, got = result
    rows = sorted((r.doc_id, r.text or "") for r in docs)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(w,) for w in set().union(*(words(t) for _, t in rows))], "word string").select("word", F.xxhash64("word").alias("term"))
    slots = {}
    for r in imatch.lexicon(table, len(rows)).join(known, "term").collect():
        slots.setdefault(r.word, set()).add(r.slot)
    by, name_of, set_of = {r.doc_id: r for r in got}, {}, {}
    own = {i: parts(t, slots) for i, t in rows}
    for k, (i, t) in enumerate(rows):
        j, following = rows[(k + 1) % len(rows)]
        edited = parts(t[: len(t) - len(t) // 4] + following[: len(t) // 4], slots)
        for held, names in ((own[i], by[i].fingerprint.split(".")), (edited, by[i].edited_fingerprint.split("."))):
            assert len(held) == len(names)
            for n, (terms, name) in enumerate(zip(held, names, strict=True)):
                place = n if len(held) > 1 else -1
                assert name_of.setdefault((place, terms), name) == name and set_of.setdefault((place, name), terms) == terms
        assert by[i].near_edited == pytest.approx(plain_likeness(own[i], edited))
        assert by[i].near_next == pytest.approx(plain_likeness(own[i], own[j]))


def test_a_shuffled_lexicon_gives_the_same(spark, small, result, monkeypatch):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", -1)
    monkeypatch.setattr(imatch, "COMMON", 0.05)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert sorted(imatch.fingerprints(docs).collect()) == sorted(result[1])


def test_likeness_separates(result):
    _, got = result
    edited, following = (sorted(getattr(r, c) for r in got) for c in ("near_edited", "near_next"))
    assert all(0 <= x <= 1 for x in edited + following)
    assert edited[len(edited) // 2] >= 0.25 and sum(following) / len(following) < 0.05


def test_equal_texts_equal_fingerprints(result):
    docs, got = result
    texts = {r.doc_id: r.text for r in docs}
    seen = {}
    for r in got:
        assert seen.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_edges(spark):
    rows = [(i, f"alpha beta w{i} w{i + 1} gamma{i % 3} " * 3) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "é日本 word"), (10**12, "far " * 30), (10**12 + 1, "x")]
    df = spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA).repartition(3)
    got = imatch.fingerprints(df).collect()
    check(rows, got)
    by = {r.doc_id: r for r in got}
    assert by[50].fingerprint == by[51].fingerprint and by[50].near_next == 1.0
    one = imatch.fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).collect()
    check([(1, "abcd efgh")], one)
    assert imatch.fingerprints(df.limit(0)).count() == 0


def test_ties_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "n"), (None, "n"), (2, "z")]
    got = imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and sum(r.doc_id is None for r in got) == 2
    assert {r.n_chars for r in got if r.doc_id is None} == {1}


def test_plan_is_native_and_moves_texts_once(spark, small):
    plan = imatch.fingerprints(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "Cartesian"))
    assert plan.count("Exchange hashpartitioning(bucket") == 2  # the texts, and the first id of each bucket


def test_lexicon_band(spark):
    docs = spark.createDataFrame([(i, "every " + f"few{i // 2} one{i}") for i in range(20)], "doc_id long, text string")
    n = lambda low, high: imatch.lexicon(docs, 20, low, high).select("term").distinct().count()
    assert n(0.0, 1.0) == 31 and n(0.0, 0.5) == 30 and n(0.1, 0.5) == 10
    slots = [r.slot for r in imatch.lexicon(docs, 20, 0.0, 1.0).collect()]
    assert 31 <= len(slots) <= 60 and all(0 <= s < imatch.SUBSETS for s in slots) and sum(s < imatch.EACH for s in slots) == 31
