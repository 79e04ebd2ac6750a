"""Repeated spans against brute force, and edge cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import paragraph_dedup as pd
from sluice.plans import scratch


def shared(rows, n=50):
    """Documents that share n words in a row with another."""
    first, out = {}, set()
    for i, t in rows:
        w = (t or "").lower().split()
        for k in range(len(w) - n + 1):
            h = tuple(w[k : k + n])
            if first.setdefault(h, i) != i:
                out |= {i, first[h]}
    return out


def planted(seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 7)))
    words = lambda n: " ".join(word() for _ in range(n))
    passages = [words(55) for _ in range(6)]
    rows = []
    for i in range(200):
        text = words(draw.randrange(5, 120)) + draw.choice([". ", "\n"]) + words(30)
        if i % 4 == 0:
            text += " " + passages[i % 6] + " " + words(draw.randrange(0, 40))
        rows.append((i, text))
    base = [word() for _ in range(40)]
    for i in range(200, 206):  # near copies of a paragraph within other text
        own = list(base)
        if i > 200:
            own[draw.randrange(40)] = word()
        rows.append((i, words(25) + "\n" + " ".join(own)))
    return rows, passages


def test_planted(spark):
    rows, passages = planted()
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, first int, key string").repartition(4)
    spans = pd.repeats(docs)
    got = spans.collect()
    texts = dict(rows)
    assert shared(rows) <= {r.doc_id for r in got}
    assert {r.doc_id for r in got} == {i for i in texts if (i < 200 and i % 4 == 0) or i >= 200}
    for r in got:
        span = texts[r.doc_id][r.first : r.end]
        assert len(span.split()) == r.n_words and r.n_words >= 20
        if r.doc_id < 200:  # the whole passage, and what happens to agree beside it
            assert passages[r.doc_id % 6] in span and r.n_words <= 58
    heads = defaultdict(set)
    for r in got:
        if r.kept:
            heads[r.head_doc].add(r.doc_id)
        assert r.head_doc <= r.doc_id
    assert all(v == {k} for k, v in heads.items())
    left = {r.doc_id: r.text for r in pd.without_repeats(docs, spans).collect()}
    assert len(left) == len(rows) and all(left[i] == t for i, t in rows if i < 200 and i % 4)
    assert sum(len(t) for t in left.values()) < sum(len(t) for t in texts.values())


def alike(rows):
    """Components of lines of 20 words or more with 100 * intersection >= 75 * union of their five-word shingles."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in rows)]
    holds, to = defaultdict(list), list(range(len(rows)))

    def root(x):
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    links = 0
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in holds[g]:
                both[j] += 1
            holds[g].append(i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links += 1
                a, b = sorted((root(i), root(j)))
                to[b] = a
    return [root(i) for i in range(len(rows))], links


def templates(shared_words, own_words, n=1500, pairs=250, seed=3):
    """Paragraphs that share a template, with some near copies of others planted among them."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghijklm") for _ in range(6))
    base = [word() for _ in range(shared_words)]
    rows = [[*base, *(word() for _ in range(own_words))] for _ in range(n)]
    for i in range(pairs):
        own = list(rows[i])
        own[-2 - (i % 2)] = word()
        rows.append(own)
    draw.shuffle(rows)
    return [" ".join(r) for r in rows]


@pytest.mark.parametrize(("shared_words", "own_words"), [(30, 10), (24, 14)])
def test_likeness_against_all_pairs(spark, shared_words, own_words):
    rows = templates(shared_words, own_words)
    hub = "h" + " h".join(map(str, range(80)))
    draw = random.Random(9)
    for k in range(120):  # copies that only the middle one links
        own = hub.split()
        for _ in range(2):
            own[draw.randrange(80)] = f"x{k}{draw.random()}"
        rows.append(hub if k == 60 else " ".join(own))
    group, links = alike(rows)
    sizes = Counter(group)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    docs = docs.select("doc_id", F.concat(F.lit("a title "), F.col("doc_id").cast("string"), F.lit("\n\n"), "text").alias("text"))
    units = docs.mapInArrow(pd._units, f"doc_id long, {pd.UNITS}").where("NOT run")
    first = pd._distinct(scratch.keep(units, "units"))
    bands = pd._bands(first)
    places = first.select("doc_id", F.array(F.struct("word", "n_words", "key", F.lit(False).alias("run"), F.col("doc_id").alias("head_doc"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("n"))).alias("places"))
    closer = docs.join(places, "doc_id").mapInArrow(pd._closer, pd._closer_schema("long"))
    groups = pd._components(first, bands, closer.select(F.col("key").alias("node"), "shingles"))
    named = groups.join(first.select(F.col("key").alias("node"), "doc_id"), "node")
    got = {r.doc_id: r.component for r in named.collect()}
    together = sum(got.get(i, -i) == got.get(g, -g) for i, g in enumerate(group) if sizes[g] > 1)
    assert links > 300 and together >= 0.99 * sum(n for n in sizes.values() if n > 1)
    # nothing is joined that brute force holds apart
    whole = defaultdict(set)
    for i, c in got.items():
        whole[c].add(group[i])
    assert all(len(x) == 1 for x in whole.values())


def test_wrapped_lines_are_one_paragraph(spark):
    words = [f"w{k}" for k in range(60)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    other = [*words[:20], "new", *words[21:]]
    docs = spark.createDataFrame([(1, wrap(words, 10)), (2, "A title\n\n" + wrap(other, 12)), (3, wrap([f"v{k}" for k in range(60)], 10))], "doc_id long, text string")
    assert {r.doc_id for r in pd.repeats(docs).collect()} == {1, 2}


def test_hot_runs_and_paragraphs(spark):
    draw = random.Random(5)
    line = " ".join(f"licence{k}" for k in range(60))
    rows = [(i, " ".join(str(draw.random()) for _ in range(30)) + "\n" + line) for i in range(12_000)]
    got = pd.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    got = scratch.keep(got, "got")  # seeds that few documents keep have spans of their own, within the line
    assert got.where("head_doc = 0 AND n_words = 60").count() == got.select("doc_id").distinct().count() == 12_000


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert shared(rows) <= {r.doc_id for r in pd.repeats(docs).collect()}


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "short"), (None, long), (4, "é " * 10), (5, long), (6, long), (6, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pd.repeats(docs).collect()
    assert {r.doc_id for r in got} == {5, 6} and all(r.head_doc == 5 for r in got)
    assert pd.repeats(docs.limit(0)).count() == 0
    assert pd.repeats(docs.where("doc_id < 5")).count() == 0


def test_passages_grow_at_their_ends_only(spark, monkeypatch):
    """A row or two a copied passage are grown, and the spans are those of seeds that all grow by themselves."""
    draw = random.Random(11)
    words = lambda n: [f"u{draw.random()}" for _ in range(n)]
    base, rows = words(400), []
    rows.append((0, words(20) + base + words(20)))
    for i in range(1, 25):
        a, b = sorted(draw.sample(range(0, 401, 25), 2))
        own = base[a:b]
        for k in range(i % 4):
            own[draw.randrange(len(own))] = f"change{i}-{k}"
        rows.append((i, words(draw.randrange(30)) + own + words(draw.randrange(30))))
    rows += [(30, words(40) + base[:120]), (30, base[100:260] + words(9)), (31, base[5:90]), (31, base[5:90])]
    twice = words(90)
    rows += [(32, twice + words(7) + twice), (33, twice[10:80]), (34, words(60)), (34, rows[-1][1])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    units = scratch.keep(docs.mapInArrow(pd._units, f"doc_id long, {pd.UNITS}").where("run"), "units")
    seeds = pd._headed(units.select("doc_id", "own", "word", "key"), "key", 2)
    whole = pd._chains(seeds.where("doc_id BETWEEN 1 AND 24 AND doc_id % 4 = 0")).groupBy("doc_id").count().collect()
    # a second one where a seed at the end of a copy is first kept in another copy
    assert len(whole) == 6 and all(r["count"] <= 2 for r in whole)
    got = sorted(map(tuple, pd.repeats(docs).collect()))
    monkeypatch.setattr(pd, "STEP", -1)
    assert got == sorted(map(tuple, pd.repeats(docs).collect())) and len(got) > 30


def test_texts_that_repeat_within_themselves(spark):
    """Rows of a stretch that repeats do not grow with its length, and it is one span to its last word."""
    draw = random.Random(13)
    words = lambda n: [f"u{draw.random()}" for _ in range(n)]
    rows, stretch = [], {}
    for i in range(40):
        period = [f"p{i % 4}-{k}" for k in range((2, 7, 24, 25)[i % 4])]
        stretch[i] = (period * 1500)[: 600 + 23 * i]
        rows.append((i, " ".join(words(20) + stretch[i] + words(20))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    units = scratch.keep(docs.mapInArrow(pd._units, f"doc_id long, {pd.UNITS}").where("run"), "units")
    seeds = pd._headed(units.select("doc_id", "own", "word", "key"), "key", 2)
    assert max(r["count"] for r in pd._chains(seeds).groupBy("doc_id").count().collect()) <= 40
    got = pd.repeats(docs).collect()
    # a seed over the end of a stretch may have another head
    texts, others = dict(rows), [r for r in got if not r.kept and r.head_doc == r.doc_id % 4]
    assert sorted(r.doc_id for r in others) == list(range(40))
    for r in others:
        span = texts[r.doc_id][r.first : r.end].split()
        # the head's own first run is kept, the runs after it are not
        inside = stretch[r.doc_id][-len(span) :] if r.doc_id == r.head_doc else stretch[r.doc_id]
        assert span == inside and r.n_words == len(span) >= len(stretch[r.doc_id]) - 30
