"""Near-dedup against brute force, and its edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.llm import near_dedup
from sluice.llm.components import connected

COLUMNS = "doc_id long, text string, lang string, component_id string, sig string"


def brute(rows):
    """doc_id -> (n_shingles, component_id, kept)."""
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def planted(seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 7)))
    rows, i = [], 0
    for group in range(30):
        base = [word() for _ in range(draw.randrange(3, 160))]
        for _ in range(draw.choice([1, 1, 2, 3, 12])):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                own[draw.randrange(len(own))] = word()
            rows.append((i, " ".join(own).upper() if group % 7 == 0 else "\n".join(own)))
            i += 1
    common = " ".join(word() for _ in range(40))
    for _ in range(100):  # one passage that many share, in texts that differ
        rows.append((i, " ".join(word() for _ in range(60)) + " " + common))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "one two"), (i + 4, "ONE two"), (i + 5, "é " * 30), (i + 6, "x " * 40_000)]
    draw.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], COLUMNS).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_real_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hot_groups(spark):
    """Many near copies: regions deepen, and all stay in one component."""
    draw = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(400):
        own = list(base)
        own[draw.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df)
    assert got.where("component_id = 0").count() == 700 and got.where("kept").count() == 1


def test_edges(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.where("doc_id = 9").count() == 0 and kept.columns == ["doc_id", "text"]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert connected(links.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["LocalCheckpoint", "Cartesian"])
def test_plan_has_no(spark, small, name):
    out = near_dedup.near_duplicates(spark.read.parquet(f"{small}/documents.parquet").where(F.col("doc_id") < 20))
    assert name not in out._jdf.queryExecution().executedPlan().toString()


def hub(copies, edits=9, seed=9):
    """Copies that all link to one text, whose id is in the middle, and mostly not to each other."""
    draw = random.Random(seed)
    base = [f"w{k}" for k in range(404)]
    rows = []
    for i in range(copies):
        own = list(base)
        for at in draw.sample(range(404), edits):
            own[at] = f"z{draw.random()}"
        rows.append((i if i < copies // 2 else i + 1, " ".join(own)))
    return [*rows, (copies // 2, " ".join(base))]


@pytest.mark.parametrize("copies", [50, 400])
def test_hub_and_spokes(spark, copies):
    rows = hub(copies)
    want = brute(rows)
    assert {c for _, c, _ in want.values()} == {0}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_long_chain_in_random_order(spark):
    """Windows over one text, each like the next only: one component, whatever the order of ids."""
    draw = random.Random(11)
    words = [f"w{k}" for k in range(5200)]
    ids = list(range(500))
    draw.shuffle(ids)
    rows = [(i, " ".join(words[10 * k : 10 * k + 84])) for k, i in enumerate(ids)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_families_of_thousands_against_brute_force(spark):
    """12,000 texts: templates whose texts nearly link, a hub that alone links its copies, and chains, in one table."""
    draw = random.Random(12)
    word = lambda: f"{draw.randrange(10**9):x}"
    texts = []
    for own in (16, 18, 20):  # a common part of 60 words: likeness of about 0.64, 0.61 and 0.58
        base = [word() for _ in range(60)]
        family = [" ".join([*base, *(word() for _ in range(own))]) for _ in range(900)]
        texts += family + [f"{t} {word()}" for t in family[:150]]
    hub = [word() for _ in range(400)]
    for _ in range(1000):
        copy = list(hub)
        for _ in range(9):
            copy[draw.randrange(400)] = word()
        texts.append(" ".join(copy))
    texts.insert(len(texts) // 2, " ".join(hub))
    texts += [" ".join(word() for _ in range(60)) for _ in range(7500)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    wrong = [i for i in got if got[i] != want[i]]
    assert len(wrong) <= 0.001 * len(rows), len(wrong)


def test_stragglers_of_a_large_component_make_few_pairs(spark, monkeypatch):
    """They join by neighbours, before all pairs of different components are made."""
    held, apart = 2000, 40
    ids = spark.range(held + apart)
    sets = ids.select(F.col("id").alias("node"), F.concat(F.sequence(F.lit(1), F.lit(60)), F.array(F.col("id") + 1000)).alias("shingles"))
    table = ids.select(F.col("id").alias("doc_id"), F.array(F.lit(1)).alias("sig"), F.lit(61).alias("n_shingles"))
    links = ids.where(F.col("id").between(1, held - 1)).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    pairs, real = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda more, of: (pairs.append(more.count()), real(more, of))[1])
    got = near_dedup.settled(links, links, ids.select(F.lit(1).alias("band"), F.col("id").alias("node")), table, lambda _: sets)
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(held + apart)}
    assert sum(pairs) < held * apart / 4
