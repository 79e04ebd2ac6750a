"""The multi-index against brute force, and its edge cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import ann


def brute(ids, rows, k=20, every=20):
    out = {}
    for q, i in enumerate(ids):
        if i % every == 0:
            scores = (rows * rows[q]).sum(1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), scores[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(ann.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(want, got):
    hits = sum(len({i for i, _ in w} & {i for i, _ in got.get(q, [])}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_real_rows(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64))
    got = found(spark.read.parquet(f"{small}/embeddings.parquet"))
    assert set(got) == set(want) and recall(want, got) >= 0.9
    exact = {(q, i): s for q, w in brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), k=499).items() for i, s in w}
    assert all(exact[q, i] == pytest.approx(s, abs=1e-12) for q, g in got.items() for i, s in g)


def test_clusters_and_hot_vector(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 10))
    rows = centres[draw.integers(0, 12, 3000)] + 0.05 * draw.normal(size=(3000, 10))
    rows[::3] = rows[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, rank int").repartition(6)
    want, got = brute(np.arange(3000), rows), found(df)
    assert recall(want, got) >= 0.9
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]  # ties go to the smallest ids


def test_edges(spark):
    odd = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, [1.0]), (None, [1.0, 1.0]), (120, [None, 1.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    assert found(df) == {0: [(3, 0.5), (4, 0.5)]}
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 20")).count() == 0
    assert ann.search(df.where("vec_id = 0")).count() == 0


@given(st.lists(st.floats(-5, 5, allow_nan=False), min_size=1, max_size=6), st.lists(st.floats(-5, 5, allow_nan=False), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_walk_is_in_order_and_whole(a, b):
    index = ann.Index((np.zeros((len(a), 1)), np.zeros((len(b), 1))))
    cells = list(index.walk(np.array(a), np.array(b)))
    sums = [a[c // len(b)] + b[c % len(b)] for c in cells]
    assert sorted(cells) == list(range(len(a) * len(b))) and all(x >= y - 1e-9 for x, y in zip(sums, sums[1:], strict=False))


def test_blocks_are_bounded():
    index = ann.Index((np.zeros((4, 1)), np.zeros((4, 1))))
    counts = np.array([5, 900, 3, 0, 40, 60, 70, 1, 1, 1, 500, 9, 9, 9, 9, 9])
    index.hold(counts, 100)
    load = np.zeros(index.blocks + 1)
    for c, n in enumerate(counts):
        for k in range(index.split[c]):
            load[index.base[c] + k] += n / index.split[c]
    assert load.max() <= 100 and load.sum() == counts.sum()
