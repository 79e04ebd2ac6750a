"""Key extraction and partition numbers, against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyarrow as pa
from sluice.functions import keys


def plain_hash(s):
    if not s:
        return 0
    h = 1
    for b in s.encode():
        h = (31 * h + (b - 256 if b > 127 else b)) & 0xFFFFFFFF
    return h & 0x7FFFFFFF


def plain_fields(line, n, chars):
    cuts = [m.start() for m in re.finditer(f"[{re.escape(chars)}]", line)]
    if len(cuts) >= n:
        if cuts[n - 1] != len(line) - 0 and n - 1 < len(cuts):
            return line[: cuts[n - 1]]
    return line[:-1] if line and line[-1] in chars else line


@given(st.lists(st.text(max_size=30), max_size=20))
@settings(max_examples=60, deadline=None)
def test_hash_array(texts):
    assert keys.hash_array(pa.array(texts, pa.string())).to_pylist() == [plain_hash(t) for t in texts]


def test_hash_array_nulls_and_slices():
    a = pa.array(["x", None, "", "été", "a\tb"])
    assert keys.hash_array(a).to_pylist() == [plain_hash("x"), None, 0, plain_hash("été"), plain_hash("a\tb")]
    assert keys.hash_array(a.slice(3)).to_pylist() == [plain_hash("été"), plain_hash("a\tb")]


def test_hash_column_and_native(spark):
    texts = ["", "a", "abc", "été", "日本", "a\tb", "x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", keys.hash_code(F.col("s")).alias("h"), keys.hash_code_native(F.col("s")).alias("n")).collect()
    assert all(r.h == r.n == plain_hash(r.s) for r in rows)


KEY_FIELD = [
    ("abc 555 zzzzz", " ", 2, 1, 10, "abc 555", "abc"),
    ("sjy", " ", 2, 1, 10, "sjy", "sjy"),
    ("", " ", 2, 1, 10, "", ""),
    ("k1\tk2", "\t", 3, 1, 100, "k1\tk2", "k1"),
    ("k1\tk2", "", 0, 0, 100, "k1", "k1"),
]


@pytest.mark.parametrize("line,sep,kf,pf,total,key,hashed", KEY_FIELD)
def test_key_field(spark, line, sep, kf, pf, total, key, hashed):
    k, n = keys.key_field(F.col("line"), total, sep, kf, pf)
    row = spark.createDataFrame([(line,)], "line string").select(k.alias("k"), n.alias("n")).first()
    assert (row.k, row.n) == (key, plain_hash(hashed) % total)


@pytest.mark.parametrize("line,total,key,number", [
    ("17 key_123 value456", 100, "key_123", 17),
    ("-1 key_123 value456", 200, "key_123", -1),
    ("", 200, "", 0),
    ("123 ", 200, "", 123),
    ("123 aaaaaaaaaaaaazzzzzzzz", 200, "aaaaaaaaaaaaazzzzzzzz", 123),
    ("abc", 200, "abc", plain_hash("abc") % 200),
    ("x7 k", 200, "k", 0),
])
def test_int_hash(spark, line, total, key, number):
    k, n = keys.int_hash(F.col("line"), total, " ")
    row = spark.createDataFrame([(line,)], "line string").select(k.alias("k"), n.alias("n")).first()
    assert (row.k, row.n) == (key, number)


def test_first_fields_fuzz(spark):
    import random

    draw = random.Random(3)
    lines = ["".join(draw.choice("ab\t ,") for _ in range(draw.randrange(9))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for chars in ("\t", "\t ", ","):
        for n in (1, 2, 3):
            got = [r.k for r in df.select(keys.first_fields(F.col("line"), n, chars).alias("k")).collect()]
            assert got == [plain_fields(x, n, chars) for x in lines]


def test_partitioner_names():
    assert keys.Partitioner.named("IntHash") is keys.Partitioner.INT_HASH
    assert keys.Partitioner.named("whatever") is keys.Partitioner.KEY_FIELD
