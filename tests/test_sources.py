"""Sources, sinks and sorted tables."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.sources import readers, sorted_kv, writers


@pytest.mark.parametrize("size", [12_580, 45_678, 10_000_000])
def test_every_line_once_at_any_split(spark, tmp_path, size):
    draw = random.Random(5)
    lines = [f"key_{i}:" + "x" * draw.randrange(200) for i in range(3000)]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    own = readers.with_split_size(spark, size)
    assert sorted(r.value for r in readers.text(own, f"file://{tmp_path}/in.txt").collect()) == sorted(lines)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_lines_end_at_newlines_only(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\r\nb\rc\n\nlast")
    assert [r.value for r in readers.text(spark, f"file://{tmp_path}/a.txt").collect()] == ["a\r", "b\rc", "", "last"]
    assert readers.text(spark, f"file://{tmp_path}/a.txt", keep_empty=False).count() == 3


def test_globs_and_hidden_files(spark, tmp_path):
    for n in ("a1", "a2", "b1", "_x", ".y"):
        (tmp_path / n).write_text(n + "\n")
    got = lambda p: sorted(r.value for r in readers.text(spark, f"file://{tmp_path}{p}").collect())
    assert got("/a?") == ["a1", "a2"] and got("/{a1,b1}") == ["a1", "b1"] and got("") == ["a1", "a2", "b1"]
    with pytest.raises(ValueError):
        readers.text(spark, "x.lzo")


def test_formats():
    assert readers.InputFormat.named("TextInputFormat") is readers.InputFormat.TEXT
    assert writers.OutputFormat.named("SuffixMultipleTextOutputFormat") is writers.OutputFormat.SUFFIX
    with pytest.raises(ValueError):
        readers.InputFormat.named("x")


def test_sequence_file_and_binary_lines(spark, tmp_path):
    pairs = spark.createDataFrame([(b"\x00k", b"\xffv"), (b"", b"")], "key binary, value binary")
    writers.sequence_file(pairs, f"file://{tmp_path}/s")
    got = {(bytes(r.key), bytes(r.value)) for r in readers.read(spark, readers.InputFormat.SEQUENCE, f"file://{tmp_path}/s").collect()}
    assert got == {(b"\x00k", b"\xffv"), (b"", b"")}
    writers.write(spark.createDataFrame([("l",)], "value string"), writers.OutputFormat.BINARY, f"file://{tmp_path}/b")
    assert bytes(readers.sequence_file(spark, f"file://{tmp_path}/b").first().value) == b"l\n"


def test_suffix_sink(spark, tmp_path):
    lines = spark.createDataFrame([("one#A",), ("two#B",), ("three#A",), ("lost",), ("Z",)], "value string")
    writers.suffix_files(lines, f"file://{tmp_path}/m")
    got = sorted((r.suffix, r.value) for r in spark.read.text(f"file://{tmp_path}/m").collect())
    assert got == [("A", "one"), ("A", "three"), ("B", "two")]


def test_output_must_be_new(spark, tmp_path):
    lines = spark.createDataFrame([("a",)], "value string")
    writers.text(lines, f"file://{tmp_path}/o", gzip=True)
    assert readers.text(spark, f"file://{tmp_path}/o").first().value == "a"
    with pytest.raises(Exception, match="already exists"):
        writers.text(lines, f"file://{tmp_path}/o")


def test_nline_and_pairs(spark, tmp_path):
    (tmp_path / "n.txt").write_text("u1\nu2\nu3\n")
    rows = readers.nline(spark, f"file://{tmp_path}/n.txt")
    assert sorted(r.value for r in rows.collect()) == ["0\tu1", "0\tu2", "0\tu3"] and rows.rdd.getNumPartitions() == 3
    assert {r.key for r in readers.text_pairs(spark, f"file://{tmp_path}/n.txt").collect()} == {"0"}


def kv(spark, n, path):
    sorted_kv.write(spark.range(1, n + 1).select(F.format_string("key_%09d", "id").alias("key"), F.format_string("value_%d", F.col("id") * 2).alias("value")), path, 3)


def test_sorted_ranges(spark, tmp_path):
    at = f"file://{tmp_path}/kv"
    kv(spark, 2500, at)
    n = lambda a="", b="": sorted_kv.scan(spark, at, a, b).count()
    assert n("key_000000123", "key_000001123") == 1000 and n() == 2500 and n("a", "b") == 0
    assert n("a", "key_000000012") == 11 and n("key_000002499") == 2 and n("key_000002501") == 0
    with pytest.raises(ValueError):
        n("key_000000251", "key_000000250")
    plan = sorted_kv.scan(spark, at, "key_000000123", "key_000001123")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key" in plan


def test_equal_keys_and_seek(spark, tmp_path):
    at = f"file://{tmp_path}/same"
    sorted_kv.write(spark.range(1000).select(F.lit("key_999").alias("key"), F.col("id").cast("string").alias("value")).union(spark.createDataFrame([("abc", "v")], "key string, value string")), at)
    assert sorted_kv.scan(spark, at, "key_999", "key_999z").count() == 1000
    keys = spark.createDataFrame([("abc",), ("nope",)], "key string")
    assert {(r.key, r.value) for r in sorted_kv.seek(spark.read.parquet(at), keys).collect()} == {("abc", "v"), ("nope", "NOT_FOUND")}


def test_merge_counts(spark, tmp_path):
    base = spark.range(1, 7501).select("id", F.format_string("key_%09d", "id").alias("key"), F.lit("v").alias("value"))
    paths = []
    for name, where in (("e", "id % 2 = 0"), ("o", "id % 2 = 1"), ("t", "id % 3 = 0")):
        paths.append(f"file://{tmp_path}/{name}")
        sorted_kv.write(base.where(where).select("key", "value"), paths[-1], 2)
    merged = [r.key for r in sorted_kv.merge(spark, paths).collect()]
    assert len(merged) == 10_000 and merged == sorted(merged)
    assert len(sorted_kv.scan(spark, paths, "key_000000100", "key_000000200").collect()) == 133


def test_files_below_the_split_size_are_one_range(spark, small, tmp_path, monkeypatch):
    """Whatever the session's split size and cores are, and however large the table is."""
    from sluice.plans import registry

    customers = spark.read.parquet(f"{small}/customer.parquet").select("c_name").crossJoin(spark.range(20))
    customers.coalesce(1).select(F.concat("c_name", F.lit("#"), F.col("id").cast("string")).alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(registry, "RANGE", 1 << 12)
    got = registry.text_as_pairs(readers.with_split_size(spark, 1000, least=1000), str(tmp_path))
    lines = sorted((r.key, r.value) for r in got.collect())
    assert lines == sorted(("0", r.c_name) for r in spark.read.parquet(f"{tmp_path}/customer.parquet").collect())
    assert len(got.inputFiles()) > 1
