"""Programs, jobs, specifications and value formats."""

import shutil

import pytest
from pyspark.sql import functions as F

from sluice.functions import values
from sluice.functions.keys import Partitioner
from sluice.operators import shuffle, stats
from sluice.plans import job
from sluice.plans.spec import JobSpec, Priority, parse, with_properties
from sluice.streaming import pipes


def lines(spark, *rows, n=2):
    return spark.createDataFrame([(r,) for r in rows], "value string").repartition(n)


def test_line_pipe_and_failure(spark):
    assert sorted(r.value for r in pipes.lines(lines(spark, "b", "a"), "tr a-z A-Z").collect()) == ["A", "B"]
    with pytest.raises(Exception, match="ended with 3"):
        pipes.lines(lines(spark, "a"), "exit 3").collect()


def test_ignored_failures(spark, tmp_path):
    """One reducer of four may fail; when more do, the job fails and leaves no output."""
    (tmp_path / "in.txt").write_text("".join(f"{i}\tx\n" for i in range(40)))
    base = dict(inputs=(f"file://{tmp_path}/in.txt",), mapper="cat", reduces=4, ignore_reduce_failures=1)
    jobs = job.Jobs(spark)
    one = jobs.submit(JobSpec(output=f"file://{tmp_path}/one", reducer='[ $mapred_task_partition = 2 ] && exit 1; cat', **base))
    kept = {int(r.value.split()[0]) for r in spark.read.text(f"{tmp_path}/one").collect()}
    assert jobs.status(one)["state"] == "completed" and kept == {i for i in range(40) if ((31 + ord(str(i)[0])) * (31 if i > 9 else 1) + (ord(str(i)[1]) if i > 9 else 0)) % 4 != 2}
    with pytest.raises(RuntimeError, match="4 reduce tasks failed; 1 may"):
        jobs.submit(JobSpec(output=f"file://{tmp_path}/all", reducer="exit 1", **base))
    assert jobs.list()[0].state == "failed" and [p.name for p in tmp_path.iterdir() if p.name.startswith("all")] == []


def test_output_of_a_failed_task_is_dropped_whole(spark, monkeypatch):
    monkeypatch.setattr(pipes, "SPOOL", 64)
    reports = pipes.Reports(spark.sparkContext)
    out = pipes.lines(lines(spark, *"abcdefgh", n=4), "seq 1 1000; grep -q a && exit 1; true", reports=reports, step="map", may_fail=True)
    assert out.count() == 3000 and reports.failures("map") == 1


def test_kill_before_start(spark, tmp_path):
    jobs = job.Jobs(spark)
    (tmp_path / "in.txt").write_text("a\n")
    with jobs.lock:
        one = jobs.submit(JobSpec(inputs=(f"file://{tmp_path}/in.txt",), output=f"file://{tmp_path}/k", mapper="cat", reduces=0), wait=False)
        jobs.held[one][0].state = "killed"
    assert jobs.wait(one).state == "killed" and not (tmp_path / "k").exists()


def test_commands(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\nb\n")
    jobs = job.Jobs(spark)
    one = jobs.command(["streaming", "-i", "-input", f"file://{tmp_path}/in.txt", "-output", f"file://{tmp_path}/c", "-mapper", "cat", "-reducer", "cat"])
    assert [s["state"] for s in jobs.command(["monitor", str(one)])][-1] == "completed"
    assert jobs.command(["list"]) == [] and [s.id for s in jobs.command(["list", "-a"])] == [one]
    assert jobs.command(["status", str(one)])["state"] == "completed"
    with pytest.raises(ValueError):
        jobs.command(["freeze", "1"])


def test_environment(spark):
    env = pipes.environment(name="n", extra={"USER_KEY": "u"})
    got = {r.value for r in pipes.lines(lines(spark, "x", n=1), 'echo "$mapred_job_name $USER_KEY $mapred_task_partition"', env).collect()}
    assert got == {"n u 0"}


def test_shipped_files_are_found_from_a_relative_folder(tmp_path, monkeypatch):
    """Executors of a cluster name their folder of files "."."""
    from pyspark import SparkFiles

    (tmp_path / "sent.txt").write_text("sent")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(SparkFiles, "_is_running_on_worker", True)
    monkeypatch.setattr(SparkFiles, "_root_directory", ".")
    assert list(pipes._run("cat sent.txt", {}, iter(()), pipes._lines, shipped={"sent.txt": "sent.txt"})) == ["sent"]


def test_jobs_ship_files_of_the_same_name(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x\n")
    for text in ("one", "two", "one"):
        at = tmp_path / f"{text} folder"
        at.mkdir(exist_ok=True)
        (at / "sent.txt").write_text(text)
        shutil.make_archive(str(at / "held"), "zip", at, "sent.txt")
        files = dict(files=(f"{at}/sent.txt",), archives=(f"{at}/held.zip#packed", f"{at}/held.zip"))
        rows = job.plan(spark, JobSpec(inputs=(f"file://{tmp_path}/in.txt",), output="none", mapper="cat sent.txt packed/sent.txt held.zip/sent.txt", reduces=0, **files))
        assert [r.value for r in rows.collect()] == [text * 3]


def test_pair_pipe(spark):
    rows = spark.createDataFrame([(b"k", b"a\nb\x00"), (b"", b"")], "key binary, value binary")
    assert {(bytes(r.key), bytes(r.value)) for r in pipes.pairs(rows, "cat").collect()} == {(b"k", b"a\nb\x00"), (b"", b"")}


def test_pairs_of_any_size(spark, monkeypatch):
    """Pairs that lie across blocks, pairs larger than a block, nulls, partitions without rows, and streams cut short."""
    import io

    import pyarrow as pa

    monkeypatch.setattr(pipes, "FRAMES", 64)
    rows = [(bytes([i % 256]) * (i % 40), bytes([i % 7]) * (i * i % 900)) for i in range(300)]
    batch = pa.record_batch([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["key", "value"])
    for part in (batch, batch.slice(17, 100), batch.slice(3, 0)):
        made = pipes.framed(part)
        assert made == b"".join(len(x).to_bytes(4, "little") + x for p in zip(*part.to_pydict().values(), strict=True) for x in p)
        assert [p for b in pipes.unframed(io.BytesIO(made)) for p in zip(*b.to_pydict().values(), strict=True)] == list(zip(*part.to_pydict().values(), strict=True))
    for cut, why in ((b"\1\0\0", "short"), (b"\1\0\0\0", "short"), (b"\1\0\0\0k", "without"), (b"\1\0\0\0k\2\0\0\0v", "short")):
        with pytest.raises(EOFError, match=why):
            list(pipes.unframed(io.BytesIO(cut)))
    with pytest.raises(ValueError, match="negative"):
        list(pipes.unframed(io.BytesIO(b"\1\0\0\0k\xff\xff\xff\xff")))
    held = spark.createDataFrame([(None, b"v"), (b"k", None)], "key binary, value binary")
    assert {(bytes(r.key), bytes(r.value)) for r in pipes.pairs(held, "cat").collect()} == {(b"", b"v"), (b"k", b"")}
    once = pipes.pairs(held.where("key = 'no'").repartition(3), "cat > /dev/null; printf '\\1\\0\\0\\0k\\0\\0\\0\\0'")
    assert [bytes(r.key) for r in once.collect()] == [b"k"] * once.rdd.getNumPartitions()


def test_counters(spark):
    rows = lines(spark, "reporter:counter:g:errors,2", "reporter:counter:errors,3", "reporter:counter:a,b,4", "reporter:counter:bad,x", "noise")
    assert {(r.counter, r.total) for r in stats.counters(rows).collect()} == {("errors", 5), ("a,b", 4)}


def test_route(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "v int, reduce_no int")
    placed = shuffle.route(rows, 3).withColumn("p", F.spark_partition_id()).collect()
    assert all(r.p == r.reduce_no for r in placed)
    bad = rows.union(spark.createDataFrame([(99, -1)], "v int, reduce_no int"))
    with pytest.raises(Exception, match="negative partition"):
        shuffle.route(bad, 3).collect()
    assert shuffle.route(bad, 3, negative="drop").count() == 30


def test_secondary_sort_has_one_exchange(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 2), ("a", 1)], "k string, v int")
    assert shuffle.secondary_sort(rows, ["k"], ["v"], 3)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in shuffle.secondary_sort(rows, ["k"], ["v"], 1).collect()] == [("a", 1), ("a", 2), ("b", 2)]


def test_job_runs_and_control(spark, tmp_path):
    (tmp_path / "in.txt").write_text("".join(f"k{i % 5}\t{i}\n" for i in range(100)) + "\n")
    spec = JobSpec(inputs=(f"file://{tmp_path}/in.txt",), output=f"file://{tmp_path}/out", mapper="cat", reducer="cut -f1 | uniq -c | awk '{print $2\"\\t\"$1}'", reduces=3, priority=Priority.HIGH)
    jobs = job.Jobs(spark)
    one = jobs.submit(spec)
    assert jobs.status(one)["state"] == "completed" and jobs.list()[0].id == one
    assert {r.value for r in spark.read.text(f"{tmp_path}/out").collect()} == {f"k{i}\t20" for i in range(5)}
    with pytest.raises(RuntimeError, match="exists"):
        jobs.submit(spec)
    map_only = JobSpec(inputs=spec.inputs, output=f"file://{tmp_path}/m", mapper="grep k1", reduces=0)
    assert "Exchange" not in job.plan(spark, map_only)._jdf.queryExecution().executedPlan().toString()


def test_spec():
    spec = parse(["streaming", "-input", "a", "-input", "b", "-output", "o", "-mapper", "cat", "-reducer", "wc", "-partitioner", "IntHash", "-D", "mapred.reduce.tasks=7,mapred.job.priority=very-high,mapred.job.memory.limit=2G", "-cmdenv", "A=1"])
    assert spec.inputs == ("a", "b") and spec.reduces == 7 and spec.memory == 2 << 30 and spec.partitioner is Partitioner.INT_HASH and spec.priority is Priority.VERY_HIGH
    with pytest.raises(ValueError, match="reducer"):
        JobSpec(inputs=("a",), output="o", mapper="m").check()
    with pytest.warns(UserWarning):
        with_properties(spec, "mapred.map.tasks=3")
    with pytest.raises(ValueError):
        with_properties(spec, "no.such=1")


def test_values():
    assert values.size_of("512M") == 512 << 20 and values.size_of("4k") == 4096 and values.switch("Yes") and not values.switch("off")
    assert [values.duration(s) for s in (3723, 5, 0, 60, 61, 3600, 3660, 7261)] == ["1 hours, 2 mins, 3 sec; 3723", "5 sec; 5", "; 0", "; 60", "1 mins, 1 sec; 61", "; 3600", "1 hours, ; 3660", "2 hours, 1 mins, 1 sec; 7261"]
    assert values.address("hdfs://h:9/x") == ("h", 9, "/x") and values.address("/x") == ("", 54310, "/x")
    assert values.table(["a", "b"], [["x" * 100, ""]]).splitlines()[2] == "x" * 80 + "  -"
    for bad in ("1X", "", "-1"):
        with pytest.raises(ValueError):
            values.size_of(bad)
    with pytest.raises(ValueError):
        values.switch("maybe")


def test_percentiles_and_time(spark):
    rows = spark.createDataFrame([("a", i) for i in range(1000)] + [("b", 1), ("b", None), ("c", 7), ("c", 7)], "k string, v long")
    got = {r.k: r for r in stats.durations(rows, ["k"], "v").collect()}
    assert (got["a"].p90, got["a"].p99, got["a"].p999, got["a"].p9999, got["a"].longest, got["a"].below_mean) == (900, 990, 999, 999, 999, 499)
    assert got["a"]["mean"] == 499 and got["b"].p90 == 1 and (got["c"].p9999, got["c"].below_mean) == (7, 0)
    # 10 tasks of 20 s on average, 2 done, 2 running for 5 s, 1 failed: (200 - 40 - 10) / (2 / 3) / 2
    assert stats.time_to_go([15, 25], [5, 5], 10, failed=1) == 112
    assert stats.time_to_go([], [5], 10) is None and stats.time_to_go([10], [], 1) is None and stats.time_to_go([10], [], 3) == 20
