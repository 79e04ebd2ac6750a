"""Jobs: scan, map, combine, partition and sort, reduce, sink; and their control."""

from __future__ import annotations

import itertools
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.keys import partition
from sluice.operators.shuffle import sorted_reducers
from sluice.plans import scratch
from sluice.plans.spec import JobSpec, Pipe, Status, parse
from sluice.sources import readers, writers
from sluice.streaming import pipes


def _located(paths: tuple[str, ...], host: str, port: str) -> list[str]:
    """Paths without a scheme lie on the named host."""
    base = f"hdfs://{host}{f':{port}' if port else ''}" if host else ""
    return [base + p if p.startswith("/") else p for p in paths]


def plan(spark: SparkSession, spec: JobSpec, reports: pipes.Reports | None = None) -> DataFrame:
    """The rows that a job writes: lines (value), or pairs (key, value) for pairs through programs.

    Map output is routed by the exact partition number and each reducer's input is sorted by key; a combiner runs
    once over each map task's sorted output. Without reduces there is no shuffle. A mapper of lines runs once a file
    range and knows it. ``reports`` collects counters and failures.
    """
    spec.check()
    sent = pipes.ship(spark.sparkContext, spec.files, spec.archives)
    spark = readers.with_split_size(spark, spec.split_size)
    reports = reports or pipes.Reports(spark.sparkContext)
    env = pipes.environment(job=spark.sparkContext.applicationId, name=spec.name, output=spec.output, reduces=spec.reduces, memory=spec.memory, extra=dict(spec.environment))
    inputs = _located(spec.inputs, spec.input_host, spec.input_port)
    if spec.pipe is Pipe.BISTREAMING:
        rows = readers.read(spark, spec.input_format, inputs)
        if rows.columns == ["value"]:
            rows = readers.text_pairs(spark, inputs)
        rows = pipes.pairs(rows, spec.mapper, env, reports, "map", sent)
        line = F.col("key").cast("string")
    else:
        rows = readers.files_of(spark, inputs) if spec.input_format is readers.InputFormat.TEXT else readers.read(spark, spec.input_format, inputs)
        if "value" != rows.columns[0]:
            rows = writers.lines_of(rows)
        rows = pipes.lines(rows, spec.mapper, env, reports, "map", spec.ignore_map_failures > 0, sent)
        line = F.col("value")
    own = list(rows.columns)
    if spec.combiner:
        key, _ = partition(spec.partitioner, line, 1, spec.separator, spec.key_fields, spec.partition_fields)
        placed = rows.withColumn("_key", key).sortWithinPartitions("_key").select(*own)
        rows = pipes.pairs(placed, spec.combiner, env, reports, "combine", sent) if spec.pipe is Pipe.BISTREAMING else pipes.lines(placed, spec.combiner, env, reports, "combine", sent=sent)
    if not spec.reduces:
        return rows
    key, number = partition(spec.partitioner, line, spec.reduces, spec.separator, spec.key_fields, spec.partition_fields)
    kept = rows.where(F.length("value") > 0) if spec.pipe is Pipe.STREAMING else rows
    routed = sorted_reducers(kept.select(*own, key.alias("_key"), number.alias("reduce_no")), spec.reduces, keys=("_key",))
    env |= {"mapred_task_is_map": "false"}
    if spec.pipe is Pipe.BISTREAMING:
        return pipes.pairs(routed.select(*own), spec.reducer, env, reports, "reduce", sent)
    return pipes.lines(routed.select("value"), spec.reducer, env, reports, "reduce", spec.ignore_reduce_failures > 0, sent)


def run(spark: SparkSession, spec: JobSpec) -> dict[str, int]:
    """``plan``, written to a new output path; the counters that programs reported.

    Where failures may be ignored, rows go to a folder beside the output, which gets its name once no more tasks failed
    than may; else it is removed and the job fails.
    """
    reports = pipes.Reports(spark.sparkContext)
    rows = plan(spark, spec, reports)
    (output,) = _located((spec.output,), spec.output_host, spec.output_port)
    allowed = {"map": spec.ignore_map_failures, "reduce": spec.ignore_reduce_failures}
    if not any(allowed.values()):
        writers.write(rows, spec.output_format, output, spec.compress)
        return reports.counters()
    if scratch.exists(spark, output):
        raise FileExistsError(f"{output} already exists")
    beside = f"{output.rstrip('/')}.{uuid.uuid4().hex[:12]}"
    try:
        writers.write(rows, spec.output_format, beside, spec.compress)
        for step, most in allowed.items():
            if (n := reports.failures(step)) > most:
                raise RuntimeError(f"{n} {step} tasks failed; {most} may")
        scratch.move(spark, beside, output)
    finally:
        scratch.drop(spark, beside)
    return reports.counters()


class Jobs:
    """Jobs of this driver: submit, kill, list, status."""

    _ids = itertools.count(1)

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: dict[int, tuple[Status, threading.Thread]] = {}
        self.lock = threading.Lock()

    def submit(self, spec: JobSpec, wait: bool = True) -> int:
        """Start a job in a pool of its priority; a job that fails raises here if waited for."""
        spec.check()
        status = Status(next(self._ids), spec.name)
        sc = self.spark.sparkContext

        def work() -> None:
            sc.setJobGroup(f"sluice-{status.id}", spec.name, interruptOnCancel=True)
            sc.setLocalProperty("spark.scheduler.pool", spec.priority.name.lower())
            try:
                with self.lock:
                    if status.state == "killed":
                        return
                    status.state = "running"
                counters = run(self.spark, spec)
                with self.lock:
                    status.counters = counters
                    status.state = "killed" if status.state == "killed" else "completed"
            except Exception as e:  # noqa: BLE001
                status.state = "killed" if status.state == "killed" else "failed"
                status.error = str(e)[:8000]

        thread = threading.Thread(target=work, daemon=True)
        self.held[status.id] = (status, thread)
        thread.start()
        if wait:
            thread.join()
            if status.state == "failed":
                raise RuntimeError(status.error)
        return status.id

    def wait(self, job: int) -> Status:
        status, thread = self.held[job]
        thread.join()
        return status

    def kill(self, job: int) -> None:
        status, _ = self.held[job]
        with self.lock:
            ended = status.state not in ("pending", "running")
            if not ended:
                status.state = "killed"
        if not ended:
            self.spark.sparkContext.cancelJobGroup(f"sluice-{job}")

    def monitor(self, job: int, every: float = 1.0) -> Iterator[dict[str, object]]:
        """``status`` again and again until the job has ended."""
        _, thread = self.held[job]
        while thread.is_alive():
            yield self.status(job)
            thread.join(every)
        yield self.status(job)

    def list(self, ended: bool = True) -> list[Status]:
        """Running jobs first, then the newest; without ``ended`` only those that wait or run."""
        found = (s for s, _ in self.held.values() if ended or s.state in ("pending", "running"))
        return sorted(found, key=lambda s: (s.state != "running", -s.id))

    def command(self, words: list[str]) -> object:
        """A command line: streaming or bistreaming with flags, kill, list, status or monitor with a job; -a for all."""
        verb, *rest = words
        if verb in ("streaming", "bistreaming"):
            spec = parse(words)
            return self.submit(spec, wait=not spec.immediate)
        every = any(w in ("-a", "--all", "-all") for w in rest)
        numbers = [int(w) for w in rest if not w.startswith("-")]
        if verb == "list":
            return self.list(every)
        if verb not in ("kill", "status", "monitor") or len(numbers) != 1:
            raise ValueError(f"no command: {' '.join(words)!r}")
        return getattr(self, verb)(numbers[0])

    def status(self, job: int) -> dict[str, object]:
        """State, and Spark's jobs and tasks of it."""
        status, _ = self.held[job]
        tracker = self.spark.sparkContext.statusTracker()
        stages = []
        for j in tracker.getJobIdsForGroup(f"sluice-{job}"):
            info = tracker.getJobInfo(j)
            for s in info.stageIds if info else ():
                if found := tracker.getStageInfo(s):
                    stages.append({"stage": s, "tasks": found.numTasks, "completed": found.numCompletedTasks, "running": found.numActiveTasks, "failed": found.numFailedTasks})
        return {"id": status.id, "name": status.name, "state": status.state, "error": status.error, "counters": status.counters, "stages": stages}
