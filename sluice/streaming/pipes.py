"""External programs as map, combine and reduce steps.

Lines are fed as text, pairs framed as length, key, length, value (32-bit little-endian lengths), both from a thread, so
that neither side waits for the other. A program that fails fails its task, unless a number of failures is to be
ignored; what programs report on standard error is counted. Programs are barriers to the optimizer: native expressions
are the first choice.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import shlex
import shutil
import struct
import subprocess
import sys
import tempfile
import threading
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import AccumulatorParam, SparkContext, SparkFiles, TaskContext
from pyspark.sql import DataFrame

from sluice.operators import stats

PREFIX = "mapred_"
#: Output of a program whose failure may be ignored is held back: in memory up to so many bytes, then in a file.
SPOOL = 16 << 20
#: Bytes of framed pairs that are read at once.
FRAMES = 1 << 20
REPORT = b"reporter:counter:"
#: What local files are sent as begins so: their content is part of the name, so jobs may ship others of the same name.
SENT = "sluice-sent-"
_copies: dict[str, str] = {}


class _Latest(AccumulatorParam):
    """What each task reported last, so that a task that runs twice counts once."""

    def zero(self, value):
        return {}

    def addInPlace(self, held, more):  # noqa: N802
        held.update(more)
        return held


class Reports:
    """Counters and failures of the tasks of a job's steps."""

    def __init__(self, sc: SparkContext):
        self.held = sc.accumulator({}, _Latest())

    def add(self, step: str, counters: Counter, failed: bool) -> None:
        """Called in a task."""
        task = TaskContext.get()
        self.held.add({(step, task.partitionId()): (dict(counters), failed)})

    def counters(self) -> dict[str, int]:
        total: Counter[str] = Counter()
        for counters, _ in self.held.value.values():
            total.update(counters)
        return dict(total)

    def failures(self, step: str) -> int:
        """Tasks of a step whose program failed in the end."""
        return sum(failed for (of, *_), (_, failed) in self.held.value.items() if of == step)


def _copied(sc: SparkContext, path: str) -> str:
    """A copy of a local file on the driver, under a name that no other file has, as it is now."""
    if sc.applicationId not in _copies:
        _copies[sc.applicationId] = os.path.realpath(tempfile.mkdtemp(prefix="sluice-ship-"))
    with open(path, "rb") as f:
        mark = hashlib.file_digest(f, "sha256").hexdigest()[:24]
    at = os.path.join(_copies[sc.applicationId], f"{SENT}{mark}-{os.path.basename(path)}")
    if not os.path.exists(at):
        shutil.copyfile(path, f"{at}.part")
        os.replace(f"{at}.part", at)
    return at


def ship(sc: SparkContext, files: Iterable[str] = (), archives: Iterable[str] = ()) -> dict[str, str]:
    """Send files and archives to all tasks: the name that programs see to the name it is sent as.

    An archive is unpacked to a folder of its name, or of what follows #.
    """
    sent = {}
    for kind, paths in (("file", files), ("archive", archives)):
        for path in paths:
            where, _, alias = path.partition("#") if kind == "archive" else (path, "", "")
            local = urlsplit(where).scheme in ("", "file")
            source = _copied(sc, unquote(urlsplit(where).path) if where.startswith("file:") else where) if local else where
            name = alias or os.path.basename(urlsplit(where).path if not local else where)
            own = os.path.basename(source) if local else name
            uri = f"file://{quote(source)}" if local else where
            if kind == "file":
                sc.addFile(uri)
            else:
                sc.addArchive(f"{uri}#{own}")
            sent[name] = own
    return sent


def _shipped(sc: SparkContext, sent: dict[str, str] | None) -> dict[str, str]:
    """``sent``, and what the caller added to the context."""
    added = (urlsplit(x).fragment or unquote(os.path.basename(urlsplit(x).path)) for x in (*sc.listFiles, *sc.listArchives))
    return {x: x for x in added if not x.startswith(SENT)} | (sent or {})


def environment(job: str = "", name: str = "", output: str = "", maps: int = 0, reduces: int = 0, memory: int = 1 << 30, is_map: bool = True, extra: dict[str, str] | None = None) -> dict[str, str]:
    """Variables that tell a program about its job."""
    env = {"job_id": job, "job_name": name, "output_dir": output, "map_tasks": str(maps), "reduce_tasks": str(reduces), "memory_limit": str(memory // 1024), "task_is_map": "true" if is_map else "false"}
    return {PREFIX + k: v for k, v in env.items()} | {k: str(v) for k, v in (extra or {}).items()}


def _task_environment(env: dict[str, str]) -> dict[str, str]:
    task = TaskContext.get()
    own = {}
    if task:
        own = {"task_partition": task.partitionId(), "task_id": f"attempt_{env.get(PREFIX + 'job_id', '')}_{task.partitionId()}_{task.attemptNumber()}", "attempt_id": task.attemptNumber()}
    return os.environ | env | {PREFIX + k: str(v) for k, v in own.items()}


def _fed(process: subprocess.Popen, feed) -> list[BaseException]:
    errors: list[BaseException] = []

    def run() -> None:
        try:
            for chunk in feed:
                process.stdin.write(chunk)
        except BrokenPipeError:
            pass  # the program has read enough
        except BaseException as e:  # noqa: BLE001
            errors.append(e)
        finally:
            try:
                process.stdin.close()
            except BrokenPipeError:
                pass

    threading.Thread(target=run, daemon=True).start()
    return errors


def _reported(stream, counters: Counter) -> None:
    """Count the counter lines of standard error and pass on the others."""
    for line in stream:
        if line.startswith(REPORT):
            key, _, amount = line.decode("utf-8", "replace").rstrip("\n").rpartition(",")
            name = key.rpartition(":")[2]
            number = amount.strip()
            if name and number.lstrip("+-").isdigit():
                counters[name] += int(number)
        else:
            sys.stderr.buffer.write(line)


def _run(command: str, env: dict[str, str], feed, read, counters: Counter | None = None, shipped: dict[str, str] | None = None) -> Iterator:
    """The output of a program that starts in a folder of its own, which holds the shipped files."""
    with tempfile.TemporaryDirectory(prefix="sluice-task-") as home:
        # executors name their folder of files by a relative path
        root = Path(SparkFiles.getRootDirectory()).resolve()
        for name, own in (shipped or {}).items():
            (Path(home) / name).symlink_to(root / own)
        yield from _ran(command, env, feed, read, counters, home)


def _ran(command: str, env: dict[str, str], feed, read, counters: Counter | None, home: str) -> Iterator:
    process = subprocess.Popen(["sh", "-c", command], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=None if counters is None else subprocess.PIPE, env=_task_environment(env), cwd=home)
    reader = None
    if counters is not None:
        reader = threading.Thread(target=_reported, args=(process.stderr, counters), daemon=True)
        reader.start()
    errors = _fed(process, feed)
    yield from read(process.stdout)
    code = process.wait()
    if reader:
        reader.join()
    if errors:
        raise errors[0]
    if code:
        raise RuntimeError(f"{shlex.quote(command)} ended with {code}")


def _lines(out) -> Iterator[str]:
    for line in out:
        yield line.decode("utf-8", "replace").rstrip("\n")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of a binary column's values, and all their bytes; nulls are empty."""
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(at), np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every place of runs of ``sizes`` bytes that begin at ``starts``."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def framed(batch: pa.RecordBatch) -> bytes:
    """The pairs (key, value) of a batch as length, key, length, value."""
    parts = [_bytes(batch.column(i)) for i in (0, 1)]
    ends = np.cumsum(parts[0][0] + parts[1][0] + 8)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - (parts[0][0] + parts[1][0] + 8)
    for sizes, data in parts:
        out[_places(at, np.full(len(at), 4))] = sizes.astype("<i4").view(np.uint8)
        out[_places(at + 4, sizes)] = data
        at = at + 4 + sizes
    return out.tobytes()


def _arrays(data: bytes, key_at: list[int], value_at: list[int], end_at: list[int]) -> pa.RecordBatch:
    raw = np.frombuffer(data, np.uint8)
    key, value, end = (np.array(x, np.int64) for x in (key_at, value_at, end_at))
    columns = []
    for at, sizes in ((key, value - 4 - key), (value, end - value)):
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw[_places(at, sizes)])]))
    return pa.RecordBatch.from_arrays(columns, ["key", "value"])


def unframed(out) -> Iterator[pa.RecordBatch]:
    """Pairs of a framed stream, in batches of about FRAMES bytes or one pair; a stream cut short raises."""
    number, data, need = struct.Struct("<i").unpack_from, b"", 0
    while True:
        block = out.read(max(FRAMES, need))
        data, at, keys, values, ends = data + block, 0, [], [], []
        size = len(data)
        while True:
            value, end = at + 8, 0
            if value <= size:
                (k,) = number(data, at)
                value += k
                if value <= size:
                    end = value + number(data, value - 4)[0]
            if not end or end > size:
                need = max(value, end) - size
                break
            if end < value or k < 0:
                raise ValueError("a pair of a negative length")
            keys.append(at + 4)
            values.append(value)
            ends.append(end)
            at = end
        if keys:
            yield _arrays(data, keys, values, ends)
        data = data[at:]
        if not block:
            if data:
                raise EOFError("a key without a value" if len(data) >= 4 and len(data) == 4 + number(data)[0] else "a pair was cut short")
            return


def _spooled(made: Iterator[str]) -> Iterator[str]:
    """All lines of a program that has ended well."""
    with tempfile.SpooledTemporaryFile(SPOOL, "w+", encoding="utf-8", newline="\n") as held:
        for line in made:
            held.write(line + "\n")
        held.seek(0)
        for line in held:
            yield line[:-1]


def lines(rows: DataFrame, command: str, env: dict[str, str] | None = None, reports: Reports | None = None, step: str = "", may_fail: bool = False, sent: dict[str, str] | None = None) -> DataFrame:
    """(value): the output lines of ``command`` for each partition's lines.

    Each partition runs the command once; where ``rows`` also has file, start and length, each range of a file does, and
    the program is told by map_input_file, map_input_start and map_input_length. ``reports`` collects counters and, with
    ``may_fail``, failures: a partition whose program fails then gives no lines, and the caller decides how many may.
    ``sent`` names what ``ship`` sent; it lies in the program's folder.
    """
    spark, env = rows.sparkSession, env or {}
    shipped = _shipped(spark.sparkContext, sent)
    ranged = rows.columns == ["value", "file", "start", "length"]

    def over(part: Iterator) -> Iterator[tuple[str]]:
        counters: Counter | None = Counter() if reports else None

        def programs() -> Iterator[str]:
            for at, rows_at in itertools.groupby(part, lambda r: tuple(r[1:])) if ranged else [((), part)]:
                own = env | dict(zip(("map_input_file", "map_input_start", "map_input_length"), map(str, at), strict=False))
                yield from _run(command, own, (((r[0] or "") + "\n").encode() for r in rows_at), _lines, counters, shipped)

        failed = False
        try:
            yield from ((x,) for x in (_spooled(programs()) if may_fail else programs()))
        except RuntimeError:
            task = TaskContext.get()
            if not may_fail or task.attemptNumber() + 1 < attempts:
                raise
            failed = True
        if reports:
            reports.add(step, counters, failed)

    sc = spark.sparkContext
    attempts = 1 if sc.master.startswith("local") else int(sc.getConf().get("spark.task.maxFailures", "4"))
    chosen = rows if ranged else rows.select("value")
    return spark.createDataFrame(chosen.rdd.mapPartitions(over), "value string")


def pairs(rows: DataFrame, command: str, env: dict[str, str] | None = None, reports: Reports | None = None, step: str = "", sent: dict[str, str] | None = None) -> DataFrame:
    """(key, value) as binary: the framed output of ``command`` for each partition's framed pairs."""
    env = env or {}
    shipped = _shipped(rows.sparkSession.sparkContext, sent)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: Counter | None = Counter() if reports else None
        yield from _run(command, env, map(framed, batches), unframed, counters, shipped)
        if reports:
            reports.add(step, counters, False)

    return rows.selectExpr("cast(key as binary)", "cast(value as binary)").mapInArrow(over, "key binary, value binary")


def reported(rows: DataFrame, command: str, env: dict[str, str] | None = None) -> DataFrame:
    """(counter, total) that a program reports on its standard error; its output is not read."""
    return stats.counters(lines(rows, f"{{ {command} ; }} 2>&1 >/dev/null", env))
