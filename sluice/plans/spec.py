"""Job specifications: fields, defaults, validation, and the command line and property names that fill them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from enum import Enum

from sluice.functions import values
from sluice.functions.keys import Partitioner
from sluice.sources.readers import InputFormat
from sluice.sources.writers import OutputFormat


class Priority(Enum):
    VERY_HIGH = 4
    HIGH = 3
    NORMAL = 2
    LOW = 1

    @classmethod
    def named(cls, name: str) -> Priority:
        return cls[name.strip().upper().replace("-", "_").replace(" ", "_").replace("VERYHIGH", "VERY_HIGH")]


class Pipe(Enum):
    STREAMING = "streaming"
    BISTREAMING = "bistreaming"


@dataclass(frozen=True)
class JobSpec:
    """What a job reads, runs and writes."""

    inputs: tuple[str, ...] = ()
    output: str = ""
    mapper: str = ""
    reducer: str = ""
    combiner: str = ""
    name: str = ""
    files: tuple[str, ...] = ()
    archives: tuple[str, ...] = ()
    pipe: Pipe = Pipe.STREAMING
    partitioner: Partitioner = Partitioner.KEY_FIELD
    input_format: InputFormat = InputFormat.TEXT
    output_format: OutputFormat = OutputFormat.TEXT
    reduces: int = 1
    separator: str = "\t"
    key_fields: int = 1
    partition_fields: int = 1
    split_size: int = 500 << 20
    compress: bool = False
    ignore_map_failures: int = 0
    ignore_reduce_failures: int = 0
    memory: int = 1 << 30
    priority: Priority = Priority.NORMAL
    check_counters: bool = False
    environment: tuple[tuple[str, str], ...] = ()
    input_host: str = ""
    input_port: str = ""
    output_host: str = ""
    output_port: str = ""
    immediate: bool = False

    def check(self) -> JobSpec:
        """Raise for what is missing."""
        missing = [n for n, v in (("input", self.inputs), ("output", self.output), ("mapper", self.mapper)) if not v]
        if self.reduces > 0 and not self.reducer:
            missing.append("reducer")
        if missing:
            raise ValueError("a job needs: " + ", ".join(missing))
        if len(self.archives) > 5:
            raise ValueError("at most 5 archives")
        if self.reduces < 0:
            raise ValueError("a negative number of reduces")
        return self


#: Property names (fixed values), and what each sets.
PROPERTIES = {
    "mapred.job.name": ("name", str),
    "mapred.job.priority": ("priority", Priority.named),
    "mapred.job.memory.limit": ("memory", values.size_of),
    "mapred.job.check.counters": ("check_counters", values.switch),
    "mapred.reduce.tasks": ("reduces", int),
    "mapred.ignore.map.failures": ("ignore_map_failures", int),
    "mapred.ignore.reduce.failures": ("ignore_reduce_failures", int),
    "mapred.input.split.size": ("split_size", values.size_of),
    "mapred.job.input.host": ("input_host", str),
    "mapred.job.input.port": ("input_port", str),
    "mapred.job.output.host": ("output_host", str),
    "mapred.job.output.port": ("output_port", str),
    "mapred.output.compress": ("compress", values.switch),
    "map.key.field.separator": ("separator", str),
    "stream.num.map.output.key.fields": ("key_fields", int),
    "num.key.fields.for.partition": ("partition_fields", int),
}
#: Taken, with a warning that says what does the same in Spark.
ELSEWHERE = {
    "mapred.map.tasks": "the number of maps follows from the splits",
    "mapred.job.cpu.millicores": "set spark.executor.cores and spark.task.cpus",
    "mapred.job.map.capacity": "set spark.cores.max, or the pool's shares",
    "mapred.job.reduce.capacity": "set spark.cores.max, or the pool's shares",
    "mapred.map.max.attempts": "set spark.task.maxFailures",
    "mapred.reduce.max.attempts": "set spark.task.maxFailures",
    "mapred.map.tasks.speculative.execution": "set spark.speculation",
    "mapred.reduce.tasks.speculative.execution": "set spark.speculation",
    "mapred.decompress.input": "compressed input is always read decompressed",
    "mapred.job.input.user": "the login of Hadoop's configuration is used",
    "mapred.job.input.password": "the login of Hadoop's configuration is used",
    "mapred.job.output.user": "the login of Hadoop's configuration is used",
    "mapred.job.output.password": "the login of Hadoop's configuration is used",
}

FLAGS = {
    "-mapper": ("mapper", str),
    "-reducer": ("reducer", str),
    "-combiner": ("combiner", str),
    "-output": ("output", str),
    "-partitioner": ("partitioner", Partitioner.named),
    "-inputformat": ("input_format", InputFormat.named),
    "-outputformat": ("output_format", OutputFormat.named),
}
SWITCHES = {"-i": "immediate", "-immediate": "immediate", "--immediate": "immediate"}
#: Flags that name a master or its naming service: the session is the master here.
NAMING = ("-master", "-nexus", "-nexus-file", "-nexus-root")
LISTS = {"-input": "inputs", "-file": "files", "-cacheArchive": "archives"}


def with_properties(spec: JobSpec, text: str) -> JobSpec:
    """``name=value`` pairs between commas; unknown names raise."""
    for pair in filter(None, (p.strip() for p in text.split(","))):
        name, _, value = pair.partition("=")
        if name in ELSEWHERE:
            warnings.warn(f"{name} has no effect: {ELSEWHERE[name]}", stacklevel=2)
            continue
        if name not in PROPERTIES:
            raise ValueError(f"no property: {name!r}")
        attribute, convert = PROPERTIES[name]
        spec = replace(spec, **{attribute: convert(value)})
    return spec


def parse(arguments: list[str]) -> JobSpec:
    """A job from the words of a command line: a verb (streaming or bistreaming), then flags."""
    spec = JobSpec(pipe=Pipe(arguments[0]))
    rest = iter(arguments[1:])
    for flag in rest:
        if flag in SWITCHES:
            spec = replace(spec, **{SWITCHES[flag]: True})
            continue
        value = next(rest, None)
        if value is None:
            raise ValueError(f"{flag} needs a value")
        if flag in NAMING:
            warnings.warn(f"{flag} has no effect: the session is the master", stacklevel=2)
        elif flag in LISTS:
            spec = replace(spec, **{LISTS[flag]: (*getattr(spec, LISTS[flag]), value)})
        elif flag in FLAGS:
            attribute, convert = FLAGS[flag]
            spec = replace(spec, **{attribute: convert(value)})
        elif flag in ("-jobconf", "-D"):
            spec = with_properties(spec, value)
        elif flag == "-cmdenv":
            name, _, text = value.partition("=")
            spec = replace(spec, environment=(*spec.environment, (name, text)))
        else:
            raise ValueError(f"no flag: {flag!r}")
    return spec.check()


@dataclass
class Status:
    """A job as listings show it."""

    id: int
    name: str
    state: str = "pending"
    error: str = ""
    counters: dict[str, int] = field(default_factory=dict)
