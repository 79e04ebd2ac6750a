"""Bounds on what crosses to Python and on what its workers hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound(spark: SparkSession) -> None:
    """Let batches hold ROWS rows at most: texts are long, and both sides hold whole batches."""
    held = int(spark.conf.get(_KEY))
    if held <= 0 or held > ROWS:
        spark.conf.set(_KEY, str(ROWS))


def returning(step: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``step`` over batches, which gives the system what its task has freed: workers live on through later stages."""

    @wraps(step)
    def whole(*args, **named) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(*args, **named)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()

    return whole


def free(columns: list[str], name: str) -> str:
    """A name that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
