"""Key extraction and partition numbers, as columns.

A line's fields are cut by any character of a separator set. Keys sort by bytes, so key columns never get a collation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MASK = 0x7FFFFFFF
_INVERSE = pow(31, -1, 1 << 32)


def _powers(base: int, n: int) -> np.ndarray:
    table = np.full(max(1, n), base, np.uint32)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint32)


def hash_array(texts: pa.Array) -> pa.Array:
    """``hash_code`` of every string of an array at once: running sums of a polynomial modulo 2**32."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return pa.array([], pa.int64())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    base, at = at[0], at - at[0]
    raw = np.frombuffer(data, np.int8)[base : base + at[-1]] if data is not None and at[-1] else np.zeros(0, np.int8)
    sums = np.zeros(len(raw) + 1, np.uint32)
    np.cumsum(raw.astype(np.int32).view(np.uint32) * _powers(_INVERSE, len(raw))[: len(raw)], dtype=np.uint32, out=sums[1:])
    up = _powers(31, len(raw) + 1)
    size = at[1:] - at[:-1]
    value = (sums[at[1:]] - sums[at[:-1]]) * up[np.maximum(at[1:] - 1, 0)] + up[size]
    value = np.where(size == 0, 0, value & np.uint32(MASK)).astype(np.int64)
    valid = np.asarray(texts.is_valid())
    return pa.array(value, pa.int64(), mask=~valid)


@F.arrow_udf(LongType())
def _hash_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield hash_array(texts)


def hash_code(text: Column) -> Column:
    """0 for the empty string, else h = 31 * h + byte (signed, from 1) in 32 bits, without the sign bit."""
    return _hash_udf(text)


def hash_code_native(text: Column) -> Column:
    """``hash_code`` from built-in functions only; slower, for plans that must not start Python."""
    at = F.sequence(F.lit(0), F.octet_length(text) - 1)
    digits = F.transform(at, lambda i: F.conv(F.substring(F.hex(F.encode(text, "UTF-8")), 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, b: F.pmod(F.lit(31).cast("long") * h + F.when(b > 127, b - 256).otherwise(b), F.lit(1 << 31))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.aggregate(digits, F.lit(1).cast("long"), step))


def _set(separators: str) -> str:
    return "".join(re.escape(c) if c in r"\]^-[&" else c for c in separators)


def first_fields(line: Column, fields: int = 1, separators: str = "\t") -> Column:
    """The first ``fields`` fields (0 means 1); a line with fewer is whole, less one trailing separator."""
    chars = _set(separators or "\t")
    found = F.regexp_extract(line, rf"^([^{chars}]*(?:[{chars}][^{chars}]*){{0,{max(1, fields) - 1}}})", 1)
    ends = line.rlike(rf"[{chars}]\z")
    return F.when((F.length(found) == F.length(line)) & ends, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(found)


class Partitioner(Enum):
    KEY_FIELD = "keyfieldbased"
    INT_HASH = "inthash"

    @classmethod
    def named(cls, name: str) -> Partitioner:
        """By name in any case; unknown names mean key fields."""
        return cls.INT_HASH if name.lower() == cls.INT_HASH.value else cls.KEY_FIELD


def key_field(line: Column, partitions: int, separators: str = "\t", key_fields: int = 1, partition_fields: int = 1) -> tuple[Column, Column]:
    """(sort key, partition): the partition hashes a prefix of fields, which allows secondary sort."""
    return first_fields(line, key_fields, separators), hash_code(first_fields(line, partition_fields, separators)) % partitions


def int_hash(line: Column, partitions: int, separators: str = "\t") -> tuple[Column, Column]:
    """(sort key, partition) of "<int> <key>...": the number before the first space names the partition.

    Text that is no number counts as 0, a negative number gives a negative partition, and a line without a space
    is hashed by its key.
    """
    space = F.instr(line, " ")
    body = F.when(space > 0, F.substring(line, space + 1, F.length(line))).otherwise(line)
    key = F.regexp_extract(body, rf"^([^{_set(separators or chr(9))}]*)", 1)
    number = F.regexp_extract(F.substring(line, F.lit(1), space - 1), r"^\s*([+-]?\d+)", 1).try_cast("long")
    return key, F.when(space > 0, F.coalesce(number, F.lit(0))).otherwise(hash_code(key)) % partitions


def partition(kind: Partitioner, line: Column, partitions: int, separators: str = "\t", key_fields: int = 1, partition_fields: int = 1) -> tuple[Column, Column]:
    if kind is Partitioner.INT_HASH:
        return int_hash(line, partitions, separators)
    return key_field(line, partitions, separators, key_fields, partition_fields)
