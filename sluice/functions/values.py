"""Small value formats: sizes, switches, durations, addresses, wildcards, counter lines, tables."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORT = 54310
_UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def size_of(text: str) -> int:
    """Bytes of "1G", "512M", "4k", "17"; anything else raises."""
    m = re.fullmatch(r"\s*(\d+)\s*([KMGT]?)B?\s*", text, re.I)
    if not m:
        raise ValueError(f"no size: {text!r}")
    return int(m[1]) * _UNITS[m[2].upper()]


def switch(text: str) -> bool:
    """True or false in words; anything else raises."""
    word = text.strip().lower()
    if word in ("true", "1", "yes", "on"):
        return True
    if word in ("false", "0", "no", "off"):
        return False
    raise ValueError(f"neither true nor false: {text!r}")


def duration(seconds: int) -> str:
    """"1 hours, 2 mins, 3 sec; 3723": hours beyond one, minutes beyond one and seconds beyond none, then all seconds."""
    hours, minutes, rest = seconds // 3600, seconds % 3600, seconds % 60
    parts = [f"{hours} hours, " if seconds > 3600 else "", f"{minutes // 60} mins, " if minutes > 60 else "", f"{rest} sec" if rest else ""]
    return "".join([*parts, f"; {seconds}"])


def duration_column(seconds: Column) -> Column:
    """``duration`` of a column of whole seconds."""
    part = lambda test, n, unit: F.when(test, F.concat(F.floor(n).cast("string"), F.lit(unit))).otherwise("")
    minutes, rest = seconds % 3600, seconds % 60
    return F.concat(part(seconds > 3600, seconds / 3600, " hours, "), part(minutes > 60, minutes / 60, " mins, "), part(rest > 0, rest, " sec"), F.lit("; "), seconds.cast("string"))


def stamp(seconds: float) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%d %H:%M:%S")


def address(uri: str) -> tuple[str, int, str]:
    """(host, port, path) of hdfs://host:port/path; a path alone has no host."""
    m = re.fullmatch(r"hdfs://([^/:]*)(?::(\d+))?(/.*)?", uri)
    if not m:
        return "", DEFAULT_PORT, uri
    return m[1], int(m[2] or DEFAULT_PORT), m[3] or "/"


def address_columns(uri: Column) -> tuple[Column, Column, Column]:
    """``address`` as columns."""
    pattern = r"^hdfs://([^/:]*)(?::(\d+))?(/.*)?$"
    found = uri.rlike(pattern)
    port = F.coalesce(F.nullif(F.regexp_extract(uri, pattern, 2), F.lit("")).cast("int"), F.lit(DEFAULT_PORT))
    path = F.coalesce(F.nullif(F.regexp_extract(uri, pattern, 3), F.lit("")), F.lit("/"))
    return F.when(found, F.regexp_extract(uri, pattern, 1)).otherwise(""), F.when(found, port).otherwise(DEFAULT_PORT), F.when(found, path).otherwise(uri)


def wildcard(pattern: str) -> str:
    """The regular expression of a pattern with * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike("(?s)" + wildcard(pattern))


COUNTER = r"reporter:counter:(?:.*:)?([^:]*),([^,]*)$"


def counter(line: Column) -> tuple[Column, Column]:
    """(key, amount) of a counter line: the key follows the last colon and ends at the last comma.

    Other lines, and amounts that are no number, give nulls.
    """
    found = line.rlike(COUNTER)
    amount = F.regexp_extract(line, COUNTER, 2).try_cast("long")
    return F.when(found & amount.isNotNull(), F.regexp_extract(line, COUNTER, 1)), F.when(found, amount)


def table(header: list[str], rows: list[list[object]], width: int = 80) -> str:
    """Columns of text; long cells are cut, empty ones show a dash."""
    cell = lambda x: (str(x) if x not in (None, "") else "-")[:width]
    grid = [[cell(x) for x in row] for row in [header, *rows]]
    wide = [max(len(row[i]) for row in grid) for i in range(len(header))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, wide, strict=True)).rstrip() for row in grid]
    return "\n".join([lines[0], "  ".join("-" * w for w in wide), *lines[1:]])
