"""Limits of keys, values and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes, and levels of branches.
MAXIMUM_KEY, MAXIMUM_VALUE, MAXIMUM_NAME, MAXIMUM_DEPTH = 1024, 64 << 20, 1024, 16
#: The last sequence that a long holds.
MAXIMUM_SEQUENCE = (1 << 63) - 1


def check_name(name: str) -> str:
    """The name, if it is not blank, has no outer white space and takes at most ``MAXIMUM_NAME`` bytes of strict UTF-8."""
    if not name or name != name.strip() or len(name.encode("utf-8", "strict")) > MAXIMUM_NAME:
        raise ValueError(f"not a valid name: {name!r}")
    return name


def beyond() -> Column:
    """Whether a mutation (k, is_delete, v) may not be committed: no key, a key or value that is too long, a put without value, a tombstone with one."""
    size = (F.length("k") > MAXIMUM_KEY) | (F.length("v") > MAXIMUM_VALUE)
    shape = F.col("k").isNull() | F.col("is_delete").isNull() | (F.col("is_delete") == F.col("v").isNotNull())
    return F.coalesce(size, F.lit(False)) | shape


def beyond_limits(writes: DataFrame) -> DataFrame:
    """Mutations that may not be committed, or recovered rows that should not be there."""
    return writes.filter(beyond())


def escaped(name: Column) -> Column:
    """A name for display: control characters, and the backslash itself, as backslash-u and four hex digits."""
    codes = F.transform(F.split(name, ""), lambda c: F.when(c.rlike(r"^[\x00-\x1F\x7F-\x9F\\\\]$"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(c)), 4, "0"))).otherwise(c))
    return F.array_join(codes, "")
