"""Helpers that every operator of this subpackage shares.

Scratch tables, the split-group lookup and the row-to-batch plumbing live here,
so the operator modules hold only their own method.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.files import drop_at_end, scratch_root

#: Text bytes that a Python worker handles at a time.
SLICE_BYTES = 2 << 20
#: Share of all rows beyond which a group is joined by broadcast: there are fewer than this many such groups.
HEAVY = 4096
#: Bits of the map of wanted ids, as a power of two: 8 MB are collected and broadcast.
ID_BITS = 26


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written intermediate tables: they cut lineage, outlive executors and are dropped when no longer read, the last ones with the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        drop_at_end(spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """The union of written tables of one schema, by one scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._scratch_path for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def join_lists(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, scratch: Scratch) -> DataFrame:
    """``rows`` joined with the table of their groups (one row a group, ``size`` rows of it in ``rows``). Keys compare null-safe.

    Groups with over 1 / ``HEAVY`` of all rows number fewer than ``HEAVY``, so these are broadcast and their rows stay where they are;
    the others meet by a shuffle in which no group exceeds that share, however large it is.
    """
    groups = scratch.cut(groups)
    total = groups.agg(F.sum(size)).first()[0] or 0
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    on = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    heavy = groups.filter(F.col(size) * HEAVY > total).withColumnsRenamed(names)
    light = groups.filter(F.col(size) * HEAVY <= total).withColumnsRenamed(names)
    hot = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(*names.values())), on, "left_anti").join(light, on)
    return hot.union(rest).drop(*names.values())


def lookup_by_group(rows: DataFrame, keys: list[str], aggregates: dict[str, Column], scratch: Scratch, least: int = 1) -> DataFrame:
    """``rows`` of groups of at least ``least`` rows with aggregates of their group, for groups of any size.

    Groups are aggregated before they are shuffled, and ``join_lists`` brings the result back.
    """
    groups = rows.groupBy(*keys).agg(F.count("*").alias("__size"), *[c.alias(n) for n, c in aggregates.items()])
    groups = groups.filter(F.col("__size") >= least) if least > 1 else groups
    return join_lists(rows, groups, keys, "__size", scratch).drop("__size")


def id_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2 ** ``ID_BITS`` bits, whatever the number of ids: the bit of every id's hash is set.

    It lets tasks leave out most rows that a later join would drop, without a shuffle of these rows.
    """
    h = id_bit(F.col(column))
    rows = ids.select(F.shiftright(h, 15).alias("bucket"), h.bitwiseAND(F.lit(32767)).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(1 << (ID_BITS - 3), np.uint8)
    for r in rows.collect():
        out[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def id_bit(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << ID_BITS))


def text_slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of each hold about ``limit`` bytes; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > limit or i - start >= 4096):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def map_text(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, column: int = 1) -> DataFrame:
    """``work`` on bounded slices of ``df``; it returns a dict of columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for part in text_slices(batches, column):
            out = work(part)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out.values(), arrow)],
                schema=arrow,
            )

    return df.mapInArrow(run, struct)
