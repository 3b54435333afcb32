"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import cut, ship

__all__ = ["cut", "held_out", "let", "map_batches", "read", "release", "running", "ship", "text_of"]

#: Rows that an Arrow batch is cut to, so that a batch of very long texts stays small.
ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def let(value: Column, of) -> Column:
    """``of`` a value that is computed once, however often the expression names it: in a lambda it would be anew for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def running(values: Column, of) -> Column:
    """Running totals of an array under an associative function, in log n steps, each a pass over the array."""

    def step(acc: Column, d: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= d, of(x, F.get(acc, i - d))).otherwise(x))

    def whole(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))
        return F.when(F.size(v) > 1, F.aggregate(steps, v, step)).otherwise(v)

    return let(values, whole)


def release() -> None:
    """Give memory that a finished task has freed back to the system: an idle worker is kept, and would keep that too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``f`` to slices of at most ROWS rows: narrow, no shuffle, memory bounded by a slice."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield f(batch.slice(at, ROWS))
        release()

    return df.mapInArrow(run, schema)
