"""Helpers shared by the training-data operators."""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.session import shared_folder

# Rows of a record batch that are worked on at a time inside a task.
SLICE_ROWS = 512


# Rows that a Python stage gets at a time; long texts bound it.
BATCH_ROWS = 1000


# How to empty what each operator remembers in a Python worker, which outlives its tasks.
_FORGET: dict[str, Callable[[], None]] = {}


def remembers(operator: str, forget: Callable[[], None]) -> None:
    _FORGET[operator] = forget


def forget_others(operator: str = "") -> None:
    """Called by a task: lets go of what tasks of other operators have left in this worker."""
    for name, forget in _FORGET.items():
        if name != operator:
            forget()
    pa.default_memory_pool().release_unused()


class Scratch:
    """Tables written once in the shared folder, so that a lost executor costs nothing and nothing is
    worked out twice."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
        """Write and read again; Python stages on the way get ``rows`` rows at a time at most."""
        path = f"{self.folder}/{name}"
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, str(rows))
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(setting, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tasks_of(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the cluster has set them."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def bundled(docs: DataFrame, *used: str) -> DataFrame:
    """The ``used`` columns, and all others as one struct ``_rest``, so that no name of theirs gets in the way."""
    others = [named(c) for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*others or [F.lit(True).alias("_none")]).alias("_rest"))


def unbundled(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """Back to ``columns``: the ``used`` ones as they are in ``df`` now, the others as they were."""
    return df.select(*[named(c) if c in used else F.col("_rest")[c].alias(c) for c in columns])


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` has about ``most`` bytes; a longer value stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = max(int(np.searchsorted(ends, done + most, "right")), begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Runs of rows, sorted by ``key``, cut only where the key changes; about ``rows`` rows each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in slices(batches, rows):
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        if not len(changes):
            continue
        cut = int(changes[-1]) + 1
        yield table.slice(0, cut)
        rest = table.slice(cut)
        held, n = rest.combine_chunks().to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)
