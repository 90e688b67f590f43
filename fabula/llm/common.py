"""Shared pieces: the shared scratch folder, checked broadcasts, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

#: Rows, and bytes of their values, that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Rows that become Python objects at once.
BATCH_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session names none, a local master (tests) gets a temporary one; a cluster
    has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fabula-"))
    return spark.sparkContext.getCheckpointDir()


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fabula/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns a scan of it: lineage
    ends there, and a lost executor costs at most the running stage. The table stays
    until discard(), as results may still read it."""
    path = f"{tables_dir(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes all tables that written() has left for this application. Results that were
    not stored elsewhere can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, which must be cheap to read (a written table), marked for broadcast if it
    has at most `rows` rows of `size` bytes in all; otherwise unmarked, so that Spark
    shuffles (and AQE splits hot keys of) the join."""
    if df.limit(rows + 1).count() > rows:
        return df
    weights = [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    if any(variable for _, variable in weights):
        total = sum((w for w, _ in weights), F.lit(0).cast("long"))
        if (df.agg(F.sum(total)).first()[0] or 0) > size:
            return df
    return F.broadcast(df)


def _bytes(column, kind) -> tuple:
    """The bytes of a column's value, and whether they vary from row to row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 8, True
    if isinstance(kind, ArrayType):
        zero = F.lit(0).cast("long")
        return F.coalesce(F.aggregate(column, zero, lambda n, x: n + _bytes(x, kind.elementType)[0]), zero) + 8, True
    if isinstance(kind, StructType):
        parts = [_bytes(column.getField(f.name), f.dataType) for f in kind.fields]
        return sum((p for p, _ in parts), F.lit(0).cast("long")), any(v for _, v in parts)
    return F.lit(8).cast("long"), False


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | StructType) -> DataFrame:
    """mapInArrow with per-task state: make() is called once a task and returns what
    handles each batch, of at most BATCH_ROWS rows."""

    def run(batches):
        handle = make()
        for batch in slices(batches, BATCH_ROWS):
            yield from handle(batch)
        getattr(handle, "close", lambda: None)()
        trim()

    return df.mapInArrow(run, schema)


def extended(df: DataFrame, ddl: str, without: tuple[str, ...] = ()) -> StructType:
    """df's schema less some columns, plus those of a DDL string."""
    return StructType([f for f in df.schema.fields if f.name not in without] + StructType.fromDDL(ddl).fields)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones, so that only a few texts at a time become Python
    objects; frees what Arrow holds at the end."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    """Gives freed memory back to the system: workers are reused, and stages add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, each as one batch, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and first != last:
            yield whole(held)
            held = []
        for a, b in zip(starts, starts[1:]):
            if a and held:
                yield whole(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield whole(held)


def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
