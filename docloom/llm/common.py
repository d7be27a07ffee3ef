"""What the operators of this subpackage share: reading tables, cutting lineage, walking over Arrow text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step works on; bounds the memory of a Python worker.
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch: it is held several times over, by the JVM and by the Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Where none is set, a local session takes one of its own; a cluster's
    must be named in spark.checkpoint.dir."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it prunes columns and doesn't work it out again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES at most (a row alone may be larger); for df.transform. The bound is a setting
    of the session that is read when a query runs, so a session with larger batches is set to BATCH_BYTES, and stays so."""
    own = df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < own <= BATCH_BYTES:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # the worker lives on in other stages, beside their own workers
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(tidy, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying: (bytes, starts, ends). A null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    starts, ends = at[:-1], at[1:].copy()
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        ends[gone] = starts[gone]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), starts, ends


def runs(starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes together; a longer row stands alone."""
    i, n, size = 0, len(starts), np.cumsum(ends - starts)
    while i < n:
        done = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield i, j
        i = j


def by_group(batches: Iterator[pa.RecordBatch], keys: int, done) -> Iterator[pa.RecordBatch]:
    """done(batches of one group) for each run of rows that are equal in the first `keys` columns; keys have no nulls."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.nonzero(new)[0].tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield done(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield done(held)


def pressed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the text column's UTF-8 bytes compressed, for an exchange; a null stays null."""
    at, schema = df.columns.index(text_col), StructType()
    for f in df.schema:
        schema.add(f.name, "binary" if f.name == text_col else f.dataType)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [compress(t.as_buffer()) if t.is_valid else None for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if n == at else c for n, c in enumerate(batch.columns)], batch.schema.names)

    return df.transform(in_arrow, press, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
