"""Helpers shared by the text operators: tables, shared folders, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables, read lazily through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and Spark runs in one process (tests) a
    folder of our own is made; on a cluster its absence is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at a place every executor can reach, so a lost
    executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most_bytes`` at most.

    A single row is never cut, so one long text may exceed the size.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
        start, base = 0, 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            base = int(ends[stop - 1])
            start = stop


def text_bytes(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of an Arrow array of texts, one after the other, and where each ends; nulls are empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    if texts.null_count or not len(texts):
        return b"".join(t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.binary())), ends
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)
    first = int(offsets[texts.offset])
    return texts.buffers()[2].slice(first, int(ends[-1])).to_pybytes() if ends[-1] else b"", ends


def _settle() -> None:
    """Give memory that a task no longer uses back to the system: workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``, with this package made importable on the executors."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            _settle()

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_WORD_KEYS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Space and the five ASCII control characters that separate words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a byte buffer.

    Words are runs of bytes other than space and 0x09 to 0x0D. The hash is a
    keyed linear sum over the bytes (positions past 4096 continue under a
    remixed key), finalised with the length.
    """
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    inside = np.flatnonzero(~space)
    first = np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    pos = np.arange(len(inside)) - first
    key = _WORD_KEYS[pos & 4095]
    if pos.max() >= 4096:
        key = mix64(key + (pos >> 12).astype(np.uint64)) | np.uint64(1)
    parts = (buf[inside].astype(np.uint64) + np.uint64(1)) * key
    sums = np.add.reduceat(parts, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return starts, ends, mix64(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
