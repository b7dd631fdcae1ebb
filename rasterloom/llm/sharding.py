"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets by a seeded hash, as many buckets
as keep each near ``bucket_bytes``. Pass two orders one bucket at a time
canonically, shuffles it with Fisher-Yates under a generator seeded by the
bucket, and emits it. Read bucket after bucket, the result is a uniform
permutation of the table: a record's place is its bucket's offset and its slot
in the bucket. Shards take places in turn, so their row counts differ by one
at most (the law ``rows``).

Both passes depend on the records and the seed alone, so a task that is run
again after an executor is lost makes the same bucket.

Defined results: a null text has no bytes and checksum 0; rows that are equal
in id and text are interchangeable and keep separate slots; a null id hashes
like any value; all columns of the table are carried, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh_path, map_arrow, partitions, text_or_empty

ROW_BYTES = 16
#: Offsets that may be broadcast; beyond it the join is shuffled.
BROADCAST_BUCKETS = 1 << 20


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation: each place from the last down swaps with one at or below it."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for i, j in zip(range(n - 1, 0, -1), draws, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def shuffle(docs: DataFrame, *, seed: int = 29, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__bucket`` and ``__slot``, in shuffled order inside each bucket.

    Adds ``__size`` too. A worker holds one bucket at a time; a bucket's rows
    are those of the hash of id and text, so one frequent id doesn't fill it.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("__size", F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")) + ROW_BYTES)
    total = sized.agg(F.sum("__size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    check = F.crc32(text_or_empty(text_col).cast("binary"))
    key = F.xxhash64(F.lit(seed), F.col(id_col), check)
    rows = sized.withColumn("__key", key).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__key")), F.lit(buckets)))
    dealt = rows.repartition(min(buckets, 4 * partitions(spark)), "__bucket").sortWithinPartitions("__bucket", "__key", id_col, text_col)
    kept = [c for c in dealt.columns if c != "__key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket = None

        def emit() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            order = fisher_yates(whole.num_rows, [seed, bucket])
            slot = np.arange(whole.num_rows)
            for i in range(0, len(order), 2000):
                part = whole.take(pa.array(order[i : i + 2000])).append_column("__slot", pa.array(slot[i : i + 2000], pa.int64()))
                yield from part.combine_chunks().to_batches()

        for batch in batches:
            ids = batch.column(kept.index("__bucket")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and ids[a] != bucket:
                    yield from emit()
                    held = []
                bucket = int(ids[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from emit()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (dealt.schema[c] for c in kept))
    return map_arrow(dealt.select(*kept), run, schema + ", __slot long")


def shard(docs: DataFrame, shards: int = 40, *, seed: int = 29, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shuffled records and read them with ``shard, slot`` and ``size``.

    Buckets are written as they come out of the second pass. Their offsets are
    a running sum over one row a bucket.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "shards")
    out = shuffle(docs, seed=seed, bucket_bytes=bucket_bytes, id_col=id_col, text_col=text_col)
    out.write.parquet(path)
    rows = spark.read.schema(out.schema).parquet(path)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__offset"))
    # 16 bytes a bucket; the records need not move again where that is little
    if counts.count() <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    placed = rows.join(offsets, "__bucket").withColumn("__place", F.col("__offset") + F.col("__slot"))
    return placed.withColumns({"shard": (F.col("__place") % shards).cast("int"), "slot": F.floor(F.col("__place") / shards).cast("long"), "size": F.col("__size")}).drop("__bucket", "__slot", "__offset", "__place", "__size")


def digests(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Where each record lies, with the checksum of the text that was carried there."""
    rows = shard(docs.select(id_col, text_col), shards, id_col=id_col, text_col=text_col, **options)
    return rows.select(id_col, "size", F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
