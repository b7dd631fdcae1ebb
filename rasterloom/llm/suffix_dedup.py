"""Repeated passages removed with suffix sorting by bucket-pointer refinement.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id. All such strings are found, without comparing all
positions of the corpus:

1. Of equal texts only that of the least id goes on; the others are repeats
   from end to end.
2. A string's anchor is the least hash among its q-grams. Neighbouring strings
   with one anchor make a run, so a document has a run about every 15 bytes,
   and equal strings have equal anchors. Anchors travel in packets, by bucket,
   as 32 bits beside a document's place in the packet. An anchor that several
   documents of a batch have is known to be shared there, so a bucket gets it
   once a batch, however common it is. Anchors of one document only are done.
3. The documents make the runs of their shared anchors anew, and these meet
   with their bytes. Equal runs need one comparison: all but those of the least
   id are repeats. What is left is suffix-sorted: initial buckets by q-gram,
   refined by sorting on the bucket pointers of later offsets, each pass using
   the pointers that the one before it made (depths 8, 16, 32, 50). Singletons
   leave the sort. Strings in one bucket at the last depth are equal, and those
   of larger ids than the bucket's least are repeats.
4. The repeats go back to their documents as spans.

Defined results: a null text counts as empty; texts shorter than ``LENGTH``
bytes keep everything; rows with one id are one document as to what precedes
them, and each keeps its own result by position in its own text, runs and spans
being kept by a name of the id and the text's digest; null ids come after all
others; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, mix64, partitions, pieces, text_or_empty, written

LENGTH = 50
Q = 20
#: Bytes of runs that are sorted at once; one anchor's runs stay together.
CHUNK = 2 << 20
#: Bytes of text whose anchors make one set of packets, and whose equal runs are told apart at once.
PACKED, MET = 4 << 20, 2 << 20


def qgram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the ``q`` bytes from each position on."""
    h, width = data.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D), 1
    base = 0x9E3779B97F4A7C15
    while width * 2 <= q:
        h = h[:-width] * np.uint64(pow(base, width, 2**64)) + h[width:]
        width *= 2
    if width < q:  # the last q-gram overlaps the one before it
        h = h[: len(h) - (q - width)] * np.uint64(pow(base, q, 2**64)) + h[q - width :]
    return mix64(h)


def runs(data: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string and number of strings of each run of a text."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none
    least, width, want = qgram_hashes(data, q), 1, length - q + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[first].view(np.int64), first, np.diff(np.concatenate((first, [len(least)])))


def bucket_pointers(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each position the place where its bucket ends, strings being equal to ``depth`` bytes.

    Order of the pointers is the order of the strings. Positions whose string
    runs past the end have pointers too, as if zeros followed.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : n + i]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    ends = np.flatnonzero(np.concatenate((ordered[1:] != ordered[:-1], [True])))
    pointer = np.empty(n, dtype=np.int64)
    pointer[order] = np.repeat(ends, np.diff(np.concatenate(([-1], ends))))
    reach = 8
    while reach < depth:
        step = min(reach, depth - reach)
        size = np.bincount(pointer, minlength=n)
        active = np.flatnonzero(size[pointer] > 1)
        if not len(active):
            break
        later = active + step
        other = np.where(later < n, pointer[np.minimum(later, n - 1)], -1)
        pair = pointer[active] * np.int64(n + 1) + other + 1
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        ends = np.flatnonzero(np.concatenate((ordered[1:] != ordered[:-1], [True])))
        # a bucket's parts end as many places before it as rows come after them
        bucket = pointer[active[order]]
        last = np.flatnonzero(np.concatenate((bucket[1:] != bucket[:-1], [True])))
        close = last[np.searchsorted(last, ends)]
        pointer[active[order]] = np.repeat(bucket[ends] - (close - ends), np.diff(np.concatenate(([-1], ends))))
        reach += step
    return pointer


def repeats(texts: list[bytes], docs: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its strings also start in a text with a smaller doc."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    pointer = bucket_pointers(data, length)
    count = np.maximum(sizes - length + 1, 0)
    begin = np.cumsum(sizes) - sizes
    head = np.cumsum(count) - count
    starts = np.arange(count.sum()) + np.repeat(begin - head, count)
    owner = np.repeat(np.array(docs, dtype=np.int64), count)
    bucket = pointer[starts]
    least = np.full(len(data), np.iinfo(np.int64).max)
    np.minimum.at(least, bucket, owner)
    return np.split(least[bucket] < owner, head[1:])


def union(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, merged spans; touching ones become one."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], first[1:] > end[:-1]))
    return first[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(first) - 1]))]


_NULL_ID = 2**63 - 1


def _split(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit key of anchors; equal keys of a bucket may be different anchors, at the cost of a needless run."""
    u = h.view(np.uint64)
    return ((u >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), u.astype(np.uint32)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours begin, and how many there are."""
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return first, np.diff(np.concatenate((first, [len(values)])))


_PACKET = "deal long, bucket int, known boolean, rows binary, at binary, keys binary"


def _packets(buckets: int):
    """Packets of anchors: keys (4 bytes) and places (2 bytes) in a list of rows (8 bytes)."""

    def packet(bucket: int, known: bool, rows: np.ndarray, keys: np.ndarray) -> tuple[int, int, bool, bytes, bytes, bytes]:
        named, at = np.unique(rows, return_inverse=True)
        return (bucket + int(named[0])) % buckets if known else bucket, bucket, known, named.tobytes(), at.astype(np.uint16).tobytes(), keys.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in pieces(batches, "text", PACKED):
            for start in range(0, big.num_rows, 1 << 16):
                batch = big.slice(start, 1 << 16)
                found = [runs(np.frombuffer(t.as_buffer(), dtype=np.uint8))[0] for t in batch.column(2).cast(pa.binary())]
                h = np.concatenate(found)
                if not len(h):
                    continue
                row = np.repeat(batch.column(1).to_numpy(), [len(x) for x in found])
                bucket, key = _split(h, buckets)
                name = bucket << np.int64(32) | key
                order = np.lexsort((row, name))
                name, row = name[order], row[order]
                new = np.concatenate(([True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])))
                name, row = name[new], row[new]
                first, size = _groups(name)
                several = np.repeat(size > 1, size)
                sent = name[first] >> 32
                edges, length = _groups(sent)
                key = name.astype(np.uint32)
                out = [packet(int(sent[a]), False, row[first[a : a + n]], key[first[a : a + n]]) for a, n in zip(edges.tolist(), length.tolist(), strict=True)]
                # what the batch itself knows needs no meeting and is dealt over all tasks
                name, row, key = name[several], row[several], key[several]
                if len(name):
                    edges, length = _groups(name >> 32)
                    out += [packet(int(name[a] >> 32), True, row[a : a + n], key[a : a + n]) for a, n in zip(edges.tolist(), length.tolist(), strict=True)]
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["deal", "bucket", "known", "rows", "at", "keys"])

    return run


_REPLY = "row long, bucket int, keys binary"


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its anchors that are in others too; buckets come one after the other."""
    waiting: list[tuple[np.ndarray, np.ndarray, bool]] = []
    last = None

    def close(bucket: int) -> pa.RecordBatch:
        key, row = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
        known = np.repeat([w[2] for w in waiting], [len(w[0]) for w in waiting])
        waiting.clear()
        order = np.lexsort((row, key))
        key, row, known = key[order], row[order], known[order]
        first, size = _groups(key)
        least, most = row[first], row[first + size - 1]
        shared = known | np.repeat(least < most, size)
        key, row = key[shared], row[shared]
        order = np.argsort(row, kind="stable")
        key, row = key[order], row[order]
        first, size = _groups(row) if len(row) else (row, row)
        keys = [key[a : a + n].tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(row[first] if len(row) else row, pa.int64()), pa.array(np.full(len(keys), bucket), pa.int32()), pa.array(keys, pa.binary())], names=["row", "bucket", "keys"])

    for batch in batches:
        for bucket, known, rows, at, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if waiting and bucket != last:
                yield close(last)
            last = bucket
            waiting.append((np.frombuffer(keys, dtype=np.uint32), np.frombuffer(rows, dtype=np.int64)[np.frombuffer(at, dtype=np.uint16)], known))
    if waiting:
        yield close(last)


def _contexts(buckets: int):
    """The runs, with their bytes, of each row's shared anchors.

    Of equal runs in a batch those of larger ids are known to be repeats: they
    go on as spans (no bytes; ``s`` to ``doc``), dealt by row. So what many
    documents have reaches its anchor's task about once a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", MET):
            h, ctx, doc, row, s = [], [], [], [], []
            for k, name, t, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                wanted = np.concatenate([np.frombuffer(f["keys"], dtype=np.uint32).astype(np.int64) | np.int64(f["bucket"]) << np.int64(32) for f in found])
                hs, ss, ns = runs(np.frombuffer(t, dtype=np.uint8))
                bucket, key = _split(hs, buckets)
                take = np.flatnonzero(np.isin(bucket << np.int64(32) | key, wanted))
                h.append(hs[take])
                s.append(ss[take])
                doc.append(np.full(len(take), k))
                row.append(np.full(len(take), name))
                ctx += [t[a : a + b + LENGTH - 1] for a, b in zip(ss[take].tolist(), ns[take].tolist(), strict=True)]
            anchor, docs, rows, place = (np.concatenate(x) for x in (h, doc, row, s))
            least: dict[bytes, int] = {}
            for t, d in zip(ctx, docs.tolist(), strict=True):
                if d < least.setdefault(t, d):
                    least[t] = d
            first = np.fromiter(map(least.__getitem__, ctx), np.int64, len(ctx))
            again = docs > first
            width = np.fromiter(map(len, ctx), np.int64, len(ctx))
            held = pa.array([None if x else t for x, t in zip(again.tolist(), ctx, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.where(again, rows, anchor), pa.int64()), held, pa.array(np.where(again, place + width, docs), pa.int64()), pa.array(rows, pa.int64()), pa.array(place.astype(np.int32))], names=["h", "bytes", "doc", "row", "s"])

    return run


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeats from runs sorted by anchor, bytes and doc."""
    texts: list[bytes] = []  # different runs that wait, with their document, and row and place
    docs: list[int] = []
    places: list[list[tuple[int, int]]] = []
    size = 0
    last_h = None
    out: list[tuple[int, int, int]] = []

    def sort() -> None:
        for rep, where, t in zip(repeats(texts, docs), places, texts, strict=True):
            if rep.any():
                on = np.flatnonzero(np.diff(np.concatenate(([0], rep.view(np.int8), [0]))))
                for a, b in zip(on[0::2].tolist(), on[1::2].tolist(), strict=True):
                    out.extend((w, s + a, s + b + LENGTH - 1) for w, s in where)
        texts.clear()
        docs.clear()
        places.clear()

    def flush() -> pa.RecordBatch:
        got = np.array(out, dtype=np.int64).reshape(-1, 3)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1].astype(np.int32)), pa.array(got[:, 2].astype(np.int32))], names=["row", "a", "b"])

    for batch in batches:
        for h, t, d, w, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t is None:  # a span already
                out.append((w, s, d))
                continue
            if h != last_h or not texts:
                if size > CHUNK:
                    sort()
                    size = 0
                last_h, new = h, True
            else:
                new = t != texts[-1]
            if new:
                texts.append(t)
                docs.append(d)
                places.append([(w, s)])
                size += len(t)
            elif d == docs[-1]:
                places[-1].append((w, s))
            else:  # the same run in a larger document: all of it is a repeat
                out.append((w, s, s + len(t)))
        if len(out) > 20_000:
            yield flush()
    if texts:
        sort()
    if out:
        yield flush()


def firsts(rows: DataFrame) -> DataFrame:
    """``row, first``: the row of the least id among those of an equal text."""
    least = rows.select("doc", _digest("text").alias("key")).groupBy("key").agg(F.min("doc").alias("doc"))
    return written(least.select(F.xxhash64("doc", "key").alias("row"), F.lit(True).alias("first")), "firsts")


def repeated_spans(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``row, spans``: byte spans (``a`` to ``b``, not merged) of the ``first`` rows' repeats."""
    buckets = partitions(rows.sparkSession)
    own = rows.join(first.hint("shuffle_hash"), "row", "left_semi").select("doc", "row", "text")
    packets = map_arrow(own, _packets(buckets), _PACKET).repartition(buckets, "deal").sortWithinPartitions("bucket").drop("deal")
    by_row = map_arrow(packets, _replies, _REPLY).groupBy("row").agg(F.collect_list(F.struct("bucket", "keys")).alias("found"))
    met = own.join(by_row, "row").select("doc", "row", "text", "found")
    contexts = map_arrow(met, _contexts(buckets), "h long, bytes binary, doc long, row long, s int")
    sorted_runs = contexts.repartition("h").sortWithinPartitions("h", "bytes", "doc", "s")
    return map_arrow(sorted_runs, _found, "row long, a int, b int").groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))


def _row(id_col: str, text_col: str) -> Column:
    """A row's name, 64 bits of its id and its text's digest: only rows that are equal in both share it."""
    return F.xxhash64(_doc(id_col), _digest(text_col))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_doc(id_col).alias("doc"), _row(id_col, text_col).alias("row"), text_or_empty(text_col).alias("text"))


def _spans(value, first: bool, size: int) -> tuple[np.ndarray, np.ndarray]:
    if not first:  # a smaller id has the whole text
        whole = np.arange(1 if size >= LENGTH else 0)
        return whole * 0, whole * 0 + size
    if not value.is_valid:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = (x.to_numpy().astype(np.int64) for x in value.values.flatten())
    return union(a, b)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            n, gone, count, sha = [], [], [], []
            for t, spans, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                first, end = _spans(spans, own, len(t))
                digest, at = hashlib.sha256(), 0
                for a, b in zip(first.tolist(), end.tolist(), strict=True):
                    digest.update(t[at:a])
                    at = b
                digest.update(t[at:])
                n.append(len(t))
                gone.append(int((end - first).sum()))
                count.append(len(first))
                sha.append(digest.hexdigest())
            keys = pa.array([None if k == _NULL_ID else k for k in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(sha, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _rows(docs, id_col, text_col)
    own = firsts(rows)
    rows = rows.join(own.hint("shuffle_hash"), "row", "left").join(repeated_spans(rows, own), "row", "left").select("doc", "text", "spans", "first")
    return map_arrow(rows, run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of ``text_col``, all other columns as they were.

    A character that a span cuts in two stays whole, so texts remain valid.
    """

    def cut(texts: pd.Series, spans: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for t, s, first in zip(texts, spans, own, strict=True):
            data = b"" if t is None else t.encode("utf-8", "surrogatepass")
            if not first and len(data) >= LENGTH:  # a smaller id has the whole text
                out.append("")
                continue
            if s is None or not len(s) or t is None:
                out.append(t)
                continue
            pairs = np.array([(x["a"], x["b"]) for x in s], dtype=np.int64)
            parts, at = [], 0
            for a, b in zip(*(x.tolist() for x in union(pairs[:, 0], pairs[:, 1])), strict=True):
                while a < b and data[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(data[at:a])
                at = b
            out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    rows = _rows(docs, id_col, text_col)
    own = firsts(rows)
    spans = repeated_spans(rows, own).select(F.col("row").alias("__key"), F.col("spans").alias("__spans"))
    joined = docs.withColumn("__key", _row(id_col, text_col)).join(own.select(F.col("row").alias("__key"), F.col("first").alias("__first")), "__key", "left").join(spans, "__key", "left")
    return joined.withColumn(text_col, F.pandas_udf(cut, "string")(text_col, "__spans", F.coalesce("__first", F.lit(False)))).select(*docs.columns)
