"""Document fingerprints: homomorphic multiset hash of paragraphs.

Every paragraph (a non-empty line) is hashed to a wide vector; a document's
fingerprint is the sum of its paragraphs' vectors, each lane modulo a power of
two. The sum doesn't depend on order, and a paragraph is inserted or deleted by
adding or subtracting its vector. A vector has two parts:

* 8 lanes modulo 2**64 from a 512-bit hash of the paragraph's bytes. They
  decide equality of the multisets.
* 128 lanes modulo 2**32 in which every word, with the two words that follow
  it in the paragraph, adds or subtracts one. Small entries keep the lanes
  comparable: the cosine of two documents' lanes estimates the share of text
  they have in common. A lane would wrap at 2**31 words of one sign only.

Defined results: a null or empty text has the zero fingerprint; two zero
fingerprints are alike (1.0); equal texts have equal fingerprints and likeness
1.0; documents with one id are ordered by text; null ids come last and have no
numeric place; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, mix64, partitions, pieces, text_or_empty, word_hashes
from rasterloom.session import ship

EXACT, LIKE = 8, 128
_PIECE = 2 << 20


def _paragraphs(text: str) -> list[bytes]:
    return [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p.strip()]


def exact_lanes(paragraph: bytes) -> np.ndarray:
    """The lanes modulo 2**64 of one paragraph."""
    return np.frombuffer(hashlib.blake2b(paragraph, digest_size=64).digest(), dtype="<u8")


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes modulo 2**64 (n x 8) and modulo 2**32 (n x 128) of many texts."""
    n = len(texts)
    exact, like = np.zeros((n, EXACT), dtype=np.uint64), np.zeros((n, LIKE), dtype=np.int64)
    start = 0
    while start < n:
        paragraphs, owner, size, stop = [], [], 0, start
        while stop < n and (size < _PIECE or stop == start):
            own = _paragraphs(texts[stop])
            paragraphs += own
            owner += [stop] * len(own)
            size += sum(map(len, own))
            stop += 1
        start = stop
        if not paragraphs:
            continue
        doc = np.array(owner)
        digest = np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=64).digest() for p in paragraphs]), dtype="<u8").reshape(-1, EXACT)
        np.add.at(exact, doc, digest)
        lengths = np.array([len(p) + 1 for p in paragraphs])
        buf = np.frombuffer(b"\n".join(paragraphs) + b"\n", dtype=np.uint8)
        begin, _, words = word_hashes(buf)
        of = np.searchsorted(np.cumsum(lengths), begin, side="right")
        # a word with the two after it, zero beyond the paragraph's end
        pad, own = np.zeros(2, dtype=np.uint64), np.concatenate((of, [-1, -1]))
        words = np.concatenate((words, pad))
        second = np.where(own[1:-1] == of, words[1:-1], np.uint64(0))
        third = np.where(own[2:] == of, words[2:], np.uint64(0))
        h = mix64(words[:-2] * np.uint64(3) + mix64(second + np.uint64(0x9E3779B97F4A7C15)) + third * np.uint64(0xC2B2AE3D27D4EB4F))
        lane = (h >> np.uint64(57)).astype(np.int64)
        sign = 1 - 2 * (h >> np.uint64(56) & np.uint64(1)).astype(np.int64)
        cell = doc[of] * LIKE + lane
        like += np.bincount(cell, sign, n * LIKE).astype(np.int64).reshape(n, LIKE)
    return exact, like.astype(np.uint32)


def to_text(exact: np.ndarray, like: np.ndarray) -> str:
    """A fingerprint as hexadecimal text."""
    return (exact.astype("<u8").tobytes() + like.astype("<u4").tobytes()).hex()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The lanes of a fingerprint's text."""
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: EXACT * 8], dtype="<u8").copy(), np.frombuffer(raw[EXACT * 8 :], dtype="<u4").copy()


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    exact, like = fingerprints([text or ""])
    return to_text(exact[0], like[0])


def add(a: str, b: str) -> str:
    """The fingerprint of two documents' paragraphs together: insertion."""
    (x, u), (y, v) = from_text(a), from_text(b)
    return to_text(x + y, u + v)


def subtract(a: str, b: str) -> str:
    """The fingerprint of ``a`` without the paragraphs of ``b``: deletion."""
    (x, u), (y, v) = from_text(a), from_text(b)
    return to_text(x - y, u - v)


def likeness_of(exact_a: np.ndarray, like_a: np.ndarray, exact_b: np.ndarray, like_b: np.ndarray) -> np.ndarray:
    """Likeness, 0 to 1, of rows of lanes: 1 for equal fingerprints, else the lanes' cosine."""
    a, b = like_a.astype(np.int32).astype(np.float64), like_b.astype(np.int32).astype(np.float64)
    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    cosine = np.clip((a * b).sum(axis=1) / np.where(norm > 0, norm, 1), 0, 1)
    equal = (exact_a == exact_b).all(axis=1) & (like_a == like_b).all(axis=1)
    return np.where(equal, 1.0, cosine)


def edited(text: str, after: str) -> str:
    """The last half of a text (rounded down) replaced by the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def bounds_of(docs: DataFrame, id_col: str) -> list[float]:
    """Ids that cut the table into about as many even ranges as there are partitions."""
    n = partitions(docs.sparkSession)
    cuts = docs.select(F.col(id_col).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return sorted(set(cuts))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by ranges of ids so that every row meets the next one.

    Returns ``k, text, part, ghost``, sorted inside partitions by descending
    id. A range's last row is followed by a copy (``ghost``) of the first row
    of the range below it; after the least id comes the greatest. The driver
    sees two numbers a partition, never texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_or_empty(text_col).alias("text"))
    cuts = bounds_of(docs, id_col)
    ship(docs.sparkSession)

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        places = np.searchsorted(np.array(cuts), k.fillna(-(2**63)).to_numpy(dtype="float64"), side="left")
        return pd.Series(places.astype("int32"))

    dealt = rows.withColumn("part", part_of("k"))
    tops = {r.part: r.top for r in rows.select("k").withColumn("part", part_of("k")).groupBy("part").agg(F.max("k").alias("top")).collect()}
    order = sorted(tops)
    # the row with the greatest id of a range follows the range above it
    above = {p: order[(i + 1) % len(order)] for i, p in enumerate(order)}
    if order:
        goes = F.create_map(*[F.lit(x) for p in order for x in (p, above[p])])
        top = F.create_map(*[F.lit(x) for p in order for x in (p, -(2**63) if tops[p] is None else tops[p])])
        is_top = F.coalesce(F.col("k"), F.lit(-(2**63))) == top[F.col("part")]
        copies = F.when(is_top, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost")), F.struct(goes[F.col("part")].alias("part"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))))
        dealt = dealt.select("k", "text", F.explode(copies).alias("to")).select("k", "text", "to.part", "to.ghost")
    else:
        dealt = dealt.withColumn("ghost", F.lit(False))
    return dealt.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "ghost", F.col("k").desc_nulls_last(), "text")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document.

    One shuffle by ranges of ids; a worker holds a few MB of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for the next: id, text
        part = None
        closed = False

        def rows(keys: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
            changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
            a = fingerprints([*texts, following[-1]])
            b = fingerprints(changed)
            # the next row's lanes are at hand, except after a range's end
            c = (np.roll(a[0], -1, axis=0)[:-1], np.roll(a[1], -1, axis=0)[:-1])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array([to_text(x, y) for x, y in zip(a[0][:-1], a[1][:-1], strict=True)]), pa.array([to_text(x, y) for x, y in zip(*b, strict=True)]), pa.array(likeness_of(a[0][:-1], a[1][:-1], *b)), pa.array(likeness_of(a[0][:-1], a[1][:-1], *c))],
                names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in pieces(batches, "text", 4 << 20):
            keys, texts, following = [], [], []
            for k, text, p, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if keys:  # a range has ended and its rows are complete
                        yield rows(keys, texts, following)
                        keys, texts, following = [], [], []
                    part, held, closed = p, None, False
                if closed:
                    continue  # ties at a range's top: the first copy is the next
                if held is not None:
                    keys.append(held[0])
                    texts.append(held[1])
                    following.append(text)
                held, closed = (k, text), ghost
            if keys:
                yield rows(keys, texts, following)

    return map_arrow(with_next(docs, id_col, text_col).select("k", "text", "part", "ghost"), run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
