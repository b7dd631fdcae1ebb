"""N-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. Sizes are cut
into bands so wide that linked sets lie in one band or in neighbouring ones;
for each band the largest symmetric difference k of two linked sets is known.
The feature domain is divided into parts, each into two sub-parts, of which
every subset of one is enumerated: a signature is the band, the part, the
chosen sub-part, and what the set has there. Each differing feature spoils one
signature at most, so with k + 1 + ``spare`` of them linked sets share more
than ``spare``.

A set drops its ``spare`` poorest signatures, by number of features and then
by value. What two sets share stands in one order for both, so each drops a
prefix of it and at least one stays shared; empty sub-parts, which many sets
would share, are the first to go.

Equal sets are one node from the start. Signatures are shuffled in packets of
five bytes each beside a count a node. In a bucket of one signature every node
is paired with the least one. A node keeps the parity of its features' number
in each of four to eight bins a feature: bins that differ are a lower bound of
the symmetric difference, so most unlinked pairs go without their texts being
read, and no linked one does. The others are checked exactly on the
documents' shingles: first each node with the least of its partners, then the
pairs that are still in different components. Buckets of three or more nodes
that aren't in one component are then compared by pairs of blocks, each pair
of blocks in a task of its own, by the bound alone; what passes is checked exactly too, so no link is lost.
Nodes are named by 64 bits of the set's hash (two sets in 2**64 would share a
name).

Defined results: null texts and texts without words have an empty set and link
with nothing; texts of fewer words than a shingle have one shingle, their
whole sequence; documents with one id and different texts are linked by their
id's name only in the result's ``component_id``, which is a least id; a null
id is never a least id unless alone; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, mix64, partitions, pieces, text_or_empty, word_hashes, written

#: Rows of a few numbers that may be broadcast; beyond it a join is shuffled.
BROADCAST_IDS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    sizes = np.array([len(t) + 1 for t in texts])
    buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    starts, _, h = word_hashes(buf)
    ends = np.searchsorted(starts, np.cumsum(sizes)).tolist()
    n = len(h)
    whole = h.copy()
    for i in range(1, words):
        whole[: n - i] = mix64(whole[: n - i] * np.uint64(0x9E3779B97F4A7C15) + h[i:]) if n > i else whole[:0]
    out, a = [], 0
    for b in ends:
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            x = h[a : a + 1] ^ np.uint64(0x5851F42D4C957F2D * (b - a) % 2**64)
            for i in range(a + 1, b):
                x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + h[i])
            out.append(x)
        else:
            out.append(h[:0])
        a = b
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; empty sets link with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@cache
def band_of(size: int, percent: int) -> tuple[int, int]:
    """Number and largest size of the band that holds ``size``; each is as wide as a link allows."""
    i, low = 0, 1
    while size > low * 100 // percent:
        i, low = i + 1, low * 100 // percent + 1
    return i, low * 100 // percent


@cache
def band_below(i: int, percent: int) -> tuple[int, int]:
    """Number and largest size of the band before band ``i``."""
    low = 1
    for _ in range(i - 1):
        low = low * 100 // percent + 1
    return i - 1, low * 100 // percent


@cache
def scheme(top: int, percent: int) -> tuple[int, int, int]:
    """k, number of sub-parts and spare for pairs whose smaller set has at most ``top`` features."""
    k = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
    cells = k + 3 + k // 3
    cells += cells % 2
    return k, cells, cells - k - 1


def signatures(features: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one set, for its own band and as the larger set for the band below."""
    i, top = band_of(len(features), percent)
    tops = [(i, top)]
    if i:
        tops.append(band_below(i, percent))
    value = mix64(features + np.uint64(0x632BE59BD9B4E019))
    out = []
    for band, top in tops:
        k, cells, spare = scheme(top, percent)
        if not k:
            continue  # only equal sets link, and those are one node
        # sub-parts 2j and 2j + 1 make up part j
        cell = ((features >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)
        sums = np.zeros(cells, dtype=np.uint64)
        np.add.at(sums, cell, value)
        held = np.bincount(cell, minlength=cells)
        place = np.arange(cells, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))
        sig = mix64(sums + mix64(place + np.uint64(0xD1B54A32D192ED03)))
        out.append(sig[np.lexsort((sig, held))[spare:]])
    return np.concatenate(out) if out else features[:0]


def parities(features: np.ndarray) -> bytes:
    """Whether an odd number of features lies in each bin; bins are a power of two, four a feature at least."""
    bins = 1 << max(6, (4 * len(features) - 1).bit_length())
    odd = np.bincount((features & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    """Parities in ``words`` times 64 bins."""
    x = np.frombuffer(bits, dtype=np.uint64)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(x: bytes, y: bytes, size: int, percent: int) -> bool:
    """False only for sets that don't link; ``size`` is the sum of theirs."""
    words = min(len(x), len(y)) // 8
    apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
    return apart * (100 + percent) <= (100 - percent) * size


def _node(features: np.ndarray) -> int:
    """A set's name: 64 bits over its features."""
    return int(mix64(np.array([np.add.reduce(mix64(features)) + np.uint64(len(features))], dtype=np.uint64)).view(np.int64)[0])


def _nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            sets = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()), pa.array([parities(s) if len(s) else b"" for s in sets], pa.binary())], names=["doc", "key", "n_shingles", "node", "bits"])

    return run


#: Signatures that a task gathers before it sends them in packets.
PACKED = 1 << 20
#: Nodes whose signatures a task remembers to have sent.
REMEMBER = 1 << 18


def _packets(words: int, percent: int, parts: int):
    """One row for each part of the signatures: their low 40 bits, grouped by node."""

    def packed(nodes: list[int], sigs: list[np.ndarray]) -> pa.RecordBatch:
        sig = np.concatenate(sigs)
        owner = np.repeat(np.arange(len(nodes)), [len(x) for x in sigs])
        part = ((sig >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, sig, owner = part[order], sig[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1]))))
        count = np.diff(np.concatenate((new, [len(part)]))).astype(np.int32)
        named = np.array(nodes, dtype=np.int64)[owner[new]]
        low, high = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sig >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8)
        here, at = np.unique(part, return_index=True)
        ends = [*at[1:].tolist(), len(part)]
        edge = np.searchsorted(new, [*at.tolist(), len(part)]).tolist()
        rows = list(zip(at.tolist(), ends, edge[:-1], edge[1:], strict=True))
        columns = ([low[a:b].tobytes() for a, b, _, _ in rows], [high[a:b].tobytes() for a, b, _, _ in rows], [named[c:d].tobytes() for _, _, c, d in rows], [count[c:d].tobytes() for _, _, c, d in rows])
        return pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["part", "low", "high", "nodes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        nodes: list[int] = []
        sigs: list[np.ndarray] = []
        size = 0
        for batch in pieces(batches, "text", 1 << 20):
            for s in shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), words):
                if not len(s) or (k := _node(s)) in sent:
                    continue
                if len(sent) >= REMEMBER:
                    sent.clear()
                sent.add(k)
                found = signatures(s, percent)
                if len(found):
                    nodes.append(k)
                    sigs.append(found)
                    size += len(found)
            if size >= PACKED:
                yield packed(nodes, sigs)
                nodes, sigs, size = [], [], 0
        if size:
            yield packed(nodes, sigs)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packets sorted by part: ``pivot, node`` of all buckets, and ``bucket, node`` of those of three nodes or more."""
    names = ["bucket", "pivot", "node"]

    def buckets(got: list[tuple[bytes, bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        low, high, node, count = (np.frombuffer(b"".join(x), dtype=t) for x, t in zip(zip(*got, strict=True), (np.uint32, np.uint8, np.int64, np.int32), strict=True))
        sig = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        node = np.repeat(node, count)
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        again = sig[1:] == sig[:-1]
        shared = np.concatenate((again, [False])) | np.concatenate(([False], again))
        sig, node = sig[shared], node[shared]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        if not len(sig):
            return
        # one row for a node of a bucket
        own = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[own], node[own]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        many = np.diff(np.concatenate((first, [len(sig)])))
        pair = np.repeat(many, many) > 1
        pivot = np.repeat(node[first], many)
        pair[first] = False
        a, b = pivot[pair], node[pair]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if len(a):
            own = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b = a[own], b[own]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], names=names)
        # buckets with the same nodes are one
        name = np.add.reduceat(mix64(node.view(np.uint64) + np.uint64(0x2545F4914F6CDD1D)), first).view(np.int64)
        _, at = np.unique(name, return_index=True)
        take = np.zeros(len(first), dtype=bool)
        take[at] = True
        take = np.repeat(take & (many > 2), many)
        if take.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, many)[take]), pa.nulls(int(take.sum()), pa.int64()), pa.array(node[take])], names=names)

    part, got = None, []
    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part and got:
                yield from buckets(got)
                got = []
            part = p
            got.append(row)
    if got:
        yield from buckets(got)


def _bounded(percent: int):
    """The pairs that the bound lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, x, y = (c.to_pylist() for c in batch.columns[2:])
            keep = pa.array([may_link(*v, percent) for v in zip(x, y, size, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return run


#: Least buckets that a node names, and pairs that are compared by them at once.
HEADS, AT_ONCE = 16, 1 << 15
#: Nodes of a bucket that make a block.
BLOCK = 1024
_LAST = 2**63 - 1


def _met_before(heads: np.ndarray, x: np.ndarray, y: np.ndarray, bucket: int) -> np.ndarray:
    """Which pairs ``x, y`` both name a bucket below this one, so that they are made there."""
    out = [np.zeros(0, dtype=bool)]
    for i in range(0, len(x), AT_ONCE):
        u, v = heads[x[i : i + AT_ONCE]], heads[y[i : i + AT_ONCE]]
        u = np.where(u < bucket, u, _LAST)
        out.append(((u[:, :, None] == v[:, None, :]) & (u[:, :, None] < _LAST)).any(axis=(1, 2)))
    return np.concatenate(out)


def _mixed(percent: int):
    """Pairs that may link of different labels in one bucket, from rows sorted by bucket and pair of blocks.

    A bucket of many nodes is cut into blocks; a group holds two of them (or
    one twice), so a bucket's comparisons are spread over tasks.

    Each node names its least buckets. A pair is left to the least bucket that
    both name; pairs whose shared buckets neither names so come from each of them.
    """

    def pairs(bucket: int, apart: bool, rows: list[tuple[int, int, int, bytes, list[int], int]]) -> Iterator[pa.RecordBatch]:
        block = np.array([r[5] for r in rows])
        heads = np.array([r[4] + [_LAST] * (HEADS - len(r[4])) for r in rows], dtype=np.int64)
        node, label, size = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
        words = min(len(r[3]) for r in rows) // 8
        bits = np.stack([folded(r[3], words) for r in rows])
        kinds, count = np.unique(label, return_counts=True)
        rare = label != kinds[count.argmax()]
        few = np.flatnonzero(rare)
        step = max(1, (1 << 21) // bits.size)
        for i in range(0, len(few), step):
            own = few[i : i + step]
            differ = np.bitwise_count(bits[own][:, None, :] ^ bits[None]).sum(axis=2, dtype=np.int64)
            ok = (differ * (100 + percent) <= (100 - percent) * (size[own][:, None] + size[None])) & (label[own][:, None] != label[None])
            if apart:  # pairs inside of one block are another group's
                ok &= block[own][:, None] != block[None]
            # of two rare nodes one leads
            ok &= ~rare[None] | (node[own][:, None] < node[None])
            x, y = np.nonzero(ok)
            x = own[x]
            new = ~_met_before(heads, x, y, bucket)
            x, y = x[new], y[new]
            if len(x):
                u, v = node[x], node[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for k, u, v, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, u, v) != group and rows:
                    yield from pairs(group[0], group[1] != group[2], rows)
                    rows = []
                group = (k, u, v)
                rows.append(row)
        if rows:
            yield from pairs(group[0], group[1] != group[2], rows)

    return run


def _check(words: int, percent: int):
    """The pairs that link, from texts sorted by ``a``, salt and role: that of ``a`` leads those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lead = None
        for batch in pieces(batches, "text", 1 << 20):
            a, b = [], []
            sets = shingle_sets(batch.column(4).cast(pa.binary()).to_pylist(), words)
            for k, salt, role, node, own in zip(*(c.to_pylist() for c in batch.columns[:4]), sets, strict=True):
                if not len(own) or _node(own) != node:
                    continue  # another text under the same id
                if not role:
                    at, lead = (k, salt), own
                elif at == (k, salt) and linked(lead, own, percent):
                    a.append(k)
                    b.append(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


#: Partners of one node that one group of texts holds.
PARTNERS = 256


def checked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct pairs ``a, b`` of nodes that link, by the shingles of one document of each.

    A text is shuffled once for each pair in which it is ``b``; that of ``a``
    once for each ``PARTNERS`` partners, so a node with many is dealt out. If
    the ids asked for are few enough they go to the texts; otherwise both
    sides are shuffled.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("groups"))
    salted = written(pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").alias("salt")), "salted")
    asked = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node"))
    asked = asked.union(salted.select("a", "salt", F.lit(0), "a").distinct())
    asked = written(asked.join(nodes.select("node", "key"), "node").select("a", "salt", "role", "node", "key"), "asked")
    few = asked.count() <= BROADCAST_IDS
    met = rows.join(F.broadcast(asked) if few else asked, "key").select("a", "salt", "role", "node", "text")
    met = met.repartition(partitions(rows.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")
    return written(map_arrow(met, _check(words, percent), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes of ``a, b`` edges: the least node that is reachable.

    Each round a node takes the least label around it, then the label of that
    label, so paths shorten by halves; rounds end when nothing changes.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = written(labels, "labels")
    # a node with many partners is a hot key of these joins, so labels are broadcast as long as they are few
    told = F.broadcast if labels.count() <= BROADCAST_IDS else (lambda x: x)
    while True:
        around = both.join(told(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        # the old label's node may now hang lower: its followers hang there too
        lower = hooked.filter("label < old").groupBy(F.col("old").alias("root")).agg(F.min("label").alias("root_label"))
        moved = hooked.join(told(lower), hooked["old"] == lower["root"], "left").select("node", "old", F.least("label", F.coalesce("root_label", "label")).alias("label"))
        jump = moved.select(F.col("node").alias("via"), F.col("label").alias("via_label"))
        step = written(moved.join(told(jump), moved["label"] == jump["via"], "left").select("node", "old", F.least("label", F.coalesce("via_label", "label")).alias("label")), "labels")
        changed = step.filter("label <> old").limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose nodes have different labels."""
    for k in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}")), k, "left")
    return pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _connect(pairs: DataFrame, edges: DataFrame | None, rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` with links among ``pairs``, and the labels of the components that all of ``pairs`` would give.

    Each node is checked with the least of its partners, then the pairs that this leaves apart are.
    """
    tried = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    found = checked(tried, rows, nodes, words, percent)
    edges = edges.union(found) if edges is not None else found
    labels = components(edges)
    left = written(_apart(pairs.join(tried, ["a", "b"], "left_anti"), labels), "left")
    if left.limit(1).count():
        edges = edges.union(checked(left, rows, nodes, words, percent))
        labels = components(edges)
    return edges, labels


def classes(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("doc", "text"))
    sets = written(map_arrow(rows, _nodes(words), "doc long, key long, n_shingles long, node long, bits binary"), "sets")
    by_id = F.struct(F.col("doc").isNull().alias("none"), "doc", "key")
    nodes = sets.filter("n_shingles > 0").groupBy("node").agg(F.min(by_id).alias("first"), F.count("*").alias("docs"), F.max("n_shingles").alias("n"), F.max("bits").alias("bits"))
    nodes = written(nodes.select("node", "first.doc", "first.key", "docs", "n", "bits"), "nodes")
    n = partitions(docs.sparkSession)
    packets = map_arrow(rows.select("text"), _packets(words, percent, n), "part int, low binary, high binary, nodes binary, counts binary")
    met = written(map_arrow(packets.repartition(n, "part").sortWithinPartitions("part"), _meet, "bucket long, pivot long, node long"), "met")
    pairs = met.filter("bucket IS NULL").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    own = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "bits_a", "bits_b")
    pairs = written(map_arrow(both, _bounded(percent), "a long, b long"), "pairs")
    edges, labels = _connect(pairs, None, rows, nodes, words, percent)
    # buckets of several components
    few = labels.count() <= BROADCAST_IDS
    members = met.filter("bucket IS NOT NULL").select("bucket", "node")
    members = members.join(F.broadcast(labels) if few else labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    several = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    several = written(members.join(several, "bucket", "left_semi").distinct(), "several")
    heads = several.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("bucket")), 1, HEADS).alias("heads"))
    # buckets of more than one block, which are few: at most a part in BLOCK of all rows
    big = written(several.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "big")
    told = F.broadcast(big) if big.count() <= BROADCAST_IDS else big
    cut = several.join(told, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), "blocks").cast("int"))
    cut = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"u": F.least("block", "with"), "v": F.greatest("block", "with")})
    dealt = cut.join(nodes.select("node", "n", "bits"), "node").join(heads, "node").select("bucket", "u", "v", "node", "label", "n", "bits", "heads", "block").repartition(n, "bucket", "u", "v").sortWithinPartitions("bucket", "u", "v")
    # a pair may still come from several buckets: it is made one before it meets the others
    rest = written(map_arrow(dealt, _mixed(percent), "a long, b long").distinct(), "found")
    rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        _, labels = _connect(rest, edges, rows, nodes, words, percent)
    low = nodes.join(labels, "node").groupBy("label").agg(F.min("doc").alias("component"))
    named_low = labels.join(low, "label").select("node", "component")
    own = written(nodes.join(named_low, "node", "left").select("node", "docs", F.coalesce("component", "doc").alias("component")), "components")
    # a set that many documents have is told to them by broadcast: those above an even share are few by their number
    least = max(1, (own.agg(F.sum("docs")).first()[0] or 0) // (4 * n))
    full = sets.filter("n_shingles > 0").join(F.broadcast(own.filter(F.col("docs") > least).select("node", F.col("component").alias("told"), F.lit(True).alias("hot"))), "node", "left")
    cold = full.filter("hot IS NULL").select("doc", "n_shingles", "node").join(own.filter(F.col("docs") <= least).select("node", "component"), "node").select("doc", "n_shingles", "component")
    full = full.filter("hot").select("doc", "n_shingles", F.col("told").alias("component")).union(cold)
    none = sets.filter("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component"))
    return full.union(none).select(F.col("doc").cast(kind).alias(id_col), "n_shingles", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those whose component has a smaller id; rows with one id stay or go together."""
    chosen = classes(docs, id_col=id_col, text_col=text_col, **options).filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    keep = chosen.select(F.col(id_col).alias("__keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi").select(*docs.columns)
