"""Token-id files: an adaptive context-mixing range coder in independent blocks.

A file's head has its ids with their frequencies, which is what order 0 says,
and a checksum. The ids are cut into blocks, each with a checksum of its own;
all start from the head and from nothing else. In a block an id is coded as a
hit or a miss of a guess: the id that order 2 (it last followed the two before
it) or order 1 (it last followed the one before it) names, whichever has been
surer. The chance of a hit is a logistic mixture of a vote of each order: how
sure orders 2 and 1 are, whether they agree, and how frequent order 0 knows the
guess to be; the votes learn from every id's error. A missed id takes its share
of the range by order 0. All arithmetic is on integers, so every machine
decodes what another has encoded.

Blocks don't depend on each other: those of a file advance together, an id at
a time, in numpy; a damaged block is found by its checksum and costs no other,
a damaged head costs the file.

Defined results: a null text counts as empty and has the end id alone; rows
with one id are ordered by text; null ids come first; ids must be below 2**17;
other columns are ignored; an empty table gives an empty table. A worker holds
the ids of one file (``chunk`` bytes of text, more if one text is longer).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm.common import fresh_path, map_arrow, mix64, partitions, pieces, text_bytes, text_or_empty

BLOCK = 2048
#: Blocks that advance together.
LANES = 4096
MAGIC, HEAD_MAGIC = b"RLB2", b"RLH2"
_BLOCK_HEAD = struct.Struct("<4sIII")  # magic, ids, payload bytes, crc32 of the ids
_FILE_HEAD = struct.Struct("<4sIII")  # magic, different ids, packed bytes, crc32 of the packed bytes

#: An entry of the tables of orders 1 and 2: how sure it is, above the place of the id it predicts.
_ID_BITS = 17
_ID_MASK = (1 << _ID_BITS) - 1
_STEP = 1 << _ID_BITS
#: Slots of the tables of orders 1 and 2.
_SLOT_BITS = 10
_SLOTS, _SLOT_MASK = 1 << _SLOT_BITS, (1 << _SLOT_BITS) - 1
_0, _1, _16, _32, _BOTTOM = (np.uint64(x) for x in (0, 1, 16, 32, 1 << 32))
_ONE, _LIMIT = 1 << 16, 2047
#: Sums of votes (units of 1/256) to 16-bit chances.
_SQUASH = np.array([min(65280, max(64, round(_ONE / (1 + exp(-x / 256))))) for x in [*range(_LIMIT + 1), *range(-_LIMIT, 0)]], dtype=np.int64)


class _Start:
    """What all blocks of a file start from: its ids, most frequent first, and their shares of the range.

    Shares sum to ``1 << bits``; each id has one at least.
    """

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids.astype(np.int64), counts.astype(np.int64)
        n, total = len(ids), int(self.counts.sum())
        self.bits = 16 if n <= 4096 else 19
        spare = (1 << self.bits) - n
        share = 1 + self.counts * spare // max(total, 1)
        share[:1] += (1 << self.bits) - share.sum()
        self.share = share.astype(np.uint64)
        self.first = (np.cumsum(share) - share).astype(np.uint64)
        # how frequent an id is, in 16 classes; ids of no place (nothing predicted yet) are in the last
        classes = np.full(_ID_MASK + 1, 15, dtype=np.int64)
        classes[:n] = np.minimum(14, self.bits - np.floor(np.log2(share)).astype(np.int64))
        self.classes = classes

    def places(self) -> np.ndarray:
        """The place of the id that each part of the range names."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint16 if len(self.ids) < 1 << 16 else np.int32), self.share.astype(np.int64))

    def pack(self) -> bytes:
        """The file's head, with its checksum."""
        order = np.argsort(self.ids)
        ids = np.diff(self.ids[order], prepend=0)
        packed = zlib.compress(np.concatenate((ids, self.counts[order])).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 6)
        return _FILE_HEAD.pack(HEAD_MAGIC, len(ids), len(packed), zlib.crc32(packed)) + packed

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray) -> _Start:
        """From ascending ids and how often each occurs."""
        order = np.argsort(-counts.astype(np.int64), kind="stable")
        return cls(ids[order], counts[order])

    @classmethod
    def unpack(cls, data: bytes) -> tuple[_Start, int]:
        """The start of a file and where its blocks begin; damage raises ``ValueError``."""
        if len(data) < _FILE_HEAD.size:
            raise ValueError("a file without a head")
        magic, n, size, crc = _FILE_HEAD.unpack_from(data)
        packed = data[_FILE_HEAD.size : _FILE_HEAD.size + size]
        if magic != HEAD_MAGIC or len(packed) < size or zlib.crc32(packed) != crc:
            raise ValueError("the file's head doesn't match its checksum")
        both = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, 2 * n).T.copy().view("<u4").ravel().astype(np.int64)
        return cls.of(np.cumsum(both[:n]), both[n:]), _FILE_HEAD.size + size


class _Model:
    """What the blocks of a batch have learned so far, a lane each.

    An id is coded as a hit of the guess or a miss. The guess is the id that
    order 2 or order 1 predicts, whichever is surer. Its chance is a logistic
    mixture: each of the orders 2, 1 and 0 has a vote, chosen by how sure it
    is, whether the two agree, and how frequent the guess is; the votes learn
    from each id's error.
    """

    def __init__(self, lanes: int, classes: np.ndarray):
        row = np.arange(lanes, dtype=np.int64)
        self.classes = classes
        self.slot0, self.vote0 = row << _SLOT_BITS, row << 5
        self.next1, self.next2 = (np.full(lanes << _SLOT_BITS, _ID_MASK, dtype=np.int32) for _ in range(2))
        self.votes = [np.zeros(lanes << 5, dtype=np.int16) for _ in range(3)]
        for sure in range(16):  # order 2 and order 1 start from a plain guess of what being sure means
            self.votes[2].reshape(lanes, 32)[:, 2 * sure : 2 * sure + 2] = -500 + 130 * min(sure, 6)
            self.votes[1].reshape(lanes, 32)[:, 2 * sure : 2 * sure + 2] = -250 + 40 * min(sure, 6)
        self.votes[0].reshape(lanes, 32)[:, 15] = -900
        self.before = np.zeros(lanes, dtype=np.int64)
        self.hashed, self.hashed2 = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The guessed place and its chance in 16 bits."""
        at1 = self.before & _SLOT_MASK
        at1 += self.slot0
        at2 = self.hashed * 5
        at2 += self.hashed2
        at2 >>= 10
        at2 &= _SLOT_MASK
        at2 += self.slot0
        e1, e2 = self.next1.take(at1).astype(np.int64), self.next2.take(at2).astype(np.int64)
        self.at1, self.at2, self.e1, self.e2 = at1, at2, e1, e2
        self.p1, self.p2 = e1 & _ID_MASK, e2 & _ID_MASK
        guess = e2 + 2 * _STEP  # of two that are alike sure, the longer context
        np.maximum(guess, e1, out=guess)
        guess &= _ID_MASK
        agree = self.vote0 + (self.p1 == self.p2)
        v0, v1, v2 = self.classes.take(guess), e1 >> _ID_BITS, e2 >> _ID_BITS
        v0 += self.vote0
        v1 += v1
        v1 += agree
        v2 += v2
        v2 += agree
        self.at = (v0, v1, v2)
        self.x = x0, x1, x2 = self.votes[0].take(v0), self.votes[1].take(v1), self.votes[2].take(v2)
        total = x0 + x1
        total += x2
        np.minimum(total, _LIMIT, out=total)
        np.maximum(total, -_LIMIT, out=total)
        self.chance = _SQUASH.take(total)  # negative sums count from the table's end
        return guess, self.chance

    def learn(self, now: np.ndarray, hit: np.ndarray) -> None:
        """Take in the place of every lane's id; lanes that have ended may learn anything."""
        error = hit * _ONE
        error -= self.chance
        error >>= 11
        error = error.astype(np.int16)
        for table, at, x in zip(self.votes, self.at, self.x, strict=True):
            x += error
            table[at] = x
        for table, at, e, p in ((self.next1, self.at1, self.e1, self.p1), (self.next2, self.at2, self.e2, self.p2)):
            # a step surer if right, else less sure; where nothing is left, the id takes the place
            right = (p == now).astype(np.int64)
            right <<= _ID_BITS + 1
            right -= _STEP
            e += right
            gone = e >> 63
            p ^= now  # e's low bits are p
            p &= gone
            gone &= _STEP
            e += gone
            e ^= p
            np.right_shift(e, _ID_BITS + 4, out=gone)
            gone <<= _ID_BITS
            e -= gone
            table[at] = e.astype(np.int32)
        self.hashed2 = self.hashed
        self.hashed = now * 40503
        self.before = now


def _blocks_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of ``BLOCK`` ids by column, longest first, and their sizes."""
    lanes = -(-len(ids) // BLOCK)
    padded = np.zeros(lanes * BLOCK, dtype=np.int64)
    padded[: len(ids)] = ids
    size = np.minimum(BLOCK, len(ids) - np.arange(lanes) * BLOCK)
    return np.ascontiguousarray(padded.reshape(lanes, BLOCK).T[: int(size.max(initial=0))]), size


def encode_blocks(start: _Start, places: np.ndarray) -> list[bytes]:
    """Payloads of the blocks of ``places`` (ids as places in ``start``)."""
    grid, size = _blocks_of(places)
    lanes = len(size)
    m = _Model(lanes, start.classes)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    out, used = np.zeros((BLOCK * 3 // 2 + 8) * lanes, dtype=np.int64), np.arange(lanes) * (BLOCK * 3 // 2 + 8)
    begin, bits = used.copy(), np.uint64(start.bits)
    least = int(size.min())
    for t in range(len(grid)):
        now = grid[t]
        guess, chance = m.predict()
        hit = guess == now
        miss = hit - _1  # all bits where the guess is wrong
        unit = width >> _16
        unit *= chance.view(np.uint64)
        rest = width - unit
        rest >>= bits
        add = start.first.take(now)
        add *= rest
        add += unit
        add &= miss
        rest *= start.share.take(now)
        rest ^= unit
        rest &= miss
        rest ^= unit
        if t >= least:  # lanes that have ended stay as they are
            over = t >= size
            np.copyto(rest, width, where=over)
            np.copyto(add, _0, where=over)
        width = rest
        low += add
        over = low < add
        if over.any():
            out[used[over] - 1] += 1
        full = np.flatnonzero(width < _BOTTOM)
        if len(full):
            x = low.take(full)
            at = used.take(full)
            out[at] = (x >> _32).view(np.int64)
            at += 1
            used[full] = at
            x <<= _32
            low[full] = x
            width[full] = width.take(full) << _32
        m.learn(now, hit)
    for _ in range(2):
        out[used] = (low >> _32).view(np.int64)
        used += 1
        low <<= _32
    found = []
    for a, b in zip(begin.tolist(), used.tolist(), strict=True):
        words = out[a:b]
        while True:  # carries run to the front
            over = np.flatnonzero(words >> 32)
            if not len(over):
                break
            words[over] &= 0xFFFFFFFF
            words[over - 1] += 1
        found.append(words.astype("<u4").tobytes())
    return found


def decode_blocks(start: _Start, blocks: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The ids of blocks; a checksum that doesn't fit raises ``ValueError``."""
    lanes = len(blocks)
    size = np.array([n for n, _, _ in blocks])
    if size.max(initial=0) > BLOCK or any(len(p) % 4 for _, _, p in blocks):
        raise ValueError("a block of a wrong size")
    longest = max((len(p) // 4 for _, _, p in blocks), default=0) + 3
    words = np.zeros((lanes, longest), dtype="<u4")
    for i, (_, _, p) in enumerate(blocks):
        words[i, : len(p) // 4] = np.frombuffer(p, dtype="<u4")
    words = words.ravel().astype(np.uint64)
    begin = np.arange(lanes) * longest
    used = begin + 2
    code, width = words[begin] << _32 | words[begin + 1], np.full(lanes, 2**64 - 1, dtype=np.uint64)
    m, names = _Model(lanes, start.classes), start.places()
    bits, most = np.uint64(start.bits), np.uint64((1 << start.bits) - 1)
    out = np.zeros((int(size.max(initial=0)), lanes), dtype=np.int32)
    for t in range(len(out)):
        guess, chance = m.predict()
        unit = width >> _16
        unit *= chance.view(np.uint64)
        hit = code < unit
        miss = hit - _1  # all bits where the guess is wrong
        rest = width - unit
        rest >>= bits
        code -= unit & miss
        at = code // rest
        np.minimum(at, most, out=at)
        now = names.take(at.view(np.int64)).astype(np.int64)
        less = start.first.take(now)
        less *= rest
        less &= miss
        code -= less
        rest *= start.share.take(now)
        rest ^= unit
        rest &= miss
        rest ^= unit
        width = rest
        now ^= guess
        now &= miss.view(np.int64)
        now ^= guess
        few = np.flatnonzero(width < _BOTTOM)
        if len(few):
            at = used.take(few)
            x = code.take(few)
            x <<= _32
            x |= words.take(at, mode="clip")
            code[few] = x
            at += 1
            used[few] = at
            width[few] = width.take(few) << _32
        m.learn(now, hit)
        out[t] = now
    found = []
    got_ids = np.append(start.ids, 0).astype("<u4").take(np.ascontiguousarray(out.T), mode="clip")
    for i, (n, crc, _) in enumerate(blocks):
        got = got_ids[i, :n]
        if zlib.crc32(got.tobytes()) != crc:
            raise ValueError(f"block {i} doesn't match its checksum")
        found.append(got)
    return found


def split_blocks(data: bytes, at: int = 0) -> list[tuple[int, int, bytes]]:
    """Ids, checksum and payload of each block of a file, from byte ``at`` on."""
    found = []
    while at < len(data):
        if at + _BLOCK_HEAD.size > len(data):
            raise ValueError(f"no block at byte {at}")
        magic, n, size, crc = _BLOCK_HEAD.unpack_from(data, at)
        if magic != MAGIC or at + _BLOCK_HEAD.size + size > len(data):
            raise ValueError(f"no block at byte {at}")
        found.append((n, crc, data[at + _BLOCK_HEAD.size : at + _BLOCK_HEAD.size + size]))
        at += _BLOCK_HEAD.size + size
    return found


def encode_ids(ids: np.ndarray) -> bytes:
    """A file's bytes: its head, then the blocks of ``ids`` in order."""
    ids = np.asarray(ids, dtype=np.uint32)
    counts = np.bincount(ids, minlength=1)
    named = np.flatnonzero(counts)
    if len(counts) > 1 << _ID_BITS or len(named) >= _ID_MASK:
        raise ValueError(f"ids must be below 2**{_ID_BITS}, and not all of them in one file")
    start = _Start.of(named, counts[named])
    place = np.zeros(len(counts), dtype=np.int64)
    place[start.ids] = np.arange(len(start.ids))
    out = [start.pack()]
    for a in range(0, len(ids), BLOCK * LANES):
        part = ids[a : a + BLOCK * LANES]
        for i, payload in enumerate(encode_blocks(start, place[part])):
            own = part[i * BLOCK : (i + 1) * BLOCK]
            out += [_BLOCK_HEAD.pack(MAGIC, len(own), len(payload), zlib.crc32(own.astype("<u4").tobytes())), payload]
    return b"".join(out)


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of a file's bytes."""
    start, at = _Start.unpack(data)
    blocks = split_blocks(data, at)
    parts = [x for i in range(0, len(blocks), LANES) for x in decode_blocks(start, blocks[i : i + LANES])]
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


#: Fixed value: the pattern by which byte-level BPE cuts a text before merging.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words that a worker remembers, and characters of a word that is remembered.
KEEP, KEEP_CHARS = 1 << 20, 64
_PLACES = 1 << 21


def _classes() -> np.ndarray:
    """Class of each code point: 0 space, 1 letter, 2 number, 3 other."""
    points = np.arange(0x110000, dtype="<u4")
    points = points[(points < 0xD800) | (points > 0xDFFF)]
    every = points.tobytes().decode("utf-32-le")
    found = np.full(0x110000, 3, dtype=np.uint8)
    for k, kind in enumerate((r"\p{White_Space}+", r"\p{L}+", r"\p{N}+")):
        for m in regex.finditer(kind, every):
            found[points[m.start() : m.end()]] = k
    return found


def word_starts(points: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where ``_PATTERN`` begins a word; ``first`` are the starts of the texts that are not empty."""
    n = len(points)
    kind = classes[points]
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[first] = True
    runs = np.flatnonzero(new)
    runs = np.append(runs, n)
    begin, end, k = runs[:-1], runs[1:], kind[runs[:-1]]
    opens = np.zeros(n + 1, dtype=bool)
    opens[first] = True
    opens[n] = True
    # of spaces before something else, the last stands alone; a blank belongs to what follows
    space = np.flatnonzero((k == 0) & ~opens[end])
    last = end[space] - 1
    new[last] = True
    new[last[points[last] == 32] + 1] = False
    # contractions: an apostrophe that begins a word, and the letters that belong to it
    quote = np.flatnonzero((k == 3) & (points[begin] == 39) & (end - begin == 1) & ~opens[end] & new[begin])
    if len(quote):
        at = begin[quote]
        stop = np.where(quote + 1 < len(begin), end[np.minimum(quote + 1, len(end) - 1)], at)  # the letters' end
        one = points[np.minimum(at + 1, n - 1)]
        two = np.where(at + 2 < stop, points[np.minimum(at + 2, n - 1)], 0)
        size = np.where(np.isin(one, _codes("stmd")), 1, 0)
        for pair in ("re", "ve", "ll"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        at, size, stop = at[size > 0], size[size > 0], stop[size > 0]
        new[at + 1] = False
        cut = at + 1 + size
        new[cut[cut < stop]] = True
    return np.flatnonzero(new)


def _codes(text: str) -> list[int]:
    return [ord(c) for c in text]


class WordTokenizer:
    """The ``tokenizers`` library over a text's words, each different word encoded once.

    Byte-level BPE never merges across words, so a text's ids are those of its
    words in order. The words are found and looked up in numpy; the library
    encodes those not met before. Words are known by 64 bits of a hash; those
    of over ``KEEP_CHARS`` characters are encoded anew. Texts with added
    tokens go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # bytes of each id: a character of its name is a byte
        for name, i in vocab.items():
            self.width[i] = len(name)
        keys = np.random.Generator(np.random.PCG64(77)).integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(keys[0])
        self.inverse = pow(self.base, -1, 2**64)
        self.salt = keys[1]
        self.powers = self.back = np.ones(1, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.keys, self.values = np.zeros(_PLACES, dtype=np.uint64), np.zeros(_PLACES, dtype=np.int64)
        self.ids, self.n_ids, self.n = np.zeros(1 << 16, dtype=np.uint32), 0, 0

    def _hashes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(points)
        if len(self.powers) < n + 1:
            steps = np.full(n + 1, self.base, dtype=np.uint64), np.full(n + 1, self.inverse, dtype=np.uint64)
            for s in steps:
                s[0] = 1
            self.powers, self.back = (np.multiply.accumulate(s) for s in steps)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((points + self.salt) * self.powers[:n], out=sums[1:])
        h = mix64((sums[end] - sums[start]) * self.back[start] + (end - start).view(np.uint64) * self.salt)
        return np.maximum(h, np.uint64(1))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Values of known words, -1 for others."""
        found = np.full(len(h), -1, dtype=np.int64)
        todo, at = np.arange(len(h)), (h >> np.uint64(43)).view(np.int64)
        while len(todo):
            key = self.keys[at]
            hit = key == h[todo]
            found[todo[hit]] = self.values[at[hit]]
            more = ~hit & (key != 0)
            todo, at = todo[more], (at[more] + 1) & (_PLACES - 1)
        return found

    def _add(self, h: np.ndarray, value: np.ndarray) -> None:
        """Remember different words."""
        todo, at = np.arange(len(h)), (h >> np.uint64(43)).view(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[todo[free]]
            own = self.keys[at] == h[todo]
            self.values[at[own]] = value[todo[own]]
            todo, at = todo[~own], (at[~own] + 1) & (_PLACES - 1)
        self.n += len(h)

    def _store(self, ids: np.ndarray) -> int:
        """Append ids; returns where they begin."""
        at, self.n_ids = self.n_ids, self.n_ids + len(ids)
        if self.n_ids > len(self.ids):
            self.ids = np.concatenate((self.ids[:at], np.zeros(self.n_ids, dtype=np.uint32)))
        self.ids[at : self.n_ids] = ids
        return at

    def _encode_words(self, text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``start`` to ``end``, one after the other, and how many each has.

        Words go to the library in lines: one that begins with a blank may
        follow any other, a line break goes before the rest, and the ids'
        widths in bytes tell where words end. Words of spaces go alone.
        """
        counts = np.zeros(len(start), dtype=np.int64)
        parts: list[np.ndarray] = []
        places: list[np.ndarray] = []
        alone = self.classes[points[end - 1]] == 0
        blank = points[start] == 32
        widths = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), out=widths[1:])
        size = widths[end] - widths[start]
        words = [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        joined, left = np.flatnonzero(~alone), [np.flatnonzero(alone)]
        groups = [joined[i : i + 512] for i in range(0, len(joined), 512)]
        lines = ["".join([words[i] if b else "\n" + words[i] for i, b in zip(g.tolist(), blank[g].tolist(), strict=True)]) for g in groups]
        for g, e in zip(groups, self.library.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.cumsum(self.width[ids])
            stop = np.cumsum(size[g] + ~blank[g])
            last = np.minimum(np.searchsorted(ends, stop), len(ids) - 1)
            first = np.concatenate(([0], last[:-1] + 1)) + ~blank[g]
            if ends[-1] != stop[-1] or (ends[last] != stop).any() or (ends[first[first > 0] - 1] != (stop - size[g])[first > 0]).any():
                left.append(g)  # the line wasn't cut where its words end
                continue
            counts[g] = last + 1 - first
            keep = np.ones(len(ids), dtype=bool)
            keep[first[~blank[g]] - 1] = False
            parts.append(ids[keep])
            places.append(g)
        for g in left:
            for i, e in zip(g.tolist(), self.library.encode_batch_fast([words[i] for i in g.tolist()], add_special_tokens=False) if len(g) else (), strict=True):
                parts.append(np.array(e.ids, dtype=np.uint32))
                places.append(np.array([i]))
                counts[i] = len(e.ids)
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *parts])
        order = np.concatenate([np.zeros(0, dtype=np.int64), *places])
        # from the order of encoding to that of the words
        from_ = np.zeros(len(start), dtype=np.int64)
        from_[order] = np.cumsum(counts[order]) - counts[order]
        before = np.cumsum(counts) - counts
        return ids[np.repeat(from_ - before, counts) + np.arange(len(ids))], counts

    def encode_texts(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts that end at ``ends``, one after the other, and how many each has."""
        text = data.decode("utf-8", "surrogatepass")
        if any(t in text for t in self.added):
            starts = [0, *ends[:-1].tolist()]
            whole = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts, ends.tolist(), strict=True)]
            got = [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(whole, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, dtype=np.uint32), *got]), np.array([len(x) for x in got], dtype=np.int64)
        if not len(text):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(ends), dtype=np.int64)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if len(points) != len(data):  # ends in characters
            leads = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80, out=leads[1:])
            ends = leads[ends]
        begin = np.concatenate(([0], ends[:-1]))
        start = word_starts(points, self.classes, begin[begin < ends])
        end = np.append(start[1:], len(points))
        h = self._hashes(points, start, end)
        value = self._find(h)
        if self.n > KEEP:
            self.clear()
            value[:] = -1
        short = end - start <= KEEP_CHARS
        missing = np.flatnonzero((value < 0) & short)
        if len(missing):
            new, which, back = np.unique(h[missing], return_index=True, return_inverse=True)
            which = missing[which]
            ids, counts = self._encode_words(text, points, start[which], end[which])
            made = (self._store(ids) + np.cumsum(counts) - counts) << 16 | counts
            self._add(new, made)
            value[missing] = made[back]
        kept, long = self.n_ids, np.flatnonzero(~short)
        if len(long):
            ids, counts = self._encode_words(text, points, start[long], end[long])
            at = self._store(ids) + np.cumsum(counts) - counts
        else:
            at = counts = np.zeros(0, dtype=np.int64)
        first, size = value >> 16, value & 0xFFFF
        first[long], size[long] = at, counts
        before = np.cumsum(size) - size
        total = int(size.sum())
        ids = self.ids[np.repeat(first - before, size) + np.arange(total)]
        self.n_ids = kept
        upto = np.concatenate((before, [total]))[np.searchsorted(start, np.concatenate(([0], ends)))]
        return ids, np.diff(upto)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk: int = 8 << 20) -> str:
    """Encode the texts in ascending order of ids and write the files; returns their folder.

    A row of the folder's table is one file: its place (``part``, ``file``),
    the documents' ids and counts, and the coded blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), F.col("doc").asc_nulls_first()).sortWithinPartitions(F.col("doc").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        t = _tokenizer(path)
        held: list[pa.RecordBatch] = []
        size, file = 0, 0

        def emit() -> pa.RecordBatch:
            counts, parts, keys = [], [], []
            for b in held:
                keys.append(b.column(0))
                data, ends = text_bytes(b.column(1))
                ids, n = t.encode_texts(data, ends)
                at = np.cumsum(n + 1) - 1  # each document's end id
                own = np.full(len(ids) + len(n), end_id, dtype=np.uint32)
                body = np.ones(len(own), dtype=bool)
                body[at] = False
                own[body] = ids
                parts.append(own)
                counts.append(n + 1)
            ids = np.concatenate(parts)
            size = len(ids)
            docs = pa.ListArray.from_arrays(pa.array([0, sum(map(len, keys))], pa.int32()), pa.concat_arrays(keys))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([size], pa.int64()), docs, pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([encode_ids(ids)], pa.binary())], names=["part", "file", "n", "docs", "counts", "data"])

        for batch in pieces(batches, "text", 1 << 20):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= chunk:
                yield emit()
                held, size, file = [], 0, file + 1
        if held:
            yield emit()

    folder = fresh_path(spark, "tokens")
    map_arrow(ordered, run, "part int, file int, n long, docs array<long>, counts array<long>, data binary").write.parquet(folder)
    return folder


def read_tokens(spark, folder: str, id_col: str = "doc_id", values: bool = True) -> DataFrame:
    """``id_col, start, n_tokens`` and the ids (or their crc32) of every document, from the files."""
    files = spark.read.schema("part int, file int, n long, docs array<long>, counts array<long>, data binary").parquet(folder)
    kind = pa.list_(pa.int64()) if values else pa.int64()
    last = ("ids", "array<long>") if values else ("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, keys, counts, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_ids(data)
                ends = np.cumsum(counts).tolist()
                own = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                got = [x.astype(np.int64) for x in own] if values else [zlib.crc32(x.tobytes()) for x in own]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(keys, pa.int64()), pa.array([0, *ends[:-1]], pa.int64()), pa.array(counts, pa.int64()), pa.array(got, kind)], names=["part", "file", id_col, "inside", "n_tokens", last[0]])

    rows = map_arrow(files.select("part", "file", "docs", "counts", "data"), run, f"part int, file int, `{id_col}` long, inside long, n_tokens long, {last[0]} {last[1]}")
    sizes = files.select("part", "file", "n")
    # files in a part, then parts: a part is a partition of the writer, so there are few
    before = W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("m"))
    offsets = parts.select("part", F.coalesce(F.sum("m").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = sizes.select("part", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")).join(offsets, "part").select("part", "file", (F.col("base") + F.col("ahead")).alias("offset"))
    return rows.join(places, ["part", "file"]).select(id_col, (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", last[0])
