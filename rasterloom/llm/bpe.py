"""BPE encoding and decoding with a priority queue over linked symbols.

A word becomes a doubly linked list of symbols. A heap holds the rank of every
adjacent pair that the vocabulary merges; the least rank is taken, its pair is
joined, and the two new neighbours are queued. Entries whose symbols have
changed since are stale and are skipped when they come up. Decoding
concatenates the vocabulary's strings.

Defined results: a null text counts as empty and has no tokens; decoding no
tokens gives an empty text; repeated rows give repeated rows; columns other
than those named are ignored, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, pieces, text_or_empty


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in byte order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` format.

    It covers the file's normaliser (NFC, white space, lower case), its
    pre-tokenising pattern, the byte alphabet, an end-of-word suffix and the
    added tokens. ``keep`` bounds the words whose result is remembered.
    """

    def __init__(self, path: str, keep: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.names = {i: s for s, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.added.items()}
        # a pair's two ids in one number -> its rank and the id it becomes, in one number
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = rank + 1 << 20 | self.vocab[a + b]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next((p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"), None)
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        alphabet = byte_alphabet()
        self.first = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + self.suffix) for c in alphabet]
        self.keep, self.known = keep, {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to one word's symbols.

        A heap entry is rank, new id and place in one number, so entries of
        equal rank come up from left to right.
        """
        n = len(ids)
        find, shift = self.merges.get, 12 if n <= 4096 else 48
        place = (1 << shift) - 1
        heap = []
        a = ids[0]
        for i in range(1, n):
            b = ids[i]
            if m := find(a << 20 | b):
                heap.append(m << shift | i - 1)
            a = b
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids.append(-1)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & place
            m = find(ids[i] << 20 | ids[j := after[i]])
            if not m or (m ^ top >> shift) & 0xFFFFF:
                continue  # stale: one of the two has been merged meanwhile
            ids[i] = new = m & 0xFFFFF
            ids[j] = -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if m := find(new << 20 | ids[j]):
                    push(heap, m << shift | i)
            if (h := before[i]) >= 0 and (m := find(ids[h] << 20 | new)):
                push(heap, m << shift | h)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        """Token ids of one pre-tokenised word."""
        data = word.encode("utf-8", "surrogatepass")
        first = self.first
        ids = [first[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        return self.merge(ids) if len(ids) > 1 else ids

    def entry(self, word: str) -> tuple[str, str, int]:
        """A word's ids as text, its tokens as text and their count."""
        ids = self.word(word)
        names = self.names
        got = (" ".join(map(str, ids)), " ".join([names[i] for i in ids]), len(ids))
        if len(self.known) < self.keep and len(word) <= 64:
            self.known[word] = got
        return got

    def entries(self, text: str) -> list[tuple[str, str, int]]:
        """The entries of a text's words and added tokens, in order."""
        out: list = []
        known, entry = self.known, self.entry
        parts = self.special.split(text) if "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                i = self.added[part]
                out.append((str(i), part, 1))
                continue
            if self.nfc and not part.isascii():
                part = unicodedata.normalize("NFC", part)
            if self.lower:
                # the capital sigma has one lower case here, wherever it stands
                part = (part.replace("Σ", "σ") if "Σ" in part else part).lower()
            out += [known.get(w) or entry(w) for w in self.words.findall(part)]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text."""
        return [int(i) for e in self.entries(text or "") for i in e[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings of ``ids``, joined as the file's decoder does."""
        return " ".join(self.names[i] for i in ids)


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec per worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def _digests(path: str, id_col: str, text_col: str, values: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in pieces(batches, text_col, 4 << 20):
            n, ids_sha, dec_sha, ids, dec = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                e = c.entries(text)
                live = [x for x in e if x[2]]
                decoded = " ".join([x[1] for x in live])
                n.append(sum([x[2] for x in live]))
                if values:
                    ids.append([int(i) for x in live for i in x[0].split()])
                    dec.append(decoded)
                else:
                    ids_sha.append(hashlib.sha256(" ".join([x[0] for x in live]).encode()).hexdigest())
                    dec_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            last = [pa.array(ids, pa.list_(pa.int32())), pa.array(dec, pa.string())] if values else [pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
            names = [id_col, "n_tokens", *(("ids", "decoded") if values else ("ids_sha256", "decoded_sha256"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *last], names=names)

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", values: bool = True) -> DataFrame:
    """Encode every text and decode its ids again.

    ``values=True`` returns ``id_col, n_tokens, ids, decoded``; otherwise the
    SHA-256 of the decimal ids and of the decoded text in their place, made
    from the same ids without sending them to the JVM. One narrow pass: no
    shuffle, and a worker holds about 4 MB of text at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias(text_col))
    last = "ids array<int>, decoded string" if values else "ids_sha256 string, decoded_sha256 string"
    return map_arrow(rows, _digests(path, id_col, text_col, values), f"`{id_col}` {kind}, n_tokens long, {last}")
