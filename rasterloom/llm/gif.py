"""GIF media columns: LZW, palettes, disposal, transparency, timed frames.

``decode`` reads any GIF87a or GIF89a stream: global and local palettes,
interlacing, transparent indices, the four disposal methods and delays. Each
frame becomes the whole canvas as RGBA at its start time, with a histogram of
16 bins a channel. ``encode`` stores frames of 8-bit indices losslessly.

Defined results: a null or undecodable media value gives no frames and a
message in ``media_error``; a stream cut short keeps what could be read, the
rest of its last frame staying at index 0; a null text counts as empty and is
stored as one frame of padding; equal inputs give equal outputs; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, pieces, text_or_empty

#: A stored text's frame is SIDE x SIDE samples, so a frame holds 576 bytes.
SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
DELAY_CS = 4
BINS = 16
#: Frames that are coded together.
LANES = 2048

_INDEX = np.arange(256)
#: Index i has red i, so that the samples can be read back from the colours.
STORE_PALETTE = np.stack([_INDEX, _INDEX * 73 % 256, _INDEX * 151 % 256], axis=1).astype(np.uint8)


def _widths(min_bits: int, n: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear: wider as the table fills."""
    free = (1 << min_bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.maximum(min_bits + 1, np.floor(np.log2(free)).astype(np.int64) + 1), 12)


_WIDTHS = {b: _widths(b, 8192) for b in range(2, 9)}
_STARTS = {b: np.concatenate(([0], np.cumsum(w)))[:-1] for b, w in _WIDTHS.items()}


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """LZW code stream of ``data``; a full table is cleared."""
    clear, widths = 1 << min_bits, _WIDTHS[min_bits]
    runs: list[list[int]] = []
    codes: list[int] = []
    grown: dict[int, int] = {}
    free, at = clear + 2, -1
    find = grown.get
    for c in data:
        if at < 0:
            at = c
            continue
        k = at << 8 | c
        e = find(k)
        if e is not None:
            at = e
            continue
        codes.append(at)
        if free == 4096:
            runs.append([*codes, clear])
            codes = []
            grown.clear()
            free = clear + 2
        else:
            grown[k] = free
            free += 1
        at = c
    if at >= 0:
        codes.append(at)
    runs.append([*codes, clear + 1])
    code = np.array([clear, *(c for r in runs for c in r)], dtype=np.int64)
    width = np.concatenate([[min_bits + 1], *(widths[: len(r)] for r in runs)])
    start = np.cumsum(width) - width
    size = int(start[-1] + width[-1] + 7) // 8
    byte, value = start >> 3, code << (start & 7)
    out = np.zeros(size + 3)
    for k in range(3):  # the bits of codes don't overlap, so sums are unions
        out += np.bincount(byte + k, value >> 8 * k & 255, size + 3)
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, min_bits: int, n: int) -> bytes:
    """At most ``n`` indices of an LZW code stream."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    if min_bits not in _WIDTHS:
        raise ValueError(f"LZW code size {min_bits}")
    widths, starts = _WIDTHS[min_bits], _STARTS[min_bits]
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    bits = len(stream) * 8
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    got, bit, seen, table, last = 0, 0, 0, roots.copy(), b""
    while got < n and bit < bits:
        # the codes up to the next clear have known places: read them at once
        if seen < 4096:
            offset, width = starts[seen : seen + 4096] - starts[seen], widths[seen : seen + 4096]
        else:
            offset, width = np.arange(4096) * 12, np.full(4096, 12)
        place = bit + offset
        fits = int(np.searchsorted(place + width, bits, side="right"))
        if not fits:
            break
        fits = min(fits, n - got + 2)
        place, width = place[:fits], width[:fits]
        byte = place >> 3
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (place & 7) & (1 << width) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        for c in codes[:stop].tolist():
            if c < len(table):
                e = table[c]
            elif last and c == len(table):
                e = last + last[:1]
            else:
                raise ValueError(f"LZW code {c} before it is defined")
            if last and len(table) < 4096:
                table.append(last + e[:1])
            out.append(e)
            got += len(e)
            last = e
        if stop == len(codes):
            seen += stop
            bit = int(place[-1] + width[-1])
        elif codes[stop] == end:
            break
        else:
            bit = int(place[stop] + width[stop])
            seen, table, last = 0, roots.copy(), b""
    return b"".join(out)[:n]


def lzw_encode_frames(samples: np.ndarray) -> list[bytes]:
    """LZW code streams of many frames of 8-bit samples, one frame a row.

    All frames advance together, a sample at a time. A frame's strings are in
    a hash table whose slots are overwritten when they meet: a decoder doesn't
    mind that the encoder forgets a string.
    """
    lanes, n = samples.shape
    if n > 3800:  # the table would fill
        return [lzw_encode(row.tobytes()) for row in samples]
    data = np.ascontiguousarray(samples.T.astype(np.int32))
    slots = 1024
    base = np.arange(lanes, dtype=np.int64) * slots
    keys, values = np.full(lanes * slots, -1, dtype=np.int32), np.zeros(lanes * slots, dtype=np.int32)
    codes = np.zeros((n + 2, lanes), dtype=np.int32)
    codes[0] = 256
    count = np.ones(lanes, dtype=np.int32)
    at = data[0]
    for t in range(1, n):
        c = data[t]
        key = at << 8 | c
        slot = base + ((key * np.int32(-1640531535) >> 13) & slots - 1)
        hit = keys[slot] == key
        miss = np.flatnonzero(~hit)
        where = slot[miss]
        emitted = count[miss]
        codes[emitted, miss] = at[miss]
        keys[where] = key[miss]
        at = np.where(hit, values[slot], c)
        values[where] = 257 + emitted
        count[miss] = emitted + 1
    lane = np.arange(lanes)
    codes[count, lane] = at
    count += 1
    full = np.empty((n + 3, lanes), dtype=np.int32)
    full[: n + 2] = codes
    full[count, lane] = 257
    count += 1
    used = np.arange(n + 3)[None, :] < count[:, None]
    code = full.T[used].astype(np.int64)
    width = np.concatenate(([9], _WIDTHS[8][: n + 2]))
    start = np.cumsum(width) - width
    size = (start[count - 1] + width[count - 1] + 7) // 8
    first = np.cumsum(size) - size
    index = np.nonzero(used)[1]
    bit = np.repeat(first * 8, count) + start[index]
    byte, value = bit >> 3, code << (bit & 7)
    total = int(size.sum())
    out = np.zeros(total + 3)
    for k in range(3):  # the bits of codes don't overlap, so sums are unions
        out += np.bincount(byte + k, value >> 8 * k & 255, total + 3)
    packed = out[:total].astype(np.uint8).tobytes()
    return [packed[a : a + b] for a, b in zip(first.tolist(), size.tolist(), strict=True)]


def lzw_decode_many(streams: list[bytes], min_bits: int, sizes: list[int]) -> list[bytes]:
    """``lzw_decode`` of many streams.

    Streams with one clear code, at their start, are taken together: a code's
    string is that of an earlier code and the sample after it, so lengths and
    samples follow from pointers that are doubled until they end. Others go
    to ``lzw_decode`` one by one.
    """
    out: list[bytes | None] = [None] * len(streams)
    clear = 1 << min_bits
    limit = 3800
    if streams and min_bits in _WIDTHS:
        widths = np.concatenate(([min_bits + 1], _WIDTHS[min_bits]))
        starts = np.concatenate(([0], min_bits + 1 + _STARTS[min_bits]))
        length = np.array([len(x) for x in streams], dtype=np.int64)
        data = np.frombuffer(b"".join(streams) + b"\0\0\0", dtype=np.uint8).astype(np.int32)
        first = np.cumsum(length) - length
        count = np.minimum(np.searchsorted(starts + widths, length * 8, side="right"), limit)
        lane = np.repeat(np.arange(len(streams)), count)
        head = np.cumsum(count) - count
        k = np.arange(len(lane)) - head[lane]
        bit = first[lane] * 8 + starts[k]
        byte = bit >> 3
        code = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (bit & 7).astype(np.int32)) & (1 << widths[k]).astype(np.int32) - 1
        stop = np.flatnonzero((code == clear + 1) | (code == clear) & (k > 0))
        ends, at = np.unique(lane[stop], return_index=True)
        last = np.full(len(streams), -1)
        last[ends] = k[stop[at]]
        starts_clear = np.zeros(len(streams), dtype=bool)
        starts_clear[count > 0] = code[head[count > 0]] == clear
        plain = starts_clear & (last > 1)
        plain[ends] &= code[stop[at]] == clear + 1
        keep = plain[lane] & (k > 0) & (k < last[lane])
        code, lane, k = code[keep], lane[keep], k[keep] - 1
        bad = (code >= clear) & (code - clear - 2 >= k)
        if bad.any():
            plain[lane[bad]] = False
            keep = plain[lane]
            code, lane, k = code[keep], lane[keep], k[keep]
        if len(code):
            here = np.arange(len(code))
            head = here - k  # place of the stream's first code
            copied = code >= clear
            source = np.where(copied, head + code - clear - 2, here)
            hops, to = copied.astype(np.int64), source
            while True:
                more = hops[to]
                if not more.any():
                    break
                hops, to = hops + more, to[to]
            size = hops + 1
            begin = np.cumsum(size) - size
            owner = np.repeat(here, size)
            to = np.arange(len(owner)) - np.repeat(begin - begin[source], size)
            while True:
                further = to[to]
                if np.array_equal(further, to):
                    break
                to = further
            text = code[owner[to]].astype(np.uint8).tobytes()
            lanes, at = np.unique(lane, return_index=True)
            bounds = [*begin[at].tolist(), len(owner)]
            for i, a, b in zip(lanes.tolist(), bounds[:-1], bounds[1:], strict=True):
                out[i] = text[a : min(b, a + sizes[i])]
    return [lzw_decode(s, min_bits, n) if x is None else x for x, s, n in zip(out, streams, sizes, strict=True)]


def _blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


_EXTENSION = b"\x21\xf9\x04" + bytes([1 << 2]) + DELAY_CS.to_bytes(2, "little") + b"\0\0"


def encode_many(samples: list[bytes], width: int = SIDE, height: int = SIDE, palette: np.ndarray = STORE_PALETTE) -> list[bytes]:
    """GIF89a streams whose frames of ``width`` x ``height`` indices are each ``samples`` in order."""
    size = width * height
    if any(not x or len(x) % size for x in samples):
        raise ValueError("samples must fill a positive number of frames")
    wh = width.to_bytes(2, "little") + height.to_bytes(2, "little")
    top = b"GIF89a" + wh + b"\xf7\0\0" + palette.tobytes()
    head = _EXTENSION + b"\x2c\0\0\0\0" + wh + b"\0\x08"
    rows = np.frombuffer(b"".join(samples), dtype=np.uint8).reshape(-1, size)
    streams = [x for i in range(0, len(rows), LANES) for x in lzw_encode_frames(rows[i : i + LANES])]
    out, at = [], 0
    for x in samples:
        n = len(x) // size
        out.append(b"".join([top, *(part for s in streams[at : at + n] for part in (head, _blocks(s))), b"\x3b"]))
        at += n
    return out


def encode(samples: bytes, width: int = SIDE, height: int = SIDE, palette: np.ndarray = STORE_PALETTE) -> bytes:
    """One GIF89a; see ``encode_many``."""
    return encode_many([samples], width, height, palette)[0]


def parse(media: bytes) -> tuple[int, int, list[dict]]:
    """Width, height and the images of a GIF with their control data and code streams."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("no GIF header")
    w, h = int.from_bytes(media[6:8], "little"), int.from_bytes(media[8:10], "little")

    def palette(flags: int, at: int) -> tuple[bytes | None, int]:
        n = 3 * (2 << (flags & 7)) if flags & 0x80 else 0
        return media[at : at + n] if n else None, at + n

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(media) and (n := media[at]):
            parts.append(media[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    common, at = palette(media[10], 13)
    images: list[dict] = []
    delay, disposal, hidden = 0, 0, -1
    while at < len(media) and (kind := media[at]) != 0x3B:
        if kind == 0x21:
            label = media[at + 1] if at + 1 < len(media) else 0
            data, at = blocks(at + 2)
            if label == 0xF9 and len(data) >= 4:
                disposal, delay = data[0] >> 2 & 7, int.from_bytes(data[1:3], "little") * 10
                hidden = data[3] if data[0] & 1 else -1
        elif kind == 0x2C and at + 10 <= len(media):
            x, y, fw, fh = (media[at + i] | media[at + i + 1] << 8 for i in (1, 3, 5, 7))
            flags = media[at + 9]
            own, pos = palette(flags, at + 10)
            colours = own if own is not None else common
            if colours is None:
                raise ValueError("a frame without a palette")
            if pos >= len(media):
                break
            data, at = blocks(pos + 1)
            images.append({"box": (x, y, fw, fh), "colours": colours, "bits": media[pos], "stream": data, "interlaced": flags & 0x40, "delay_ms": delay, "disposal": disposal, "hidden": hidden})
            delay, disposal, hidden = 0, 0, -1
        else:
            raise ValueError(f"unknown block {kind:#x}")
    return w, h, images


def compose(w: int, h: int, images: list[dict]) -> list[dict]:
    """The canvas after each image, by its palette, transparency and disposal."""
    canvas = np.zeros((h, w, 4), dtype=np.uint8)
    out, clock, tables = [], 0, {}
    for m in images:
        x, y, fw, fh = m["box"]
        if (table := tables.get(m["colours"])) is None:
            table = tables[m["colours"]] = np.zeros((256, 4), dtype=np.uint8)
            table[:, 3] = 255
            raw = np.frombuffer(m["colours"], dtype=np.uint8)
            table[: len(raw) // 3, :3] = raw[: len(raw) // 3 * 3].reshape(-1, 3)
        indices = np.frombuffer(m["indices"], dtype=np.uint8)
        if len(indices) < fw * fh:
            indices = np.concatenate([indices, np.zeros(fw * fh - len(indices), dtype=np.uint8)])
        indices = indices.reshape(fh, fw)
        if m["interlaced"]:
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, fh, step)]
            rows = np.empty_like(indices)
            rows[order] = indices
            indices = rows
        before = canvas.copy() if m["disposal"] == 3 else None
        spot = canvas[y : y + fh, x : x + fw]
        indices = indices[: spot.shape[0], : spot.shape[1]]
        if m["hidden"] < 0:
            np.take(table, indices, axis=0, out=spot) if spot.flags.c_contiguous else spot.__setitem__(..., table[indices])
        else:
            seen = indices != m["hidden"]
            spot[seen] = table[indices[seen]]
        out.append({"start_ms": clock, "delay_ms": m["delay_ms"], "disposal": m["disposal"], "width": w, "height": h, "canvas": canvas.copy()})
        clock += m["delay_ms"]
        if m["disposal"] == 2:
            spot[...] = 0
        elif before is not None:
            canvas = before
    return out


def decode_many(media: list[bytes | None]) -> list[list[dict] | str]:
    """For each value its timed frames, or a message where it can't be decoded."""
    out: list = []
    todo: dict[int, list[dict]] = {}
    for value in media:
        try:
            w, h, images = parse(value)
            for m in images:
                todo.setdefault(m["bits"], []).append(m)
            out.append((w, h, images))
        except (TypeError, ValueError, IndexError) as e:
            out.append("null" if value is None else str(e))
    for bits, images in todo.items():
        for i in range(0, len(images), LANES):
            part = images[i : i + LANES]
            try:
                got = lzw_decode_many([m["stream"] for m in part], bits, [m["box"][2] * m["box"][3] for m in part])
            except ValueError:  # one of them is broken: one by one
                got = []
                for m in part:
                    try:
                        got.append(lzw_decode(m["stream"], bits, m["box"][2] * m["box"][3]))
                    except ValueError as e:
                        got.append(e)
            for m, x in zip(part, got, strict=True):
                m["indices"] = x
    for i, x in enumerate(out):
        if not isinstance(x, str):
            broken = next((m["indices"] for m in x[2] if isinstance(m["indices"], ValueError)), None)
            out[i] = compose(*x) if broken is None else str(broken)
    return out


def decode(media: bytes) -> list[dict]:
    """Timed frames: ``start_ms, delay_ms, disposal, width, height, canvas`` (RGBA)."""
    got = decode_many([media])[0]
    if isinstance(got, str):
        raise ValueError(got)
    return got


def histograms(frames: list[dict]) -> np.ndarray:
    """Pixels by frame, channel (red, green, blue) and bin of 16 levels; clear pixels don't count."""
    n = len(frames)
    out = np.zeros((n, 3, BINS), dtype=np.int64)
    if n:
        seen = np.stack([f["canvas"] for f in frames]).reshape(n, -1, 4)
        solid = seen[:, :, 3].ravel() > 0
        cell = np.repeat(np.arange(n) * BINS, seen.shape[1])
        for c in range(3):
            got = cell + (seen[:, :, c].ravel() >> 4)
            out[:, c] = np.bincount(got[solid], minlength=n * BINS).reshape(n, BINS)
    return out


def payload_of(text: str) -> bytes:
    """UTF-8 bytes of a text, padded with bytes 255 to a positive multiple of a frame."""
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes([PAD]) * (-len(data) % FRAME if data else FRAME)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media``: every whole text stored losslessly as an animated GIF."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 4 << 20):
            texts = batch.column(1).to_pylist()
            n = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            media = pa.array(encode_many([payload_of(t) for t in texts]), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, media], names=[id_col, "n_bytes", "media"])

    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias(text_col))
    return map_arrow(rows, run, f"`{id_col}` {kind}, n_bytes long, media binary")


FRAME_COLUMNS = "frame int, start_ms long, delay_ms long, disposal int, width int, height int, rgba binary, hist_r array<int>, hist_g array<int>, hist_b array<int>, media_error string"


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for every timed frame, with its canvas as RGBA and its histograms.

    A value that can't be decoded gives one row with ``media_error`` and nulls.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.from_numpy_dtype(np.int64)), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("hist_r", pa.list_(pa.int32())), ("hist_g", pa.list_(pa.int32())), ("hist_b", pa.list_(pa.int32())), ("media_error", pa.string())])
        for batch in pieces(batches, media_col, 1 << 20):
            schema = schema.set(0, pa.field(id_col, batch.schema.field(0).type))
            for key, got in zip(batch.column(0).to_pylist(), decode_many(batch.column(1).to_pylist()), strict=True):
                got, error = ([], got) if isinstance(got, str) else (got, "no frames")
                hist = histograms(got)
                rows = [{id_col: key, "frame": i, "rgba": f["canvas"].tobytes(), "hist_r": hist[i, 0], "hist_g": hist[i, 1], "hist_b": hist[i, 2], **{k: f[k] for k in ("start_ms", "delay_ms", "disposal", "width", "height")}} for i, f in enumerate(got)]
                yield pa.RecordBatch.from_pylist(rows or [{id_col: key, "media_error": error}], schema=schema)

    return map_arrow(media.select(id_col, media_col), run, f"`{id_col}` {kind}, {FRAME_COLUMNS}")


def features(frames_: list[dict], hist: np.ndarray) -> str:
    """Frames, size, duration and a digest of the colour histograms, as one string."""
    duration = frames_[-1]["start_ms"] + frames_[-1]["delay_ms"] if frames_ else 0
    total = hist.sum(axis=0) if len(hist) else np.zeros((3, BINS), dtype=np.int64)
    w, h = (frames_[0]["width"], frames_[0]["height"]) if frames_ else (0, 0)
    return f"frames={len(frames_)};size={w}x{h};ms={duration};red={','.join(map(str, total[0]))};hist={zlib.crc32(hist.astype('<i8').tobytes()):08x}"


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored GIFs hold, read back through ``decode``: one row per text."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", 4 << 20):
            out: list[list] = [[] for _ in names[2:]]
            values = batch.column(2).to_pylist()
            for value, got in zip(values, decode_many(values), strict=True):
                if isinstance(got, str):
                    raise ValueError(got)
                payload = b"".join([f["canvas"][:, :, 0].tobytes() for f in got])
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(value), hashlib.sha256(value).hexdigest(), features(got, histograms(got)))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], names=names)

    return map_arrow(media.select(id_col, "n_bytes", "media"), run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
