"""GIF images: writing samples as frames, and decoding streams into timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridspark.llm.batches import add_columns

WIDTH, FRAME_ROWS, DELAY = 192, 1024, 10
BINS = 16
#: Larger canvases and frames are an error, so that a damaged header cannot fill the memory.
MOST_PIXELS = 1 << 26
_MOST_CODES = 4096
_GREY = bytes(level for level in range(256) for _ in range(3))


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The LZW codes of samples below ``2**bits``, packed from the lowest bit on."""
    clear = 1 << bits
    codes: list[int] = [clear]
    put, at, table = codes.append, None, {}
    rest = iter(samples)
    while True:
        get, following = table.get, clear + 2
        for sample in rest:
            if at is None:
                at = sample
            elif (code := get(at << 8 | sample)) is not None:
                at = code
            else:
                put(at)
                table[at << 8 | sample] = following
                at = sample
                following += 1
                if following == _MOST_CODES:
                    break
        else:
            break
        put(clear)
        table = {}
    if at is not None:
        put(at)
    put(clear + 1)
    return _packed(np.array(codes, dtype=np.int64), bits)


@lru_cache(maxsize=8)
def _all_widths(bits: int) -> np.ndarray:
    return _widths(2 * _MOST_CODES, bits)


def _widths(n: int, bits: int) -> np.ndarray:
    """Widths of the first ``n`` codes after a clear code.

    The table has ``2**bits + 2`` codes then; from the second code on each adds one, and a width lasts until the table has
    outgrown it.
    """
    size = np.minimum((1 << bits) + 1 + np.arange(n), _MOST_CODES - 1)
    size[:1] = (1 << bits) + 1
    return np.maximum(bits + 1, np.frexp(size.astype(np.float64))[1]).astype(np.int64)


def _packed(codes: np.ndarray, bits: int) -> bytes:
    clear = 1 << bits
    # widths start anew behind each clear code, which itself has the width reached before it
    starts = np.flatnonzero(codes == clear)
    widths = np.empty(len(codes), dtype=np.int64)
    widths[0] = bits + 1
    for start, end in zip(starts, [*starts[1:], len(codes) - 1]):
        widths[start + 1:end + 1] = _all_widths(bits)[:end - start]
    offsets = np.cumsum(widths) - widths
    out = np.zeros((int(widths.sum()) + 7) // 8 + 3, dtype=np.uint8)
    at, shifted = offsets >> 3, codes << (offsets & 7)
    for k in range(3):  # a code of 12 bits lies in 3 bytes at most; parts of different codes do not overlap
        out += np.bincount(at + k, weights=(shifted >> 8 * k) & 255, minlength=len(out)).astype(np.uint8)
    return out[:(int(widths.sum()) + 7) // 8].tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The samples of packed LZW codes, ``most`` of them at the most.

    Codes between two clear codes have known widths and are cut out at once.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    position, out, size = 0, [], 0
    widths = _all_widths(bits)
    ends = np.cumsum(widths)
    while size < most:
        n = int(np.searchsorted(ends, 8 * len(data) - position, side="right"))
        bit = position + ends[:n] - widths[:n]
        at = bit >> 3
        codes = ((raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16) >> (bit & 7)) & ((1 << widths[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stops[0]) if len(stops) else n
        out.append(_expanded(codes[:used].tolist(), bits))
        size += len(out[-1])
        if not len(stops):
            if n == len(widths):
                raise ValueError("a GIF stream goes on too long without a clear code")
            break
        position += int(ends[used])
        if codes[used] == end:
            break
    return b"".join(out)[:most]


def _expanded(codes: list[int], bits: int) -> bytes:
    """The samples of the codes of one table."""
    if not codes:
        return b""
    table = [bytes([x]) for x in range(1 << bits)] + [b"", b""]
    if codes[0] >= 1 << bits:
        raise ValueError("a GIF stream begins with a code that is not in its table")
    before = table[codes[0]]
    out, add = [before], table.append
    put = out.append
    for code in codes[1:]:
        try:
            now = table[code]
        except IndexError:
            # only the code being made can be missing: the last output and its first sample again
            if code > len(table):
                raise ValueError("a GIF stream names a code that is not in its table") from None
            now = before + before[:1]
        put(now)
        add(before + now[:1])
        before = now
    return b"".join(out)


@dataclass
class Frame:
    """One frame: where it lies, its samples, and the canvas as colours after it."""
    index: int
    delay_ms: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    samples: bytes
    canvas: np.ndarray  # height, width, RGBA

    def histogram(self, bins: int = BINS) -> list[int]:
        """Counts of visible pixels by red, green and blue level, ``bins`` each."""
        seen = self.canvas[self.canvas[..., 3] > 0]
        return [int(x) for c in range(3) for x in np.bincount(seen[:, c].astype(np.int64) * bins >> 8, minlength=bins)]


def encode(samples: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """Samples as a grey GIF of the given width, with frames of up to ``rows`` rows; nothing is lost."""
    if not samples or len(samples) % width:
        raise ValueError(f"the number of samples must be a positive multiple of {width}")
    height = min(rows, len(samples) // width)
    parts = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for at in range(0, len(samples), width * rows):
        part = samples[at:at + width * rows]
        parts += [b"!\xf9\x04\x04", delay.to_bytes(2, "little"), b"\0\0", b",\0\0\0\0", width.to_bytes(2, "little"),
                  (len(part) // width).to_bytes(2, "little"), b"\0\x08"]
        packed = lzw_encode(part)
        parts += [bytes([len(packed[k:k + 255])]) + packed[k:k + 255] for k in range(0, len(packed), 255)]
        parts.append(b"\0")
    return b"".join([*parts, b";"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1:at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), dtype=np.uint8)
    colours[:n] = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
    return colours, at + 3 * n


def _rows_in_order(height: int, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return np.arange(height)
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF: palettes, transparency and disposal applied to a canvas that starts transparent."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, at = *np.frombuffer(data, dtype="<u2", count=2, offset=6).tolist(), data[10], 13
    shared = np.zeros((256, 3), dtype=np.uint8)
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    if width * height > MOST_PIXELS:
        raise ValueError(f"a GIF of {width} x {height} pixels is larger than {MOST_PIXELS}")
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay, disposal, transparent, index = 0, 0, -1, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = _blocks(data, at + 2)
            if kind == 0xF9:
                delay, disposal = 10 * int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError("a GIF holds a block of unknown kind")
        left, top, w, h = np.frombuffer(data, dtype="<u2", count=4, offset=at + 1).tolist()
        own, at = data[at + 9], at + 10
        if w * h > MOST_PIXELS:
            raise ValueError(f"a frame of {w} x {h} pixels is larger than {MOST_PIXELS}")
        colours = shared
        if own & 0x80:
            colours, at = _palette(data, at, own)
        bits = data[at]
        packed, at = _blocks(data, at + 1)
        read = np.frombuffer(lzw_decode(packed, bits, w * h).ljust(w * h, b"\0"), dtype=np.uint8).reshape(h, w)
        samples = np.empty_like(read)
        samples[_rows_in_order(h, bool(own & 0x40))] = read
        before = canvas.copy() if disposal == 3 else None
        inside = samples[:max(0, height - top), :max(0, width - left)]
        opaque = np.concatenate([colours, np.full((256, 1), 255, dtype=np.uint8)], axis=1)
        area = canvas[top:top + h, left:left + w]
        np.copyto(area, opaque[inside], where=(inside != transparent)[..., None])
        yield Frame(index, delay, disposal, left, top, w, h, samples.tobytes(), canvas.copy())
        if disposal == 2:
            canvas[top:top + h, left:left + w] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent, index = 0, 0, -1, index + 1


def payload(text: str | None, unit: int = WIDTH) -> tuple[bytes, int]:
    """A text as UTF-8, filled with blanks to a positive multiple of ``unit`` bytes, and its own length; null is empty."""
    raw = (text or "").encode()
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" "), len(raw)


def store(df: DataFrame, text: str = "text", media: str = "media", carry: list[str] | None = None) -> DataFrame:
    """Add ``media``, the text's payload as a GIF, and ``n_bytes``, its length before filling.

    Null and empty texts are one row of blanks.  Equal texts give equal bytes; each row stands alone, so repeated rows and
    empty tables need no special case; columns of these names are replaced.
    """
    def make():
        def run(texts):
            found = [payload(t) for t in texts]
            return {media: [encode(p) for p, _ in found], "n_bytes": [n for _, n in found]}
        return run

    return add_columns(df, [text], T.StructType([T.StructField(media, T.BinaryType()), T.StructField("n_bytes", T.LongType())]), make, carry)


FRAME = T.StructType([
    T.StructField("index", T.IntegerType()), T.StructField("start_ms", T.LongType()), T.StructField("delay_ms", T.IntegerType()),
    T.StructField("disposal", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("samples", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.LongType()))])


def read_frames(df: DataFrame, media: str = "media", out: str = "frames", carry: list[str] | None = None,
                error: str = "media_error") -> DataFrame:
    """Add ``frames``: the timed frames of each GIF with samples and colour histogram, and ``media_error``.

    Null media have no frames and no error.  Media that are no GIF, are cut off or damaged have the frames before the damage and
    an error that names it.  Columns of these names are replaced; repeated rows and empty tables need no special case.
    """
    def make():
        def run(rows):
            found, errors = [], []
            for data in rows:
                start, of, wrong = 0, [], None
                try:
                    for f in frames(bytes(data)) if data is not None else ():
                        of.append({"index": f.index, "start_ms": start, "delay_ms": f.delay_ms, "disposal": f.disposal, "width": f.width,
                                   "height": f.height, "samples": f.samples, "histogram": f.histogram()})
                        start += f.delay_ms
                except DAMAGE as e:
                    wrong = _named(e)
                found.append(of)
                errors.append(wrong)
            return {out: found, error: errors}
        return run

    return add_columns(df, [media], T.StructType([T.StructField(out, T.ArrayType(FRAME)), T.StructField(error, T.StringType())]), make, carry)


DAMAGE = (ValueError, IndexError)


def _named(e: Exception) -> str:
    return str(e) if isinstance(e, ValueError) else "a GIF ends before its end"


NOTHING = (None, None, None, None)


def _read_back(data: bytes) -> tuple[tuple, str | None]:
    """Length, hash, tail checksum and histogram of the samples of a GIF, or nothing and what is wrong with it."""
    sums, samples = np.zeros(3 * BINS, dtype=np.int64), []
    try:
        for f in frames(data):
            samples.append(f.samples)
            sums += f.histogram()
    except DAMAGE as e:
        return NOTHING, _named(e)
    read = b"".join(samples)
    return (len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), f"{len(samples)}:" + ",".join(map(str, sums[:BINS]))), None


def digests(df: DataFrame, media: str = "media", carry: list[str] | None = None) -> DataFrame:
    """Add what is read back from each GIF: payload length, hash and tail checksum, hash and length of the media, histogram.

    Null media have nulls.  Media that are no GIF, are cut off or damaged have their length and hash, an error in
    ``media_error`` and nulls elsewhere.  Columns of these names are replaced; repeated rows and empty tables need no special case.
    """
    def make():
        def run(rows):
            out = {n: [] for n in DIGEST.fieldNames()}
            for data in rows:
                data = None if data is None else bytes(data)
                read, wrong = (NOTHING, None) if data is None else _read_back(data)
                whole = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                for name, value in zip(DIGEST.fieldNames(), (*read[:3], *whole, read[3], wrong)):
                    out[name].append(value)
            return out
        return run

    return add_columns(df, [media], DIGEST, make, carry)


DIGEST = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("media_error", T.StringType())])
