from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import gif


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=700), st.integers(1, 40))
def test_codes_come_back(data, times):
    samples = data * times
    assert gif.lzw_decode(gif.lzw_encode(samples), 8, len(samples)) == samples


@pytest.mark.parametrize("n", [192, 192 * 1023, 192 * 1024, 192 * 1025, 192 * 2100])
def test_frames_come_back(n):
    samples = np.random.default_rng(n).integers(0, 40, n, dtype=np.uint8).tobytes()
    found = list(gif.frames(gif.encode(samples)))
    assert b"".join(f.samples for f in found) == samples and len(found) == -(-n // (192 * 1024))
    assert found[0].canvas[0, 0].tolist() == [samples[0]] * 3 + [255]


def image(left, top, w, h, samples, disposal=0, transparent=None, delay=5, palette=None, interlaced=False):
    """A frame with two-bit codes."""
    control = b"!\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + delay.to_bytes(2, "little") + bytes([transparent or 0, 0])
    flags = (0x40 if interlaced else 0) | (0x81 if palette else 0)
    head = b"," + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([flags]) + (bytes(palette) if palette else b"")
    packed = gif.lzw_encode(bytes(samples), 2)
    return control + head + b"\x02" + bytes([len(packed)]) + packed + b"\0"


RED, GREEN, BLUE, WHITE = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)


def movie(*images, w=2, h=2):
    return b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\x81\0\0" + bytes(sum((RED, GREEN, BLUE, WHITE), ())) + b"".join(images) + b";"


def seen(frame):
    return [tuple(p[:3]) if p[3] else None for p in frame.canvas.reshape(-1, 4).tolist()]


def test_disposal_and_transparency():
    got = list(gif.frames(movie(
        image(0, 0, 2, 2, [0, 1, 2, 3], disposal=1), image(1, 0, 1, 1, [3], disposal=3, delay=7), image(0, 1, 2, 1, [1, 0], disposal=2, transparent=0),
        image(0, 0, 1, 1, [2]))))
    assert seen(got[0]) == [RED, GREEN, BLUE, WHITE]
    assert seen(got[1]) == [RED, WHITE, BLUE, WHITE] and got[1].delay_ms == 70
    assert seen(got[2]) == [RED, GREEN, GREEN, WHITE]     # the second is taken back, one pixel of the third is see-through
    assert seen(got[3]) == [BLUE, GREEN, None, None]      # the third leaves nothing behind
    assert sum(got[3].histogram()) == 3 * 2


def test_palette_of_a_frame_and_interlacing():
    own = (9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 0, 0)
    frame = next(gif.frames(movie(image(0, 0, 1, 8, [0, 1, 2, 3, 0, 1, 2, 3], palette=own, interlaced=True), w=1, h=8)))
    assert list(frame.samples) == [0, 0, 2, 1, 1, 2, 3, 3]
    assert frame.canvas[0, 0].tolist() == [9, 8, 7, 255]


def test_broken_streams_are_errors():
    with pytest.raises(ValueError, match="not a GIF"):
        list(gif.frames(b"PNG" * 9))
    with pytest.raises(ValueError, match="table"):
        gif.lzw_decode(gif._packed(np.array([256, 65, 300, 257]), 8), 8, 100)


def test_query(sure, texts):
    got = sure("op5_gif")
    for k, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()


def test_edges(docs, collect):
    df = docs(None, "", "x", "x", "long " * 120_000).withColumnRenamed("lang", "media")
    got = collect(gif.read_frames(gif.store(df)))
    assert got[0]["media"] == got[1]["media"] and got[2]["media"] == got[3]["media"] and got[0]["n_bytes"] == 0
    assert len(got[4]["frames"]) == 4 and [f["start_ms"] for f in got[4]["frames"]] == [0, 100, 200, 300]
    assert b"".join(bytes(f["samples"]) for f in got[4]["frames"]).rstrip() == ("long " * 120_000).strip().encode()
    assert gif.store(df.limit(0)).count() == 0


def test_null_and_broken_media_are_reported(spark):
    good = gif.encode(bytes(range(192)) * 8)
    bad = [None, good, b"", b"no image at all", good[:-30], good[:9], good[:800], good[:6] + b"\xff\xff\xff\xff" + good[10:], good]
    df = spark.createDataFrame([(i, m, "x") for i, m in enumerate(bad)], "id int, media binary, feature string")
    got = {r.id: r for r in gif.digests(df).collect()}
    assert got[0].media_bytes is None and got[0].media_error is None and got[0].payload_bytes is None
    for i in (1, 8):
        assert got[i].payload_bytes == 192 * 8 and got[i].media_error is None
    for i in range(2, 8):
        assert got[i].media_error and got[i].payload_bytes is None and got[i].media_bytes == len(bad[i])
    frames = {r.id: r for r in gif.read_frames(df).collect()}
    assert frames[0].frames == [] and frames[0].media_error is None and len(frames[1].frames) == 1 and frames[1].media_error is None
    assert all(frames[i].media_error for i in range(2, 8))
    assert gif.digests(df.limit(0)).count() == 0
