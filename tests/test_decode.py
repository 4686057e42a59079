"""PNG and PNM files, read and written."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from tillscan.operators import decode as C


def png(rows: list[bytes], width, depth, colour, extra=b"", interlace=0):
    """A file from filtered scanlines."""
    head = struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, interlace)
    data = zlib.compress(b"".join(rows))
    parts = [(b"IHDR", head), *([(b"PLTE", extra)] if extra else []), (b"IDAT", data[:3]), (b"IDAT", data[3:]), (b"IEND", b"")]
    return C.PNG_MARK + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def filtered(image: np.ndarray, kinds: list[int]) -> list[bytes]:
    """Scanlines by the definition of each filter, sample by sample."""
    h, w, s = image.shape
    flat = image.reshape(h, w * s).astype(int)
    rows = []
    for y, kind in enumerate(kinds):
        line = [kind]
        for i in range(w * s):
            a = flat[y, i - s] if i >= s else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - s] if y and i >= s else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append(int(flat[y, i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append(bytes(line))
    return rows


@pytest.mark.parametrize("colour, samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters(colour, samples):
    image = np.random.default_rng(colour).integers(0, 256, (10, 7, samples), dtype=np.uint8)
    got = C.read_png(png(filtered(image, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]), 7, 8, colour))
    wanted = image[..., :3] if samples >= 3 else np.repeat(image[..., :1], 3, axis=2)
    assert (got == wanted).all()


def test_depths_and_palette():
    assert C.read_png(png([b"\x00\xb0"], 4, 1, 0))[0, :, 0].tolist() == [255, 0, 255, 255]
    assert C.read_png(png([b"\x00\x1b"], 4, 2, 0))[0, :, 0].tolist() == [0, 85, 170, 255]
    assert C.read_png(png([b"\x00\x12\x34\xff\x00"], 2, 16, 0))[0, :, 0].tolist() == [0x12, 0xFF]
    assert C.read_png(png([b"\x00\x10"], 2, 4, 3, bytes(range(6))))[0].tolist() == [[3, 4, 5], [0, 1, 2]]


@pytest.mark.parametrize("filter_", [0, 1, 2])
def test_round_trip(filter_):
    for shape in ((5, 4), (5, 4, 3), (1, 1)):
        image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
        got = C.read_image(C.png_bytes(image, filter_))
        assert (got == (image if image.ndim == 3 else image[..., None])).all()


def test_pnm():
    assert C.read_image(b"P6\n# c\n2 1\n# d\n255\nabcdef").tolist() == [[[97, 98, 99], [100, 101, 102]]]
    assert C.read_image(b"P5 1 1 15 \x0f").tolist() == [[[255] * 3]]


def test_what_cannot_be_read_is_a_row_with_a_message(spark):
    good = C.png_bytes(np.zeros((2, 2), np.uint8))
    bad = [
        None, b"", b"GIF89a", good[:-5], good[:40] + b"x" + good[41:], png([b"\x05\x00"], 1, 8, 0), png([b"\x00\x00"], 1, 8, 0, interlace=1),
        png([b"\x00\x00"], 9, 8, 0), png([b"\x00\x09"], 1, 8, 3, bytes(3)), b"P5 9 9 255 x", b"P6 0 0 255 ", png([b"\x00"], 2**30, 8, 0),
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, good])], "k int, content binary").repartition(3)
    got = {r.k: (r.width, r.height, r.pixels, r.message) for r in C.decode_images(df, "k").collect()}
    assert got.pop(len(bad)) == (2, 2, b"\0" * 12, None)
    assert set(got.values()) == {(None, None, None, C.UNREADABLE)}
    back = C.encode_images(C.decode_images(df, "k"), "k").collect()
    assert {r.k: r.content is None for r in back} == {i: i < len(bad) for i in range(len(bad) + 1)}
