"""Checksums of Layer I and II frames, written bit by bit and checked by a plain CRC."""

from __future__ import annotations

import random

import pytest

from tillscan.llm.mpeg_audio import allocation_widths, header, read_stream


def plain_crc(bits):
    """The remainder of the bits as a polynomial over x16 + x15 + x2 + 1, from all ones."""
    r = [1] * 16
    for b in bits:
        out = r.pop(0) ^ b
        r.append(0)
        if out:
            for k in (0, 13, 15):  # x15, x2 and 1
                r[k] ^= 1
    return r


def bits_of(value, n):
    return [value >> (n - 1 - i) & 1 for i in range(n)]


def frame(word, draw):
    h = header(word)
    channels, joint = h.channels, word >> 6 & 3 == 1
    bound = 4 * ((word >> 4 & 3) + 1) if joint else 32
    covered = []
    if h.layer == 1:
        for band in range(32):
            for _ in range(channels if band < bound else 1):
                covered += bits_of(draw.randrange(15), 4)
    else:
        allocated = []
        for band, width in enumerate(allocation_widths(h)):
            own = [draw.choice([0, draw.randrange(1 << width)]) for _ in range(channels if band < bound else 1)]
            for v in own:
                covered += bits_of(v, width)
            allocated.append(own if len(own) == channels else own * channels)
        for own in allocated:
            for v in own:
                covered += bits_of(draw.randrange(4), 2) if v else []
    head = bits_of(word, 32)
    body = covered + [draw.randrange(2) for _ in range(8 * (h.size - 6) - len(covered))]
    everything = head + plain_crc(head[16:] + covered) + body
    return bytes(int("".join(map(str, everything[i : i + 8])), 2) for i in range(0, len(everything), 8)), 48 + len(covered)


@pytest.mark.parametrize(
    ("word", "bands"),
    [
        (0xFFFC8400, 27),  # Layer II, 128 kbit/s, 48 kHz, stereo
        (0xFFFCA000, 30),  # 192 kbit/s, 44.1 kHz, stereo
        (0xFFFC2800, 12),  # 48 kbit/s, 32 kHz, stereo
        (0xFFFC10C0, 8),  # 32 kbit/s, 44.1 kHz, mono
        (0xFFFC8450, 27),  # joint stereo, bound 8
        (0xFFF48000, 30),  # MPEG-2, 64 kbit/s, 22.05 kHz, stereo
        (0xFFFE8400, None),  # Layer I, stereo
        (0xFFFE8460, None),  # Layer I, joint stereo, bound 12
        (0xFFFE84C0, None),  # Layer I, mono
    ],
)
def test_checksums_hold_and_fail(word, bands):
    draw = random.Random(word)
    if bands:
        assert len(allocation_widths(header(word))) == bands
    made = [frame(word, draw) for _ in range(6)]
    stream = read_stream(b"".join(f for f, _ in made))
    assert (len(stream.offsets), stream.crc_good, stream.crc_bad) == (6, 6, 0)
    broken = bytearray(b"".join(f for f, _ in made))
    broken[len(made[0][0]) + 7] ^= 16  # in the second frame's bit allocation
    stream = read_stream(bytes(broken))
    assert (len(stream.offsets), stream.crc_good, stream.crc_bad) == (6, 5, 1)
    outside = bytearray(b"".join(f for f, _ in made))
    outside[made[0][1] // 8 + 1] ^= 1  # behind what is covered
    assert read_stream(bytes(outside)).crc_good == 6
