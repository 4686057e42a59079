"""Operator 3: exact round trips, and a stream that is not its own."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest

from tillscan.llm.mpeg_audio import crc16, header, media_columns, padded, read_payload, read_stream, store, write_stream

TEXTS = [None, "", "a", "é" * 40, "x" * 64, "y" * 65, "\x00\xff" * 900, "TAG" * 5000, "ID3" + "�" * 3000, "Xing" * 999]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    raw = (text or "").encode()
    payload = padded(text)
    assert payload[: len(raw)] == raw and len(payload) % 64 == 0 and len(payload) >= 64 and len(payload) - len(raw) <= 64
    media = write_stream(payload)
    s = read_stream(media)
    assert read_payload(s) == payload
    assert s.skipped == 0 and s.crc_bad == 0 and s.crc_good == len(s.offsets) == s.table["frames"]
    assert s.samples == 1152 * len(s.offsets) and s.rate == 48000
    assert s.table["bytes"] == len(media) - s.table["at"] and len(s.table["toc"]) == 100
    for a in s.offsets:
        assert header(int.from_bytes(media[a : a + 4], "big")) is not None


def test_a_tag_in_the_text_is_no_tag():
    """TAG at every place near the end, in last frames of all sizes."""
    for n in (150, 300, 700, 960, 1000, 1100, 1930):
        for back in range(3, 150):
            text = "x" * (n - back) + "TAG" + "y" * (back - 3)
            media = write_stream(padded(text))
            s = read_stream(media)
            assert read_payload(s) == padded(text) and s.skipped == 0 and set(s.tags) == {"payload_bytes", "payload_crc32"}
            assert s.crc_good == len(s.offsets) == s.table["frames"] and s.table["bytes"] == len(media) - s.table["at"]


def test_any_bytes_survive():
    draw = random.Random(1)
    for n in (64, 640, 6400, 64000):
        payload = draw.randbytes(n)  # false sync words included
        assert read_payload(read_stream(write_stream(payload))) == payload


def test_resynchronises_behind_junk():
    media = write_stream(padded("hello " * 2000))
    clean = read_stream(media)
    at = clean.offsets[2]
    junk = b"\xff\xfb\x90\x00" + bytes(range(256))
    dirty = read_stream(media[:at] + junk + media[at:])
    assert dirty.skipped == len(junk) and dirty.ancillary == clean.ancillary
    assert dirty.offsets[2:] == [o + len(junk) for o in clean.offsets[2:]]


def test_damage_is_noticed():
    media = bytearray(write_stream(padded("hello " * 2000)))
    s = read_stream(bytes(media))
    media[s.offsets[1] + 8] ^= 1  # side information
    assert read_stream(bytes(media)).crc_bad == 1
    media = bytearray(write_stream(padded("hello " * 2000)))
    media[s.offsets[1] + 60] ^= 1  # stored bytes
    with pytest.raises(ValueError):
        read_payload(read_stream(bytes(media)))
    assert len(read_stream(bytes(media[: s.offsets[3] + 10])).offsets) == 3


def bitwise_crc(data):
    r = 0xFFFF
    for b in data:
        for i in range(7, -1, -1):
            r = (r << 1 ^ (0x8005 if (r >> 15 ^ b >> i) & 1 else 0)) & 0xFFFF
    return r


def test_checksum_of_the_standard():
    for data in (b"", b"\x00", b"123456789", bytes(range(200))):
        assert crc16(data) == bitwise_crc(data)


@pytest.mark.parametrize(
    ("word", "size", "samples", "rate"),
    [
        (0xFFFB9000, 417, 1152, 44100),  # MPEG-1 Layer III, 128 kbit/s
        (0xFFFB9200, 418, 1152, 44100),  # with padding
        (0xFFFD8400, 384, 1152, 48000),  # MPEG-1 Layer II, 128 kbit/s
        (0xFFFF1800, 48, 384, 32000),  # MPEG-1 Layer I, 32 kbit/s
        (0xFFF38000, 208, 576, 22050),  # MPEG-2 Layer III, 64 kbit/s
        (0xFFE31800, 72, 576, 8000),  # MPEG-2.5 Layer III, 8 kbit/s
    ],
)
def test_headers(word, size, samples, rate):
    h = header(word)
    assert (h.size, h.samples, h.rate) == (size, samples, rate)


@pytest.mark.parametrize("word", [0, 0xFFEB9000, 0xFFF99000, 0xFFFBF000, 0xFFFB0000, 0xFFFB9C00, 0xFFFB9002])
def test_no_headers(word):
    assert header(word) is None


def test_foreign_stream_with_all_tags():
    frame = bytes.fromhex("fffb9000") + bytes(413)
    vbri = bytearray(frame)
    vbri[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 417 * 5, 4, 2, 1, 2, 2)
    vbri[62:66] = struct.pack(">HH", 834, 834)
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + b"Singer".ljust(30, b"\0") + bytes(30) + b"1999" + bytes(31)
    v2 = b"ID3\x03\x00\x00\x00\x00\x00\x0fTIT2\x00\x00\x00\x05\x00\x00\x00Tune"
    s = read_stream(v2 + bytes(vbri) + frame * 4 + v1)
    assert s.tags == {"TIT2": "Tune", "v1_title": "Song", "v1_artist": "Singer", "v1_year": "1999"}
    assert s.table["name"] == "VBRI" and s.table["toc"] == [834, 834] and s.table["frames"] == 4
    assert len(s.offsets) == 4 and s.kind == "mpeg1 layer 3" and s.seconds == 4 * 1152 / 44100
    assert read_stream(b"").offsets == [] and read_stream(b"\xff" * 500).offsets == []


def test_columns(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "abc", 8), (2, "abc", 8)], "doc_id long, text string, rate int")
    out = media_columns(df).collect()
    for r in out:
        assert r.rate == 48000 and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded(r.text)[-64:]) and r.feature == store(r.text)["feature"]
    assert out[1] == out[2] or len({r.feature for r in out if r.doc_id == 2}) == 1
    assert media_columns(df.limit(0)).count() == 0
