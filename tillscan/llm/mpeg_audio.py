"""Operator 3, media columns of MPEG audio.

``write_stream`` stores bytes losslessly in a valid stream: an ID3v2.4 tag, a Xing frame
with the variable-bitrate table, then MPEG-1 Layer III frames (48 kHz, mono) that decode to
silence and carry the bytes as ancillary data, each with its CRC-16; the last frame has the
least bitrate that holds the rest. ``read_stream`` makes no use of how a stream came about:
it skips tags, resynchronises on frame headers (a header counts if another of the same kind,
or the end, follows at its length, or if it stands right behind a frame of its kind; free-format
frames, whose length no header tells, are skipped bytes), verifies the CRC-16 of all layers, parses Xing,
Info and VBRI tables, and returns exact durations (samples over rate) and the byte offset
of every frame.

Defined cases: null text is empty and stored as 64 zero bytes; a stream without frames has
no duration and no offsets; bytes between frames are counted as skipped; truncated last
frames are not frames; repeated rows and equal texts get equal results; columns that carry
the name of a result column are replaced, others pass through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

# Fixed values of the public standards ISO 11172-3 and 13818-3, in kbit/s and Hz.
V1_L1 = (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
V1_L2 = (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
V1_L3 = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
V2_L1 = (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
V2_L23 = (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSION = {3: "1", 2: "2", 0: "2.5"}


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ 0x8005 if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio frames: polynomial 0x8005, from 0xFFFF."""
    r = 0xFFFF
    for b in data:
        r = (r << 8 & 0xFFFF) ^ _CRC[r >> 8 ^ b]
    return r


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    size: int  # bytes of the frame
    samples: int
    channels: int
    bound: int = 32  # subband from which both channels share their bits (Layers I and II)

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.rate

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        if self.version == 3:
            return 17 if self.channels == 1 else 32
        return 9 if self.channels == 1 else 17


#: Layer II: widths of the bit allocation of runs of subbands, by table (Annex B of both standards).
L2_WIDE, L2_NARROW = ((11, 4), (12, 3), (7, 2)), ((2, 4), (10, 3))
L2_LOW_RATES = ((4, 4), (7, 3), (19, 2))


def allocation_widths(h: Header) -> list[int]:
    """Bits of the allocation of each subband of a Layer II frame."""
    if h.version != 3:
        table, bands = L2_LOW_RATES, 30
    elif h.kbps // h.channels < 56:
        table, bands = L2_NARROW, 12 if h.rate == 32000 else 8
    else:
        table, bands = L2_WIDE, 30 if h.kbps // h.channels >= 96 and h.rate != 48000 else 27
    return [bits for n, bits in table for _ in range(n)][:bands]


_HEADERS: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The frame header in a 32-bit word, or None; free-format frames have no header."""
    if word not in _HEADERS:
        if len(_HEADERS) > 50_000:
            _HEADERS.clear()
        _HEADERS[word] = _parse_header(word)
    return _HEADERS[word]


def _parse_header(word: int) -> Header | None:
    version, code = word >> 19 & 3, word >> 17 & 3
    bitrate, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or code == 0 or bitrate in (0, 15) or rate == 3:
        return None
    if word & 3 == 2:  # reserved emphasis
        return None
    layer = 4 - code
    if version == 3:
        kbps = (V1_L1, V1_L2, V1_L3)[layer - 1][bitrate - 1]
    else:
        kbps = (V2_L1 if layer == 1 else V2_L23)[bitrate - 1]
    hz = RATES[version][rate]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    padding = word >> 9 & 1
    size = (12000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
    channels = 1 if word >> 6 & 3 == 3 else 2
    bound = 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32
    return Header(version, layer, not word >> 16 & 1, kbps, hz, size, samples, channels, bound)


@dataclass
class Stream:
    """What a stream holds; offsets are from its first byte."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    kind: str = ""
    bitrates: dict[int, int] = field(default_factory=dict)  # kbit/s: frames
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    table: dict | None = None  # the Xing, Info or VBRI table
    ancillary: bytes = b""

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _text(raw: bytes) -> str:
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return raw[1:].decode(kinds.get(raw[0] if raw else 0, "latin-1"), "replace").rstrip("\x00")


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read one ID3v2 tag; where it ends."""
    major, flags = data[at + 3], data[at + 5]
    body, end = at + 10, at + 10 + _syncsafe(data[at + 6 : at + 10])
    stop = min(end, len(data))
    if flags & 0x40 and body + 4 <= stop:  # extended header
        raw = data[body : body + 4]
        body += _syncsafe(raw) if major == 4 else 4 + int.from_bytes(raw, "big")
    while major >= 3 and body + 10 <= stop and data[body]:
        name = data[body : body + 4].decode("latin-1")
        raw = data[body + 4 : body + 8]
        size = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        value = data[body + 10 : min(body + 10 + size, stop)]
        if name == "TXXX":
            key, _, text = _text(value).partition("\x00")
            tags[key] = text
        elif name[0] == "T":
            tags[name] = _text(value)
        body += 10 + size
    return end + (10 if flags & 0x10 else 0)


def _vbr_table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in the frame at ``at``."""
    for spot in (at + 4 + h.side, at + 6 + h.side):
        name = data[spot : spot + 4]
        if name in (b"Xing", b"Info"):
            flags, spot = int.from_bytes(data[spot + 4 : spot + 8], "big"), spot + 8
            out: dict = {"name": name.decode()}
            for bit, key, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
                if flags & bit:
                    raw = data[spot : spot + size]
                    out[key] = list(raw) if key == "toc" else int.from_bytes(raw, "big")
                    spot += size
            return out
    spot = at + 36
    if data[spot : spot + 4] == b"VBRI" and spot + 26 <= len(data):
        _, _, quality, size, frames, n, scale, width, per = struct.unpack_from(">HHHIIHHHH", data, spot + 4)
        raw = data[spot + 26 : spot + 26 + n * width]
        toc = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), max(width, 1))]
        return {"name": "VBRI", "frames": frames, "bytes": size, "toc": toc, "quality": quality, "per": per}
    return None


_CHECKED: dict[bytes, int] = {}


def _crc_bits(data: bytes, bits: int) -> int:
    """The checksum of the first ``bits`` bits."""
    r = crc16(data[: bits // 8])
    for i in range(bits // 8 * 8, bits):
        bit = data[i // 8] >> (7 - i % 8) & 1
        r = (r << 1 & 0xFFFF) ^ (0x8005 if (r >> 15) ^ bit else 0)
    return r


def _covered_bits(data: bytes, at: int, h: Header) -> int:
    """Bits behind the checksum that it covers.

    Layer III: the side information. Layer I: the bit allocation, which subbands from the
    bound on have once for both channels. Layer II: that, and the scale factor selection,
    two bits for each channel of a subband that has bits at all.
    """
    if h.layer == 3:
        return 8 * h.side
    shared = min(h.bound, 32) if h.channels == 2 else 32
    if h.layer == 1:
        return 4 * (shared * h.channels + 32 - shared)
    widths = allocation_widths(h)
    value = int.from_bytes(data[at + 6 : at + 6 + 32], "big")
    place, chosen = 256, 0
    for band, width in enumerate(widths):
        separate = h.channels if band < shared else 1
        for _ in range(separate):
            place -= width
            if value >> place & (1 << width) - 1:
                chosen += 2 * h.channels // separate
    return 256 - place + chosen


def _checksum(data: bytes, at: int, h: Header) -> bool:
    """Whether the frame's CRC holds."""
    bits = _covered_bits(data, at, h)
    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + (bits + 7) // 8]
    key = covered + bytes([bits % 8])
    if key not in _CHECKED:
        if len(_CHECKED) > 10_000:
            _CHECKED.clear()
        _CHECKED[key] = _crc_bits(covered, 16 + bits)
    return _CHECKED[key] == int.from_bytes(data[at + 4 : at + 6], "big")


def _ancillary(data: bytes, at: int, h: Header) -> bytes:
    """Bytes of a Layer III frame behind its main data (none if that begins earlier)."""
    if h.layer != 3:
        return b""
    side = at + (6 if h.protected else 4)
    bits = int.from_bytes(data[side : side + h.side], "big")
    total = 8 * h.side
    back, used = (9, 9 + (5 if h.channels == 1 else 3) + 4 * h.channels) if h.version == 3 else (8, 8 + h.channels)
    if bits >> (total - back):
        return b""
    main = 0
    granule = 59 if h.version == 3 else 63
    for i in range((2 if h.version == 3 else 1) * h.channels):
        main += bits >> (total - used - i * granule - 12) & 0xFFF
    return data[side + h.side + (main + 7) // 8 : at + h.size]


def read_stream(data: bytes) -> Stream:
    """Parse a whole stream."""
    out = Stream()
    at, end = 0, len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        for key, b, e in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + b : end + e].split(b"\x00")[0].decode("latin-1").strip():
                out.tags["v1_" + key] = text
    while at + 10 <= end and data[at : at + 3] == b"ID3":
        at = _id3v2(data, at, out.tags)
    parts: list[bytes] = []
    kind: tuple[int, int, int] | None = None
    aligned = -1
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big")) if data[at] == 0xFF else None
        if h is not None and at + h.size <= end:
            after = at + h.size
            follows = header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            sure = after == end or (follows is not None and follows.kind == h.kind)
            # A frame right behind another of its kind needs no third as witness.
            if sure or (kind == h.kind and at == aligned):
                found = _vbr_table(data, at, h) if kind is None and out.table is None else None
                if found:
                    out.table = found | {"at": at}
                else:
                    out.offsets.append(at)
                    out.samples += h.samples
                    out.bitrates[h.kbps] = out.bitrates.get(h.kbps, 0) + 1
                    parts.append(_ancillary(data, at, h))
                    if h.protected:
                        good = _checksum(data, at, h)
                        out.crc_good += good is True
                        out.crc_bad += good is False
                kind = h.kind
                at = aligned = after
                continue
        again = data.find(b"\xff", at + 1, end)  # resynchronise
        again = again if again >= 0 else end
        out.skipped += again - at
        at = again
    out.skipped += max(0, end - at)
    if kind:
        out.rate, out.kind = kind[2], f"mpeg{VERSION[kind[0]]} layer {kind[1]}"
    out.ancillary = b"".join(parts)
    return out


def _own_header(bitrate: int, protected: bool) -> bytes:
    """MPEG-1 Layer III, 48 kHz, mono, for the bitrate of that index from 1."""
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | bitrate << 12 | 1 << 10 | 3 << 6
    return word.to_bytes(4, "big")


def _room(bitrate: int) -> int:
    return 3 * V1_L3[bitrate - 1] - 4 - 2 - 17


def _frame_start(bitrate: int) -> bytes:
    """Header, CRC and the side information of silence."""
    head, side = _own_header(bitrate, True), bytes(17)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_STARTS = [b"", *(_frame_start(i) for i in range(1, 15))]


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\x00" + value.encode()
    return b"TXXX" + _size(len(body)) + b"\x00\x00" + body


def _size(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def write_stream(payload: bytes) -> bytes:
    """A stream that holds ``payload``; ``read_payload`` gives it back."""
    tags = _text_frame("payload_bytes", str(len(payload))) + _text_frame("payload_crc32", str(zlib.crc32(payload)))
    full = _room(14)
    frames = []
    for b in range(0, len(payload), full):
        chunk = payload[b : b + full]
        bitrate = next(i for i in range(1, 15) if _room(i) >= len(chunk))
        frames.append(_STARTS[bitrate] + chunk + bytes(_room(bitrate) - len(chunk)))
    if b"".join(frames[-2:])[-128:-125] == b"TAG":  # bytes of the payload, but readers take them for an ID3v1 tag
        frames.append(_STARTS[3] + bytes(_room(3)))  # 144 bytes of silence
    first = _own_header(9, False) + bytes(17)  # 128 kbit/s holds the table
    whole = 3 * V1_L3[8] + sum(map(len, frames))
    ends, n = 3 * V1_L3[8], len(frames)
    toc, size, at = [], [len(f) for f in frames], 0
    for percent in range(100):
        while at < percent * n // 100:
            ends += size[at]
            at += 1
        toc.append(min(255, 256 * ends // whole))
    xing = b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + whole.to_bytes(4, "big") + bytes(toc) + bytes(4)
    head = first + xing
    head += bytes(3 * V1_L3[8] - len(head))
    return b"".join([b"ID3\x04\x00\x00" + _size(len(tags)) + tags, head, *frames])


def read_payload(stream: Stream) -> bytes:
    """The bytes that ``write_stream`` stored; checks their length and CRC-32."""
    payload = stream.ancillary[: int(stream.tags["payload_bytes"])]
    if zlib.crc32(payload) != int(stream.tags["payload_crc32"]):
        raise ValueError("the stored payload is damaged")
    return payload


def padded(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def feature(s: Stream) -> str:
    """Exact properties of a stream as one line."""
    rates = " ".join(f"{k}k:{n}" for k, n in sorted(s.bitrates.items()))
    offsets = hashlib.md5(",".join(map(str, s.offsets)).encode()).hexdigest()
    t = s.table or {}
    return (
        f"{s.kind}; frames {len(s.offsets)}; duration {s.samples}/{s.rate}; bitrates {rates}; "
        f"crc good {s.crc_good} bad {s.crc_bad}; skipped {s.skipped}; "
        f"{t.get('name', 'no table')} frames {t.get('frames', '-')} bytes {t.get('bytes', '-')}; offsets {offsets}"
    )


MEDIA = {
    "media": (T.BinaryType(), pa.binary()),
    "kind": (T.StringType(), pa.string()),
    "samples": (T.LongType(), pa.int64()),
    "rate": (T.IntegerType(), pa.int32()),
    "crc_good": (T.LongType(), pa.int64()),
    "crc_bad": (T.LongType(), pa.int64()),
    "skipped": (T.LongType(), pa.int64()),
    "seek_offsets": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "n_bytes": (T.LongType(), pa.int64()),
    "payload_bytes": (T.LongType(), pa.int64()),
    "payload_sha256": (T.StringType(), pa.string()),
    "tail_crc32": (T.LongType(), pa.int64()),
    "media_bytes": (T.LongType(), pa.int64()),
    "media_sha256": (T.StringType(), pa.string()),
    "feature": (T.StringType(), pa.string()),
}


def store(text: str | None) -> dict:
    """Store one text and read it back from the stored bytes."""
    media = write_stream(padded(text))
    s = read_stream(media)
    payload = read_payload(s)
    return {
        "media": media, "kind": s.kind, "samples": s.samples, "rate": s.rate,
        "crc_good": s.crc_good, "crc_bad": s.crc_bad, "skipped": s.skipped,
        "seek_offsets": s.offsets, "n_bytes": len((text or "").encode()),
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(s),
    }


def media_columns(
    df: DataFrame, text_col: str = "text", outputs: tuple[str, ...] = tuple(MEDIA), keep_text: bool = True
) -> DataFrame:
    """``df`` with the named columns of ``MEDIA``; a map without any shuffle."""
    names = [c for c in df.columns if c not in outputs and (keep_text or c != text_col)]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(c, MEDIA[c][0]) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {c: [] for c in outputs}
            for text in batch.column(text_col):
                got = store(text.as_py())
                for c in outputs:
                    made[c].append(got[c])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(made[c], MEDIA[c][1]) for c in outputs],
                names=[*names, *outputs],
            )

    return df.mapInArrow(run, schema)


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = (
        "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
    )
    return media_columns(docs, outputs=digest, keep_text=False)
