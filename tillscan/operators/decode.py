"""Image files to samples and back, over binary columns (S2; the body of S5).

PNG (gray, palette or colours, with or without alpha, up to 16 bits a sample, not interlaced) and
binary PNM files become (width, height, pixels) with three bytes a pixel. What cannot be read is a row with
a message, never a failed job: checksums are verified, and no more is inflated than the header announces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PNG_MARK = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by the kind of colour.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MAX_PIXELS = 100_000_000
UNREADABLE = "No se pudo leer la imagen."
_PNM = re.compile(rb"P([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


class Unreadable(ValueError):
    """A file that is no image, or a damaged one."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG_MARK)
    while at + 12 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise Unreadable("chunk")
        yield kind, body
        at += 12 + size


def _unfiltered(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Scanlines without their filters; ``step`` bytes lie between a sample and the one to its left."""
    lines = np.frombuffer(data, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)  # a line of zeros above the first
    for y in range(height):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:  # the left sample was subtracted
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            out[y + 1] = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:  # the one above
            out[y + 1] = line + above
        elif kind in (3, 4):  # the mean of both, or that of three which is nearest to their plane
            out[y + 1] = _from_left(line.tolist(), above.tolist(), step, kind == 4)
        else:
            raise Unreadable("filter")
    return out[1:]


def _from_left(line: list[int], above: list[int], step: int, paeth: bool) -> list[int]:
    out = line[:]
    for i, (value, up) in enumerate(zip(line, above, strict=True)):
        left, corner = (out[i - step], above[i - step]) if i >= step else (0, 0)
        if paeth:
            near = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
        else:
            near = (left + up) // 2
        out[i] = (value + near) & 255
    return out


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 3) samples."""
    head, body, palette = None, [], None
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
    else:
        raise Unreadable("end")
    if head is None or head[3] not in PNG_SAMPLES or head[4:] != (0, 0, 0) or head[2] not in (1, 2, 4, 8, 16):
        raise Unreadable("header")
    width, height, depth, colour = head[:4]
    samples = PNG_SAMPLES[colour]
    if not 0 < width * height <= MAX_PIXELS or (colour == 3 and palette is None):
        raise Unreadable("size")
    stride = (width * samples * depth + 7) // 8
    wanted = height * (stride + 1)
    flat = zlib.decompressobj().decompress(b"".join(body), wanted)
    if len(flat) != wanted:
        raise Unreadable("data")
    lines = _unfiltered(flat, height, stride, max(1, samples * depth // 8))
    if depth == 16:
        lines = lines[:, ::2]  # the high bytes
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        lines = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, : width * samples].astype(np.uint8)
        if colour == 0:
            lines = lines * np.uint8(255 // ((1 << depth) - 1))
    pixels = lines.reshape(height, width, samples)
    if colour == 3:
        if pixels.max() >= len(palette):
            raise Unreadable("palette")
        return palette[pixels[..., 0]]
    return pixels[..., :3] if samples >= 3 else np.repeat(pixels[..., :1], 3, axis=2)


def read_pnm(data: bytes) -> np.ndarray:
    """(height, width, 3) samples of a binary gray or colour map."""
    head = _PNM.match(data)
    if head is None:
        raise Unreadable("header")
    samples = 1 if head[1] == b"5" else 3
    width, height, most = (int(x) for x in head.groups()[1:])
    body = data[head.end() : head.end() + width * height * samples]
    if not 0 < most < 256 or not 0 < width * height <= MAX_PIXELS or len(body) < width * height * samples:
        raise Unreadable("data")
    pixels = np.frombuffer(body, np.uint8).reshape(height, width, samples)
    if most != 255:
        pixels = (np.minimum(pixels, most).astype(np.uint32) * 255 // most).astype(np.uint8)
    return np.repeat(pixels, 3, axis=2) if samples == 1 else pixels


def read_image(data: bytes) -> np.ndarray:
    return read_png(data) if data.startswith(PNG_MARK) else read_pnm(data)


def png_bytes(image: np.ndarray, filtered: int = 0) -> bytes:
    """A PNG of gray or colour samples; all lines get one filter (none, left or above)."""
    height, width = image.shape[:2]
    samples = image.shape[2] if image.ndim == 3 else 1
    lines = image.reshape(height, width * samples)
    before = np.zeros_like(lines)
    if filtered == 1:
        before[:, samples:] = lines[:, :-samples]
    elif filtered == 2:
        before[1:] = lines[:-1]
    rows = np.concatenate([np.full((height, 1), filtered, np.uint8), lines - before], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if samples == 1 else 2, 0, 0, 0)
    parts = [(b"IHDR", head), (b"IDAT", zlib.compress(rows.tobytes())), (b"IEND", b"")]
    made = [struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts]
    return PNG_MARK + b"".join(made)


def decode_images(files: DataFrame, *keys: str, content_col: str = "content") -> DataFrame:
    """(keys, width, height, pixels, message) of image files: samples, or why there are none."""
    added = "width int, height int, pixels binary, message string"
    schema = T.StructType([files.schema[k] for k in keys] + T.StructType.fromDDL(added).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                try:
                    image = read_image(bytes(row[-1] or b""))
                    made = (image.shape[1], image.shape[0], image.tobytes(), None)
                except (Unreadable, zlib.error, struct.error, ValueError):
                    made = (None, None, None, UNREADABLE)
                one = pd.DataFrame([(*row[:-1], *made)], columns=schema.names)
                yield one.astype({"width": "Int32", "height": "Int32"})

    return files.select(*keys, content_col).mapInPandas(run, schema)


def encode_images(images: DataFrame, *keys: str) -> DataFrame:
    """(keys, content): PNG files of (width, height, pixels), gray or with three bytes a pixel; null where sizes do not fit."""
    schema = T.StructType([images.schema[k] for k in keys] + [T.StructField("content", T.BinaryType())])

    def body(width: object, height: object, pixels: bytes | None) -> bytes | None:
        if pixels is None or pd.isna(width) or pd.isna(height) or not len(pixels):
            return None
        count = int(width) * int(height)
        if len(pixels) not in (count, 3 * count):
            return None
        shape = (int(height), int(width)) if len(pixels) == count else (int(height), int(width), 3)
        return png_bytes(np.frombuffer(pixels, np.uint8).reshape(shape), filtered=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = zip(rows["width"], rows["height"], rows["pixels"], strict=True)
            yield rows[list(keys)].assign(content=[body(*f) for f in found])

    return images.select(*keys, "width", "height", "pixels").mapInPandas(run, schema)
