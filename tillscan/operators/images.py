"""Preparing images for OCR, over columns of raw samples.

An image is (width, height, pixels): one byte a pixel in rows from the top, or three (red,
green, blue). Steps are numpy functions over one image, applied in Arrow batches;
``image_variants`` puts them together to the 32 renderings of a page. Empty images stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscan import dictionaries as D


def grayscale(pixels: np.ndarray) -> np.ndarray:
    """Luminance of (height, width, 3) samples, in 16-bit fixed point."""
    r, g, b = (pixels[..., i].astype(np.uint32) for i in range(3))
    return ((r * D.GRAY_RED + g * D.GRAY_GREEN + b * D.GRAY_BLUE + 0x8000) >> 16).astype(np.uint8)


def prepared(gray: np.ndarray) -> np.ndarray:
    """Stretched contrast in a white border."""
    bright = np.clip(gray * np.float32(D.CONTRAST_SCALE) + np.float32(D.CONTRAST_OFFSET), 0, 255).astype(np.uint8)
    return np.pad(bright, D.BORDER, constant_values=255)


def crop_box(gray: np.ndarray) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of the bright paper, or of the whole image."""
    height, width = gray.shape
    whole = (0, 0, width, height)
    if not gray.size:
        return whole
    low, high = int(gray.min()), int(gray.max())
    if high > low:
        scale = 255.0 / (high - low)
        gray = np.clip(np.arange(256) * scale - low * scale, 0, 255).astype(np.uint8)[gray]
    bright = gray > D.PAPER_LEVEL
    rows, columns = (np.flatnonzero(bright.mean(axis=a) > D.PAPER_SHARE) for a in (1, 0))
    if min(len(rows), len(columns)) < D.PAPER_LINES:
        return whole
    top, bottom = max(int(rows[0]) - D.PAPER_MARGIN, 0), min(int(rows[-1]) + D.PAPER_MARGIN, height)
    left, right = max(int(columns[0]) - D.PAPER_MARGIN, 0), min(int(columns[-1]) + D.PAPER_MARGIN, width)
    small = right - left < width * D.PAPER_WIDTH or bottom - top < height * D.PAPER_HEIGHT
    return whole if small else (left, top, right, bottom)


def cropped(gray: np.ndarray) -> np.ndarray:
    left, top, right, bottom = crop_box(gray)
    return gray[top:bottom, left:right]


def threshold(level: int) -> Callable[[np.ndarray], np.ndarray]:
    """Black up to ``level``, white above (a part of I2)."""
    return lambda gray: np.where(gray > level, np.uint8(255), np.uint8(0))


def rotated(degrees: int) -> Callable[[np.ndarray], np.ndarray]:
    """Turned against the clock by a multiple of 90 degrees (a part of I2)."""
    return lambda gray: np.rot90(gray, degrees // 90)


def median3(gray: np.ndarray) -> np.ndarray:
    """The median of each pixel and its neighbours; the border repeats outwards (a part of I2)."""
    if not gray.size:
        return gray
    wide = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median([wide[y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0).astype(np.uint8)


def _blended(base: np.ndarray, image: np.ndarray, factor: float) -> np.ndarray:
    """``image`` moved away from ``base`` (or towards it) by a factor."""
    low, high = base.astype(np.float32), image.astype(np.float32)
    return np.clip(low + np.float32(factor) * (high - low), 0, 255).astype(np.uint8)


def contrasted(factor: float) -> Callable[[np.ndarray], np.ndarray]:
    """Contrast about the mean level (a part of I2)."""

    def run(gray: np.ndarray) -> np.ndarray:
        mean = np.floor(gray.mean() + 0.5) if gray.size else 0
        return _blended(np.full_like(gray, mean), gray, factor)

    return run


def smoothed(gray: np.ndarray) -> np.ndarray:
    """A mean of each pixel and its neighbours in which it counts five times; the border stays (a part of I2)."""
    h, w = gray.shape
    if min(h, w) < 3:
        return gray
    wide = gray.astype(np.int32)
    total = sum(wide[y : h - 2 + y, x : w - 2 + x] for y in range(3) for x in range(3)) + 4 * wide[1:-1, 1:-1]
    out = gray.copy()
    out[1:-1, 1:-1] = (2 * total + 13) // 26  # rounded thirteenths
    return out


def sharpened(factor: float) -> Callable[[np.ndarray], np.ndarray]:
    """Sharpness: away from the smoothed image (a part of I2)."""
    return lambda gray: _blended(smoothed(gray), gray, factor)


#: Bits behind the point of a kernel's weights, and its half width in samples.
KERNEL_BITS, KERNEL_REACH = 22, 3.0


def lanczos_taps(size: int, new_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(new_size, taps) source places and fixed-point weights of a windowed-sinc resampling."""
    scale = size / new_size
    stretch = max(scale, 1.0)
    reach = KERNEL_REACH * stretch
    center = (np.arange(new_size) + 0.5) * scale
    first = np.maximum((center - reach + 0.5).astype(np.int64), 0)
    stop = np.minimum((center + reach + 0.5).astype(np.int64), size)
    at = first[:, None] + np.arange(int((stop - first).max()))
    x = (at - center[:, None] + 0.5) / stretch
    weight = np.where((np.abs(x) < KERNEL_REACH) & (at < stop[:, None]), np.sinc(x) * np.sinc(x / KERNEL_REACH), 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.minimum(at, size - 1), np.floor(weight * (1 << KERNEL_BITS) + 0.5).astype(np.int64)


def _resampled_rows(image: np.ndarray, new_size: int) -> np.ndarray:
    """The first axis resampled: one weighted sum of source rows for each new row."""
    at, weight = lanczos_taps(len(image), new_size)
    shape = (-1,) + (1,) * (image.ndim - 1)
    total = np.full((new_size, *image.shape[1:]), 1 << (KERNEL_BITS - 1), np.int64)
    for t in range(at.shape[1]):
        total += weight[:, t].reshape(shape) * image[at[:, t]]
    return np.clip(total >> KERNEL_BITS, 0, 255).astype(np.uint8)


def resized(width: int, height: int) -> Callable[[np.ndarray], np.ndarray]:
    """Resampled across, then down; an axis of the right size stays."""

    def run(image: np.ndarray) -> np.ndarray:
        if not image.size:
            return image
        if image.shape[1] != width:
            image = _resampled_rows(image.swapaxes(0, 1), width).swapaxes(0, 1)
        return image if image.shape[0] == height else _resampled_rows(image, height)

    return run


def limited(longest: int) -> Callable[[np.ndarray], np.ndarray]:
    """Resampled so that no side is over ``longest``."""

    def run(image: np.ndarray) -> np.ndarray:
        height, width = image.shape[:2]
        if max(width, height) <= longest:
            return image
        scale = longest / max(width, height)
        return resized(max(1, int(width * scale)), max(1, int(height * scale)))(image)

    return run


def page_variants(image: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """The renderings of a page of colours, in the order that settles ties (I2); what they share is made once."""
    for turn, suffix in D.VARIANT_TURNS:
        turned = rotated(turn)(image)
        left, top, right, bottom = crop_box(grayscale(turned))
        base = limited(D.VARIANT_SIDE)(turned[top:bottom, left:right])
        gray = grayscale(base)
        sharp = sharpened(D.SHARPNESS_FACTOR)(contrasted(D.CONTRAST_FACTOR)(gray))
        height, width = sharp.shape
        enlarged = limited(D.ENLARGED_SIDE)(resized(2 * width, 2 * height)(sharp))
        denoised = median3(enlarged)
        small = limited(D.SMALL_SIDE)(base)
        made = (
            base, gray, enlarged, threshold(D.DARK_LEVEL)(enlarged), denoised, threshold(D.LIGHT_LEVEL)(denoised), small, grayscale(small),
        )
        for name, variant in zip(D.VARIANT_NAMES, made, strict=True):
            yield f"{name}-{suffix}", variant


def image_variants(images: DataFrame, *keys: str) -> DataFrame:
    """(keys, variant_pos, variant, channels, width, height, pixels): 32 rows for each page of colours.

    ``variant_pos`` is the order in which renderings are tried, as ``best_variant`` wants it. A page
    whose samples do not fill its size has none. A page and its renderings are in memory at a time.
    """
    added = "variant_pos int, variant string, channels int, width int, height int, pixels binary"
    schema = T.StructType([images.schema[k] for k in keys] + T.StructType.fromDDL(added).fields)

    def run(batches):
        for rows in batches:
            for row in rows.itertuples(index=False):
                of = row._asdict()
                w, h, data = of["width"], of["height"], of["pixels"]
                if data is None or pd.isna(w) or pd.isna(h) or not len(data) or len(data) != int(w) * int(h) * 3:
                    continue
                page = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)
                made = [
                    (*(of[k] for k in keys), i, name, v.ndim == 3 and 3 or 1, v.shape[1], v.shape[0], v.tobytes())
                    for i, (name, v) in enumerate(page_variants(page))
                ]
                yield pd.DataFrame(made, columns=schema.names)

    return images.select(*keys, "width", "height", "pixels").mapInPandas(run, schema)


def transform_images(images: DataFrame, *steps: Callable[[np.ndarray], np.ndarray], channels: int = 1) -> DataFrame:
    """``images`` with ``width``, ``height`` and ``pixels`` after the steps; a map without a shuffle.

    Images whose samples do not fill width times height get null pixels.
    """

    def run(batches):
        for rows in batches:
            made = []
            for w, h, data in zip(rows["width"], rows["height"], rows["pixels"], strict=True):
                if data is None or pd.isna(w) or pd.isna(h) or len(data) != int(w) * int(h) * channels:
                    made.append((w, h, None))
                    continue
                shape = (int(h), int(w)) if channels == 1 else (int(h), int(w), channels)
                image = np.frombuffer(data, dtype=np.uint8).reshape(shape)
                for step in steps:
                    image = step(image)
                made.append((image.shape[1], image.shape[0], image.tobytes()))
            columns = list(zip(*made, strict=True)) if made else [[], [], []]
            yield rows.assign(width=pd.array(columns[0], "Int32"), height=pd.array(columns[1], "Int32"), pixels=list(columns[2]))

    return images.mapInPandas(run, images.schema)


def limited_size(width: Column, height: Column, longest: int = D.LONGEST_SIDE) -> tuple[Column, Column]:
    """The size of an image whose longest side may be ``longest``."""
    most = F.greatest(width, height)
    scale = F.lit(float(longest)) / most
    return tuple(
        F.when(most <= longest, side).otherwise(F.greatest(F.lit(1), F.floor(side * scale).cast("int"))) for side in (width, height)
    )


def retry_delay(attempt: Column) -> Column:
    """Milliseconds to wait after a failed attempt, from 1."""
    return F.least(attempt * D.RETRY_STEP, F.lit(D.RETRY_MOST))
