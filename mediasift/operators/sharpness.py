"""Pixel kernels over luma and colour grids, and the sharpness verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Sharpness
from ..ship import ship

MEASURES = "laplacian float, tenengrad float, energy_p90 float, energy_median float, luma_mean float, luma_std float"


def verdict(c: Sharpness = Sharpness()) -> Column:
    """MTH-06: verdict from ``laplacian, tenengrad, luma_mean, luma_std``; nulls tell too little."""
    enough = F.coalesce(~((F.col("luma_mean") < c.dark) | (F.col("luma_std") < c.flat)), F.lit(False))
    blurry = (F.col("laplacian") <= c.blurry_laplacian) & (F.col("tenengrad") <= c.blurry_tenengrad)
    return F.when(~enough, "insufficientInformation").when(F.col("laplacian") >= c.sharp, "sharp").when(blurry, "likelyBlurry").otherwise("borderline")


def _around(g: np.ndarray) -> np.ndarray:
    return np.pad(g, 1, mode="edge")


def measure(luma: np.ndarray, blocks: int = Sharpness.blocks) -> tuple[float, ...]:
    """MTH-05, AGG-14/15: focus measures of a square luma grid with values from 0 to 1.

    Variance of the Laplacian, mean Sobel energy, upper and middle block energy
    (the element at int((n - 1) * 0.9), no interpolation; the mean of the two middle ones), mean and deviation. Edges repeat outwards.
    """
    g = luma.astype(np.float32)
    p = _around(g)
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    energy = gx * gx + gy * gy
    side = max(1, g.shape[0] // blocks)
    n = g.shape[0] // side
    means = np.sort(energy[: n * side, : n * side].reshape(n, side, n, side).mean(axis=(1, 3)).ravel())
    k = len(means)
    median = means[k // 2] if k % 2 else (means[k // 2 - 1] + means[k // 2]) / 2
    return float(lap.var()), float(energy.mean()), float(means[int((k - 1) * 0.9)]), float(median), float(g.mean()), float(g.std())


def _weights(n: int, side: int, scale: float) -> np.ndarray:
    """Rows of weights that bring ``n`` samples to the middle ``side`` of ``n * scale``: boxes where it shrinks, triangles where it grows."""
    at = (np.arange(side) + 0.5 - side / 2) / scale + n / 2
    left, right = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
    if scale <= 1:
        w = np.clip(np.minimum(right, at[:, None] + 0.5 / scale) - np.maximum(left, at[:, None] - 0.5 / scale), 0, None)
    else:
        w = np.clip(1 - np.abs(np.clip(at, 0.5, n - 0.5)[:, None] - left - 0.5), 0, None)
    return w / w.sum(axis=1, keepdims=True)


#: What the orientation numbers of images ask for: quarter turns counter-clockwise, after mirroring left and right.
TURNS = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (1, True), 6: (3, False), 7: (3, True), 8: (1, False)}


def aspect_fill(luma: np.ndarray, side: int, orientation: int = 1) -> np.ndarray:
    """SRC-11: the middle of an image that fills a square of ``side``, upright."""
    turns, mirrored = TURNS[orientation]
    image = np.rot90(luma[:, ::-1] if mirrored else luma, turns)
    scale = side / min(image.shape)
    return (_weights(image.shape[0], side, scale) @ image.astype(np.float64) @ _weights(image.shape[1], side, scale).T).astype(np.float32)


def thumbnails(images: DataFrame, side: int = Sharpness.side) -> DataFrame:
    """SRC-11: ``id, luma, reason`` from ``id, luma`` (array), ``width, height, orientation``: a square of ``side`` values a side, upright, cut from the middle.

    An image without pixels is ``imageUnavailable``, one whose pixels do not fit its size or whose orientation is unknown ``thumbnailFailed``; both have
    a null ``luma``. A null orientation is upright. The result goes into :func:`sharpness`.
    """
    ship(images.sparkSession)

    def render(luma, width: int, height: int, orientation: float) -> tuple:
        if luma is None or width is None or height is None:
            return None, "imageUnavailable"
        turn = 1 if orientation is None or orientation != orientation else int(orientation)
        if turn not in TURNS or width != width or height != height or min(width, height) < 1 or len(luma) != width * height:
            return None, "thumbnailFailed"
        return aspect_fill(np.asarray(luma, dtype=np.float32).reshape(int(height), int(width)), side, turn).ravel(), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [render(*r) for r in zip(pdf["luma"], pdf["width"], pdf["height"], pdf["orientation"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "luma": pd.Series([d[0] for d in done], index=pdf.index, dtype=object), "reason": pd.Series([d[1] for d in done], index=pdf.index, dtype=object)})

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "luma", "width", "height", "orientation").mapInPandas(run, f"id {kind}, luma array<float>, reason string")


def sharpness(grids: DataFrame, side: int = Sharpness.side) -> DataFrame:
    """MTH-05: ``id`` and focus measures from ``id, luma`` (array of side * side floats). A grid of another size or a null one has null measures."""
    ship(grids.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *(measure(np.asarray(v, dtype=np.float32).reshape(side, side)) if v is not None and len(v) == side * side else [None] * 6)) for i, v in zip(pdf["id"], pdf["luma"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", *[m.split()[0] for m in MEASURES.split(", ")]])

    kind = grids.schema["id"].dataType.simpleString()
    return grids.select("id", "luma").mapInPandas(run, f"id {kind}, {MEASURES}")


def difference_hash(gray: Column) -> Column:
    """MTH-03: 64 bits from a grid of 8 rows of 9 grey values: bit ``row * 8 + col`` is set where a value is below its right neighbour. Null for another size."""
    bits = [F.when(F.get(gray, F.lit(r * 9 + c)) < F.get(gray, F.lit(r * 9 + c + 1)), F.lit((1 << (r * 8 + c)) - ((1 << 64) if r * 8 + c == 63 else 0))).otherwise(F.lit(0)) for r in range(8) for c in range(8)]
    return F.when(F.size(gray) == 72, F.aggregate(F.array(*bits), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b)))


def grid_descriptor(rgb: np.ndarray) -> np.ndarray:
    """MTH-04: 771 floats from a 16 x 16 x 3 grid: channels less their means, the means at half weight, scaled to length 1."""
    x = rgb.reshape(256, 3).astype(np.float32)
    means = x.mean(axis=0)
    v = np.concatenate([(x - means).ravel(), means * np.float32(0.5)]).astype(np.float32)
    length = np.sqrt(np.sum(v * v, dtype=np.float32))
    return v / length if length > 0 else v


def descriptors(grids: DataFrame) -> DataFrame:
    """MTH-04: ``id, values`` from ``id, rgb`` (array of 768 floats); another size gives null."""
    ship(grids.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "values": [grid_descriptor(np.asarray(v, dtype=np.float32)) if v is not None and len(v) == 768 else None for v in pdf["rgb"]]})

    kind = grids.schema["id"].dataType.simpleString()
    return grids.select("id", "rgb").mapInPandas(run, f"id {kind}, values array<float>")
