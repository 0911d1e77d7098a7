"""Fingerprints from image rows: map-only numpy batches over BGR bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import bound_batches

# Canonical geometry of the descriptor and its footer.
CANON_W, CANON_H = 240, 336
FULL_GRID, COLOUR_GRID = 16, 6
ART = (42, 168, 30, 210)  # y0, y1, x0, x1
ART_GRID = (12, 14)  # across, down
STRIP_Y = (300, 336)
STRIP_GRID = (30, 4)
ROW_BYTES, STRIP_BYTES = 96, 15
WEIGHTS = (0.114, 0.587, 0.299)  # b, g, r


def luma(bgr: np.ndarray) -> np.ndarray:
    x = bgr.astype(np.float64)
    return np.floor(WEIGHTS[2] * x[..., 2] + WEIGHTS[1] * x[..., 1] + WEIGHTS[0] * x[..., 0]).astype(np.int64)


def cell_sums(planes: np.ndarray, across: int, down: int) -> np.ndarray:
    """Integer sums of equal boxes of a stack of planes."""
    n, h, w = planes.shape
    return planes.reshape(n, down, h // down, across, w // across).sum(axis=(2, 4), dtype=np.int64)


def describe_batch(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors (n x 96 bytes) and footers (n x 15) of a canonical BGR stack."""
    n = len(images)
    grey = luma(images)
    full = cell_sums(grey, FULL_GRID, FULL_GRID)
    art = cell_sums(grey[:, ART[0] : ART[1], ART[2] : ART[3]], *ART_GRID)
    parts = [full[:, :, 1:] > full[:, :, :-1], full[:, 1:, :] > full[:, :-1, :], art[:, :, 1:] > art[:, :, :-1]]
    for channel in range(3):
        cells = cell_sums(images[..., channel].astype(np.int64), COLOUR_GRID, COLOUR_GRID).reshape(n, -1)
        parts.append(cells > np.median(cells, axis=1, keepdims=True))
    bits = np.concatenate([p.reshape(n, -1) for p in parts], axis=1)
    strip = cell_sums(grey[:, STRIP_Y[0] : STRIP_Y[1]], *STRIP_GRID)
    strip_bits = (strip[:, :, 1:] > strip[:, :, :-1]).reshape(n, -1)

    def pack(b, size):
        packed = np.packbits(b, axis=1)
        return np.pad(packed, ((0, 0), (0, size - packed.shape[1])))

    return pack(bits, ROW_BYTES), pack(strip_bits, STRIP_BYTES)


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint8) for x in pdf["data"]]).reshape(-1, CANON_H, CANON_W, 3)


def describe_images(images: DataFrame, key: str = "image_id", describer: Callable = describe_batch) -> DataFrame:
    """``key, desc, strip`` of canonical 240x336 BGR rows; other sizes are left out.

    ``describer`` is a batch function from an image stack to both byte matrices.
    """
    fitting = images.filter((F.col("width") == CANON_W) & (F.col("height") == CANON_H) & (F.col("nChannels") == 3))

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Small stacks: a canonical image takes 2 MB once it is widened.
            for at in range(0, len(pdf), 32):
                part = pdf.iloc[at : at + 32]
                desc, strip = describer(_stack(part))
                yield pd.DataFrame({key: part[key].values, "desc": [d.tobytes() for d in desc], "strip": [s.tobytes() for s in strip]})

    bound_batches(images.sparkSession)
    kind = dict(images.dtypes)[key]
    return fitting.select(key, "data").mapInPandas(over, f"{key} {kind}, desc binary, strip binary")


def trim_one(image: np.ndarray) -> np.ndarray:
    """Crop to what stands out from the border colour; keep the image if that is little."""
    x = image.astype(np.int64)
    # 14-bit fixed-point grey weights.
    grey = (x[..., 2] * 4899 + x[..., 1] * 9617 + x[..., 0] * 1868 + 8192) >> 14
    border = np.concatenate([grey[0], grey[-1], grey[:, 0], grey[:, -1]])
    ys, xs = np.nonzero(np.abs(grey - np.median(border)) > 12)
    if len(xs) < 100:
        return image
    y0, y1, x0, x1 = ys.min(), ys.max(), xs.min(), xs.max()
    if x1 - x0 < image.shape[1] * 0.3 or y1 - y0 < image.shape[0] * 0.3:
        return image
    return image[y0 : y1 + 1, x0 : x1 + 1]


def trim_border(images: DataFrame, key: str = "image_id") -> DataFrame:
    def over(batches):
        for pdf in batches:
            rows = []
            for ident, w, h, data in zip(pdf[key], pdf["width"], pdf["height"], pdf["data"]):
                cut = trim_one(np.frombuffer(data, np.uint8).reshape(h, w, 3))
                rows.append((ident, cut.shape[1], cut.shape[0], 3, cut.tobytes()))
            yield pd.DataFrame(rows, columns=[key, "width", "height", "nChannels", "data"])

    bound_batches(images.sparkSession)
    kind = dict(images.dtypes)[key]
    return images.select(key, "width", "height", "data").mapInPandas(
        over, f"{key} {kind}, width int, height int, nChannels int, data binary")


def _area_weights(src: int, dst: int) -> np.ndarray:
    """dst x src weights of pixel-area resampling."""
    edges = np.arange(dst + 1) * (src / dst)
    low, high = edges[:-1, None], edges[1:, None]
    at = np.arange(src)[None, :]
    cover = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def fit_canonical(images: DataFrame, key: str = "image_id") -> DataFrame:
    """Resize to the canonical size by pixel area."""
    def over(batches):
        for pdf in batches:
            out = []
            for w, h, data in zip(pdf["width"], pdf["height"], pdf["data"]):
                x = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                if (w, h) != (CANON_W, CANON_H):
                    y = np.einsum("yh,hwc,xw->yxc", _area_weights(h, CANON_H), x.astype(np.float64), _area_weights(w, CANON_W), optimize=True)
                    x = np.clip(np.rint(y), 0, 255).astype(np.uint8)
                out.append(x.tobytes())
            yield pd.DataFrame({key: pdf[key].values, "width": CANON_W, "height": CANON_H, "nChannels": 3, "data": out})

    bound_batches(images.sparkSession)
    kind = dict(images.dtypes)[key]
    return images.select(key, "width", "height", "data").mapInPandas(
        over, f"{key} {kind}, width int, height int, nChannels int, data binary")


def image_sharpness(images: DataFrame, key: str = "image_id") -> DataFrame:
    """Variance of the Laplacian of the grey image, edges mirrored."""
    def over(batches):
        for pdf in batches:
            out = []
            for w, h, data in zip(pdf["width"], pdf["height"], pdf["data"]):
                g = np.pad(luma(np.frombuffer(data, np.uint8).reshape(h, w, 3)).astype(np.float64), 1, mode="reflect")
                lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
                out.append(float(lap.var()))
            yield pd.DataFrame({key: pdf[key].values, "sharpness": out})

    bound_batches(images.sparkSession)
    kind = dict(images.dtypes)[key]
    return images.select(key, "width", "height", "data").mapInPandas(over, f"{key} {kind}, sharpness double")


def build_index(catalogue: DataFrame, images: DataFrame, bucket=None, order: str = "position") -> tuple[DataFrame, DataFrame]:
    """Fingerprints of every catalogue card with a usable image, densely numbered.

    ``catalogue``: ``card_id, position``. Rows keep catalogue order; the dense
    ``row_id`` is a two-phase count. Cards without an image are the second frame.
    """
    from vitrine.operators.ordered import row_index

    bucket = F.floor(F.col(order) / 1_000_000) if bucket is None else bucket
    prints = describe_images(images.withColumnRenamed("image_id", "card_id"), "card_id")
    found = catalogue.join(prints, "card_id")
    missing = catalogue.join(prints.select("card_id"), "card_id", "left_anti")
    return row_index(found, [], [order], bucket, "row_id"), missing
