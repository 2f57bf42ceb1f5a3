"""Numeric features of images: colour statistics, histograms, edges, texture, brightness, contrast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIDE = 64
BINS = 16
PATCH = 4


def resize(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Nearest-pixel resampling to a square."""
    height, width = pixels.shape[:2]
    rows = (np.arange(side) + 0.5) * height / side
    columns = (np.arange(side) + 0.5) * width / side
    return pixels[rows.astype(int)][:, columns.astype(int)]


def describe(pixels: np.ndarray) -> np.ndarray:
    """62 numbers from an RGB array: per channel mean, deviation, 16-bin histogram, patch variance and range,
    plus edge strength and brightness of the grey image."""
    image = pixels.astype(float)
    channels = [image[:, :, c] for c in range(3)]
    statistics = [s for c in channels for s in (c.mean(), c.std())]
    shares = [np.histogram(c, bins=BINS, range=(0, 256))[0] / c.size for c in channels]
    grey = image.mean(axis=2)
    right, down = np.diff(grey, axis=1)[:-1, :], np.diff(grey, axis=0)[:, :-1]
    edges = np.hypot(right, down).mean()
    n = SIDE // PATCH
    texture = [c.reshape(n, PATCH, n, PATCH).mean(axis=(1, 3)).var() for c in channels]
    contrast = [c.max() - c.min() for c in channels]
    return np.concatenate([statistics, *shares, [edges], texture, [grey.mean()], contrast])


def image_features(images: DataFrame) -> DataFrame:
    """file_name, label and a 62-number array per decoded image (Spark's image source stores BGR bytes)."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for height, width, channels, data in zip(batch["height"], batch["width"], batch["channels"], batch["data"]):
                raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                rgb = raw[:, :, [2, 1, 0]] if channels >= 3 else np.repeat(raw[:, :, :1], 3, axis=2)
                rows.append(describe(resize(rgb)))
            yield pd.DataFrame({"file_name": batch["file_name"], "label": batch["label"], "features": rows})

    return images.mapInPandas(extract, "file_name string, label int, features array<double>")
