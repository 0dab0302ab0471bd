"""Image batches from files to features.

Files are decoded in the JVM by Spark's image source. Resizing, seeded augmentation
and the descriptor run on arrays in Arrow batches, without a shuffle; an image goes
alone through them, so only batches of ``size`` x ``size`` arrays are held. A batch
comes from ``spark.sql.execution.arrow.maxRecordsPerBatch`` decoded images: lower it
where images are large.

A file that can't be decoded gives a row with ``readable`` false and null features;
Spark's file sources pass over files without a byte, which give no row.
Flips, brightness and contrast depend on the path and the seed alone, so another run or
a task that is repeated gives the same features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, BATCH = 224, 32  # fixed values: side of a resized image, images a batch (U4)
BRIGHTNESS, CONTRAST = 0.2, (0.8, 1.2)  # fixed values: greatest shift of brightness, range of contrast (U4)
SUFFIXES = "*.{png,jpg,JPG,jpeg}"  # fixed value (S14)

Descriptor = Callable[[np.ndarray], np.ndarray]


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, readable, image) of images below a folder; the label is the folder's name, image is decoded."""
    source = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES)
    origin = F.col("image.origin")
    return source.load(path).select(origin.alias("path"), F.element_at(F.split(origin, "/"), -2).alias("label"), (F.col("image.height") > 0).alias("readable"), "image")


def as_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Red, green and blue of a decoded image, 0 to 1; grey is spread over the three, transparency dropped."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    colours = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]  # stored as blue, green, red
    return colours.astype(np.float32) / 255


def resized(image: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Bilinear, from the centres of pixels; edges are repeated."""

    def along(values: np.ndarray, axis: int) -> np.ndarray:
        n = values.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).astype(np.float32).reshape([-1 if a == axis else 1 for a in range(3)])
        return values.take(low, axis) * (1 - part) + values.take(np.minimum(low + 1, n - 1), axis) * part

    return along(along(image, 0), 1)


def augmented(image: np.ndarray, seed: int) -> np.ndarray:
    """U4: flips, then brightness, then contrast about each channel's mean, all drawn from ``seed``."""
    draw = np.random.default_rng(seed % 2**64)
    across, down, shift, factor = draw.random() < 0.5, draw.random() < 0.5, draw.uniform(-BRIGHTNESS, BRIGHTNESS), draw.uniform(*CONTRAST)
    image = image[:, ::-1] if across else image
    image = (image[::-1] if down else image) + np.float32(shift)
    mean = image.mean(axis=(0, 1), keepdims=True)
    return np.clip((image - mean) * np.float32(factor) + mean, 0, 1)


def gradient_histogram(images: np.ndarray, cells: int = 4, bins: int = 9) -> np.ndarray:
    """U4's default model: for each of ``cells`` x ``cells`` parts of an image how strong its gradients are in ``bins`` directions, at length one."""
    n, side = images.shape[:2]
    down, across = np.gradient(images.mean(axis=3), axis=(1, 2))
    turn = np.minimum((np.mod(np.arctan2(down, across), np.pi) / np.pi * bins).astype(int), bins - 1)
    part = np.arange(side) * cells // side
    place = ((np.arange(n)[:, None, None] * cells + part[:, None]) * cells + part) * bins + turn
    sums = np.bincount(place.ravel(), np.hypot(down, across).ravel(), n * cells * cells * bins).reshape(n, -1)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(length > 0, length, 1)


def describe(images: DataFrame, model: Descriptor = gradient_histogram, seed: int | None = 0, size: int = SIZE, batch: int = BATCH) -> DataFrame:
    """U4: rows of ``read_pixels`` with ``features`` in place of the image; ``seed`` None leaves images as they are.

    ``model`` takes arrays of (images, size, size, 3) from 0 to 1 and gives a row of numbers for each.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        for pictures, seeds in parts:
            out: list[list[float] | None] = [None] * len(pictures)
            held: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if held:
                    for (k, _), row in zip(held, model(np.stack([a for _, a in held]))):
                        out[k] = np.asarray(row, np.float32).tolist()
                    held.clear()

            rows = zip(pictures["data"], pictures["height"], pictures["width"], pictures["nChannels"], seeds)
            for k, (data, height, width, channels, own) in enumerate(rows):
                if height > 0:
                    small = resized(as_array(data, height, width, channels), size)
                    held.append((k, small if seed is None else augmented(small, int(own))))
                if len(held) == batch:
                    flush()
            flush()
            yield pd.Series(out, dtype="object")

    own = F.xxhash64("path", F.lit(0 if seed is None else seed))
    return images.withColumn("features", run("image", own)).drop("image")
