"""Images from files to features (S14, U4), against plain loops over pixels."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest

from catalith.operators import images


def png(pixels: np.ndarray) -> bytes:
    """A file of an array (height, width, 3) or (height, width)."""
    h, w = pixels.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, draw = tmp_path_factory.mktemp("pictures"), np.random.default_rng(5)
    made = {}
    for k, shape in enumerate([(5, 9, 3), (30, 20, 3), (1, 1, 3), (8, 8), (40, 3, 3)]):
        made[f"k{k % 2}/{k}.png"] = draw.integers(0, 256, shape, dtype=np.uint8)
    for name, pixels in made.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(png(pixels))
    (root / "k0" / "broken.jpg").write_bytes(b"no picture")
    (root / "k0" / "empty.png").write_bytes(b"")
    (root / "k0" / "other.PNG").write_bytes(png(made["k0/0.png"]))  # suffixes are case-sensitive
    return root, made


def plain_resize(image, size):
    h, w = len(image), len(image[0])
    out = np.zeros((size, size, 3))
    for y in range(size):
        for x in range(size):
            fy, fx = (min(max((v + 0.5) * n / size - 0.5, 0), n - 1) for v, n in ((y, h), (x, w)))
            y0, x0 = math.floor(fy), math.floor(fx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            for c in range(3):
                top = image[y0][x0][c] * (1 - fx + x0) + image[y0][x1][c] * (fx - x0)
                low = image[y1][x0][c] * (1 - fx + x0) + image[y1][x1][c] * (fx - x0)
                out[y, x, c] = top * (1 - fy + y0) + low * (fy - y0)
    return out


def plain_histogram(image, cells=4, bins=9):
    side = len(image)
    grey = image.mean(axis=2)
    sums = [0.0] * (cells * cells * bins)
    slope = lambda v, k: v[1] - v[0] if k == 0 else v[-1] - v[-2] if k == len(v) - 1 else (v[k + 1] - v[k - 1]) / 2
    for y in range(side):
        for x in range(side):
            down, across = slope(grey[:, x], y), slope(grey[y], x)
            turn = min(int(math.atan2(down, across) % math.pi / math.pi * bins), bins - 1)
            sums[((y * cells // side) * cells + x * cells // side) * bins + turn] += math.hypot(down, across)
    length = math.sqrt(sum(v * v for v in sums))
    return [v / length if length else 0.0 for v in sums]


def test_like_plain_loops(spark, folder):
    root, made = folder
    rows = images.describe(images.read_pixels(spark, str(root)), seed=None, size=16, batch=2).collect()
    got = {"/".join(r.path.split("/")[-2:]): r for r in rows}
    assert set(got) == {*made, "k0/broken.jpg"}  # a file without a byte gives no row
    assert {k for k, r in got.items() if not r.readable} == {"k0/broken.jpg"}
    for name, r in got.items():
        assert r.label == name.split("/")[0]
        if name not in made:
            assert r.features is None
            continue
        pixels = made[name] if made[name].ndim == 3 else np.repeat(made[name][:, :, None], 3, 2)
        # in single precision, as the operator computes: a direction on the edge of two bins may fall to either
        small = plain_resize((pixels / 255).tolist(), 16)
        np.testing.assert_allclose(images.resized(pixels.astype(np.float32) / 255, 16), small, atol=1e-5)
        np.testing.assert_allclose(r.features, plain_histogram(small), atol=2e-2)


def test_seeds_decide(spark, folder):
    pictures = images.read_pixels(spark, str(folder[0]))
    one, again, other = ({r.path: r.features for r in images.describe(rows, seed=s, size=16).collect()} for rows, s in ((pictures, 1), (pictures.repartition(3), 1), (pictures, 2)))
    assert one == again and one != other


def test_augmented_by_hand():
    image = np.random.default_rng(1).random((6, 6, 3)).astype(np.float32)
    shapes = set()
    for seed in range(-20, 20):
        draw = np.random.default_rng(seed % 2**64)
        across, down, shift, factor = draw.random() < 0.5, draw.random() < 0.5, draw.uniform(-0.2, 0.2), draw.uniform(0.8, 1.2)
        want = np.zeros((6, 6, 3))
        for y in range(6):
            for x in range(6):
                want[y, x] = image[5 - y if down else y, 5 - x if across else x] + shift
        for c in range(3):
            mean = want[:, :, c].mean()
            want[:, :, c] = [[min(max((v - mean) * factor + mean, 0), 1) for v in line] for line in want[:, :, c]]
        np.testing.assert_allclose(images.augmented(image, seed), want, atol=1e-5)
        shapes.add((across, down))
    assert len(shapes) == 4


def test_full_size_and_own_model(spark, folder):
    pictures = images.read_pixels(spark, str(folder[0])).where("readable")
    assert {len(r.features) for r in images.describe(pictures).collect()} == {144}
    assert {tuple(r.features) for r in images.describe(pictures, model=lambda a: a.reshape(len(a), -1).shape[1] + np.zeros((len(a), 1))).collect()} == {(224 * 224 * 3.0,)}


def test_no_images(spark):
    empty = spark.createDataFrame([], "path string, label string, readable boolean, image struct<origin string, height int, width int, nChannels int, mode int, data binary>")
    assert images.describe(empty).collect() == []
