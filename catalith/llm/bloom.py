"""A Bloom filter over 64-bit values, built on executors, of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalith.llm.grams import mix

#: Largest filter, in bits; bits a value; probes; pieces in which it is put together, by so many tasks at first.
BITS, EACH, PROBES, PIECES, TASKS = 1 << 27, 32, 8, 64, 16

_U = np.uint64


def places(values: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bit of each value for each probe."""
    h = mix(values.view(_U).copy())
    step = (h >> _U(36)) | _U(1)
    for k in range(PROBES):
        yield (h + _U(k) * step) & _U(bits - 1)


def held(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the values that the filter has."""
    at = np.arange(len(values))
    for k in range(PROBES):
        h = mix(values[at].view(_U).copy())
        bit = (h + _U(k) * ((h >> _U(36)) | _U(1))) & _U(bits - 1)
        at = at[((bitmap[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1).astype(bool)]
    return at


def bloom(values: DataFrame, n: int) -> tuple[bytes, int]:
    """The bitmap of ``n`` values, a table of one long column, and its bits.

    Tasks set the bits of their rows and the maps are joined by bitwise or, piece by
    piece; the driver gets the joined map, 16 MB at most however many values there are.
    """
    bits = min(BITS, max(1 << 16, 1 << (EACH * n).bit_length()))
    size = bits // 8 // PIECES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for bit in places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(bitmap, (bit >> _U(3)).astype(np.int64), np.uint8(1) << (bit & _U(7)).astype(np.uint8))
        for k in range(PIECES):
            part = bitmap[k * size : (k + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["piece", "bits"])

    def join(table: pa.Table) -> pa.Table:
        out = np.zeros(size, np.uint8)
        for part in table["bits"]:
            out |= np.frombuffer(part.as_buffer(), np.uint8)
        return pa.table({"piece": table["piece"][:1], "bits": pa.array([out.tobytes()], pa.binary())})

    schema = "piece int, bits binary"
    out = bytearray(bits // 8)
    for row in values.coalesce(TASKS).mapInArrow(mark, schema).groupBy("piece").applyInArrow(join, schema).collect():
        out[row["piece"] * size : (row["piece"] + 1) * size] = row["bits"]
    return bytes(out), bits
