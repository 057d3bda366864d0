"""Bitmaps of hashes, built in parts: a filter in front of a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 14


class Bits:
    """A set of 64-bit hashes with two places each: holds all that were put in,
    and few others."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(bits >> 6, np.uint64) if words is None else words

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.uint64, copy=False)
        return h & np.uint64(self.bits - 1), (h >> np.uint64(32)) & np.uint64(self.bits - 1)

    def put(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def held(self, hashes: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        a, b = ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & one for at in self.places(hashes))
        return (a & b) == one


def bits_for(entries: int, least: int = 1 << 17, most: int = 1 << 29) -> int:
    """A power of two, 32 places an entry, within the bounds; beyond ``most``
    (64 MB) the filter lets more rows pass, and the join behind it decides."""
    return min(most, max(least, 1 << (32 * max(1, entries) - 1).bit_length()))


def bitmap(hashes: DataFrame, bits: int) -> Bits:
    """The set of the hashes in the only (bigint) column. Tasks fill their own
    maps, equal chunks are united before they reach the driver, which gets at
    most ``bits`` bits whatever the number of hashes."""
    spec, schema = "chunk int, words binary", pa.schema([("chunk", pa.int32()), ("words", pa.binary())])
    size = min(CHUNK, bits) >> 6

    def rows(of: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(of), pa.int32()), pa.array([w.tobytes() for w in of.values()], pa.binary())], schema=schema)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bits(bits)
        for batch in batches:
            own.put(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        parts = own.words.reshape(-1, size)
        yield rows({int(k): parts[k] for k in np.flatnonzero(parts.any(axis=1))})

    def unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(w, np.uint64)
                held[k] = held[k] | part if k in held else part
        yield rows(held)

    whole = Bits(bits)
    parts = whole.words.reshape(-1, size)
    for row in hashes.mapInArrow(fill, spec).repartition("chunk").mapInArrow(unite, spec).collect():
        parts[row["chunk"]] |= np.frombuffer(row["words"], np.uint64)
    return whole
