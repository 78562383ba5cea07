"""Fixed-size bitmaps that thin out rows before a shuffle.

A bitmap never decides a result: it lets through every row that matters and
some that don't, and an exact step follows.  Its size is fixed, so it may be
broadcast at any scale; beyond its capacity it loses selectivity, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, tidy
from .textkernel import U64, mix64

#: 2**27 bits are 16 MB; 2**24 bits are 2 MB.
REPEATED_BITS, MEMBER_BITS, _FLUSH = 27, 24, 1_000_000


def contains(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash's leading bits are set."""
    at = h >> U64(64 - (len(bitmap) * 8 - 1).bit_length())
    return (bitmap[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def _bits(at: np.ndarray, size: int) -> bytes:
    flags = np.zeros(size, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def repeated(df: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the 64-bit hashes that occur more than once in a column of packed hashes.

    Tasks send each hash at most twice, in slices by its leading bits; slices,
    of which there are more as the session's partitions grow, are counted
    exactly, one after the other, and only their bits come to the driver.
    """
    bits = min(max(8, (8 * partitions(df.sparkSession)).bit_length()), 16)
    slices = 1 << bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate([*held, np.zeros(0, U64)]))
            held.clear()
            third = np.zeros(len(h), bool)
            third[2:] = h[2:] == h[:-2]
            h = h[~third]
            ends = np.searchsorted(h >> U64(64 - bits), np.arange(slices + 1, dtype=U64))
            parts = [(i, h[ends[i] : ends[i + 1]].astype("<u8").tobytes()) for i in range(slices) if ends[i + 1] > ends[i]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["slice", "data"])

        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    held.append(np.frombuffer(x.as_buffer(), "<u8"))
            if sum(map(len, held)) > _FLUSH:
                yield flush()
        yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None
        size = 1 << (REPEATED_BITS - bits)

        def close() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            held.clear()
            twice = h[1:][h[1:] == h[:-1]]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_bits((twice >> U64(64 - REPEATED_BITS)).astype(np.int64) - at * size, size)], pa.binary())], ["slice", "bits"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held and i != at:
                    yield close()
                at = i
                held.append(np.frombuffer(x.as_buffer(), "<u8"))
        if held:
            yield close()

    rows = df.select(column).mapInArrow(tidy(send), "slice int, data binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(tidy(count), "slice int, bits binary").collect()
    bitmap = np.zeros(1 << (REPEATED_BITS - 3), np.uint8)
    size = len(bitmap) // slices
    for r in rows:
        bitmap[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def id_hash(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(U64))


def members(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap of the ids (long) in a column; one aggregated row per 32 bits comes to the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (id_hash(b.column(0).to_numpy(zero_copy_only=False)) >> U64(64 - MEMBER_BITS)).astype(np.int64)
            u = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(u >> 5), pa.array(np.int64(1) << (u & 31))], ["word", "bits"])

    words = ids.select(F.col(column).cast("long").alias("id")).where("id is not null").distinct().mapInArrow(tidy(place), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (MEMBER_BITS - 5), np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)
