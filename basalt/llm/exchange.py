"""Counting by request and answer: compact columns of keys travel, not a row for each key.

A batch of documents asks for the totals of its distinct keys. Keys are cut by range into buckets; a bucket gathers
what all batches ask, adds up, and answers every batch in the order in which it asked. Blobs are sorted numbers,
their differences laid out by byte plane and packed, so that a key costs a few bytes. A key that occurs everywhere is
one entry for each batch, so no key is hot, and a bucket holds a bounded share of all keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a bucket holds at most, as long as keys are spread evenly, which hashes are.
BUCKET_KEYS = 2_000_000


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """Whole numbers by byte plane, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=level).compress(planes)


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "u8"), dtype=np.uint64)


def buckets_for(spark: SparkSession, keys: int, least: int | None = None) -> int:
    """Buckets for so many requested keys."""
    least = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, -(-keys // BUCKET_KEYS))


def cut_by_range(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the parts of sorted 64-bit keys; buckets are equal ranges of the key space."""
    width = (1 << 64) // buckets + 1
    edges = np.searchsorted(keys, np.array([min(i * width, (1 << 64) - 1) for i in range(1, buckets)], np.uint64), side="left")
    edges = [0, *edges.tolist(), len(keys)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def grouped(df: DataFrame, by: str, function: Callable[[pa.Table], Iterator[pa.RecordBatch] | pa.Table], schema: str) -> DataFrame:
    """function on the rows of each value of `by`, at once."""
    return df.groupBy(by).applyInArrow(function, schema)


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


__all__ = ["buckets_for", "cut_by_range", "grouped", "mixed", "pack", "pack_sorted", "unpack", "unpack_sorted", "F"]
