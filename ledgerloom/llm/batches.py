"""Helpers for work on Arrow batches: batch size, partition counts and byte hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BATCH = 500


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bound an Arrow batch by rows, since one text may be very long (a session setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession, times: int = 1) -> int:
    """Shuffle partitions of the session, which grow with the data there."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) * times


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition by ``columns`` for a task that gathers whole keys."""
    return df.repartition(partitions(df.sparkSession), *columns)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def packed(texts: list[bytes], gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array with ``gap`` zero bytes after each, and their starts and lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1] + gap, out=starts[1:]) if len(texts) > 1 else None
    joined = (b"\0" * gap).join(texts) + b"\0" * gap
    return np.frombuffer(joined, np.uint8), starts, lengths


def chunked(batches: Iterator[pa.RecordBatch], limit: int, size_of: str) -> Iterator[pa.Table]:
    """Join batches until the column ``size_of`` holds about ``limit`` bytes; split larger batches."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        column = batch.column(size_of)
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        first = 0
        for row, n in enumerate(sizes.tolist()):
            held += n
            if held >= limit:
                kept.append(batch.slice(first, row + 1 - first))
                yield pa.Table.from_batches(kept)
                kept, held, first = [], 0, row + 1
        if first < batch.num_rows:
            kept.append(batch.slice(first))
    if kept:
        yield pa.Table.from_batches(kept)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Polynomial prefix hashes of a byte array: the hash of any slice in O(1), vectorised.

    Arithmetic is modulo 2**64 with an odd base, so powers can be inverted.
    """

    BASE = 0x9E3779B97F4A7C15 | 5
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_powers", cls.BASE), ("_inverse", pow(cls.BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls._powers, cls._inverse

    def __init__(self, data: np.ndarray) -> None:
        forward, self.back = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` points under the edges, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
