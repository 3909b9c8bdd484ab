"""Helpers shared by the corpus operators: word counts, row iteration, block numbers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is in every contract: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(0))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null reads as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        end, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = end[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(end, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return what Arrow and the C library hold but do not use; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mapped(work: Callable) -> Callable:
    """``work`` for ``mapInArrow``, after which the worker gives back its free memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def grouped(work: Callable) -> Callable:
    """``work`` for ``applyInArrow``, with the same after each group."""

    def run(group):
        try:
            return work(group)
        finally:
            give_back()

    return run


def cogrouped(work: Callable) -> Callable:
    """``work`` for ``applyInArrow`` of two frames, with the same after each pair of groups."""

    def run(left, right):
        try:
            return work(left, right)
        finally:
            give_back()

    return run


def offsets(parts: list[bytes]) -> np.ndarray:
    """Start of each part in their concatenation, and the total length."""
    return np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))))


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Number of groups so that each holds about ``per_part`` rows."""
    return max(least, -(-rows // per_part))


def bit_table(rows: DataFrame, column: str, most: int = 28) -> np.ndarray:
    """A bit for every 64-bit hash in ``column``, at its lowest bits: sixteen bits a row, at most 2^``most`` in all.

    It tells for sure what is not among the rows; a few others pass, more of them beyond 2^24 rows.
    """
    bits = min(most, max(16, (16 * rows.count()).bit_length()))
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    cells = rows.select(F.shiftright(low, 6).alias("cell"), F.expr(f"shiftleft(1L, CAST(`{column}` & 63 AS INT))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found.column("cell").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return table


def in_bits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each unsigned 64-bit hash may be among those of the table."""
    slot = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
