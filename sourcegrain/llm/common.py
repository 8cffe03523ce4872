"""Helpers that several operators of this subpackage share.

Texts reach Python as UTF-8 bytes: ``bytes.split()`` cuts at exactly x20 and x09-x0D and ``bytes.lower()`` changes
exactly A-Z, which are the word rules of these operators.
"""

from __future__ import annotations

import ctypes
import functools
import math
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_HIGH, BASE_LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd, so no word loses bits


def utf8(text: str | Column) -> Column:
    """The text as bytes; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def give_back() -> None:
    """Return the memory that this worker has freed to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def mapped(run: Callable) -> Callable:
    """``run`` of ``mapInArrow``; the worker outlives its task, so what the task used is given back at its end."""
    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return whole


def grouped(work: Callable) -> Callable:
    """``work`` of ``applyInArrow`` on one table; what it used is given back after each group."""
    @functools.wraps(work)
    def whole(table):
        out = work(table)
        give_back()
        return out
    return whole


def in_chunks(docs: DataFrame, id_column: str, text_column: str, chunk_bytes: int = 8 << 20) -> tuple[DataFrame, int]:
    """Documents with a column ``_chunk``, dealt out by it, and the number of partitions.

    A chunk holds about ``chunk_bytes`` of text of any documents. Operators send one message per chunk and
    bucket of keys, in which a key stands once however often the chunk has it: no key gathers rows in one task.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / chunk_bytes))
    chunk = F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(parts)).cast("int")
    return docs.withColumn("_chunk", chunk).repartition(parts, "_chunk"), parts


class Words:
    """The words of many texts as one array of numbers, with two 64-bit hashes of each word."""

    def __init__(self, texts: Iterable[bytes]):
        known: dict[bytes, int] = {}
        numbers, lengths = array("i"), []
        for text in texts:
            words = text.split()
            lengths.append(len(words))
            numbers.extend([known.setdefault(w, len(known)) for w in words])
        self.distinct = list(known)  # each word is held once, however often it stands
        self.ids = np.array(numbers, dtype=np.int32)
        self._digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in known), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        sizes = np.array(lengths, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        here = np.arange(len(self.ids), dtype=np.int32)
        self.place = here - np.repeat(self.starts[:-1].astype(np.int32), sizes)  # within its own text
        self.left = np.repeat(self.starts[1:].astype(np.int32), sizes) - here  # words from here to the end

    @property
    def high(self) -> np.ndarray:
        return self._digests[self.ids, 0]

    @property
    def low(self) -> np.ndarray:
        return self._digests[self.ids, 1]

    def of(self, text: int) -> np.ndarray:
        """The word numbers of one text."""
        return self.ids[self.starts[text]:self.starts[text + 1]]


def rolling(values: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """At each place the polynomial hash of the ``width`` values from there (too few: of no meaning)."""
    def ahead(a: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([a[by:], np.zeros(min(by, len(a)), np.uint64)])

    block, size, power = values, 1, int(base)
    out, done = np.zeros(len(values), np.uint64), 0
    while size <= width:
        if width & size:
            out, done = out * np.uint64(power) + ahead(block, done), done + size
        block = block * np.uint64(power) + ahead(block, size)
        power, size = power * power % (1 << 64), size * 2
    return out


def by_bucket(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted keys starts; one more entry for the end."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]]).astype(np.int64)


def blobs(column: pa.ChunkedArray) -> list[bytes]:
    return column.to_pylist()
