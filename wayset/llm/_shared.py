"""Helpers that the corpus operators share: words, hashes, shared storage, plan cuts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import at_exit_removed, shared_dir

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def crc32_sql(column: str) -> str:
    """DuckDB SQL for crc32 of a number's decimal text, bit by bit, as it has no such function. The constant is the
    polynomial's, a fixed value."""
    byte = "list_reduce(list_concat([xor(a, c)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, z: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384::UBIGINT) ELSE b >> 1 END)"
    codes = f"list_transform(string_split({column}::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), lambda a, c: {byte}), 4294967295::UBIGINT)::BIGINT"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: rows are computed once and lineage ends there."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    return at_exit_removed(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Functions that drop what an operator's tasks remember in a worker.
REMEMBERED: list[Callable[[], None]] = []


def fresh() -> None:
    """Begin a task or group in a worker that Spark reuses, with no more memory than it needs.

    Drops what other operators' tasks remembered there, and returns freed memory to the system: Arrow's pool, and
    the C library's where it is one that can (elsewhere nothing happens).
    """
    for drop in REMEMBERED:
        drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: a bijection of 64-bit integers that scrambles every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _GOLD)


_BYTE = seeds(256, 11)
_POWER = seeds(4096, 12) | _U(1)


def word_hashes(blob: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end with one space after each.

    ``ends`` holds each text's length with that space. Returns the hashes in order and each text's word count.
    Words are told apart by whole content: every byte is keyed by its place in the word.
    """
    space = SPACES[blob]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(blob) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, stops = edge[0::2], edge[1::2]
    bounds = np.cumsum(ends)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))
    if not len(starts):
        return np.zeros(0, _U), counts
    lengths = stops - starts
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keyed = _BYTE[blob[inside]]
    long_ones = place >= len(_POWER)
    power = _POWER[place % len(_POWER)]
    if long_ones.any():
        power[long_ones] = mix64(power[long_ones] + place[long_ones].astype(_U)) | _U(1)
    keyed *= power
    sums = np.add.reduceat(keyed, np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(_U) * _GOLD), counts


_STEP = seeds(8, 13) | _U(1)


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, repeats kept, and how many each text has.

    A text of fewer than ``width`` words has its whole word sequence as its one shingle; one without words has none.
    """
    blob = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    hashes, counts = word_hashes(blob, np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    first = np.cumsum(counts) - counts
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    if not n.sum():
        return np.zeros(0, _U), n
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = np.repeat(first + counts, n)
    out = np.zeros(len(at), _U)
    padded = np.concatenate([hashes, np.zeros(width, _U)])
    for k in range(width):
        out += np.where(at + k < last, padded[at + k] * _STEP[k], _U(0))
    return mix64(out), n


def in_chunks(sizes, most: int):
    """Slices of consecutive items whose sizes add up to ``most`` or are one item."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield slice(start, i)
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield slice(start, len(sizes))
