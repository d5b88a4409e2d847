"""What the operators share: the scratch folder, size-checked joins and word arrays."""

from __future__ import annotations

import ctypes
import ctypes.util
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import discard, scratch  # noqa: F401
from shelfmark.session import written as materialise  # noqa: F401

#: Rows up to which a key table of a few dozen bytes a row is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows allow it, else as it is."""
    return F.broadcast(df) if rows <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for what runs inside; afterwards it is what it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession):
    """Fewer whole texts, and bytes of them, at a time between the JVM and Python, whose buffers stay with the executor."""
    arrow = "spark.sql.execution.arrow"
    with setting(spark, f"{arrow}.maxRecordsPerBatch", "2000"), setting(spark, f"{arrow}.maxBytesPerBatch", "4MB"):
        yield


# --- text arrays -----------------------------------------------------------------


def text_slices(column: pa.Array, most: int = 1 << 20):
    """Cut a string array into runs of about `most` bytes; yields (first, last, offsets, bytes).

    Nulls count as empty. A text longer than `most` gets a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL(ctypes.util.find_library("c"))
    except OSError:
        return None


def tidy() -> None:
    """Give freed memory back to the system. Python workers outlive their tasks and count as the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc(), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(rows):
    """A function over Arrow batches that tidies up when its task is done."""

    def run(batches):
        yield from rows(batches)
        tidy()

    return run


_RNG = np.random.default_rng(20240229)
#: One random 64-bit number a byte; A-Z share those of a-z.
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Bytes that are hashed together; longer texts are hashed in pieces that end at white space.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, for the bytes of one piece."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        a = np.full(PIECE + 1, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(offsets: np.ndarray, data: np.ndarray, stems: tuple[int, ...] = ()):
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts, A-Z lower-cased, as 64-bit hashes.

    Returns the hashes in order, for each of `stems` the hashes of the words' first so many bytes, and the
    number of words before each text and in all. A long text is hashed piece by piece, so that no
    table grows with it.
    """
    if len(data) <= PIECE:
        return _piece(offsets, data, stems)
    if len(offsets) > 2:  # text by text
        parts = [word_hashes(np.array([0, b - a]), data[a:b], stems) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        first = np.append(0, np.cumsum([len(x[0]) for x in parts]))
    else:
        parts, a, n = [], 0, len(data)
        while a < n:
            b = _piece_end(data, a)
            whole = np.array([0, b - a])
            parts.append(_piece(whole, data[a:b], stems) if b - a <= PIECE else _long_word(data[a:b], stems))
            a = b
        first = np.array([0, sum(len(x[0]) for x in parts)])
    return np.concatenate([x[0] for x in parts]), [np.concatenate([x[1][k] for x in parts]) for k in range(len(stems))], first


def _piece_end(data: np.ndarray, a: int) -> int:
    """Where a piece that begins at a ends: behind the last white space in reach, else before the next, else at the end."""
    b = a + PIECE
    if b >= len(data):
        return len(data)
    spaces = np.flatnonzero(_SPACE[data[a:b]])
    if len(spaces):
        return a + int(spaces[-1]) + 1
    while b < len(data):
        spaces = np.flatnonzero(_SPACE[data[b : b + PIECE]])
        if len(spaces):
            return b + int(spaces[0])
        b += PIECE
    return len(data)


def _piece(offsets: np.ndarray, data: np.ndarray, stems: tuple[int, ...]):
    n = len(data)
    up, down = _powers()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def hashed(stops):
        return mix((sums[stops] - sums[starts]) * down[starts])

    return hashed(ends), [hashed(np.minimum(ends, starts + k)) for k in stems], np.searchsorted(starts, offsets)


def _long_word(data: np.ndarray, stems: tuple[int, ...]):
    """The hashes of a single word that is longer than a piece."""
    up, _ = _powers()
    total, lead, step = 0, 1, pow(_STEP, PIECE, 1 << 64)
    for a in range(0, len(data), PIECE):
        some = data[a : a + PIECE]
        total = (total + int((_BYTE[some] * up[: len(some)]).sum(dtype=np.uint64)) * lead) & _MASK
        lead = lead * step & _MASK
    short = [np.array([(_BYTE[data[:k]] * up[:k]).sum(dtype=np.uint64)]) for k in stems]
    return mix(np.array([total], np.uint64)), [mix(x) for x in short], np.array([0, 1])


# --- names of helper columns ---------------------------------------------------------


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def matching(docs: DataFrame, keys: DataFrame, rows: int, how: str) -> DataFrame:
    """The rows of docs whose doc_id (null equals null) and text are in keys (left_semi) or are not (left_anti).

    keys has doc_id and text_key, the text_key() of a text, so that rows that share an identifier stand or fall by
    their own text; `rows` is its counted size.
    """
    key, name, other = (unused(docs, x) for x in ("_text_key", "_key_id", "_other_key"))
    keys = keys.select(F.col("doc_id").cast("bigint").alias(name), F.col("text_key").alias(other)).distinct()
    left = docs.withColumn(key, text_key(F.col("text")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)) & (F.col(key) == F.col(other))
    return left.join(bounded(keys, rows), same, how).drop(key)


def text_key(text: Column) -> Column:
    """A 64-bit key that tells apart the texts of one identifier; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
