"""What the corpus operators share: tables, checkpoints, and words of whole Arrow batches.

Word arithmetic runs on the UTF-8 bytes of many documents at once. A chunk of
documents is bounded by ``CHUNK_BYTES`` (one longer document is a chunk of its
own), so memory follows the longest document and not the partition.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 512 << 10

#: Bytes that make words: all but ASCII white space; or digits, a-z and everything past ASCII.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # both odd, so both have inverses mod 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def by_value(name: str) -> None:
    """Send the module's functions to executors by value, so they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


#: Rows of an Arrow batch at most where rows are whole texts.
BATCH_ROWS = 1000


def release() -> None:
    """Gives what the last batches' buffers held back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow``, whose workers release their memory when a task ends."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(lean, schema)


def small_batches(spark: SparkSession) -> None:
    """Rows that are whole texts are large: fewer of them than usual make an Arrow batch from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that the session names. Without one, a session of one process gets a temporary
    folder until it ends; on a cluster no folder of one machine would do, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder; later plans read that copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the relation (the files' size for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Shuffle partitions so that each gets about ``bytes_each`` of the input, never under the session's
    number, which also serves where Catalyst has no estimate (it then says exabytes)."""
    set_to, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return set_to if size >= 1 << 53 else min(100_000, max(set_to, -(-size // bytes_each)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = end


def groups(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of about ``limit`` bytes of one string column, or of one row."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            for a, b in chunks(utf8(whole.column(column))[0], limit):
                yield whole.slice(a, b - a)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(utf8(batch.column(column))[1])
            if size >= limit:
                yield from cut(held)
                held, size = [], 0
    yield from cut(held)


def words(data: np.ndarray, offsets: np.ndarray, makes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each document's words begin (one more entry than documents)."""
    inside = makes[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and their inverses mod 2**64, kept for the next chunk."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        got = out[0], out[1]
        if n <= CHUNK_BYTES + 1:
            _POWERS[base] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash, mod 2**64, of values[start:end] for each pair, from one running sum."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = rolling(data.astype(np.uint64) + np.uint64(1), starts, ends, _BYTE_BASE)
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and document of every window of ``size`` words of one document."""
    counts = np.maximum(np.diff(at) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + at[:-1][doc]
    return mix(rolling(hashes, first, first + size, _WORD_BASE)), first, doc


def covered(first: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n words lie in any of the intervals [first, first + length)."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    return np.cumsum(change[:-1]) > 0


def runs(flags: np.ndarray) -> np.ndarray:
    """Start and end of each maximal run of true values, as rows."""
    change = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return change.reshape(-1, 2)


by_value(__name__)
