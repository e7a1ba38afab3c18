"""Shared helpers: vectorised word hashing over Arrow string columns, shared checkpoints, size estimates."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to numpy at a time; bounds the worker's memory whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20
#: A-Z, for translate(); the contracts lower-case these letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def _byte_values() -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    values[_SPACE] = 0  # white space adds nothing to a word's sum
    return values


_VALUES = _byte_values()
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 4096), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.cumprod(more)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, row after the last, bytes, offsets. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each document's first word (one more at the end)."""
    ink = ~_SPACE[data]
    begins, stops = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    stops[:-1] &= ~ink[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    begins[at] = ink[at]
    at = offsets[1:][full] - 1
    stops[at] = ink[at]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words' bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    terms = _VALUES[data[starts[0] :]] * _powers(int(lengths.max()) + 1)[place]
    return mix(np.add.reduceat(terms, starts - starts[0]) + (ends - starts).astype(np.uint64))


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _FOLD[data]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (over document borders too; see starts_of)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h = h * _BASE + words[k : k + m]
    return mix(h)


def starts_of(firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes at which an n-word run within one document starts, and that document's index."""
    counts = np.maximum(np.diff(firsts) - n + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return firsts[:-1][docs] + within, docs


#: What a worker keeps from task to task, as functions that empty it.
TABLES: list[Callable[[], None]] = []


def give_back() -> None:
    """Give memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def frugal(run, tables: bool = False):
    """run for mapInArrow; its worker gives memory that it no longer uses back after it: workers stay, idle, while other tasks need it. tables: run
    uses what workers keep; other tasks, which come when another step has begun, empty it first."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables and TABLES:
            for empty in TABLES:
                empty()
            give_back()
        yield from run(batches)
        give_back()

    return own


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Without spark.checkpoint.dir, only a local master gets a folder of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "textloom-checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def checkpoint(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; survives lost executors. tasks: how many compute and write it at most.
    A local file costs its executor two processes (Hadoop calls chmod for it and for its checksum), so small tables shouldn't be many files."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return (df.coalesce(tasks) if tasks else df).checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver drop what it no longer refers to, shuffle files above all; they stay until its next full collection otherwise."""
    for _ in range(2):  # what the first round lets go of in Python, the second finds in the JVM
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: for files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """How many shuffle parts keep each near bytes_each of input; never fewer than the session's."""
    size = size_in_bytes(df)
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-size // bytes_each)) if size < 1 << 60 else floor


def pieces_for(df: DataFrame, bytes_each: int) -> int:
    """Like parts_for, but from the data alone: small tables get one."""
    size = size_in_bytes(df)
    return max(1, -(-size // bytes_each)) if size < 1 << 60 else parts_for(df)


def tasks_for(df: DataFrame, bytes_each: int) -> int:
    """How many tasks keep each near bytes_each of input and all cores busy; for coalesce, which makes no more of them than there are."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, pieces_for(df, bytes_each))


def text_parts(df: DataFrame, text_col: str, chars_each: int) -> int:
    """How many parts keep each near chars_each characters of text, counted, so that compression doesn't matter; never fewer than the session's."""
    chars = df.agg(F.sum(F.length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // chars_each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(column: str, n: int):
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1)).cast("int")
