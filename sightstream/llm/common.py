"""What several of the operators share: the shared folder, Arrow batches, vectorised word hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sightstream.sources.files import new_path, shared_dir, stored

__all__ = ["new_path", "shared_dir", "stored"]

SPACES = bytes([0x20, *range(0x09, 0x0E)])

#: Rows, and bytes of their texts, that a task's Python works on at once; a longer text is alone.
ROWS, BYTES = 512, 4 << 20

#: Bytes of text that one numpy pass works on. A longer document is one pass of its own.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch. Spark's own bound, 64 MB, is held by the JVM and by Python for each task, beside what is made of it.
BATCH = "4m"


def tune(df: DataFrame) -> DataFrame:
    """df, whose session has Arrow batches of BATCH bytes from now on, unless it was given a bound of its own. Plans read the
    setting when they run, so that it can't be set back here."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == str(64 << 20) + "b":
        conf.set(key, BATCH)
    return df


def trim() -> None:
    """Memory that a worker has freed goes back to the machine, since workers wait for later tasks beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows whose texts, in column `at`, have BYTES bytes at most."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            before = size[lo - 1] if lo else 0
            hi = min(lo + ROWS, max(lo + 1, int(np.searchsorted(size, before + BYTES, "right"))), b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi
    trim()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes for df to have no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- words of whole texts, hashed by numpy over a slice of documents at once ---

_R = np.random.Generator(np.random.PCG64(20240607))
_GRID = _R.integers(0, 1 << 63, (64, 256), dtype=np.int64).view(np.uint64) * np.uint64(2) + _R.integers(0, 2, (64, 256)).astype(np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words(NamedTuple):
    """Words of some documents, one after another."""

    hash: np.ndarray  # uint64
    start: np.ndarray  # byte of the slice at which a word starts
    end: np.ndarray
    first: np.ndarray  # n_docs + 1: number of words before each document
    data: np.ndarray  # the slice's bytes

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def byte_set(separators: bytes) -> np.ndarray:
    """A table of 256 flags: true for bytes of words."""
    flags = np.ones(256, bool)
    flags[list(separators)] = False
    return flags


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Words are maximal runs of bytes in is_word inside one document; offsets has the n + 1 document borders."""
    n = len(data)
    inside = is_word[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    k = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    values = _GRID[k & 63, data[inside]]
    if len(k) and (top := int(k.max()) >> 6):
        values *= powers(top + 1)[k >> 6]
    hashes = np.add.reduceat(values, at) if len(at) else np.zeros(0, np.uint64)
    hashes = mix(hashes + lengths.astype(np.uint64) * _ODD)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive words of the slice, documents' borders not looked at."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(k, np.uint64(0xD6E8FEB86659FD93))):
        out += hashes[j : j + n] * p
    return mix(out)


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, document borders in them) of about SLICE_BYTES, or `size` if that is less, each; null
    counts as empty."""
    size = min(size, SLICE_BYTES)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
