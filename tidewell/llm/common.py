"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words: space and U+0009 to U+000D. No byte of a multi-byte UTF-8 character is among them.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
#: Bytes that words are hashed in at once.
BLOCK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where that is unset, a folder of its own on a local master (tests), an error on a
    cluster, whose machines don't see each other's folders."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a Parquet table of the shared folder and read from there: later stages survive lost executors without recomputing it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or plain path; tasks use it to read and write binary files of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def trim() -> None:
    """Gives back to the system what a worker has freed: Arrow's pool and the C library keep it otherwise, and workers live as long as the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(batches: Iterable) -> Iterator:
    """The batches, with memory given back after each."""
    for batch in batches:
        yield batch
        del batch
        trim()


_held: list = []


def held(key, build: Callable):
    """What build() makes, kept by a worker for its next tasks under `key`. A worker holds one such object at most: it drops that of another operator before it makes
    its own, so that a worker which serves several operators needs no more memory than the largest of them."""
    if not _held or _held[0] != key:
        _held.clear()
        _powers.clear()
        trim()
        _held[:] = [key, build()]
    return _held[1]


def utf8(text) -> bytes:
    """UTF-8 bytes; nulls (None, NaN) give none."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of a published hash), so that high bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(blobs: Iterable[bytes], limit: int = 1 << 20):
    """Consecutive runs of blobs of about `limit` bytes, so that numpy work on a run has bounded memory (a longer blob is a run of its own)."""
    run, size = [], 0
    for b in blobs:
        if run and size + len(b) > limit:
            yield run
            run, size = [], 0
        run.append(b)
        size += len(b)
    if run:
        yield run


def word_hashes(blobs: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all blobs, and for each blob the index of its first word (one more entry ends the last).

    Words are runs of bytes that are no white space. The hash of a word is a difference of running polynomial sums, which takes a few passes over the bytes however many
    words there are. The sums run over blocks of about BLOCK bytes that end at white space, and a word has the same hash wherever it stands.
    """
    data = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    n = len(data)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    hashes, lo = np.empty(len(start), np.uint64), 0
    while lo < n:
        hi = lo + BLOCK
        hi = n if hi >= n else hi + int(space[hi:].argmax()) + 1
        if not _powers or len(_powers[0]) < hi - lo + 1:
            size = max(hi - lo, BLOCK + 4096) + 1
            with np.errstate(over="ignore"):
                _powers[:] = [np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))).cumprod() for b in (_BASE, _UNBASE)]
        up, down = _powers
        of = slice(*np.searchsorted(start, (lo, hi)))
        first, last = start[of] - lo, end[of] - lo
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        hashes[of] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        lo = hi
    at = np.cumsum([0, *(len(b) + 1 for b in blobs)])
    if _powers and len(_powers[0]) > 2 * BLOCK:  # those of a very long word are not kept
        _powers.clear()
    return hashes, np.searchsorted(start, at)
