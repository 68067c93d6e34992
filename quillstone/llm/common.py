"""Shared parts of the training-data operators: word splitting, hashing, checkpoints, row keys."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here takes it: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_MIX_A = np.uint64(0xFF51AFD7ED558CCD)
_MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; where it is unset, a session on this machine alone gets one here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="quillstone-shared-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


_TABLES: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back. release() deletes such tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillstone/{label}-{uuid.uuid4().hex}"
    df.write.parquet(registered(path))
    return spark.read.schema(df.schema).parquet(path)


def registered(path: str) -> str:
    """A path that release() deletes too."""
    _TABLES.append(path)
    return path


def tables() -> int:
    """How many tables written() has made and release() has not deleted: a mark for release()."""
    return len(_TABLES)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables written after a mark, but for the last `keep`. Results that still read them must have been written elsewhere."""
    gone = _TABLES[since : len(_TABLES) - keep]
    del _TABLES[since : len(_TABLES) - keep]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in gone:
        p = hadoop(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_column(text: Column) -> Column:
    """Words of a text as an array; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8 bytes. bytes.split() splits at exactly the six ASCII white-space bytes, bytes.lower() maps A-Z only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit keyed hash of every word."""
    if not words:
        return np.empty(0, np.uint64)
    held = np.empty(len(words), object)
    held[:] = words
    return pd.util.hash_array(held, categorize=True)


def finish(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_A
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_B
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, order taken into account; doubling keeps it at O(n log k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, width, power = None, 0, finish(h.astype(np.uint64) + _STEP)
    span, left = 1, k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if done is None:
                    done = power
                else:
                    m = len(power) - width
                    done = finish(done[:m] * _STEP + power[width : width + m] + np.uint64(width + span))
                width += span
            left >>= 1
            if left:
                power = finish(power[:-span] * _STEP + power[span:] + np.uint64(span))
                span *= 2
    return done[:n]


def trimmed(batches):
    """Passes batches on and gives memory that a worker has freed back to the system after each: workers outlive their tasks and stand beside an executor's heap."""
    for batch in batches:
        yield batch
        del batch
        trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: The C library's call, where it has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(lengths: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Cuts a batch into consecutive parts of about budget units, each of a row at least."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > budget:
            out.append((begin, i))
            begin, total = i, 0
        total += int(n)
    if begin < len(lengths):
        out.append((begin, len(lengths)))
    return out

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: An odd base of the polynomial hash and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(max(n, _BLOCK + 1), base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.cumprod(steps))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    word = np.concatenate(([False], ~_BLANK[b], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    begins, ends = edges[::2], edges[1::2]
    up, down = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        h = (sums[ends] - sums[begins]) * down[begins]
        return finish(h + (ends - begins).astype(np.uint64) * _STEP), begins


def hash_texts(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and where each text's words begin (one entry more than texts).

    Words are hashed in numpy, by sums of powers over blocks of bytes that end at white space; no word objects are made.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"
    h, places = hash_bytes(data.lower() if lower else data)
    heads = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    return h, np.searchsorted(places, heads)


def hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 text that ends in white space, and where they begin."""
    hashes, places, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        stop = min(len(data), at + _BLOCK)
        while stop < len(data) and not _BLANK[data[stop - 1]]:
            stop += 1
        h, begins = _hash_block(data[at:stop])
        hashes.append(h)
        places.append(begins + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(places)


def unrolled(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes h[bounds[i]:bounds[i + 1]], order taken into account."""
    up, down = _powers(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(finish(h + _STEP) * up[:-1])))
        return finish((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * _STEP)


def batch_windows(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of a batch, and which of them lie in one text."""
    g = window_hashes(h, k)
    fits = np.ones(len(g), bool)
    for e in np.unique(bounds[1:]):
        fits[max(0, e - k + 1) : e] = False
    return g, fits


def running(a: np.ndarray, n: int, of) -> np.ndarray:
    """of (np.minimum, np.maximum) over each n consecutive values."""
    if len(a) < n:
        return a[:0]
    span, out = 1, a
    while span * 2 <= n:
        out = of(out[:-span], out[span:])
        span *= 2
    return out if span == n else of(out[: -(n - span)], out[n - span :])
