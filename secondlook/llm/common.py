"""What the operators share: tables, folds, and texts as numpy arrays inside tasks."""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a single longer text forms a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; -1 for a null key, which is thus never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def give_back() -> None:
    """Give freed memory back to the system; a Python worker lives on after its task and would hold it beside the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library on Linux
    if trim:
        trim(0)


def giving_back(parts: Iterator) -> Iterator:
    """What a task yields; once it has ended, what it has freed goes back to the system."""
    yield from parts
    give_back()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of every text, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [t or b"" for t in texts.cast(kind).to_pylist()]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[list[bytes]]:
    """Runs of consecutive texts with about ``limit`` bytes each."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) + 1
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def per_step(work: Callable, texts: pa.Array, limit: int = STEP_BYTES) -> list:
    """Apply ``work`` (list of bytes -> list of results, one per text) step by step."""
    found: list = []
    for run in steps(as_bytes(texts), limit):
        found += work(run)
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finalizer of a well-known integer hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: The separators between words: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def words(run: list[bytes], separators: np.ndarray = SPACES):
    """All words of a run of texts; space always is among the separators.

    Returns (hashes, first, buffer, starts, ends): 64-bit hashes of the words with A-Z lower-cased, the
    number of the first word of each text (one more entry at the end), and where the words lie in the
    joined buffer. Equal words have equal hashes in any buffer.
    """
    buffer = np.frombuffer(b" ".join(run) + b" ", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in run), np.int64, len(run))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    inside = ~separators[buffer]
    turns = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = turns[0::2], turns[1::2]
    up, down = _power_tables(max(len(buffer) + 1, STEP_BYTES + 1))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[buffer] * up[: len(buffer)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), buffer, starts, ends


def text_of_word(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of the text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def joined(hashes: np.ndarray, steps_ahead: tuple[int, ...]) -> np.ndarray:
    """Hash of each word with the words so many places further on; the last words have none."""
    n = max(0, len(hashes) - max(steps_ahead))
    total = hashes[:n] * np.uint64(0xD6E8FEB86659FD93)
    for k, ahead in enumerate(steps_ahead):
        total = mixed(total + np.uint64(k + 1)) + hashes[ahead : ahead + n] * np.uint64(0xA0761D6478BD642F)
    return mixed(total)


def sums_per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the words' values for each text; texts without words get 0."""
    running = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return running[first[1:]] - running[first[:-1]]
