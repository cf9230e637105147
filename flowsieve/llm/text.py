"""Words and hashes of whole Arrow string columns at once, and small helpers all operators share.

A word is a run of ``[^\\x20\\x09-\\x0D]`` characters. Texts are handled as the UTF-8 bytes Arrow already holds; no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from flowsieve.session import shared_folder

SLICE_BYTES = 1 << 19
_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_R = 0xD6E8FEB86659FD93
_R_INVERSE = pow(_R, -1, 1 << 64)
LAST = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((seed * int(_ODD)) & ((1 << 64) - 1)))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        have = _powers[base] = np.multiply.accumulate(table)
        if size > 8 * SLICE_BYTES:  # one very long text: its table is not kept
            del _powers[base]
    return have


_libc = None


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, beside the executor's own memory."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
            _libc.malloc_trim
        except (OSError, AttributeError):  # another C library
            _libc = False
    if _libc:
        _libc.malloc_trim(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (a longer text alone), so that the arrays made from them stay small."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)
    give_back()


class Words:
    """The words of some texts: ``start`` and ``end`` are byte positions in ``data``, ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        edge = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        low, high = int(edge[0]), int(edge[-1])
        raw = np.frombuffer(data, dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        edge = edge - low
        self.data, self.edge = raw, edge
        if not len(raw):
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(edge), np.int64)
            return
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = edge[1:-1]
        at = cut[cut < len(raw)]
        begins[at] |= inside[at]  # a text ends its last word and begins a new one
        before = cut[cut > 0] - 1
        ends[before] |= inside[before]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, edge)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, from prefix sums, then mixed with its length."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_R, n + 1)[:n], out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * _power_table(_R_INVERSE, n + 1)[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64) * _ODD)

    def text(self, a: int, b: int) -> bytes:
        """Words ``a`` to ``b`` (excluded) of one text, joined by one space."""
        raw = self.data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return b" ".join(raw[self.start[a] : self.end[b - 1]].split()) if a < b else b""


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the folder all executors share and read it back: later steps start from files that survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
