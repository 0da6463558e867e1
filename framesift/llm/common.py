"""Helpers shared by the operators of this subpackage: batches of text, hashes and sizes."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: odd multiplier of the polynomial hashes, and its inverse modulo 2**64
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: text bytes that the NumPy operators look at in one step
STEP_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one is set only where none is and all runs on one machine."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="framesift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", there)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of len+1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (two xor-multiply rounds)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


KEPT_POWERS = 1 << 22
#: each byte plus one
ABOVE = np.arange(1, 257, dtype=U64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to KEPT_POWERS are kept for the life of the worker."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        # what one very long text needs is not kept
        size = 1 << max(16, (n - 1).bit_length()) if n <= KEPT_POWERS else n
        kept = np.full(size, base, dtype=U64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if size <= KEPT_POWERS:
            _powers[base] = kept
    return kept[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum over j < i of (byte j + 1) * BASE**j; see range_hash."""
    out = np.zeros(len(data) + 1, dtype=U64)
    if len(data):
        terms = ABOVE[data]
        terms *= powers(BASE, len(data))
        np.cumsum(terms, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal hashes for equal bytes of the ranges, wherever these lie in the buffer."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column: one pass that sends one number to the driver."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def worker_path(name: str) -> str:
    """A path as it is on the executors, or the same file in this Python's site-packages."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))
