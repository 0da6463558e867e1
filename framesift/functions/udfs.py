"""Codecs as Arrow functions: batches of values cross once, no value is pickled."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from framesift.functions import codecs


def binary_function(work: Callable[[bytes], bytes]):
    """A column function of binary to binary; null stays null, a damaged value gives null."""

    @F.arrow_udf(BinaryType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([_tried(work, v) for v in values.to_pylist()], pa.binary())

    return run


def number_function(work: Callable[[bytes], int]):
    @F.arrow_udf(LongType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else work(v) for v in values.to_pylist()], pa.int64())

    return run


def _tried(work: Callable, value: bytes | None) -> bytes | None:
    if value is None:
        return None
    try:
        return work(value)
    except codecs.Damaged:
        return None


deflate, inflate = binary_function(codecs.deflate), binary_function(codecs.inflate)
snappy, unsnappy = binary_function(codecs.snappy), binary_function(codecs.unsnappy)
snappy_framed, snappy_unframed = binary_function(codecs.snappy_framed), binary_function(codecs.snappy_unframed)
lz4, lz4_blocks, unlz4 = binary_function(codecs.lz4), binary_function(codecs.lz4_blocks), binary_function(codecs.unlz4)
lzw, unlzw = binary_function(codecs.lzw), binary_function(codecs.unlzw)
bool_code, bool_decode = binary_function(codecs.bool_code), binary_function(codecs.bool_decode)
weightpack, weightunpack = binary_function(codecs.weightpack), binary_function(codecs.weightunpack)
crc8, crc16, crc32c, ogg_crc, xxh32 = (number_function(f) for f in (codecs.crc8, codecs.crc16, codecs.crc32c, codecs.ogg_crc, codecs.xxh32))
