"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A long text is cut before it is encoded, only where the pattern always ends a match: before a single
space that stands between two characters that are not white space. Ids of the pieces joined are then
the ids of the whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import worker_path

#: rank file of the public tokenizers by which token counts are made
PUBLIC_RANKS = "byte_bpe_multi_50k.tiktoken"
#: texts above so many characters are cut into pieces of about this size
PIECE_CHARS = 16_384
#: a match can't go on over the place before such a space
SAFE = re.compile(r"(?<=\S)(?= \S)")

_loaded: dict = {}


def encoding(ranks: str, pattern: str):
    """The tiktoken encoding of a rank file, once per worker process."""
    if (ranks, pattern) not in _loaded:
        import tiktoken

        with open(worker_path(ranks), "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _loaded[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _loaded[ranks, pattern]


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts at safe boundaries, at least `most` characters apart."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc, text: str, most: int = PIECE_CHARS) -> list[int]:
    if len(text) <= most:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text, most) for i in enc.encode_ordinary(piece)]


def _over(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str, make: Callable) -> Iterator[pa.RecordBatch]:
    enc = encoding(ranks, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield make(enc, part.column(0), part.column(1))


def _encoded(enc, rows: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    ids = pa.array([encode(enc, t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))
    return pa.record_batch({"doc_id": rows, "ids": ids})


def _decoded(enc, rows: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    return pa.record_batch(
        {"doc_id": rows, "bytes": pa.array([enc.decode_bytes(x or []) for x in ids.to_pylist()], pa.binary())}
    )


def _digests(enc, rows: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    n, ids_sha, decoded_sha = [], [], []
    for text in texts.to_pylist():
        ids = encode(enc, text or "")
        n.append(len(ids))
        ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        decoded_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
    return pa.record_batch(
        {
            "doc_id": rows,
            "n_tokens": pa.array(n, pa.int64()),
            "ids_sha256": pa.array(ids_sha, pa.string()),
            "decoded_sha256": pa.array(decoded_sha, pa.string()),
        }
    )


def _counted(enc, rows: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    return pa.record_batch({"doc_id": rows, "n": pa.array([len(encode(enc, t or "")) for t in texts.to_pylist()], pa.int64())})


def counts(ranks: str | None = None, pattern: str | None = None) -> Callable:
    """A function from batches of doc_id and text to batches of doc_id and n, the number of tokens of the whole text.

    Ranks and pattern are those of PUBLIC_RANKS unless given; a null text has no tokens.
    """
    import public_tokenizers

    ranks, pattern = ranks or public_tokenizers.path(PUBLIC_RANKS), pattern or public_tokenizers.PATTERN
    return lambda it: _over(it, ranks, pattern, _counted)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the tokens of every whole text; null and empty texts have none.

    One row per row of docs, repeated and missing ids included; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _over(it, ranks, pattern, _encoded), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, bytes: raw bytes, which need not be valid UTF-8 for any list of ids; null ids give none."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda it: _over(it, ranks, pattern, _decoded), "doc_id long, bytes binary")


def digest_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_texts and decode_ids in one pass, as digests."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        lambda it: _over(it, ranks, pattern, _digests),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
