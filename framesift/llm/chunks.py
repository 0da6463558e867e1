"""Documents dealt into chunks by a hash of their id, as compressed Arrow tables.

A chunk is read several times by one query; packed tables keep the text's one shuffle small, and equal
plans of it are one exchange. Rows of a chunk are in order of id and text, so that a chunk that is
computed again numbers its rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ids that stand for missing ones lie above this number
MISSING = 1 << 62
CHUNK_BYTES = 2 << 20
CODEC = pa.ipc.IpcWriteOptions(compression="zstd")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunk = batch.column(0).to_numpy()
        by = np.argsort(chunk, kind="stable")
        first = np.flatnonzero(np.append(True, chunk[by][1:] != chunk[by][:-1])) if len(by) else by
        last = np.append(first[1:], len(by))
        rows = batch.select(range(1, batch.num_columns))
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            part = rows.take(pa.array(by[a:b]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=CODEC) as out:
                out.write_batch(part)
            yield pa.record_batch({"chunk": pa.array([chunk[by[a]]], pa.int64()), "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def row_number(id_col: str, text_col: str):
    """The id as a long; a hash of the text above MISSING where there is none."""
    missing = F.lit(MISSING) + F.pmod(F.xxhash64(F.col(text_col)), F.lit(MISSING - 1))
    return F.coalesce(F.col(id_col).cast("long"), missing)


def deal(docs: DataFrame, chunks: int, id_col: str, text_col: str, others: bool = False) -> DataFrame:
    """chunk, packed: tables of row, text and, where asked for, all columns of docs but the text as `rest`."""
    row = row_number(id_col, text_col)
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("rest")] if others else []
    dealt = docs.select(
        F.pmod(F.xxhash64(row), F.lit(chunks)).alias("chunk"), row.alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *rest
    )
    return dealt.mapInArrow(_pack, "chunk long not null, packed binary")


def unpack(table: pa.Table) -> pa.Table:
    """The rows of a chunk in order of row and text."""
    # what the chunk before has left goes back to the system
    pa.default_memory_pool().release_unused()
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for c in table.column("packed").chunks for x in c]
    rows = pa.concat_tables(parts).combine_chunks()
    return rows.take(pc.sort_indices(rows.select(["row", "text"]), [("row", "ascending"), ("text", "ascending")])).combine_chunks()


def matrix(columns: dict[str, np.ndarray], widths: dict[str, tuple]) -> np.ndarray:
    """Columns of numbers as byte planes, a row a plane: planes of zeros compress to nothing."""
    n = len(next(iter(columns.values())))
    out = np.empty((sum(w for _, w in widths.values()), n), np.uint8)
    at = 0
    for name, (dtype, width) in widths.items():
        raw = np.ascontiguousarray(columns[name], dtype).view(np.uint8).reshape(n, np.dtype(dtype).itemsize)
        out[at : at + width] = raw[:, :width].T
        at += width
    return out


def cut(part: np.ndarray, columns: dict[str, np.ndarray], widths: dict[str, tuple]) -> list[tuple[int, bytes]]:
    """(part, byte planes of its rows) in order of part."""
    if not len(part):
        return []
    by = np.argsort(part, kind="stable")
    part = part[by]
    whole = matrix({k: v[by] for k, v in columns.items()}, widths)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    last = np.append(first[1:], len(part))
    return [(p, whole[:, a:b].tobytes()) for p, a, b in zip(part[first].tolist(), first.tolist(), last.tolist(), strict=True)]


def columns_of(blobs: list[bytes], widths: dict[str, tuple]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of all blobs, and the number of rows of each blob."""
    height = sum(w for _, w in widths.values())
    parts = [np.frombuffer(x, np.uint8).reshape(height, len(x) // height) for x in blobs]
    whole = np.concatenate(parts, axis=1) if parts else np.zeros((height, 0), np.uint8)
    out, at = {}, 0
    for name, (dtype, width) in widths.items():
        raw = np.zeros((whole.shape[1], np.dtype(dtype).itemsize), np.uint8)
        raw[:, :width] = whole[at : at + width].T
        out[name] = raw.view(dtype).ravel()
        at += width
    return out, np.array([p.shape[1] for p in parts], np.int64)


def records(columns: dict[str, np.ndarray], widths: dict[str, tuple]) -> np.ndarray:
    """Columns of numbers as rows of bytes."""
    n = len(next(iter(columns.values())))
    out, at = np.empty((n, sum(w for _, w in widths.values())), np.uint8), 0
    for name, (dtype, width) in widths.items():
        raw = np.ascontiguousarray(columns[name], dtype).view(np.uint8).reshape(n, np.dtype(dtype).itemsize)
        out[:, at : at + width] = raw[:, :width]
        at += width
    return out


def blobs(rows: np.ndarray, ends: np.ndarray) -> pa.Array | pa.ChunkedArray:
    """Binary values, one for each end, of the rows before it; together they are one buffer that nothing walks."""
    size = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    bounds = np.concatenate([[0], ends]) * size
    data = pa.py_buffer(np.ascontiguousarray(rows))
    if bounds[-1] >= 1 << 31:
        return pa.chunked_array([pa.array([data[a:b].to_pybytes()], pa.binary()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int32)), data])


def joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all blobs of a column without nulls, and the length of each."""
    column = column.cast(pa.large_binary()).combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), np.diff(at)


def fields(column: pa.ChunkedArray, widths: dict[str, tuple]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of all blobs of records, and the number of rows of each blob."""
    raw, sizes = joined(column)
    wide = sum(w for _, w in widths.values())
    rows, out, at = raw.reshape(-1, wide), {}, 0
    for name, (dtype, width) in widths.items():
        whole = np.zeros((len(rows), np.dtype(dtype).itemsize), np.uint8)
        whole[:, :width] = rows[:, at : at + width]
        out[name] = whole.view(dtype).ravel()
        at += width
    return out, sizes // wide


def split_by(part: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(part, column slices) in order of part, each slice in its old order."""
    if not len(part):
        return []
    by = np.argsort(part, kind="stable")
    part = part[by]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    last = np.append(first[1:], len(part))
    columns = [c[by] for c in columns]
    return [(int(part[a]), *(c[a:b] for c in columns)) for a, b in zip(first, last, strict=True)]
