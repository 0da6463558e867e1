"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Documents are dealt by a hash into groups of a bounded number of
rows. A group packs its pieces in order of falling size: each goes into the open bin that it leaves with the
least room; where none has room, a bin of the least-cost length for the piece is opened. The lengths are
optimised jointly: a group packs its pieces once for every choice of lengths that bins may open with (the
longest is always one of them), weighs each by the cost of its bins after every bin has been downsized to the
shortest permitted length that holds its contents, and keeps the best.

Sizes are tokens of the byte-level BPE of byte_bpe.py.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.byte_bpe import counts

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: a sequence costs its length, this much besides, and a share that grows with the square of its length
FIXED_COST = 32
SQUARE_COST = 1 / 65536
GROUP_ROWS = 2_000


def cost(length: int) -> float:
    return FIXED_COST + length + SQUARE_COST * length * length


def best_fit(sizes: Sequence[int], lengths: Sequence[int]) -> tuple[list[int], list[int]]:
    """The bin of each of the falling sizes, and what each bin holds, if bins open with one of the (rising) lengths.

    Of the lengths that hold the piece, the one with the least cost a token opens.
    """
    # the least-cost length for pieces above each bound
    cheapest = [min(lengths[i:], key=lambda n: (cost(n) / n, n)) for i in range(len(lengths))]
    where: list[int] = []
    used: list[int] = []
    room_of: dict[int, list[int]] = {}
    rooms = 0
    for size in sizes:
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = room_of[room].pop()
            if not room_of[room]:
                rooms ^= 1 << room
        else:
            room = cheapest[bisect_left(lengths, size)]
            at = len(used)
            used.append(0)
        where.append(at)
        used[at] += size
        room -= size
        if room:
            bins = room_of.setdefault(room, [])
            if not bins:
                rooms |= 1 << room
            bins.append(at)
    return where, used


def downsized(used: Sequence[int], lengths: Sequence[int]) -> list[int]:
    """The shortest permitted length that holds each bin's contents."""
    return [lengths[i] for i in np.searchsorted(lengths, used)] if used else []


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin of each of the falling sizes, tokens and final length of each bin, at the least total cost."""
    best, price = None, {n: cost(n) for n in lengths}
    for count in range(len(lengths)):
        for some in combinations(lengths[:-1], count):
            where, used = best_fit(sizes, (*some, lengths[-1]))
            final = downsized(used, lengths)
            total = sum(price[n] for n in final)
            if best is None or total < best[0]:
                best = total, where, used, final
    return best[1:]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of equal ones before them in the partition, so that repeated rows part."""
    seen: Counter = Counter()
    for batch in batches:
        again = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            again.append(seen[key])
            seen[key] += 1
        yield pa.record_batch({"doc_id": batch.column(0), "n": batch.column(1), "again": pa.array(again, pa.int64())})


def _pack_group(lengths: Sequence[int]):
    def work(table: pa.Table) -> pa.Table:
        group = table.column("part")[0].as_py()
        order = table.sort_by([("n", "descending"), ("doc_id", "ascending")])
        ids, sizes = order.column("doc_id").to_pylist(), order.column("n").to_pylist()
        most = lengths[-1]
        items = [(min(most, n - at), row, at // most, at) for row, n in zip(ids, sizes, strict=True) for at in range(0, n, most)]
        items.sort(key=lambda x: -x[0])
        where, used, final = pack([x[0] for x in items], lengths)
        filled = [0] * len(used)
        offset = []
        for (size, *_), at in zip(items, where, strict=True):
            offset.append(filled[at])
            filled[at] += size
        empty = [row for row, n in zip(ids, sizes, strict=True) if n == 0]
        none = [None] * len(empty)
        long = pa.int64()
        return pa.table(
            {
                "doc_id": pa.array([x[1] for x in items] + empty, long),
                "piece": pa.array([x[2] for x in items] + [0] * len(empty), long),
                "start": pa.array([x[3] for x in items] + [0] * len(empty), long),
                "n_tokens": pa.array([x[0] for x in items] + [0] * len(empty), long),
                "bin_group": pa.array([group] * (len(items) + len(empty)), long),
                "bin": pa.array(where + none, long),
                "bin_offset": pa.array(offset + none, long),
                "bin_used": pa.array([used[i] for i in where] + none, long),
                "bin_length": pa.array([final[i] for i in where] + none, long),
            }
        )

    return work


def pack_documents(
    docs: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    group_rows: int = GROUP_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    size_col: str | None = None,
    rank_file: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, n_tokens, bin_group, bin, bin_offset, bin_used, bin_length.

    Sizes are those of size_col, or the number of tokens of the whole text by the ranks of rank_file and the pre-split
    pattern (those of the public tokenizer PUBLIC_RANKS unless given). A document longer than the longest length is cut into
    pieces of that length and a rest, so no token is dropped. A document without tokens, null ones too, has one row
    and no bin. Repeated and missing ids are packed as rows of their own; equal rows are spread over the groups. A
    bin is the pair (bin_group, bin). Extra columns are ignored; an empty table gives no rows.
    """
    lengths = tuple(sorted(set(lengths)))
    row = F.col(id_col).cast("long").alias("doc_id")
    if size_col is None:
        # counted and numbered in one step, so that a task has one Python worker
        count = counts(rank_file, pattern)
        sized, work = docs.select(row, F.col(text_col).cast("string").alias("text")), lambda it: _spread(count(it))
    else:
        sized = docs.select(row, F.greatest(F.lit(0), F.coalesce(F.col(size_col).cast("long"), F.lit(0))).alias("n"))
        work = _spread
    groups = max(1, -(-docs.count() // group_rows))
    dealt = sized.mapInArrow(work, "doc_id long, n long, again long")
    dealt = dealt.select("doc_id", "n", F.pmod(F.xxhash64("doc_id", "n", "again"), F.lit(groups)).alias("part"))
    schema = "doc_id long, piece long, start long, n_tokens long, bin_group long, bin long, bin_offset long, bin_used long, bin_length long"
    return dealt.groupBy("part").applyInArrow(_pack_group(lengths), schema)
