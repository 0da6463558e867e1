"""SimHash near-dedup: fingerprints, a binary-trie self-join under a Hamming budget, components.

Fingerprints that differ in `budget` bits or fewer agree on at least one choice of blocks, as in
the pigeonhole principle, so each different fingerprint is dealt once for each choice, with the chosen
bits first. A partition then holds whole tries: it walks pairs of nodes level by level, adds one to the
error where the two sides take different bits, and drops a pair above the budget. More fingerprints mean
more blocks, so that the tries under one key stay small; keys above `hot` fingerprints are dealt again by
blocks of their other bits. A partition returns a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import U64, checkpoint_dir
from framesift.llm.components import components

BUDGET = 3
SHINGLE_WORDS = 3
SEED = 42
HOT = 200_000
#: node pairs walked at once; pairs of nodes with so few leaf pairs are compared directly
FRONTIER = 1 << 19
DIRECT = 32


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The bits that are set in over half of the hashes of the word shingles; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], U64)
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(found) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)),
            U64,
            len(starts),
        )
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(U64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        values = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in texts), U64, len(texts))
        yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(values.view(np.int64))})


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row of docs; null counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle, seed), "doc_id long, fp long")


def block_bounds(first: int, blocks: int) -> list[tuple[int, int]]:
    """Bit ranges [a, b) that cut bits first..63 into blocks of nearly equal size."""
    cuts = [first + (64 - first) * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def layouts(first: int, blocks: int, budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """Every choice of blocks - budget blocks, then the others; bits before `first` stay in front."""
    bounds = block_bounds(first, blocks)
    head = [(0, first)] if first else []
    return [head + [bounds[i] for i in kept] + [x for i, x in enumerate(bounds) if i not in kept]
            for kept in combinations(range(blocks), blocks - budget)]


def rearranged(column, layout: list[tuple[int, int]]):
    """A long whose bits, the greatest first, are those of the ranges in turn."""
    out = None
    for a, b in layout:
        size = b - a
        bits = F.shiftrightunsigned(column, 64 - b)
        if size < 64:
            bits = bits.bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        out = bits if out is None else F.shiftleft(out, size).bitwiseOR(bits)
    return out


def key_bits(first: int, blocks: int, budget: int, choice: int) -> int:
    """Bits in front that all members of a key share."""
    bounds = block_bounds(first, blocks)
    kept = list(combinations(range(blocks), blocks - budget))[choice]
    return first + sum(bounds[i][1] - bounds[i][0] for i in kept)


def walk(values: np.ndarray, lows: np.ndarray, highs: np.ndarray, depths: np.ndarray, budget: int) -> Iterator[tuple]:
    """Places (i, j) of sorted values that differ in `budget` bits or fewer, inside each range.

    A range is a trie; its members share the first `depths` bits. The walk holds pairs of nodes, each a
    range of places, and their errors; what is over FRONTIER pairs waits on a stack.
    """
    todo = []
    for depth in np.unique(depths):
        of = depths == depth
        zero = np.zeros(int(of.sum()), np.int64)
        todo.append((int(depth), lows[of], highs[of], lows[of], highs[of], zero))
    zeros: dict[int, np.ndarray] = {}
    while todo:
        depth, a0, a1, b0, b1, error = todo.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            todo += [(depth, *(x[half:] for x in (a0, a1, b0, b1, error))), (depth, *(x[:half] for x in (a0, a1, b0, b1, error)))]
            continue
        few = ((a1 - a0) * (b1 - b0) <= DIRECT) | (depth == 64)
        if few.any():
            yield from _compare(values, a0[few], a1[few], b0[few], b1[few], budget)
            a0, a1, b0, b1, error = (x[~few] for x in (a0, a1, b0, b1, error))
        if not len(a0):
            continue
        if depth not in zeros:
            zeros[depth] = np.concatenate([[0], np.cumsum(values >> U64(63 - depth) & U64(1) == 0)])
            if len(zeros) > 8:
                zeros.pop(next(iter(zeros)))
        z = zeros[depth]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        own = (a0 == b0) & (a1 == b1)
        other = ~own
        made = [
            (a0, am, b0, bm, error),
            (am, a1, bm, b1, error),
            (a0, am, bm, b1, error + 1),
            tuple(x[other] for x in (am, a1, b0, bm, error + 1)),
        ]
        joined = [np.concatenate(x) for x in zip(*made, strict=True)]
        live = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= budget)
        todo.append((depth + 1, *(x[live] for x in joined)))


def _compare(values, a0, a1, b0, b1, budget) -> Iterator[tuple]:
    """Leaf pairs of small node pairs, compared directly."""
    size = (a1 - a0) * (b1 - b0)
    start = 0
    total = np.cumsum(size)
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + 4 * FRONTIER)))
        part = slice(start, end)
        of = np.repeat(np.arange(start, end), size[part])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        wide = (b1 - b0)[of]
        i, j = a0[of] + nth // wide, b0[of] + nth % wide
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        yield i[near], j[near]
        start = end


def join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the sets of i and j in place; a set's root is its least place."""
    while len(i):
        for x in (i, j):
            while True:
                up = parent[x]
                if (up == x).all():
                    break
                np.copyto(x, up)
        differ = i != j
        i, j = i[differ], j[differ]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def _links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of each trie of the partition."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()) for b in batches]
    if not parts:
        return
    choice, depth, value, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    value = value.view(U64)
    by = np.lexsort((value, choice))
    choice, depth, value, fp = choice[by], depth[by], value[by], fp[by]
    if not len(value):
        return
    key = value >> (U64(63) - (depth - 1).astype(U64))
    cut = np.append(True, (key[1:] != key[:-1]) | (choice[1:] != choice[:-1]))
    low = np.flatnonzero(cut)
    high = np.append(low[1:], len(value))
    more = high - low > 1
    parent = np.arange(len(value))
    for i, j in walk(value, low[more], high[more], depth[low[more]], budget):
        join_roots(parent, i.copy(), j.copy())
    root = parent
    while (root != parent[root]).any():
        root = parent[root]
    child = np.flatnonzero(root != np.arange(len(root)))
    yield pa.record_batch({"a": pa.array(fp[child]), "b": pa.array(fp[root[child]])})


def blocks_for(n: int, budget: int = BUDGET) -> int:
    """Blocks such that about as many keys as fingerprints exist: 16, 25 or 32 bits for a budget of 3."""
    return budget + 1 if n < 1 << 22 else budget + 2 if n < 1 << 31 else budget + 3


def near_links(fps: DataFrame, budget: int = BUDGET, hot: int = HOT, blocks: int | None = None) -> DataFrame:
    """a, b: links whose transitive closure is that of all pairs of different fps within the budget."""
    different = fps.select("fp").distinct()
    blocks = blocks or blocks_for(different.count(), budget)
    plans = layouts(0, blocks, budget)
    entries = F.array(
        *(
            F.struct(F.lit(i).alias("choice"), F.lit(key_bits(0, blocks, budget, i)).alias("depth"), rearranged(F.col("fp"), p).alias("value"))
            for i, p in enumerate(plans)
        )
    )
    dealt = different.select("fp", F.explode(entries).alias("e")).select("e.choice", "e.depth", "e.value", "fp")
    dealt = dealt.withColumn("key", F.expr("shiftrightunsigned(value, 64 - depth)"))
    full = dealt.groupBy("choice", "key").count().where(F.col("count") > hot).select("choice", "key").checkpoint()
    schema = "a long, b long"
    if full.isEmpty():
        plain, again = dealt, None
    else:
        plain = dealt.join(full, ["choice", "key"], "left_anti")
        again = dealt.join(full, ["choice", "key"], "left_semi")
    columns = ["choice", "depth", "value", "fp"]
    links = plain.repartition("choice", "key").select(*columns).mapInArrow(lambda it: _links(it, budget), schema)
    for d in sorted({key_bits(0, blocks, budget, i) for i in range(len(plans))}) if again is not None else []:
        deeper = layouts(d, budget + 1, budget)
        entries = F.array(
            *(
                F.struct(
                    (F.col("choice") * 100 + 100 + i).alias("choice"),
                    F.lit(key_bits(d, budget + 1, budget, i)).alias("depth"),
                    rearranged(F.col("value"), p).alias("value"),
                )
                for i, p in enumerate(deeper)
            )
        )
        split = again.where(F.col("depth") == d).select("fp", F.explode(entries).alias("e")).select("e.choice", "e.depth", "e.value", "fp")
        split = split.withColumn("key", F.expr("shiftrightunsigned(value, 64 - depth)"))
        links = links.unionByName(split.repartition("choice", "key").select(*columns).mapInArrow(lambda it: _links(it, budget), schema))
    return links


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, hot: int = HOT
) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (least doc_id reachable over links).

    Null and empty texts have fingerprint 0, which links like any other. Equal fingerprints meet before
    any pair is looked at. Rows that repeat an id keep a row each. A missing id is no candidate for
    component_id, which is null where no row of the component has an id. Empty tables give no rows.
    """
    checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col).checkpoint()
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(near_links(classes, budget, hot))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )
