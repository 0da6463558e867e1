"""Line dedup by an exact set-similarity join.

A line is the set of its words. It goes when an earlier one, in order of document id and line, has a Jaccard
similarity of `THRESHOLD` or more, judged on the input. Lines of under `least` words stay; with `least=1`
these are the lines without words.

1. Words are counted over all documents, in a table of a fixed number of hashed slots; their order is
   by that count, rarest first. Any one order gives the same result, a better one fewer candidates.
2. Each chunk sends its lines' prefixes: a line of n words has n - ceil(t n) + 1 of them, and two
   similar lines share one. What occurs once in all texts is not sent; a set so small that only an equal
   one is similar is sent under its sum. An entry has the word's hash, its position, the line's size, a sketch
   and a check sum of the set. Of lines with equal sets in one chunk only the first sends entries.
3. Lines that share a word are candidates if their sizes, the words left after the shared one, and
   the sketches, whose distance never exceeds the number of words that only one line has, allow it.
4. Chunks fetch the words of the candidates and verify the Jaccard similarity. Where size and check sum
   are equal, the 64-bit sum over the set is compared instead.

For each word, lines with equal sets name the first of them only, and the firsts name all candidates
among them. Where a word joins a dense family of different sets, a line names a few only; if none of
these is verified and there are more, the line comes back and is held against every earlier line. So pairs
grow with the lines, not with the square of a family, and nothing is lost.

All of it is one job, so the documents and the entries are dealt once and every later step reads that one
exchange. The second round of steps 3 and 4 looks at what the lines that come back share, and ends in the step
that takes the lines out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.chunks import CHUNK_BYTES, blobs, columns_of, cut, deal, fields, joined, records, unpack
from framesift.llm.common import U64, mix, steps, text_bytes

THRESHOLD = Fraction(4, 5)
LEAST_WORDS = 1
SLOTS = 1 << 22
#: class of frequency of a slot that one occurrence in all texts fills
ONCE = 12
RANGE_BYTES = 4 << 20
#: candidates that a line of a dense family names first for each word
FIRST = 4
PAIRS = 1 << 21
#: bytes of text tokenised at once: few enough for a core's cache
STEP = 1 << 17
#: different sets of one word above which leaders name candidates
DENSE = 256
#: where all candidates of the dense families are so many times the entries of a part at most, all are named
SPARE = 4
#: pairs of a dense family that are looked at for that
SQUARE = 1 << 24
#: odd multiplier that joins the eight-byte pieces of a word
TERM = U64(0xBF58476D1CE4E5B9)
#: the first n bytes of eight
HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: words of more bytes are hashed one by one
WIDE = 64


def needed(size, t: Fraction = THRESHOLD):
    """Common words of a line of this size with any similar one, at least."""
    return -(-size * t.numerator // t.denominator)


def needed_of_two(both, t: Fraction = THRESHOLD):
    """Common words of two similar lines with so many words together, at least."""
    return -(-both * t.numerator // (t.numerator + t.denominator))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the lower-cased words of a buffer of texts."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & (raw - np.uint8(9) > 4)
    edge = inside[1:] != inside[:-1]
    edge[offsets] = True
    start, end = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    low = np.zeros(len(raw) + 8, np.uint8)
    low[:-8] = raw | ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    eight = np.ndarray(len(raw) + 1, "<u8", low, strides=(1,))
    size = end - start
    hashes = mix((eight.take(start) & HEAD.take(np.minimum(size, 8))) + size.astype(U64) * TERM)
    long = np.flatnonzero(size > 8)
    for at in range(8, WIDE, 8):
        if not len(long):
            break
        piece = eight[start[long] + at] & HEAD[np.minimum(size[long] - at, 8)]
        hashes[long] = mix((hashes[long] ^ piece) * TERM)
        long = long[size[long] > at + 8]
    for i in long.tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(low[start[i] : end[i]])
    return start, hashes


def _packed(counts: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(counts), "zstd", asbytes=True)


def _unpacked(blob: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, SLOTS * np.dtype(dtype).itemsize, "zstd"), dtype)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, size = np.zeros(SLOTS, np.int64), 0
    slots, held = [np.zeros(0, np.int32)], 0
    for batch in batches:
        raw, offsets = text_bytes(batch.column(0))
        size += len(raw)
        for a, b in steps(offsets, STEP):
            _, found = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            slots.append((found & U64(SLOTS - 1)).astype(np.int32))
            held += len(found)
            if held > SLOTS:
                total += np.bincount(np.concatenate(slots), minlength=SLOTS)
                slots, held = [np.zeros(0, np.int32)], 0
    total += np.bincount(np.concatenate(slots), minlength=SLOTS)
    yield pa.record_batch({"n": pa.array([_packed(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))], pa.binary()), "size": pa.array([size], pa.int64())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, size = np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        size += sum(batch.column(1).to_pylist())
        for blob in batch.column(0):
            total += _unpacked(blob.as_buffer(), np.uint32)
    yield pa.record_batch({"n": pa.array([_packed(total)], pa.binary()), "size": pa.array([size], pa.int64())})


def word_ranks(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """A class of frequency for each slot, 0 to 511, in a table of fixed size; and the bytes of all texts."""
    schema = "n binary, size long"
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_count, schema).repartition(8).mapInArrow(_add, schema)
    total, size = np.zeros(SLOTS, np.int64), 0
    for row in parts.collect():
        total += _unpacked(row.n, np.int64)
        size += row.size
    return np.minimum(511, ONCE * np.log2(total + 1)).astype(np.uint16), size


class Lines:
    """The lines of a chunk: document, place among the lines of its row number, bytes."""

    def __init__(self, table: pa.Table):
        self.table = unpack(table)
        rows = self.table.column("row").to_numpy()
        self.raw, self.offsets = text_bytes(self.table.column("text"))
        newline = np.flatnonzero(self.raw == 10)
        # each line but a document's first follows a line feed
        before = np.searchsorted(newline, self.offsets)
        self.doc = np.repeat(np.arange(len(rows)), np.diff(before) + 1)
        first = before[:-1] + np.arange(len(rows))
        self.start = np.empty(len(self.doc), np.int64)
        self.start[first] = self.offsets[:-1]
        self.start[np.delete(np.arange(len(self.doc)), first)] = newline + 1
        self.end = self.offsets[self.doc + 1].copy()
        same = np.flatnonzero(self.doc[1:] == self.doc[:-1])
        self.end[same] = self.start[same + 1] - 1
        self.row = rows[self.doc]
        self.line = np.arange(len(self.row)) - np.searchsorted(self.row, self.row, "left")

    def find(self, row: np.ndarray, line: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.row, row, "left") + line

    def sets(self, which: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different words of each of the (ascending) lines in their order, offsets by line, and words of each line."""
        found, sizes, long = [np.zeros(0, U64)], np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        begin, end = self.start[which], self.end[which]
        bounds = np.concatenate([[0], np.cumsum(end - begin + 1)])
        body = memoryview(self.raw)
        for a, b in steps(bounds, STEP):
            if end[b - 1] - begin[a] < 2 * (bounds[b] - bounds[a]):
                # lines that lie close together are read where they are
                raw, starts, ends = self.raw[begin[a] : end[b - 1]], begin[a:b] - begin[a], end[a:b] - begin[a]
            else:
                raw = np.frombuffer(b"".join(body[x:y] for x, y in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True)), np.uint8)
                ends = np.cumsum(end[a:b] - begin[a:b])
                starts = ends - (end[a:b] - begin[a:b])
            start, hashes = words(raw, np.concatenate([starts, ends]))
            first, last = np.searchsorted(start, starts), np.searchsorted(start, ends)
            long[a:b] = last - first
            if len(start) > long[a:b].sum():
                hashes = hashes[np.repeat(first - np.cumsum(long[a:b]) + long[a:b], long[a:b]) + np.arange(long[a:b].sum())]
            of = np.repeat(np.arange(b - a), long[a:b])
            rarity = (ranks.take((hashes & U64(SLOTS - 1)).view(np.int64)).astype(U64) << U64(36)) | (hashes >> U64(28))
            keys = (of.astype(U64) << U64(45)) | rarity
            by = np.argsort(keys)
            of, hashes = (keys.take(by) >> U64(45)).view(np.int64), hashes.take(by)
            fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))[: len(of)]
            found.append(hashes[fresh])
            sizes[a:b] = np.bincount(of[fresh], minlength=b - a)
        return np.concatenate(found), np.concatenate([[0], np.cumsum(sizes)]), long


def set_sums(found: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, a sum that equal sets share, and the sketch, a row of SKETCH.

    The sketch has parities of 64 classes of the members. Sets of over LONG[0], LONG[1] and LONG[2] members have
    twice, four and eight times as many: the new columns are one half of each class, the old ones both.
    """
    mixed = mix(found ^ U64(0x8EBC6AF09C88C6E3))
    bit = U64(1) << (mixed >> U64(58))
    sketch = np.zeros((len(SKETCH), len(offsets) - 1), U64)
    sketch[0] = _reduce(np.bitwise_xor, bit, offsets)
    size = np.diff(offsets)
    for level, least in enumerate(LONG):
        sets = np.flatnonzero(size > least)
        if not len(sets):
            break
        bounds = np.concatenate([[0], np.cumsum(size[sets])])
        place = np.repeat(offsets[sets] - bounds[:-1], size[sets]) + np.arange(bounds[-1])
        of, own = (mixed[place] & U64(2 * (1 << level) - 1)).astype(np.uint8), bit[place]
        for k in range(1 << level, 2 << level):
            sketch[k, sets] = _reduce(np.bitwise_xor, np.where(of == k, own, U64(0)), bounds)
    return _reduce(np.add, mixed, offsets), sketch


def sketch_distance(e: dict, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Classes whose parities differ: never more than the members that only one of the sets has."""
    halves = [e["sketch"].take(i) ^ e["sketch"].take(j)]
    far, left = np.bitwise_count(halves[0]).astype(np.int64), np.arange(len(i))
    for bound in LONG:
        long = least[left] > bound
        left = left[long]
        if not len(left):
            break
        one, two = i[left], j[left]
        new = [e[k].take(one) ^ e[k].take(two) for k in SKETCH[len(halves) : 2 * len(halves)]]
        halves = [old[long] ^ half for old, half in zip(halves, new, strict=True)] + new
        far[left] = sum(np.bitwise_count(h).astype(np.int64) for h in halves)
    return far


def _reduce(f, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """f.reduceat over ranges, 0 for empty ones."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = f.reduceat(values, offsets[:-1][some])
    return out


#: columns of the sketch; those that only long sets fill compress to nothing elsewhere
SKETCH = ("sketch", *(f"sketch{k}" for k in range(1, 8)))
LONG = (48, 190, 400)
#: what an entry is in a chunk of usual texts, and in any other
ENTRY = {"word": (np.uint32, 4), "size": (np.uint32, 2), "at": (np.uint32, 1), "check": (np.uint32, 4), "sketch": (np.uint64, 8), "row": (np.int64, 4), "line": (np.uint32, 2)}
WIDE_ENTRY = {k: (dtype, np.dtype(dtype).itemsize) for k, (dtype, _) in ENTRY.items()}
ENTRY_SCHEMA = "part long not null, chunk long, wide boolean, entries binary, sketches binary"


def _entries(lines: Lines, which: np.ndarray, ranks: np.ndarray, parts: int, least: int, once: bool) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Part and columns of the prefix entries of the given lines; if `once`, of equal sets only the first's, and the other lines' places."""
    found, offsets, long = lines.sets(which, ranks)
    size = np.diff(offsets)
    total, sketch = set_sums(found, offsets)
    use = long >= least
    repeats = np.zeros(0, np.int64)
    if once:
        at = np.flatnonzero(use)
        fresh = np.zeros(len(at), bool)
        fresh[np.unique(total[at], return_index=True)[1]] = True
        repeats = which[at[~fresh]]
        use[at[~fresh]] = False
    prefix = np.where(use, size - needed(size) + 1, 0)
    of = np.repeat(np.arange(len(which)), prefix)
    at = np.arange(len(of)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    word = found.take(offsets.take(of) + at)
    shared = ranks.take((word & U64(SLOTS - 1)).view(np.int64)) > ONCE
    of, at, word = of[shared], at[shared], word[shared]
    # sets of so few tokens are similar to equal ones only
    whole = (needed(size) == size) & (needed(size + 1) > size)
    word = mix(np.where(whole.take(of), total.take(of), word))
    columns = {"word": word >> U64(32), "at": at} | {k: v.take(of) for k, v in {"size": size, "check": (total >> U64(32)).astype(np.uint32), "row": lines.row[which], "line": lines.line[which]}.items()}
    return (word % U64(parts)).astype(np.int64), columns | {k: v.take(of) for k, v in zip(SKETCH, sketch, strict=True)}, repeats


def _narrow(columns: dict[str, np.ndarray]) -> bool:
    """Whether the narrow record holds all values."""
    return all(not len(columns[k]) or (columns[k].min() >= 0 and columns[k].max() < 1 << 8 * ENTRY[k][1]) for k in ("size", "at", "row", "line"))


def _levels(size: np.ndarray) -> np.ndarray:
    """Of a set of each size, the number of times its sketch has doubled."""
    return np.searchsorted(LONG, size, "left")


def _entry_table(part: np.ndarray, columns: dict[str, np.ndarray], chunk: int) -> pa.Table:
    """A row a part: records, and the further columns of the sketches that have any, entry by entry."""
    by = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    part = part[by]
    ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(part) else np.zeros(0, np.int64)
    wide = not _narrow(columns)
    level = _levels(columns["size"])[by]
    after = np.cumsum((1 << level) - 1)
    sketches = np.empty(after[-1] if len(by) else 0, np.uint64)
    for k in range(1, len(SKETCH)):
        some = np.flatnonzero(level >= k.bit_length())
        sketches[after[some] - (1 << level[some]) + k] = columns[SKETCH[k]][by[some]]
    return pa.table(
        {
            "part": pa.array(part[ends - 1], pa.int64()),
            "chunk": pa.array(np.full(len(ends), chunk), pa.int64()),
            "wide": pa.array(np.full(len(ends), wide), pa.bool_()),
            "entries": blobs(records(columns, WIDE_ENTRY if wide else ENTRY).take(by, 0), ends),
            "sketches": blobs(sketches, after[ends - 1]),
        }
    )


def _send(ranks, parts: int, least: int):
    def send(table: pa.Table) -> pa.Table:
        lines = Lines(table)
        chunk = table.column("chunk")[0].as_py()
        part, columns, repeats = _entries(lines, np.arange(len(lines.row)), ranks.value, parts, least, True)
        if len(repeats):
            # a part of its own brings the repeats of a chunk back to it
            none = np.zeros(len(repeats), np.int64)
            known = dict.fromkeys(columns, none.astype(U64)) | {"size": none, "row": lines.row[repeats], "line": lines.line[repeats]}
            part, columns = np.append(part, none + parts + chunk), {k: np.append(v, known[k].astype(v.dtype)) for k, v in columns.items()}
        return _entry_table(part, columns, chunk)

    return send


def _read_entries(table: pa.Table) -> dict[str, np.ndarray]:
    """The entries of all rows; columns of the sketch that no set fills are one array of zeros."""
    read = []
    for wide in (False, True):
        some = table.filter(pc.equal(table.column("wide"), wide))
        if wide and read[0]["word"].size and not some.num_rows:
            break
        e, n = fields(some.column("entries"), WIDE_ENTRY if wide else ENTRY)
        e["chunk"] = np.repeat(some.column("chunk").to_numpy(), n)
        sketches = np.frombuffer(joined(some.column("sketches"))[0], np.uint64)
        level = _levels(e["size"])
        after, none = np.cumsum((1 << level) - 1), np.zeros(len(level), np.uint64)
        for k in range(1, len(SKETCH)):
            own = np.flatnonzero(level >= k.bit_length())
            e[SKETCH[k]] = none
            if len(own):
                e[SKETCH[k]] = np.zeros(len(level), np.uint64)
                e[SKETCH[k]][own] = sketches[after[own] - (1 << level[own]) + k]
        read.append(e)
    return read[0] if len(read) == 1 else {k: np.concatenate([r[k] for r in read]) for k in read[0]}


def _in_order(e: dict[str, np.ndarray]) -> np.ndarray:
    """Places of the entries in order of word, row and line."""
    row = e["row"]
    if not len(row) or row.min() < 0 or row.max() >> 32:
        return np.lexsort((e["line"], row, e["word"]))
    keys = (e["word"].astype(U64) << U64(32)) | row.astype(U64)
    by = np.argsort(keys)
    keys = keys[by]
    same = np.append(False, keys[1:] == keys[:-1])
    same = np.flatnonzero(same | np.append(same[1:], False))
    # only words in several lines of one row are left to sort
    by[same] = by[same][np.lexsort((e["line"][by[same]], keys[same]))]
    return by


def _may_match(e: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length, positional and sketch filters for entries i and j of one word."""
    a, b = e["size"].take(i).astype(np.int64), e["size"].take(j).astype(np.int64)
    both = needed_of_two(a + b)
    ok = needed(np.maximum(a, b)) <= np.minimum(a, b)
    ok &= 1 + np.minimum(a - e["at"].take(i) - 1, b - e["at"].take(j) - 1) >= both
    left = np.flatnonzero(ok)
    i, j = i[left], j[left]
    far = sketch_distance(e, i, j, np.minimum(a, b)[left])
    ok[left] = (far <= (a + b - 2 * both)[left]) & ((e["row"][i] != e["row"][j]) | (e["line"][i] != e["line"][j]))
    return ok


def _near(e: dict, kept: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (earlier, later) of the same group; only entries of sizes near enough meet."""
    by = np.lexsort((e["size"][kept], group))
    kept, size, base = kept[by], e["size"][kept[by]].astype(np.int64), group[by] << 32
    count = np.arange(len(by)) - np.searchsorted(base + size, base + needed(size))
    total, start = np.cumsum(count), 0
    while start < len(by):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS)))
        n = count[start:end]
        j = np.repeat(np.arange(start, end), n)
        i = j - np.repeat(n, n) + (np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n))
        i, j = kept.take(i), kept.take(j)
        ok = _may_match(e, i, j)
        yield np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
        start = end


MORE, SAME, KNOWN = 1, 2, 4


def _firsts(e: dict) -> tuple[np.ndarray, np.ndarray]:
    """For entries in order of word, row and line: the first entry of the same word and set, and those that are it."""
    word, size, n = e["word"], e["size"], len(e["word"])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = (np.cumsum(np.append(False, word[1:] != word[:-1])).astype(U64) << U64(32)) | e["check"].astype(U64)
    by = np.argsort(keys)
    keys = keys[by]
    if (size[by][1:] != size[by][:-1])[keys[1:] == keys[:-1]].any():
        by = np.lexsort((size, e["check"], word))
        keys = np.cumsum(np.append(False, np.logical_or.reduce([e[k][by][1:] != e[k][by][:-1] for k in ("word", "check", "size")])))
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    first = np.empty(n, np.int64)
    first[by] = np.repeat(np.minimum.reduceat(by, start), np.diff(np.append(start, n)))
    return first, np.flatnonzero(first == np.arange(n))


def _group_pairs(e: dict, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (earlier, later) of entries in order of word, row and line, and their flags."""
    first_of, kept = _firsts(e)
    repeats = np.flatnonzero(first_of != np.arange(len(first_of)))
    out = [(first_of[repeats], repeats, np.full(len(repeats), SAME, np.uint8))]
    word = e["word"][kept]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(kept) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(kept)))
    member = np.flatnonzero(np.repeat((size > 1) & (size <= DENSE), size))
    out += [(i, j, np.zeros(len(i), np.uint8)) for i, j in _near(e, kept[member], np.repeat(np.arange(len(size)), size)[member])]
    left = SPARE * len(first_of)
    for a, n in sorted(zip(first[size > DENSE].tolist(), size[size > DENSE].tolist(), strict=True), key=lambda g: g[1]):
        group = kept[a : a + n]
        if n * n <= SQUARE:
            found, number = [], 0
            for i, j in _near(e, group, np.zeros(n, np.int64)):
                found.append((i, j, np.zeros(len(i), np.uint8)))
                number += len(i)
                if number > left:
                    break
            if number <= left:
                left -= number
                out += found
                continue
        named = np.zeros(n, np.int64)
        for k in range(n):
            if named[k]:
                continue
            # no leader has named it: it is held against all before it, then leads those after it
            past = group[:k][_may_match(e, group[:k], np.full(k, group[k]))]
            some = past[:most]
            out.append((some, np.full(len(some), group[k]), np.full(len(some), MORE * (len(past) > most), np.uint8)))
            free = np.flatnonzero(named[k + 1 :] < most) + k + 1
            new = free[_may_match(e, np.full(len(free), group[k]), group[free])]
            named[new] += 1
            out.append((np.full(len(new), group[k]), group[new], np.full(len(new), MORE, np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


PAIR = {"row": (np.int64, 8), "line": (np.uint32, 4), "to_chunk": (np.int64, 4), "to_row": (np.int64, 8), "to_line": (np.uint32, 4), "flags": (np.uint8, 1)}
PAIR_SCHEMA = "chunk long not null, pairs binary"
PAIR_TABLE = pa.schema([("chunk", pa.int64()), ("pairs", pa.binary())])


def _pair_table(e: dict, i: np.ndarray, j: np.ndarray, flags: np.ndarray) -> pa.Table:
    """Candidates by the chunk of the earlier line; each pair once a part."""
    pair = {"row": e["row"][i], "line": e["line"][i], "to_chunk": e["chunk"][j], "to_row": e["row"][j], "to_line": e["line"][j], "flags": flags}
    by = np.lexsort((flags & MORE ^ MORE, pair["to_line"], pair["to_row"], pair["line"], pair["row"]))
    pair, chunk = {k: v[by] for k, v in pair.items()}, e["chunk"][i][by]
    fresh = np.ones(len(by), bool)
    if len(by):
        fresh[1:] = np.logical_or.reduce([pair[k][1:] != pair[k][:-1] for k in ("row", "line", "to_row", "to_line")])
    rows = cut(chunk[fresh], {k: v[fresh] for k, v in pair.items()}, PAIR)
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "pairs": pa.array([r[1] for r in rows], pa.binary())})


def _pairs(most: int, parts: int):
    def pairs(table: pa.Table) -> pa.Table:
        e = _read_entries(table)
        if table.column("part")[0].as_py() >= parts:
            own = np.arange(len(e["row"]))
            return _pair_table(e, own, own, np.full(len(own), KNOWN, np.uint8))
        by = _in_order(e)
        none = e[SKETCH[-1]]
        e = {k: v if v is none and not none.any() else v.take(by) for k, v in e.items()}
        return _pair_table(e, *_group_pairs(e, most))

    return pairs


def _all_pairs(open_entries: pa.Table, table: pa.Table) -> pa.Table:
    """Every earlier candidate of the lines that came back."""
    if not open_entries.num_rows:
        return PAIR_TABLE.empty_table()
    asked, e = _read_entries(open_entries), _read_entries(table)
    by = np.argsort(e["word"], kind="stable")
    e = {k: v[by] for k, v in e.items()}
    low, high = np.searchsorted(e["word"], asked["word"], "left"), np.searchsorted(e["word"], asked["word"], "right")
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    both = {k: np.concatenate([e[k], asked[k]]) for k in e}
    for k in range(len(low)):
        i = np.arange(low[k], high[k])
        i = i[(e["row"][i] < asked["row"][k]) | ((e["row"][i] == asked["row"][k]) & (e["line"][i] < asked["line"][k]))]
        j = np.full(len(i), len(e["word"]) + k)
        ok = _may_match(both, i, j)
        out_i.append(i[ok])
        out_j.append(j[ok])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    return _pair_table(both, i, j, np.zeros(len(i), np.uint8))


LATER = {"row": (np.int64, 8), "line": (np.uint32, 4), "of": (np.uint32, 4), "flags": (np.uint8, 1)}
SETS = {"sum": (np.uint64, 8), "size": (np.uint32, 4)}
FETCH_SCHEMA = "chunk long not null, later binary, sets binary, words binary"
PLACE = {"row": (np.int64, 8), "line": (np.uint32, 4)}
TOLD_SCHEMA = "chunk long not null, gone binary, part long not null, wide boolean, entries binary, sketches binary"
TOLD = pa.schema([("chunk", pa.int64()), ("gone", pa.binary()), ("part", pa.int64()), ("wide", pa.bool_()), ("entries", pa.binary()), ("sketches", pa.binary())])


def _different(columns: dict[str, np.ndarray]) -> np.ndarray:
    """Places of different rows: equal ones are left out, unless other rows of the same hash lie between."""
    hashes = np.zeros(len(next(iter(columns.values()))), U64)
    for v in columns.values():
        hashes = mix(hashes ^ v.astype(U64))
    by = np.argsort(hashes)
    fresh = np.append(True, np.logical_or.reduce([v[by][1:] != v[by][:-1] for v in columns.values()]))
    return np.sort(by[fresh[: len(by)]])


def _fetch(ranks):
    """Sends the sets of earlier lines to the chunks of the later ones; where SAME, only the sum and no members."""

    def fetch(table: pa.Table, asked: pa.Table) -> pa.Table:
        if table.num_rows and asked.num_rows:
            lines = Lines(table)
            p, _ = columns_of(asked.column("pairs").to_pylist(), PAIR)
            where = lines.find(p["row"], p["line"].astype(np.int64))
            fresh = _different({"where": where, **{k: p[k] for k in ("to_chunk", "to_row", "to_line", "flags")}})
            p, where = {k: v[fresh] for k, v in p.items()}, where[fresh]
            which, of = np.unique(where, return_inverse=True)
            found, offsets, _ = lines.sets(which, ranks.value)
            total, _ = set_sums(found, offsets)
            # a line is sent with its members where any of a chunk's lines needs them
            of = of * 2 + (p["flags"] & (SAME | KNOWN) > 0)
            by = np.lexsort((of, p["to_chunk"]))
            p, of, to = {k: v[by] for k, v in p.items()}, of[by], p["to_chunk"][by]
            begin = np.append(True, to[1:] != to[:-1])
            new = begin | np.append(True, of[1:] != of[:-1])
            place = np.cumsum(new) - 1
            ends = np.append(np.flatnonzero(begin)[1:], len(to))
            place_ends = place[ends - 1] + 1
            used = of[new]
            size = np.where(used % 2 == 0, np.diff(offsets)[used // 2], 0)
            after = np.cumsum(size)
            at = np.repeat(offsets[used // 2] - (after - size), size) + np.arange(size.sum())
            place = place - np.repeat(place[begin], np.diff(np.append(0, ends)))
            return pa.table(
                {
                    "chunk": pa.array(to[begin], pa.int64()),
                    "later": blobs(records({"row": p["to_row"], "line": p["to_line"], "of": place, "flags": p["flags"]}, LATER), ends),
                    "sets": blobs(records({"sum": total[used // 2], "size": size}, SETS), place_ends),
                    "words": blobs(found[at], after[place_ends - 1]),
                }
            )
        return pa.table({k: pa.array([], pa.binary() if k != "chunk" else pa.int64()) for k in ("chunk", "later", "sets", "words")})

    return fetch


def _verified(lines: Lines, sent: pa.Table, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line whether an earlier match is verified, and whether it has candidates that it was not told."""
    done, again = np.zeros(len(lines.row), bool), np.zeros(len(lines.row), bool)
    p, pairs_of = fields(sent.column("later"), LATER)
    sets, sets_of = fields(sent.column("sets"), SETS)
    members = np.frombuffer(joined(sent.column("words"))[0], U64)
    source = p["of"].astype(np.int64) + np.repeat(np.cumsum(sets_of) - sets_of, pairs_of)
    later = lines.find(p["row"], p["line"].astype(np.int64))
    open_pairs = np.flatnonzero(p["flags"] & KNOWN == 0)
    which, of = np.unique(later[open_pairs], return_inverse=True)
    found, offsets, _ = lines.sets(which, ranks)
    total, _ = set_sums(found, offsets)
    source, flags = source[open_pairs], p["flags"][open_pairs]
    same = flags & SAME > 0
    similar = same & (sets["sum"][source] == total[of])
    sizes = sets["size"].astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    # members in order of line and hash; 45 bits of the hash find the place, all bits decide
    near = lambda w, o: (o.astype(U64) << U64(45)) | (w >> U64(19))
    keys = near(found, np.repeat(np.arange(len(which)), np.diff(offsets)))
    by = np.argsort(keys)
    keys, found = keys[by], found[by]
    matched = np.bincount(of[similar], minlength=len(which)) > 0
    order = np.argsort(of, kind="stable")
    order = order[~same[order]]
    nth = np.arange(len(order)) - np.searchsorted(of[order], of[order])
    # a line's further candidates are looked at only where the ones before don't match
    for low, high in ((0, 1), (1, 4), (4, len(order))):
        pairs = order[(nth >= low) & (nth < high) & ~matched[of[order]]]
        size = sizes[source[pairs]]
        pair = np.repeat(np.arange(len(pairs)), size)
        member = members[np.repeat(begins[source[pairs]] - (np.cumsum(size) - size), size) + np.arange(len(pair))]
        at = np.minimum(np.searchsorted(keys, near(member, of[pairs][pair])), max(0, len(keys) - 1))
        common = np.bincount(pair[found[at] == member] if len(keys) else pair[:0], minlength=len(pairs))
        union = size + np.diff(offsets)[of[pairs]] - common
        similar[pairs] = common * THRESHOLD.denominator >= union * THRESHOLD.numerator
        matched[of[pairs[similar[pairs]]]] = True
    done[later[p["flags"] & KNOWN > 0]] = True
    done[which[of[similar]]] = True
    # a sum that differs although size and check sum agree leaves the pair open as well
    again[which[of[(flags & MORE > 0) | (same & ~similar)]]] = True
    return done, again & ~done


def _verify(ranks, parts: int, least: int):
    """The lines of a chunk with a verified earlier match, as PLACE, and the entries of those that come back."""

    def verify(table: pa.Table, sent: pa.Table) -> pa.Table:
        told = rows = None
        if table.num_rows and sent.num_rows:
            lines, chunk = Lines(table), table.column("chunk")[0].as_py()
            done, again = _verified(lines, sent, ranks.value)
            gone, left = np.flatnonzero(done), np.flatnonzero(again)
            told = records({"row": lines.row[gone], "line": lines.line[gone]}, PLACE)
            part, columns, _ = _entries(lines, left, ranks.value, parts, least, False)
            rows = _entry_table(part, columns, chunk)
        empty = TOLD.empty_table()
        if told is None:
            return empty
        said = pa.table({"chunk": pa.array([chunk], pa.int64()), "gone": blobs(told, np.array([len(told)])), "part": pa.array([-1], pa.int64())})
        return pa.concat_tables([empty, *([said] if len(told) else []), rows], promote_options="default").select(TOLD.names)

    return verify


def _finish(ranks):
    """Takes out the lines that either round has verified."""

    def finish(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        lines = Lines(table)
        gone = np.zeros(len(lines.row), bool)
        sent = verdicts.filter(pc.is_valid(verdicts.column("later")))
        if sent.num_rows:
            gone, _ = _verified(lines, sent, ranks.value)
        if verdicts.num_rows:
            p, _ = fields(verdicts.column("gone").drop_null(), PLACE)
            gone[lines.find(p["row"], p["line"].astype(np.int64))] = True
        n = len(lines.offsets) - 1
        total = np.bincount(lines.doc, minlength=n)
        removed = np.bincount(lines.doc[gone], minlength=n)
        texts = lines.table.column("text").to_pylist()
        for doc in np.flatnonzero(removed).tolist():
            a = int(np.searchsorted(lines.doc, doc))
            parts = texts[doc].split("\n")
            texts[doc] = "\n".join(p for p, g in zip(parts, gone[a : a + len(parts)].tolist(), strict=True) if not g)
        return pa.table(
            {
                "rest": lines.table.column("rest"),
                "text": pa.array(texts, pa.string()),
                "n_lines": pa.array(total, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
            }
        )

    return finish


def _as_is(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """No filter goes below this, so what lies below is one exchange for all that read it."""
    yield from batches


def line_dedup(
    docs: DataFrame,
    least: int = LEAST_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    first: int = FIRST,
) -> DataFrame:
    """docs with the later ones of similar lines removed from the text, and n_lines and n_removed.

    Lines end at a line feed; words are what white space (tab to carriage return, space) separates, in
    lower case for A-Z. Lines of under `least` words stay: with 1 those without words, so that a line that has any
    is compared. Null texts become empty; a text may become empty, its row stays. Missing ids sort after all
    others, by a hash of the text. Rows that share an id count as one document in order of their texts; a fully
    equal row repeats its lines. Texts and lines of any length are read whole, one text in one task. Other columns
    keep their values; columns of docs that are called n_lines or n_removed give way to the new ones. An empty
    table gives no rows.
    """
    docs = docs.drop(*(c for c in ("n_lines", "n_removed") if c not in (id_col, text_col)))
    ranks, size = word_ranks(docs, text_col)
    chunks, parts = max(64, -(-size // chunk_bytes)), max(64, -(-size // RANGE_BYTES))
    ranks = docs.sparkSession.sparkContext.broadcast(ranks)
    dealt = deal(docs, chunks, id_col, text_col, others=True)
    entries = dealt.groupBy("chunk").applyInArrow(_send(ranks, parts, least), ENTRY_SCHEMA)

    def fetched(there: DataFrame, pairs: DataFrame) -> DataFrame:
        return there.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(_fetch(ranks), FETCH_SCHEMA)

    sent = fetched(dealt, entries.groupBy("part").applyInArrow(_pairs(first, parts), PAIR_SCHEMA))
    told = dealt.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(_verify(ranks, parts, least), TOLD_SCHEMA)
    told = told.repartition("chunk").mapInArrow(_as_is, TOLD_SCHEMA)
    opened = told.where("entries IS NOT NULL").select("part", "chunk", "wide", "entries", "sketches")
    again = opened.groupBy("part").cogroup(entries.groupBy("part")).applyInArrow(_all_pairs, PAIR_SCHEMA)
    later = fetched(dealt, again).unionByName(told.where("gone IS NOT NULL").select("chunk", "gone"), allowMissingColumns=True)
    rest = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    done = dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(
        _finish(ranks), f"rest struct<{rest}>, text string, n_lines long, n_removed long"
    )
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns), "n_lines", "n_removed")
