"""Repeated passages of any position, found with suffix arrays that are sorted in two stages.

A window is a string of `width` bytes inside one document. A window counts as a repeat where it also
starts in a document with a smaller id, and the bytes that such windows cover are removed.

How the corpus is cut so that no suffix array holds more than a bounded piece of it:

1. Documents are dealt into chunks by a hash of their id. Every window has a key, the least hash of its
   k-byte strings, so equal windows have equal keys wherever they are. Neighbouring windows mostly share
   their key; such a run is a fragment. A chunk asks, for each key once, whether other documents have it.
2. The owner of a range of keys answers each chunk with the keys of two documents or more.
3. A chunk sends its fragments with such keys, each different one once with its least and greatest id.
4. For each range of keys a suffix array over the different fragments is built, two adjacent common
   prefixes of `width` bytes put windows in one class, and the least id of each class goes back.
5. A chunk marks the windows whose class has a smaller id than their document.

A passage that a third of the documents share is thus sent once a chunk, not once a document. Chunks are
ordered by id and text before they are numbered, so a chunk that is computed again gives the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.chunks import split_by
from framesift.llm.common import BASE, BASE_INVERSE, U64, mix, powers, text_bytes, total_bytes

WIDTH = 50
#: bytes of the strings whose least hash is a window's key
KEY_BYTES = 20
CHUNK_BYTES = 2 << 20
RANGE_BYTES = 4 << 20
#: windows looked at in one step, and in one fragment at most
STEP = 1 << 19
LONGEST_RUN = 64
NO_ID = (1 << 63) - 1
REPLY = np.dtype([("at", "<i4"), ("start", "<i2"), ("n", "<i2"), ("least", "<i8")])


def successor_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last is greater than the empty one."""
    n = len(text)
    up = np.zeros(n, bool)
    if n < 2:
        return up
    change = np.flatnonzero(text[1:] != text[:-1])
    up[: change[-1] + 1 if len(change) else 0] = np.repeat(text[change + 1] > text[change], np.diff(change, prepend=-1))
    return up


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros beyond the end."""
    n = len(text)
    out = np.zeros(n + 8, U64)
    out[:n] = text
    for size in (1, 2, 4):
        out[: n + 8 - size] = out[: n + 8 - size] << U64(8 * size) | out[size:]
        out[n:] = 0
    return out[:n]


def sort_directly(word: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes `which` in order of their first `depth` bytes; only ties look at the next eight."""
    if not len(which):
        return which
    last = len(word) - 1
    order = which[np.argsort(word[which])]
    first = word[order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    for at in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        group = np.cumsum(new)[places]
        rows = order[places]
        further = rows + at
        key = np.where(further <= last, word[np.minimum(further, last)], U64(0))
        by = np.lexsort((key, group))
        order[places] = rows[by]
        key, group = key[by], group[by]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[places] = fresh
    return order


def suffix_array(text: np.ndarray, depth: int = WIDTH, word: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order of at least their first `depth` bytes.

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets of
    first bytes in ascending order; the suffix before each scanned one, where it is greater than its
    successor, goes to the next free place of its own bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    word = words(text) if word is None else word
    small = successor_types(text)
    direct = sort_directly(word, np.flatnonzero(small), depth)
    heads = text[direct]
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    done = []
    for byte in np.flatnonzero(np.bincount(text, minlength=256)):
        front = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        greater = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[text[front] == byte]
            greater.append(front)
        low, high = np.searchsorted(heads, [byte, byte + 1]) if byte < 255 else (np.searchsorted(heads, byte), len(heads))
        bucket = np.concatenate([*greater, direct[low:high]])
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        head = text[before]
        before, head = before[head > byte], head[head > byte]
        if len(before):
            by = np.argsort(head, kind="stable")
            before, head = before[by], head[by]
            cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
            for part in np.split(before, cuts):
                induced[text[part[0]]].append(part)
    return np.concatenate(done)


def adjacent_prefixes(word: np.ndarray, order: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Bytes that each suffix of `order` has in common with the one before it, `depth` at most.

    Every suffix in `order` has at least `depth` bytes.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    left = np.arange(1, n)
    for at in range(0, depth, 8):
        if not len(left):
            break
        last = len(word) - 1
        a, b = word[np.minimum(order[left - 1] + at, last)], word[np.minimum(order[left] + at, last)]
        differ = a ^ b
        same = differ == 0
        out[left[same]] = at + 8
        for shift in range(8, 64, 8):
            more = (differ >> U64(64 - shift) == 0) & ~same
            out[left[more]] = at + shift // 8
        left = left[same]
    return np.minimum(out, depth)


class Fragments:
    """The runs of windows with one key, over all documents of a chunk in order of id and text."""

    def __init__(self, table: pa.Table, width: int, key_bytes: int):
        ids = pc.fill_null(table.column("row"), NO_ID)
        by = pc.sort_indices(pa.table({"i": ids, "t": table.column("text")}), [("i", "ascending"), ("t", "ascending")])
        self.missing = table.column("row").take(by)
        self.ids = ids.take(by).to_numpy()
        self.raw, self.offsets = text_bytes(table.column("text").take(by))
        self.width, total = width, len(self.raw)
        whole = np.zeros(total + 1, np.int8)
        sizes = np.diff(self.offsets)
        np.add.at(whole, self.offsets[:-1], sizes >= width)
        np.subtract.at(whole, np.maximum(self.offsets[:-1], self.offsets[1:] - width + 1), sizes >= width)
        whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
        starts, ends, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for low in range(0, total - width + 1, STEP):
            high = min(low + STEP, total - width + 1)
            least = window_keys(self.raw[low : high + width - 1], width, key_bytes)
            here = whole[low:high]
            same = np.zeros(len(here) + 1, bool)
            same[1:-1] = (least[1:] == least[:-1]) & here[:-1] & here[1:]
            first, last = np.flatnonzero(here & ~same[:-1]), np.flatnonzero(here & ~same[1:]) + 1
            parts = -(-(last - first) // LONGEST_RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.repeat(first, parts) + nth * LONGEST_RUN
            starts.append(low + begin)
            ends.append(low + np.minimum(begin + LONGEST_RUN, np.repeat(last, parts)))
            keys.append(least[begin])
        self.start, self.end, self.key = np.concatenate(starts), np.concatenate(ends), np.concatenate(keys)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of one document of the chunk, and keys of more."""
        if not len(self.key):
            return self.key, self.key
        by = np.argsort(self.key, kind="stable")
        key, row = self.key[by], self.ids[self.doc[by]]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)
        return key[first[~many]], key[first[many]]

    def shared(self, keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Fragments with one of the sorted places of keys: where they are, the number of each one's bytes, these bytes."""
        own = placed(*ranges_of(self.key, ranges))
        at = np.searchsorted(keys, own)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == own)) if len(keys) else np.zeros(0, np.int64)
        seen: dict[bytes, int] = {}
        body = self.raw.tobytes()
        number = np.fromiter(
            (
                seen.setdefault(body[s:e], len(seen))
                for s, e in zip(self.start[hit].tolist(), (self.end[hit] + self.width - 1).tolist(), strict=True)
            ),
            np.int64,
            len(hit),
        )
        return hit, number, list(seen)


def window_keys(raw: np.ndarray, width: int, key_bytes: int) -> np.ndarray:
    """The least hash of the strings of key_bytes inside every window of raw."""
    n = len(raw)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(BASE, n), out=prefix[1:])
    least = mix((prefix[key_bytes:] - prefix[:-key_bytes]) * powers(BASE_INVERSE, n - key_bytes + 1))
    size, wanted = 1, width - key_bytes + 1
    while size * 2 <= wanted:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wanted:
        least = np.minimum(least[: len(least) - (wanted - size)], least[wanted - size :])
    return least


def ranges_of(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each key, and the 40 bits that stand for the key inside it.

    Keys are minima, so they are mixed again first. Two keys with equal bits only mean more candidates.
    """
    mixed = mix(keys ^ U64(0xC2B2AE3D27D4EB4F))
    return (mixed % U64(ranges)).astype(np.int64), mixed >> U64(24)


def packed(short: np.ndarray) -> bytes:
    return np.ascontiguousarray(short.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def placed(part: np.ndarray | int, short: np.ndarray) -> np.ndarray:
    """One number for a range and the bits inside it."""
    return (np.asarray(part).astype(U64) << U64(40)) ^ short


def _ask(width: int, key_bytes: int, ranges: int):
    def ask(table: pa.Table) -> pa.Table:
        once, many = Fragments(table, width, key_bytes).asked()
        key = np.concatenate([once, many])
        flag = np.arange(len(key)) >= len(once)
        part, short = ranges_of(key, ranges)
        rows = split_by(part, short, flag)
        chunk = table.column("chunk")[0].as_py()
        return pa.table(
            {
                "part": pa.array([r[0] for r in rows], pa.int64()),
                "chunk": pa.array([chunk] * len(rows), pa.int64()),
                "once": pa.array([packed(r[1][~r[2]]) for r in rows], pa.binary()),
                "many": pa.array([packed(r[1][r[2]]) for r in rows], pa.binary()),
            }
        )

    return ask


def _answer(table: pa.Table) -> pa.Table:
    keys, chunks, flags = [], [], []
    for chunk, once, many in zip(*(table.column(c).to_pylist() for c in ("chunk", "once", "many")), strict=True):
        for blob, flag in ((once, 1), (many, 2)):
            found = unpacked(blob)
            keys.append(found)
            chunks.append(np.full(len(found), chunk))
            flags.append(np.full(len(found), flag))
    key, chunk, flag = np.concatenate(keys), np.concatenate(chunks), np.concatenate(flags)
    by = np.argsort(key, kind="stable")
    key, chunk, flag = key[by], chunk[by], flag[by]
    rows = []
    if len(key):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        common = np.repeat(np.add.reduceat(flag, first) > 1, np.diff(np.append(first, len(key))))
        rows = split_by(chunk[common], key[common])
    return pa.table(
        {
            "part": pa.array([table.column("part")[0].as_py() for _ in rows], pa.int64()),
            "chunk": pa.array([r[0] for r in rows], pa.int64()),
            "keys": pa.array([packed(r[1]) for r in rows], pa.binary()),
        }
    )


def _answered(table: pa.Table) -> np.ndarray:
    """The answers to a chunk as sorted places of keys."""
    pairs = zip(table.column("part").to_pylist(), table.column("keys").to_pylist(), strict=True)
    found = [placed(part, unpacked(keys)) for part, keys in pairs if keys is not None]
    return np.sort(np.concatenate([np.zeros(0, U64), *found]))


def _send(width: int, key_bytes: int, ranges: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows, pack = [], zstandard.ZstdCompressor(level=1).compress
        if table.num_rows:
            fragments = Fragments(table, width, key_bytes)
            hit, number, bodies = fragments.shared(_answered(answers), ranges)
            n = len(bodies)
            row = fragments.ids[fragments.doc[hit]]
            least, most = np.full(n, NO_ID), np.full(n, -NO_ID - 1)
            np.minimum.at(least, number, row)
            np.maximum.at(most, number, row)
            key = np.zeros(n, U64)
            key[number] = fragments.key[hit]
            rows = split_by(ranges_of(key, ranges)[0], np.arange(n), least, most)
            chunk = table.column("chunk")[0].as_py()
        return pa.table(
            {
                "part": pa.array([r[0] for r in rows], pa.int64()),
                "chunk": pa.array([chunk for _ in rows], pa.int64()),
                "at": pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary()),
                "least": pa.array([r[2].tobytes() for r in rows], pa.binary()),
                "most": pa.array([r[3].tobytes() for r in rows], pa.binary()),
                "sizes": pa.array([np.array([len(bodies[i]) for i in r[1]], "<i4").tobytes() for r in rows], pa.binary()),
                "body": pa.array([pack(b"".join(bodies[i] for i in r[1])) for r in rows], pa.binary()),
            }
        )

    return send


def least_of_windows(bodies: list[bytes], least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every body, the least id of the bodies that have it; and the windows' offsets by body."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    text = np.frombuffer(b"".join(bodies), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    word = words(text)
    order = suffix_array(text, width, word)
    body = np.repeat(np.arange(len(bodies)), sizes)
    whole = np.arange(len(text)) + width <= starts[body + 1]
    order = order[whole[order]]
    common = adjacent_prefixes(word, order, width)
    first = np.flatnonzero(np.append(True, common[1:] < width)) if len(order) else np.zeros(0, np.int64)
    owner = least[body[order]]
    best = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(order)))) if len(order) else owner
    of = np.zeros(len(text), np.int64)
    of[order] = best
    return of[whole], np.concatenate([[0], np.cumsum(np.maximum(0, sizes - width + 1))])


def _sort(width: int):
    def find(table: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        which, holders, least, most, at = [], [], [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for chunk, blob_at, blob_least, blob_most, sizes, body in zip(
            *(table.column(c).to_pylist() for c in ("chunk", "at", "least", "most", "sizes", "body")), strict=True
        ):
            ends, body = np.cumsum(np.frombuffer(sizes, "<i4")).tolist(), unpack(body)
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                which.append(seen.setdefault(body[start:end], len(seen)))
            holders.append(np.full(len(ends), chunk))
            at.append(np.frombuffer(blob_at, "<i4"))
            least.append(np.frombuffer(blob_least, "<i8"))
            most.append(np.frombuffer(blob_most, "<i8"))
        rows = []
        if which:
            which, chunk, at = np.array(which), np.concatenate(holders), np.concatenate(at)
            most = np.concatenate(most)
            best = np.full(len(seen), NO_ID)
            np.minimum.at(best, which, np.concatenate(least))
            of, offsets = least_of_windows(list(seen), best, width)
            body = np.repeat(np.arange(len(seen)), np.diff(offsets))
            cut = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (body[1:] != body[:-1])))
            run_body, run_start, run_least = body[cut], cut - offsets[body[cut]], of[cut]
            run_size = np.diff(np.append(cut, len(of)))
            per = np.searchsorted(run_body, np.arange(len(seen) + 1))
            count = (per[1:] - per[:-1])[which]
            holder = np.repeat(np.arange(len(which)), count)
            run = np.arange(len(holder)) - np.repeat(np.cumsum(count) - count, count) + per[which[holder]]
            use = run_least[run] < most[holder]
            holder, run = holder[use], run[use]
            reply = np.zeros(len(run), REPLY)
            reply["at"], reply["start"], reply["n"], reply["least"] = at[holder], run_start[run], run_size[run], run_least[run]
            rows = split_by(chunk[holder], reply)
        return pa.table(
            {
                "part": pa.array([None] * len(rows), pa.int64()),
                "chunk": pa.array([r[0] for r in rows], pa.int64()),
                "reply": pa.array([r[1].tobytes() for r in rows], pa.binary()),
                "keys": pa.array([None] * len(rows), pa.binary()),
            }
        )

    return find


def _mark(width: int, key_bytes: int, ranges: int):
    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in MARKED.items()})
        fragments = Fragments(table, width, key_bytes)
        covered = np.zeros(len(fragments.raw) + 1, np.int32)
        reply = np.frombuffer(b"".join(x for x in answers.column("reply").to_pylist() if x is not None), REPLY)
        if len(reply):
            hit, number, bodies = fragments.shared(_answered(answers), ranges)
            by = np.argsort(number, kind="stable")
            per = np.searchsorted(number[by], np.arange(len(bodies) + 1))
            count = (per[1:] - per[:-1])[reply["at"]]
            of = np.repeat(np.arange(len(reply)), count)
            place = hit[by[np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + per[reply["at"][of]]]]
            use = reply["least"][of] < fragments.ids[fragments.doc[place]]
            of, place = of[use], place[use]
            start = fragments.start[place] + reply["start"][of]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + reply["n"][of] + width - 1, -1)
        gone = np.cumsum(covered)[:-1] > 0
        kept, spans = [], []
        for low, high in zip(fragments.offsets[:-1].tolist(), fragments.offsets[1:].tolist(), strict=True):
            lost = gone[low:high]
            kept.append(fragments.raw[low:high][~lost].tobytes())
            edge = np.flatnonzero(np.diff(lost.astype(np.int8), prepend=0, append=0))
            spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
        return pa.table(
            {
                "doc_id": fragments.missing.combine_chunks() if isinstance(fragments.missing, pa.ChunkedArray) else fragments.missing,
                "n_bytes": pa.array(np.diff(fragments.offsets)),
                "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(spans, MARKED["spans"]),
            }
        )

    return mark


MARKED = {
    "doc_id": pa.int64(),
    "n_bytes": pa.int64(),
    "kept": pa.binary(),
    "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}


def suffix_dedup(
    docs: DataFrame,
    width: int = WIDTH,
    key_bytes: int = KEY_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, kept (bytes left), spans (removed byte ranges).

    A byte goes where a window of `width` bytes that covers it also starts in a document with a smaller
    id, judged on the input. Null counts as empty; texts under `width` bytes stay whole. Rows with one id
    are parts of one document and don't remove each other's bytes; a missing id sorts after all others.
    An empty table gives no rows; extra columns are ignored. `kept` may end inside a character.
    """
    size = total_bytes(docs, text_col)
    chunks, ranges = max(64, -(-size // chunk_bytes)), max(64, -(-size // range_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.select(F.pmod(F.xxhash64(F.coalesce("row", F.xxhash64("text"))), F.lit(chunks)).alias("chunk"), "row", F.coalesce("text", F.lit("")).alias("text"))
    asked = dealt.groupBy("chunk").applyInArrow(
        _ask(width, key_bytes, ranges), "part long, chunk long, once binary, many binary"
    )
    answers = asked.groupBy("part").applyInArrow(_answer, "part long, chunk long, keys binary")
    sent = (
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            _send(width, key_bytes, ranges),
            "part long, chunk long, at binary, least binary, most binary, sizes binary, body binary",
        )
    )
    found = sent.groupBy("part").applyInArrow(
        _sort(width), "part long, chunk long, reply binary, keys binary"
    )
    replies = found.unionByName(answers.select("part", "chunk", F.lit(None).cast("binary").alias("reply"), "keys"))
    return (
        dealt.groupBy("chunk")
        .cogroup(replies.groupBy("chunk"))
        .applyInArrow(
            _mark(width, key_bytes, ranges),
            "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>",
        )
    )
