"""Exact dedup with Patricia-trie owners.

Rows are dealt by length and content hash; each partition inserts the full byte strings into a
compressed radix trie whose terminal nodes hold the owner, the best row of that text. Equal texts of
one batch meet in a small trie first, so a text that a third of the rows share reaches the shuffle
once a batch, and the ids of its rows never pass through the partition that owns the text: they join
its answer by content digest, where adaptive execution splits a frequent digest.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: white space that does not count, as bytes
SPACE = b" \t\n\x0b\x0c\r"
#: an id above all others stands for a missing one
NO_ID = (1 << 63) - 1
#: bytes of keys that a trie holds in memory before it spills a subtree
HELD_BYTES = 48 << 20


class Node:
    """A node of a compressed radix trie; `owner` is set where a key ends."""

    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.owner, self.children = label, owner, None


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:], by halving."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """Maps whole byte strings to owners; subtrees past the memory bound wait in files.

    An owner is [n_chars, id, rows, extra]: the most characters win, then the smallest id. All keys share their
    first `depth` bytes, so the byte there tells a key's subtree.
    """

    def __init__(self, held: int = HELD_BYTES, depth: int = 0):
        self.root, self.held, self.depth, self.size = Node(b""), held, depth, 0
        self.spilled: dict[int, tempfile._TemporaryFileWrapper] = {}
        self.sizes: dict[int, int] = {}

    @staticmethod
    def better(owner: list, new: list) -> None:
        owner[2] += new[2]
        if (-new[0], new[1]) < (-owner[0], owner[1]):
            owner[0], owner[1] = new[0], new[1]

    def add(self, key: bytes, owner: list) -> None:
        first = key[self.depth] if len(key) > self.depth else -1
        if first in self.spilled:
            self._write(first, key, owner)
            return
        if self._insert(key, owner):
            # a repeated key takes no room
            self.sizes[first] = self.sizes.get(first, 0) + len(key) + 64
            self.size += len(key) + 64
            if self.size > self.held:
                self._spill()

    def _insert(self, key: bytes, owner: list) -> bool:
        """True where the key is new."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.owner is None:
                    node.owner = owner
                    return True
                self.better(node.owner, owner)
                return False
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner)
                return True
            n = common(child.label, key, at)
            if n < len(child.label):
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children = {child.label[0]: child}
                node.children[key[at]] = upper
                child = upper
            node, at = child, at + n

    def _write(self, first: int, key: bytes, owner: list) -> None:
        digest = owner[3] or b""
        head = np.array([len(key), owner[0], owner[1], owner[2], len(digest)], "<i8").tobytes()
        self.spilled[first].write(head + key + digest)

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, list]]:
        file.seek(0)
        while head := file.read(40):
            size, chars, row, rows, extra = np.frombuffer(head, "<i8").tolist()
            yield file.read(size), [chars, row, rows, file.read(extra)]

    def _walk(self, node: Node, before: bytes) -> Iterator[tuple[bytes, list]]:
        todo = [(node, before)]
        while todo:
            node, before = todo.pop()
            key = before + node.label
            if node.owner is not None:
                yield key, node.owner
            todo += [(c, key) for c in (node.children or {}).values()]

    def _spill(self) -> None:
        """Moves the largest subtree below the shared bytes to a file; a key that ends there stays."""
        first = max((k for k in self.sizes if k >= 0), key=self.sizes.get, default=-1)
        if first < 0:
            return
        node, before = self.root, b""
        while len(before) < self.depth:
            child = next(iter(node.children.values()))
            if len(before) + len(child.label) > self.depth:
                break
            node, before = child, before + child.label
        else:
            child = node.children[first]
        del node.children[child.label[0]]
        self.spilled[first] = tempfile.TemporaryFile()
        for key, owner in self._walk(child, before):
            self._write(first, key, owner)
        self.size -= self.sizes.pop(first)

    def owners(self) -> Iterator[list]:
        """Every owner once; spilled subtrees are built one at a time, each from where its keys part."""
        trie, waiting = self, []
        while True:
            for _, owner in trie._walk(trie.root, b""):
                yield owner
            trie.root = Node(b"")
            waiting += trie.spilled.values()
            if not waiting:
                return
            file = waiting.pop()
            shared = None
            for key, _ in self._read(file):
                shared = key if shared is None else shared[: common(shared, key, 0)]
            trie = PatriciaTrie(self.held, len(shared))
            for key, owner in self._read(file):
                trie.add(key, owner)
            file.close()


def _entries(batches: Iterator[pa.RecordBatch], members: bool) -> Iterator[pa.RecordBatch]:
    """One row for each different text of a batch: its owner there, or the rows that have it."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        raw = pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()
        groups: dict[tuple[int, int], PatriciaTrie] = {}
        found: dict[bytes, list] = {}
        ids = ids.to_pylist()
        for row, text, n in zip(ids, raw, chars, strict=True):
            key = text.translate(None, SPACE)
            if members:
                found.setdefault(hashlib.sha256(key).digest(), []).append((row, n))
                continue
            at = (len(key), xxhash.xxh3_64_intdigest(key))
            trie = groups.get(at)
            if trie is None:
                groups[at] = trie = PatriciaTrie()
            trie.add(key, [n, NO_ID if row is None else row, 1, key])
        if members:
            yield pa.record_batch(
                {
                    "digest": pa.array(found, pa.binary()),
                    "rows": pa.array([[r for r, _ in v] for v in found.values()], pa.list_(pa.int64())),
                    "chars": pa.array([[n for _, n in v] for v in found.values()], pa.list_(pa.int64())),
                }
            )
            continue
        out = [(k, o) for k, trie in groups.items() for o in trie.owners()]
        yield pa.record_batch(
            {
                "size": pa.array([k[0] for k, _ in out], pa.int64()),
                "hash": pa.array([k[1] - (1 << 63) for k, _ in out], pa.int64()),
                "body": pa.array([o[3] for _, o in out], pa.binary()),
                "n_chars": pa.array([o[0] for _, o in out], pa.int64()),
                "owner": pa.array([o[1] for _, o in out], pa.int64()),
                "n": pa.array([o[2] for _, o in out], pa.int64()),
            }
        )


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owners of one partition of texts."""
    trie = PatriciaTrie()
    for batch in batches:
        _, _, body, chars, owner, n = (batch.column(i).to_pylist() for i in range(6))
        for key, c, row, rows in zip(body, chars, owner, n, strict=True):
            trie.add(key, [c, row, rows, hashlib.sha256(key).digest()])
    out = []
    for o in trie.owners():
        out.append(o)
        if len(out) == 8192:
            yield _owner_batch(out)
            out = []
    yield _owner_batch(out)


def _owner_batch(out: list) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "digest": pa.array([o[3] for o in out], pa.binary()),
            "keep_chars": pa.array([o[0] for o in out], pa.int64()),
            "keep_id": pa.array([o[1] for o in out], pa.int64()),
            "group_size": pa.array([o[2] for o in out], pa.int64()),
        }
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty. The row with the most
    code points stays, then the smallest id. A missing id sorts last and gives keep_id null. Rows that
    repeat an id are each counted; of fully equal rows all are marked as kept, as they share the id.
    An empty table gives no rows. Extra columns are ignored. Texts of any length are compared whole; a
    partition whose keys exceed HELD_BYTES moves subtrees of its trie to files of its own task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    entries = rows.mapInArrow(
        lambda it: _entries(it, False), "size long, hash long, body binary, n_chars long, owner long, n long"
    )
    owners = entries.repartition("size", "hash").mapInArrow(
        _own, "digest binary, keep_chars long, keep_id long, group_size long"
    )
    members = rows.mapInArrow(lambda it: _entries(it, True), "digest binary, rows array<long>, chars array<long>")
    joined = members.join(owners, "digest")
    pair = F.explode(F.arrays_zip("rows", "chars")).alias("of")
    flat = joined.select("digest", "keep_chars", "keep_id", "group_size", pair)
    row, keep = F.col("of.rows"), F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return flat.select(
        row.alias("doc_id"),
        keep.alias("keep_id"),
        "group_size",
        (row.eqNullSafe(keep) & (F.col("of.chars") == F.col("keep_chars"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
