"""Document quality by a factorisation machine over hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; a pair of features counts the product of its vectors. The
sum over all pairs comes from the identity 2 * sum_{i<j} <vi,vj> xi xj = |sum vi xi|^2 - sum |vi xi|^2, so
a text is scored in time linear in its words.

The machine is fitted on the driver with labelled rows, TRAIN_ROWS at most, chosen by a hash of their id:
its memory does not grow with the corpus. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import U64, mix, prefix_hash, range_hash, steps, text_bytes

TRAIN_ROWS = 8_000
HASHED = 1 << 15
RANK = 8
BINS = 10
EPOCHS = 12
RATE = 0.02
DECAY = 1e-5
THRESHOLD = 0.3
#: rows whose crc32(id) modulo FOLDS is 0 are held out
FOLDS = 5

SPACES = b"\t\n\x0b\x0c\r "
PLAIN = b".,;:'\"?-"

SPACE, LETTER, UPPER, DIGIT, MARK, ODD = range(6)


def _classes() -> np.ndarray:
    """The class of each byte; bytes above 127 are letters."""
    table = np.full(256, LETTER, np.uint8)
    table[:128] = ODD
    for a, b, kind in ((b"a", b"z", LETTER), (b"A", b"Z", UPPER), (b"0", b"9", DIGIT)):
        table[a[0] : b[0] + 1] = kind
    table[list(PLAIN)] = MARK
    table[list(SPACES)] = SPACE
    return table


CLASSES = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STATISTICS = (
    "bytes", "words", "lines", "upper", "digits", "marks", "odd", "spaces", "word_size", "longest_word", "odd_ends",
    "odd_words", "upper_words", "long_words", "distinct_words", "distinct_triples", "distinct_lines", "line_words",
    "short_lines", "stops",
)


def _distinct(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Different keys of each of n texts."""
    by = np.argsort(mix(keys + of.astype(U64) * U64(0x9FB21C651E98DF25)), kind="stable")
    keys, of = keys[by], of[by]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[first], minlength=n)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n texts: statistics (n rows), and the texts, hashed words and values of the nonzero word features.

    A text's word values are its counts over their Euclidean norm. A text without words has none.
    """
    n = len(offsets) - 1
    kind = CLASSES[raw]
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    in_word = kind != SPACE
    edge = np.ones(len(raw) + 1, bool)
    if len(raw):
        edge[1:-1] = (in_word[1:] != in_word[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    word = in_word[start] if len(raw) else np.zeros(0, bool)
    start, end = start[word], end[word]
    of = doc[start] if len(raw) else np.zeros(0, np.int64)
    lowered = LOWER[raw]
    prefix = prefix_hash(lowered)
    hashes = range_hash(prefix, start, end)
    width = end - start
    words = np.bincount(of, minlength=n)
    byte_count = lambda code: np.bincount(doc[kind == code], minlength=n)
    totals = {code: np.concatenate([[0], np.cumsum(kind == code)]) for code in (UPPER, ODD, LETTER)}
    inside = {code: t[end] - t[start] for code, t in totals.items()}
    share = lambda mask: np.bincount(of[mask], minlength=n) / np.maximum(words, 1)
    newline = np.flatnonzero(raw == 10)
    line_cut = np.unique(np.concatenate([offsets[:-1][size > 0], newline + 1]))
    line_cut = line_cut[line_cut < len(raw)]
    line_end = np.append(line_cut[1:], len(raw)) if len(line_cut) else line_cut
    line_of = doc[line_cut] if len(raw) else np.zeros(0, np.int64)
    line_hash = range_hash(prefix, line_cut, line_end)
    lines = np.bincount(line_of, minlength=n)
    line_words = np.searchsorted(start, line_end) - np.searchsorted(start, line_cut)
    triple = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    triples = mix(hashes[triple] + U64(3) * mix(hashes[triple + 1] + U64(5) * hashes[triple + 2])) if len(triple) else hashes[:0]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, of, width)
    last = kind[end - 1] if len(end) else kind[:0]
    some, many = np.maximum(size, 1), np.maximum(words, 1)
    n_triples = np.bincount(of[triple], minlength=n)
    table = np.stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(lines),
            byte_count(UPPER) / some, byte_count(DIGIT) / some, byte_count(MARK) / some, byte_count(ODD) / some,
            byte_count(SPACE) / some, np.bincount(of, width, n) / many, np.log1p(longest),
            share((last == ODD) & (width > 1)), share(inside[ODD] == width), share((inside[UPPER] > 1) & (inside[LETTER] == 0)),
            share(width > 14), _distinct(hashes, of, n) / many,
            np.where(n_triples > 0, _distinct(triples, of[triple], n) / np.maximum(n_triples, 1), 1),
            _distinct(line_hash, line_of, n) / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1)),
            np.bincount(line_of[line_words <= 3], minlength=n) / np.maximum(lines, 1), share(width <= 4),
        ],
        axis=1,
    ).astype(np.float32)
    slot = (hashes % U64(HASHED)).astype(np.int64)
    pair, count = np.unique(of * HASHED + slot, return_counts=True)
    text, slot, value = pair // HASHED, pair % HASHED, count.astype(np.float32)
    norm = np.sqrt(np.bincount(text, value**2, n)).astype(np.float32)
    return table, text, slot, value / norm[text]


class FactorisationMachine:
    """Weights, vectors and the bin edges of the statistics; see score for the formula."""

    def __init__(self, edges: np.ndarray, seed: int = 7):
        self.edges = edges
        size = HASHED + edges.shape[0] * (edges.shape[1] + 1)
        rng = np.random.default_rng(seed)
        self.bias = np.zeros(1, np.float32)
        self.weights = np.zeros(size, np.float32)
        self.vectors = rng.normal(0, 0.03, (size, RANK)).astype(np.float32)

    def rows(self, table: np.ndarray, text: np.ndarray, slot: np.ndarray, value: np.ndarray) -> tuple:
        """All nonzero features in order of text: offsets, columns, values."""
        n, kinds = table.shape
        width = self.edges.shape[1] + 1
        bins = np.stack([np.searchsorted(e, table[:, i], "right") for i, e in enumerate(self.edges)], axis=1)
        columns = HASHED + np.arange(kinds) * width + bins
        text = np.concatenate([text, np.repeat(np.arange(n), kinds)])
        by = np.argsort(text, kind="stable")
        columns = np.concatenate([slot, columns.ravel()])[by]
        values = np.concatenate([value, np.ones(n * kinds, np.float32)])[by]
        return np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]), columns, values

    def parts(self, offsets: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple:
        first = offsets[:-1]
        scaled = self.vectors[columns] * values[:, None]
        total = np.add.reduceat(scaled, first, axis=0)
        squares = np.add.reduceat((scaled**2).sum(axis=1), first)
        linear = np.add.reduceat(self.weights[columns] * values, first)
        return self.bias[0] + linear + 0.5 * ((total**2).sum(axis=1) - squares), total, scaled

    def score(self, table, text, slot, value) -> np.ndarray:
        if not len(table):
            return np.zeros(0)
        raw = self.parts(*self.rows(table, text, slot, value))[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    def fit(self, offsets: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, seed: int = 7) -> None:
        """Logistic loss by AdaGrad over batches of texts in a seeded order."""
        rng = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full_like(self.weights, 1e-6), np.full_like(self.vectors, 1e-6), 1e-6
        sizes = np.diff(offsets)
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
                size = sizes[batch]
                local = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(offsets[batch] - local[:-1], size) + np.arange(local[-1])
                column, value = columns[at], values[at]
                raw, total, scaled = self.parts(local, column, value)
                slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[batch]) / len(batch)
                each = np.repeat(slope, size).astype(np.float32) * value
                unique, where = np.unique(column, return_inverse=True)
                grad_w = np.bincount(where, each, len(unique)).astype(np.float32) + DECAY * self.weights[unique]
                pull = each[:, None] * (np.repeat(total, size, axis=0) - scaled)
                grad_v = np.stack([np.bincount(where, pull[:, f], len(unique)) for f in range(RANK)], axis=1).astype(np.float32)
                grad_v += DECAY * self.vectors[unique]
                seen_w[unique] += grad_w**2
                seen_v[unique] += grad_v**2
                self.weights[unique] -= RATE * 2 * grad_w / np.sqrt(seen_w[unique])
                self.vectors[unique] -= RATE * grad_v / np.sqrt(seen_v[unique])
                seen_b += slope.sum() ** 2
                self.bias[0] -= RATE * slope.sum() / np.sqrt(seen_b)


def fold(id_col: str):
    """crc32 of the id as text, modulo FOLDS; null for a missing id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(0))
        for a, b in steps(offsets):
            table, text, slot, value = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            cuts = np.searchsorted(text, np.arange(b - a + 1))
            yield pa.record_batch(
                {
                    "label": batch.column(1)[a:b],
                    "statistics": pa.array([r.tobytes() for r in table], pa.binary()),
                    "slots": pa.array([slot[x:y].astype("<u2").tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    "values": pa.array([value[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                }
            )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fits on labelled rows outside the held-out fold, `rows` at most: those with the least hash of their id.

    Labels other than 0 and 1 and missing ids are left out; without any labelled row every score is 0.5 or so.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("row"), F.col("quality").cast("int").alias("label"))
        .where((fold("row") != 0) & F.col("label").isin(0, 1))
        .groupBy("row")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("row"), "row")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    # `rows` bounds what is broadcast; the order by hash makes the fit the same however the rows lie
    joined = texts.join(F.broadcast(chosen), "row")
    # one text an id, that with the least hash, so `rows` bounds what is collected as well
    joined = joined.groupBy("row").agg(F.min("label").alias("label"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = joined.select("text", "label").mapInArrow(_extract, "label int, statistics binary, slots binary, values binary").collect()
    found.sort(key=lambda r: (r.statistics, r.slots, r.label))
    table = np.array([np.frombuffer(r.statistics, np.float32) for r in found], np.float32).reshape(len(found), len(STATISTICS))
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(table, cuts, axis=0).T.astype(np.float32) if len(found) else np.zeros((len(STATISTICS), BINS - 1), np.float32)
    machine = FactorisationMachine(edges)
    if found:
        text = np.repeat(np.arange(len(found)), [len(r.slots) // 2 for r in found])
        slot = np.frombuffer(b"".join(r.slots for r in found), "<u2").astype(np.int64)
        value = np.frombuffer(b"".join(r["values"] for r in found), np.float32)
        machine.fit(*machine.rows(table, text, slot, value), np.array([r.label for r in found], np.float32))
    return machine


def _score(machine, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for a, b in steps(offsets):
        out.append(machine.score(*features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])))
    return np.concatenate(out)


def score_texts(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null counts as empty; an empty text's
    score is that of its statistics alone. A missing id is not held out. Extra columns are ignored."""
    kept = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _score(kept.value, *text_bytes(batch.column(2)))
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(found)})

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score `threshold` or more, with all their columns."""
    kept = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _score(kept.value, *text_bytes(batch.column(at).cast(pa.string())))
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(choose, docs.schema)
