"""Secret scans: fixed rules, and a linear-chain conditional random field for what the rules don't name.

The field tags each token of a line as O (outside), B (a secret begins) or I (inside). Features are the
token's shape, the hashed words before and after it, and how much its file looks like settings or code. It is
fitted on lines that a seeded generator writes, so the corpus has no part in it. Decoding is Viterbi; a
token whose emission lies so low that no transition could make it B or I is O on the best path, so the
search runs only over the stretches between such tokens and gives the same path as over whole lines.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import U64, prefix_hash, range_hash, steps, text_bytes

# the rules of the base scan
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "field")
NAMES = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

#: bytes of text looked at in one step: a task needs about 100 bytes for each
STEP = 1 << 18
O, B, I = range(3)  # noqa: E741
KEYWORDS = (
    "password passwd pwd pass secret token key apikey api_key access_key auth authorization bearer credential credentials private login"
).split()


def _table(*sets: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for i, chars in enumerate(sets, 1):
        out[list(chars)] = i
    return out


LETTERS = bytes(range(97, 123))
# 1 lower, 2 upper, 3 digit, 4 symbol, 5 dash or dot, 6 above ASCII; 0 ends a token
CLASS = _table(LETTERS, LETTERS.upper(), b"0123456789", b"+/_", b"-.", bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: classes of a hashed neighbour; the next number stands for none on the line, that after it for one that the fit
#: met fewer than COMMON times
WORDS = 1 << 14
COMMON = 20
SIZES = (10, 64, 16, WORDS + 2, WORDS + 2, WORDS + 2, 8, 10, 4, 64)
NEIGHBOURS = slice(3, 6)
LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 40, 64])


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts of a buffer: starts, ends, texts, lines (numbers) and feature codes of all tokens."""
    n = len(offsets) - 1
    kind = CLASS[raw]
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    inside = kind > 0
    edge = np.ones(len(raw) + 1, bool)
    if len(raw):
        edge[1:-1] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = inside[start] if len(raw) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    of = doc[start] if len(raw) else np.zeros(0, np.int32)
    newline = np.concatenate([[0], np.cumsum(raw == 10)])
    line = newline[start] + of
    size = end - start
    count = []
    for k in range(1, 7):
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(kind == k, out=total[1:])
        count.append(total[end] - total[start])
    lower, upper, digit, symbol, dash, high = count
    turn = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(kind[1:] != kind[:-1], out=turn[1:-1]) if len(raw) > 1 else None
    turns = turn[np.maximum(end - 1, start)] - turn[start]
    length = np.searchsorted(LENGTHS, size, "right")
    mask = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (symbol > 0) + 16 * (dash > 0) + 32 * (high > 0)
    low = LOWER[raw]
    hexes = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(((low >= 97) & (low <= 102)) | (kind == 3), out=hexes[1:])
    vowels = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(np.isin(low, np.frombuffer(b"aeiou", np.uint8)) | (kind == 6), out=vowels[1:])
    shape = (
        (hexes[end] - hexes[start] == size)
        + 2 * (3 * digit >= size)
        + 4 * (turns >= 4)
        + 8 * (5 * (vowels[end] - vowels[start]) < lower + upper)
    )
    hashes = range_hash(prefix_hash(low), start, end)
    word = (hashes >> U64(50)).astype(np.int64)
    before, second, after = (np.full(len(start), WORDS) for _ in range(3))
    same = line[1:] == line[:-1]
    before[1:] = np.where(same, word[:-1], WORDS)
    second[2:] = np.where(line[2:] == line[:-2], word[:-2], WORDS)
    after[:-1] = np.where(same, word[1:], WORDS)
    signs = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((raw == 58) | (raw == 61), out=signs[1:])
    gap = np.maximum(start, 1) - 1
    quote = np.isin(raw[gap], np.frombuffer(b"\"'`", np.uint8)) if len(raw) else np.zeros(0, bool)
    last_end = np.append(offsets[of[:1]], end[:-1]) if len(start) else end
    last_end = np.maximum(last_end, offsets[:-1][of]) if len(start) else end
    between = (signs[start] > signs[last_end]) + 2 * quote + 4 * (raw[gap] == 64 if len(raw) else quote)
    following = np.full(len(start), 9)
    following[:-1] = np.where(same, length[1:], 9)
    code = np.bincount(doc[(raw == 61) | (raw == 123) | (raw == 59)], minlength=n) / np.maximum(1, np.bincount(doc[raw == 10], minlength=n) + 1)
    file = np.searchsorted([0.05, 0.3, 1.0], code, "right")[of]
    two = low[start].astype(np.int64) * 31 + low[np.minimum(start + 1, end - 1)] if len(start) else start
    codes = np.stack([length, mask, shape, before, second, after, between, following, file, two % 64])
    return start, end, of, line, codes.astype(np.int64)


class Field:
    """Weights: one table a feature, three states wide, and transitions between states."""

    def __init__(self):
        self.tables = [np.zeros((k, 3)) for k in SIZES]
        self.moves = np.zeros((3, 3))
        self.rare = np.zeros(WORDS + 2, bool)

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[1], 3))
        for table, code in zip(self.tables, self.merged(codes), strict=True):
            out += table[code]
        return out

    def merged(self, codes: np.ndarray) -> np.ndarray:
        """codes with the rare neighbours as one class."""
        codes = codes.copy()
        codes[NEIGHBOURS][self.rare[codes[NEIGHBOURS]]] = WORDS + 1
        return codes

    def fit(self, codes: np.ndarray, line: np.ndarray, states: np.ndarray, rounds: int = 80, rate: float = 0.25) -> None:
        """Conditional log-likelihood by AdaGrad; forward and backward sums run over all lines at once."""
        self.rare[:WORDS] = np.bincount(codes[NEIGHBOURS].ravel(), minlength=WORDS)[:WORDS] < COMMON
        codes = self.merged(codes)
        lines, of = np.unique(line, return_inverse=True)
        first = np.searchsorted(of, np.arange(len(lines)))
        place = np.arange(len(of)) - first[of]
        width, n = int(place.max()) + 1, len(lines)
        live = np.zeros((n, width), bool)
        live[of, place] = True
        gold = np.full((n, width + 2), O)
        gold[of, place + 1] = states
        pair = np.zeros((3, 3))
        for t in range(width + 1):
            real = live[:, t] if t < width else np.zeros(n, bool)
            closing = (live[:, t - 1] if t else np.zeros(n, bool)) & ~real
            np.add.at(pair, (gold[real | closing, t], gold[real | closing, t + 1]), 1)
        seen = [np.full_like(t, 1e-6) for t in self.tables]
        seen_moves = np.full((3, 3), 1e-6)
        add = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for _ in range(rounds):
            score = np.zeros((n, width, 3))
            score[of, place] = self.emissions(codes)
            forward, back = np.zeros((n, width, 3)), np.zeros((n, width, 3))
            forward[:, 0] = self.moves[O] + score[:, 0]
            for t in range(1, width):
                step = add(forward[:, t - 1, :, None] + self.moves, 1) + score[:, t]
                forward[:, t] = np.where(live[:, t, None], step, forward[:, t - 1])
            back[:, width - 1] = self.moves[:, O]
            for t in range(width - 2, -1, -1):
                step = add(self.moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(live[:, t + 1, None], step, self.moves[:, O])
            whole = add(forward[:, 0] + back[:, 0], 1)
            chance = np.exp(forward + back - whole[:, None, None])[of, place]
            slope = -chance
            slope[np.arange(len(of)), states] += 1
            moved = pair.copy()
            moved[O] -= np.exp(forward[:, 0] + back[:, 0] - whole[:, None]).sum(axis=0)
            for t in range(1, width):
                joint = forward[:, t - 1, :, None] + self.moves + (score[:, t] + back[:, t])[:, None, :] - whole[:, None, None]
                moved -= np.exp(joint[live[:, t]]).sum(axis=0)
            final = np.exp(forward[np.arange(n), live.sum(axis=1) - 1] + self.moves[:, O] - whole[:, None])
            moved[:, O] -= final.sum(axis=0)
            for table, grown, code in zip(self.tables, seen, codes, strict=True):
                grad = np.stack([np.bincount(code, slope[:, s], len(table)) for s in range(3)], axis=1) - 0.02 * table
                grown += grad**2
                table += rate * grad / np.sqrt(grown)
            grad = moved - 0.02 * self.moves
            seen_moves += grad**2
            self.moves += rate * grad / np.sqrt(seen_moves)

    def bound(self) -> float:
        """What transitions can add at most where one token turns from O to B or I."""
        gain = self.moves[:, 1:, None] + self.moves[None, 1:, :] - self.moves[:, O][:, None, None] - self.moves[O][None, None, :]
        return max(0.0, float(gain.max()))

    def viterbi(self, score: np.ndarray) -> list[int]:
        """The best states of tokens between two that are O."""
        best, back = self.moves[O] + score[0], []
        for row in score[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        state = int((best + self.moves[:, O]).argmax())
        path = [state]
        for row in reversed(back):
            path.append(int(row[path[-1]]))
        return path[::-1]

    def spans(self, start: np.ndarray, end: np.ndarray, line: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(first token's number, start, end) of each run B I* on the best paths."""
        if not len(start):
            return []
        score = self.emissions(codes)
        may = np.flatnonzero(score[:, 1:].max(axis=1) - score[:, O] > -self.bound())
        if not len(may):
            return []
        cuts = np.flatnonzero((np.diff(may) != 1) | (line[may[1:]] != line[may[:-1]])) + 1
        out = []
        for run in np.split(may, cuts):
            if len(run) == 1:
                alone = self.moves[O] + score[run[0]] + self.moves[:, O]
                path = [int(alone.argmax())]
            else:
                path = self.viterbi(score[run])
            for token, state in zip(run.tolist(), path, strict=True):
                if state == I and out and out[-1][3] == token - 1:
                    out[-1][2:] = [int(end[token]), token]
                elif state != O:
                    out.append([token, int(start[token]), int(end[token]), token])
        return [(a, b, c) for a, b, c, _ in out]


def _made(rng: random.Random) -> list[tuple[str, bool]]:
    """One line of prose or settings as pieces, with those marked that are secrets."""
    syllables = "an the on re er st ing ti en le que ou ai de la ver ge ein lich os ado ción é ü ß è ê ç á ñ ö ä eau tre ment".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word().capitalize() if rng.random() < 0.1 else word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secret = rng.choice(
        [
            lambda: pick("0123456789abcdef", 24, 64), lambda: pick(low + up + num, 20, 44), lambda: pick(low + up + num + "+/", 28, 60),
            lambda: "AKIA" + pick(up + num, 16, 16), lambda: rng.choice(["ghp_", "xoxb-", "sk-", "pk_"]) + pick(low + up + num, 24, 40),
            lambda: pick(low, 3, 6) + pick(num, 2, 4) + pick(up + low + num, 3, 6), lambda: pick(low + num, 16, 32), lambda: pick(up + num, 16, 32),
        ]
    )
    key = rng.choice(KEYWORDS)
    key = rng.choice([key, key.upper(), key.capitalize(), word() + "_" + key])
    kind = rng.random()
    if kind < 0.45:
        q = rng.choice(['"', "'", "", ""])
        sign = rng.choice([" = ", "=", ": ", ":", " is ", " "])
        pieces = [(key + sign + q, False), (secret(), True), (q, False)]
    elif kind < 0.55:
        pieces = [("Authorization: Bearer ", False), (secret(), True)]
    else:
        plain = rng.choice(
            [
                lambda: pick(num, 4, 17), lambda: f"{word()}.{word()}{pick(num, 1, 3)}@{word()}.example.com", lambda: ".".join(pick(num, 1, 3) for _ in range(4)),
                lambda: f"+{pick(num, 9, 12)}", lambda: f"({pick(num, 3, 3)}) {pick(num, 3, 3)}-{pick(num, 4, 4)}", lambda: f"20{pick(num, 2, 2)}-{pick(num, 2, 2)}-{pick(num, 2, 2)}",
                lambda: f"https://{word()}.example.com/{word()}/{pick(num, 1, 5)}", lambda: word() * 3, lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(5, 10))).capitalize(), lambda: prose(3).upper(), lambda: f"{word()}_{word()}",
                lambda: f"v{pick(num, 1, 1)}.{pick(num, 1, 2)}.{pick(num, 1, 2)}", lambda: f"{key} {prose(4)}", lambda: f"{key}: {word()}", lambda: f"{word().capitalize()}{word().capitalize()}",
                lambda: " | ".join(word() for _ in range(5)), lambda: prose(6), lambda: f"{word()} = {pick(num, 1, 6)}", lambda: f"{word()}: {prose(3)}",
                lambda: f"{prose(2)} is {prose(3)}", lambda: f"{key} is {word()}{word()}", lambda: f"{prose(1)} is {pick(low, 2, 2)} {word()}{word()}", lambda: prose(12),
            ]
        )
        pieces = [(plain(), False)]
    return [(prose(rng.randint(0, 8)) + " ", False), *pieces, (" " + prose(rng.randint(0, 8)), False)]


@lru_cache(maxsize=2)
def fitted(lines: int = 3000, seed: int = 11) -> Field:
    """The field, fitted in this process; equal arguments give an equal field."""
    rng, text, marks = random.Random(seed), bytearray(), []
    offsets = [0]
    for _ in range(lines // 6):
        for _ in range(6):
            for piece, mark in _made(rng):
                marks += [mark] * len(piece.encode())
                text += piece.encode()
            marks.append(False)
            text += b"\n"
        offsets.append(len(text))
    start, end, _, line, codes = tokens(np.frombuffer(bytes(text), np.uint8), np.array(offsets))
    marked = np.array(marks)
    secret = marked[start] & marked[end - 1]
    states = np.where(secret, B, O)
    follows = secret[1:] & secret[:-1] & (line[1:] == line[:-1])
    states[1:][follows] = I
    field = Field()
    field.fit(codes, line, states)
    return field


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the rules' spans, each rule leftmost without overlap."""
    out = []
    if NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def field_spans(raw: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[int, int]]]:
    """Per text of the buffer the field's spans in code points, in order."""
    found: list[list] = []
    for a, b in steps(offsets, STEP):
        part = raw[offsets[a] : offsets[b]]
        local = offsets[a : b + 1] - offsets[a]
        start, end, of, line, codes = tokens(part, local)
        places: list[list] = [[] for _ in range(b - a)]
        for token, low, high in field.spans(start, end, line, codes):
            doc = int(of[token])
            while high < local[doc + 1] and part[high] == 61:
                high += 1
            while high > low + 1 and part[high - 1] in b".-":
                high -= 1
            places[doc].append((low, high))
        if any(places):
            # code points that begin before each byte
            points = np.concatenate([[0], np.cumsum(part & 0xC0 != 0x80)])
            base = points[local]
            places = [[(int(points[x] - base[i]), int(points[y] - base[i])) for x, y in p] for i, p in enumerate(places)]
        found += places
    return found


def find_secrets(raw: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[int, int, str]]]:
    """Per text of the buffer its spans, those of the rules and the field's that meet none of these."""
    found = []
    for i, tagged in enumerate(field_spans(raw, offsets, field)):
        base = base_spans(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        found.append(ordered(base + [(a, b, "field") for a, b in apart(tagged, base)]))
    return found


def apart(tagged: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The tagged spans, which are in order, that meet no base span."""
    out, at, reach = [], 0, 0
    base = sorted(base)
    for a, b in tagged:
        # `reach` is the furthest end of the base spans that begin before b
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= a:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
TAGGED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, spans array<struct<kind,start,end>> and tagged array<struct<start,end>> in code points, ends exclusive.

    Spans are in order of start, then of KINDS; `tagged` has all of the field's, those that meet a rule's span
    too. Null counts as empty, and neither it nor an empty text has spans. Repeated and missing ids keep a row
    each; extra columns are ignored. A text of any length is read whole, in time that grows with its length.
    """
    kept = docs.sparkSession.sparkContext.broadcast(fitted())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            tagged, spans = field_spans(raw, offsets, kept.value), []
            for i, own in enumerate(tagged):
                base = base_spans(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                whole = ordered(base + [(a, b, "field") for a, b in apart(own, base)])
                spans.append([{"kind": k, "start": a, "end": b} for a, b, k in whole])
            tagged = [[{"start": a, "end": b} for a, b in own] for own in tagged]
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(spans, SPANS), "tagged": pa.array(tagged, TAGGED)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>, tagged array<struct<start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mark`, and the number of characters, where there is one, counted again.

    Overlapping spans become one mark. Null texts stay null; other columns stay as they are.
    """
    kept = docs.sparkSession.sparkContext.broadcast(fitted())
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(find_secrets(*text_bytes(batch.column(at)), kept.value)):
                if texts[i] is None or not spans:
                    continue
                out, end = [], 0
                for a, b, _ in spans:
                    if a >= end:
                        out += [texts[i][end:a], mark]
                    end = max(end, b)
                texts[i] = "".join(out) + texts[i][end:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                old = batch.column(chars)
                n = [None if t is None else len(t) for t in texts]
                columns[chars] = pa.array(n, pa.int64()).cast(old.type)
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(clean, docs.schema)

