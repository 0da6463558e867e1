"""Vorbis audio: headers and packets to samples, one stream at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from framesift.functions.audio import mdct_basis, sine_window
from framesift.functions.codecs import Damaged
from framesift.functions.entropy import LowBitReader
from framesift.sources.containers import ogg_packets, vorbis_identification

#: magnitudes of floor steps: 256 levels of 140 / 256 dB, the last is 1
DECIBELS = 10.0 ** ((np.arange(256) - 255) * (140 / 256) / 20)
RANGES = (256, 128, 86, 64)


def _float(x: int) -> float:
    """A 32-bit Vorbis float: 21 bits of mantissa, 10 of exponent, a sign."""
    mantissa = x & 0x1FFFFF
    return (-mantissa if x >> 31 else mantissa) * 2.0 ** ((x >> 21 & 0x3FF) - 788)


class Codebook:
    """A prefix code over entries, and the vector of each."""

    def __init__(self, r: LowBitReader):
        if r.get(24) != 0x564342:
            raise Damaged("vorbis: no codebook")
        self.dimensions, entries = r.get(16), r.get(24)
        lengths = [0] * entries
        if r.get(1):
            at, size = 0, r.get(5) + 1
            while at < entries:
                n = r.get((entries - at).bit_length())
                if at + n > entries:
                    raise Damaged("vorbis: too many codewords")
                lengths[at : at + n] = [size] * n
                at, size = at + n, size + 1
        else:
            sparse = r.get(1)
            for i in range(entries):
                if not sparse or r.get(1):
                    lengths[i] = r.get(5) + 1
        self.table = self._codewords(lengths)
        kind = r.get(4)
        self.vectors = None
        if kind in (1, 2):
            least, step, bits, running = _float(r.get(32)), _float(r.get(32)), r.get(4) + 1, r.get(1)
            size = entries * self.dimensions
            if kind == 1:
                size = int(round(entries ** (1 / self.dimensions)))
                while size**self.dimensions > entries:
                    size -= 1
                while (size + 1) ** self.dimensions <= entries:
                    size += 1
            values = np.array([r.get(bits) for _ in range(size)], float) * step + least
            if kind == 1:
                places = np.arange(entries)[:, None] // size ** np.arange(self.dimensions) % size
            else:
                places = np.arange(size).reshape(entries, self.dimensions)
            self.vectors = np.cumsum(values[places], axis=1) if running else values[places]
        elif kind:
            raise Damaged("vorbis: an unknown lookup")

    @staticmethod
    def _codewords(lengths: list[int]) -> dict[tuple[int, int], int]:
        """Each entry takes the lowest free codeword of its length, in order of entries."""
        used = [i for i, n in enumerate(lengths) if n]
        if len(used) == 1:
            return {(lengths[used[0]], 0): used[0], (lengths[used[0]], 1): used[0]}
        free, out = [(0, 0)], {}
        for i in used:
            n = lengths[i]
            fits = [f for f in free if f[0] <= n]
            if not fits:
                raise Damaged("vorbis: too many codewords")
            node = min(fits, key=lambda f: f[1] << 32 - f[0])
            free.remove(node)
            size, code = node
            while size < n:
                size, code = size + 1, code << 1
                free.append((size, code | 1))
            out[n, code] = i
        return out

    def entry(self, r: LowBitReader) -> int:
        code = 0
        for size in range(1, 33):
            code = code << 1 | r.get(1)
            found = self.table.get((size, code))
            if found is not None:
                return found
        raise Damaged("vorbis: a codeword is not in the book")


def _floor(r: LowBitReader) -> dict:
    kind = r.get(16)
    if kind != 1:
        raise Damaged("vorbis: only floors of type 1 are read")
    classes = [r.get(4) for _ in range(r.get(5))]
    sizes, bits, masters, books = [], [], [], []
    for _ in range(max(classes, default=-1) + 1):
        sizes.append(r.get(3) + 1)
        bits.append(r.get(2))
        masters.append(r.get(8) if bits[-1] else None)
        books.append([r.get(8) - 1 for _ in range(1 << bits[-1])])
    step, width = r.get(2) + 1, r.get(4)
    x = [0, 1 << width] + [r.get(width) for c in classes for _ in range(sizes[c])]
    return {"classes": classes, "sizes": sizes, "bits": bits, "masters": masters, "books": books, "step": step, "x": x}


def _residue(r: LowBitReader) -> dict:
    out = {"kind": r.get(16), "begin": r.get(24), "end": r.get(24), "size": r.get(24) + 1}
    n, out["book"] = r.get(6) + 1, r.get(8)
    stages = []
    for _ in range(n):
        low = r.get(3)
        stages.append((r.get(5) if r.get(1) else 0) << 3 | low)
    out["books"] = [[r.get(8) if s >> i & 1 else None for i in range(8)] for s in stages]
    return out


def _mapping(r: LowBitReader, channels: int) -> dict:
    if r.get(16):
        raise Damaged("vorbis: an unknown mapping")
    submaps = r.get(4) + 1 if r.get(1) else 1
    width = (channels - 1).bit_length()
    pairs = [(r.get(width), r.get(width)) for _ in range(r.get(8) + 1)] if r.get(1) else []
    if r.get(2):
        raise Damaged("vorbis: a reserved field is set")
    mux = [r.get(4) for _ in range(channels)] if submaps > 1 else [0] * channels
    parts = [(r.get(8), r.get(8), r.get(8))[1:] for _ in range(submaps)]
    return {"pairs": pairs, "mux": mux, "parts": parts}


def setup_header(data: bytes, channels: int) -> dict:
    """Codebooks, floors, residues, mappings and modes."""
    if data[:7] != b"\x05vorbis":
        raise Damaged("vorbis: no setup header")
    r = LowBitReader(data[7:])
    books = [Codebook(r) for _ in range(r.get(8) + 1)]
    if any(r.get(16) for _ in range(r.get(6) + 1)):
        raise Damaged("vorbis: a time transform that is not zero")
    floors = [_floor(r) for _ in range(r.get(6) + 1)]
    residues = [_residue(r) for _ in range(r.get(6) + 1)]
    mappings = [_mapping(r, channels) for _ in range(r.get(6) + 1)]
    modes = []
    for _ in range(r.get(6) + 1):
        long = r.get(1)
        if r.get(16) or r.get(16):
            raise Damaged("vorbis: an unknown window or transform")
        modes.append((bool(long), r.get(8)))
    if not r.get(1):
        raise Damaged("vorbis: no framing bit")
    return {"books": books, "floors": floors, "residues": residues, "mappings": mappings, "modes": modes}


def _line(x0: int, y0: int, x1: int, y1: int, x: int) -> int:
    step = abs(y1 - y0) * (x - x0) // (x1 - x0)
    return y0 - step if y1 < y0 else y0 + step


def floor_curve(f: dict, y: list[int], n: int) -> np.ndarray:
    """The magnitudes of n bins from the amplitudes of a floor's points."""
    most, x = RANGES[f["step"] - 1], f["x"]
    final, used = [y[0], y[1]], [True, True]
    for i in range(2, len(x)):
        low = max((j for j in range(i) if x[j] < x[i]), key=lambda j: x[j])
        high = min((j for j in range(i) if x[j] > x[i]), key=lambda j: x[j])
        guess = _line(x[low], final[low], x[high], final[high], x[i])
        above, value = most - guess, y[i]
        if not value:
            final.append(guess)
            used.append(False)
            continue
        used[low] = used[high] = True
        used.append(True)
        if value >= 2 * min(above, guess):
            final.append(value if above > guess else guess - value + above - 1)
        else:
            final.append(guess - (value + 1) // 2 if value & 1 else guess + value // 2)
    points = sorted((x[i], final[i] * f["step"]) for i in range(len(x)) if used[i])
    out = np.empty(n, np.int64)
    for (x0, y0), (x1, y1) in zip(points[:-1], points[1:], strict=True):
        at = np.arange(x0, min(x1, n))
        step = np.abs(y1 - y0) * (at - x0) // (x1 - x0)
        out[x0 : x0 + len(at)] = y0 - step if y1 < y0 else y0 + step
    if points[-1][0] < n:
        out[points[-1][0] :] = points[-1][1]
    return DECIBELS[np.clip(out, 0, 255)]


def _read_floor(f: dict, books: list[Codebook], r: LowBitReader) -> list[int] | None:
    if not r.get(1):
        return None
    width = (RANGES[f["step"] - 1] - 1).bit_length()
    y = [r.get(width), r.get(width)]
    for c in f["classes"]:
        bits, value = f["bits"][c], 0
        if bits:
            value = books[f["masters"][c]].entry(r)
        for _ in range(f["sizes"][c]):
            book = f["books"][c][value & (1 << bits) - 1]
            value >>= bits
            y.append(books[book].entry(r) if book >= 0 else 0)
    return y


def _read_residue(e: dict, books: list[Codebook], r: LowBitReader, vectors: list[np.ndarray]) -> None:
    """Adds the residue of each vector in place; a packet that ends early leaves the rest as it is."""
    if e["kind"] == 2:
        whole = np.zeros(len(vectors[0]) * len(vectors))
        _read_residue(e | {"kind": 1}, books, r, [whole])
        for c, v in enumerate(vectors):
            v += whole[c :: len(vectors)]
        return
    begin, end = e["begin"], min(e["end"], len(vectors[0]))
    parts, words, kinds = max(0, end - begin) // e["size"], books[e["book"]].dimensions, len(e["books"])
    chosen = [[0] * (parts + words) for _ in vectors]
    try:
        for stage in range(8):
            for first in range(0, parts, words):
                if stage == 0:
                    for c in chosen:
                        value = books[e["book"]].entry(r)
                        for i in range(words - 1, -1, -1):
                            c[first + i] = value % kinds
                            value //= kinds
                for part in range(first, min(first + words, parts)):
                    at = begin + part * e["size"]
                    for c, v in zip(chosen, vectors, strict=True):
                        number = e["books"][c[part]][stage]
                        if number is None:
                            continue
                        book = books[number]
                        steps = e["size"] // book.dimensions
                        for i in range(steps):
                            value = book.vectors[book.entry(r)]
                            if e["kind"] == 0:
                                v[at + i : at + e["size"] : steps] += value
                            else:
                                v[at + i * book.dimensions : at + (i + 1) * book.dimensions] += value
    except Damaged as error:
        if "cut off" not in str(error):
            raise


class Decoder:
    """Packets of one stream in order; the first audio packet gives no samples."""

    def __init__(self, identification: bytes, setup: bytes):
        self.head = vorbis_identification(identification)
        self.channels = self.head["channels"]
        self.setup = setup_header(setup, self.channels)
        self.sizes = (self.head["short"], self.head["long"])
        self.tail: np.ndarray | None = None
        self.before = 0

    def window(self, n: int, left: int, right: int) -> np.ndarray:
        """A window of n whose slopes are those of blocks of `left` and `right`."""
        out = np.zeros(n)
        slope = lambda size: np.sin(np.pi / 2 * sine_window(size) ** 2)
        a, b = n // 4 - left // 4, n * 3 // 4 - right // 4
        out[a : a + left // 2] = slope(left)[: left // 2]
        out[a + left // 2 : b] = 1
        out[b : b + right // 2] = slope(right)[right // 2 :]
        return out

    def spectrum(self, packet: bytes) -> tuple[np.ndarray, int, int, int]:
        """Spectra of all channels, the block size, and the sizes that the slopes have."""
        r = LowBitReader(packet)
        if r.get(1):
            raise Damaged("vorbis: not an audio packet")
        long, number = self.setup["modes"][r.get((len(self.setup["modes"]) - 1).bit_length())]
        n = left = right = self.sizes[long]
        if long:
            left, right = self.sizes[r.get(1)], self.sizes[r.get(1)]
        m, books = self.setup["mappings"][number], self.setup["books"]
        curves = []
        for c in range(self.channels):
            f = self.setup["floors"][m["parts"][m["mux"][c]][0]]
            y = _read_floor(f, books, r)
            curves.append(None if y is None else floor_curve(f, y, n // 2))
        needed = [c is not None for c in curves]
        for a, b in m["pairs"]:
            needed[a] = needed[b] = needed[a] or needed[b]
        vectors = np.zeros((self.channels, n // 2))
        for i, (_, residue) in enumerate(m["parts"]):
            e, own = self.setup["residues"][residue], [c for c in range(self.channels) if m["mux"][c] == i]
            live = own if e["kind"] == 2 and any(needed[c] for c in own) else [c for c in own if needed[c]]
            if live:
                _read_residue(e, books, r, [vectors[c] for c in live])
        for a, b in reversed(m["pairs"]):
            size, angle = vectors[a].copy(), vectors[b].copy()
            up, positive = size > 0, angle > 0
            vectors[a] = np.where(positive, size, np.where(up, size + angle, size - angle))
            vectors[b] = np.where(positive, np.where(up, size - angle, size + angle), size)
        for c, curve in enumerate(curves):
            vectors[c] *= 0 if curve is None else curve
        return vectors, n, left, right

    def decode(self, packet: bytes) -> np.ndarray:
        """Samples (channels x n) that the packet completes."""
        spectra, n, left, right = self.spectrum(packet)
        block = spectra @ mdct_basis(n // 2) * self.window(n, left, right)
        out = np.zeros((self.channels, 0))
        if self.tail is not None:
            out = np.zeros((self.channels, self.before // 4 + n // 4))
            out[:, : self.before // 2] += self.tail[:, : out.shape[1]]
            at = self.before // 4 - n // 4
            a, b = max(0, at), max(0, at) + n // 2 + min(0, at)
            out[:, a:b] += block[:, max(0, -at) : n // 2]
        self.tail, self.before = block[:, n // 2 :], n
        return out


def decode_ogg(data: bytes) -> dict:
    """rate, channels and samples (channels x n) of the first Vorbis stream of an Ogg file."""
    packets: Iterable[dict] = ogg_packets(data)
    serial, heads, decoder, parts = None, [], None, []
    for p in packets:
        if serial is None and p["data"][:7] == b"\x01vorbis":
            serial = p["track"]
        if p["track"] != serial:
            continue
        if len(heads) < 3:
            heads.append(p["data"])
            if len(heads) == 3:
                decoder = Decoder(heads[0], heads[2])
            continue
        parts.append(decoder.decode(p["data"]))
    if decoder is None:
        raise Damaged("vorbis: no stream")
    return {"rate": decoder.head["rate"], "channels": decoder.channels, "samples": np.concatenate(parts, axis=1) if parts else np.zeros((decoder.channels, 0))}
