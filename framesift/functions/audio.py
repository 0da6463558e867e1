"""Audio codecs and transforms on NumPy arrays: FLAC both ways, MDCT, windows, block switching."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence

import numpy as np

from framesift.functions.codecs import Damaged, crc8, crc16

RATES = {88200: 1, 176400: 2, 192000: 3, 8000: 4, 16000: 5, 22050: 6, 24000: 7, 32000: 8, 44100: 9, 48000: 10, 96000: 11}
DEPTHS = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6, 32: 7}


class BitWriter:
    """Bits, the highest first."""

    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, bits: int) -> None:
        if bits:
            self.parts.append(format(value & (1 << bits) - 1, f"0{bits}b"))

    def unary(self, value: int) -> None:
        self.parts.append("0" * value + "1")

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at * 8, len(data) * 8

    def get(self, bits: int) -> int:
        if self.at + bits > self.end:
            raise Damaged("flac: a frame is cut off")
        first, last = self.at >> 3, self.at + bits + 7 >> 3
        value = int.from_bytes(self.data[first:last], "big") >> last * 8 - self.at - bits & (1 << bits) - 1
        self.at += bits
        return value

    def signed(self, bits: int) -> int:
        value = self.get(bits)
        return value - (1 << bits) if bits and value >> bits - 1 else value

    def unary(self) -> int:
        """Zeros before the next one, which is read as well."""
        n = 0
        while self.at < self.end:
            width = min(32, self.end - self.at)
            chunk = self.get(width)
            if chunk:
                left = chunk.bit_length() - 1
                self.at -= left
                return n + width - 1 - left
            n += width
        raise Damaged("flac: a frame is cut off")


def rice_parameter(u: np.ndarray) -> tuple[int, int]:
    """(bits, k) of the cheapest parameter, the least on ties."""
    best = None
    for k in range(15):
        bits = int((u >> k).sum()) + len(u) * (k + 1)
        if best is None or bits < best[0]:
            best = bits, k
    return best


def _partitions(residual: np.ndarray, order: int, block: int, most: int = 4) -> tuple[int, int, list[int]]:
    """(bits, partition order, parameters); the finer order wins a tie."""
    u = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    best = None
    for po in range(min(most, (block & -block).bit_length() - 1), -1, -1):
        size = block >> po
        if size <= order:
            continue
        cuts = [0, *(size * (i + 1) - order for i in range(1 << po))]
        chosen = [rice_parameter(u[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        bits = sum(b + 4 for b, _ in chosen)
        if best is None or bits < best[0]:
            best = bits, po, [k for _, k in chosen]
    return best


def _subframe(out: BitWriter, x: np.ndarray, depth: int) -> None:
    wasted = 0
    folded = int(np.bitwise_or.reduce(x)) if len(x) else 0
    if (x == x[0]).all():
        out.put(0, 8)
        out.put(int(x[0]), depth)
        return
    while folded and not folded >> wasted & 1:
        wasted += 1
    x = x >> wasted
    depth -= wasted
    best = None
    for order in range(min(4, len(x) - 1) + 1):
        residual = np.diff(x, order)
        if np.abs(residual).max(initial=0) >= 1 << 30:
            continue
        found = _partitions(residual, order, len(x))
        if found and (best is None or found[0] + order * depth < best[0]):
            best = found[0] + order * depth, order, residual, found
    verbatim = best is None or best[0] >= depth * len(x)
    out.put(0, 1)
    out.put(1 if verbatim else 8 | best[1], 6)
    out.put(1 if wasted else 0, 1)
    if wasted:
        out.unary(wasted - 1)
    if verbatim:
        for v in x.tolist():
            out.put(v, depth)
        return
    _, order, residual, (_, po, parameters) = best
    for v in x[:order].tolist():
        out.put(v, depth)
    out.put(0, 2)
    out.put(po, 4)
    size, at = len(x) >> po, 0
    values = residual.tolist()
    for i, k in enumerate(parameters):
        out.put(k, 4)
        n = size - (order if i == 0 else 0)
        for v in values[at : at + n]:
            u = 2 * v if v >= 0 else -2 * v - 1
            out.unary(u >> k)
            out.put(u, k)
        at += n


def utf8_number(value: int) -> bytes:
    if value < 128:
        return bytes([value])
    tail = []
    while value >= 1 << 6 - len(tail):
        tail.append(128 | value & 63)
        value >>= 6
    n = len(tail)
    return bytes([(0xFF << 7 - n & 255) | value, *reversed(tail)]) if n < 7 else bytes([0xFE, *reversed(tail)])


def encode_flac(samples: np.ndarray, rate: int, bits: int = 16, block: int = 4096, tags: Sequence[tuple[str, str]] = ()) -> bytes:
    """Samples of frames x channels; fixed predictors, the cheapest stereo pair, an MD5 of the samples."""
    samples = np.asarray(samples, np.int64).reshape(len(samples), -1)
    n, channels = samples.shape
    size = (bits + 7) // 8
    raw = samples.astype("<i8").reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    frames = []
    for number, a in enumerate(range(0, n, block)):
        part = samples[a : a + block]
        if channels == 2:
            left, right = part[:, 0], part[:, 1]
            mid, side = left + right >> 1, left - right
            modes = ((1, (left, bits), (right, bits)), (8, (left, bits), (side, bits + 1)), (9, (side, bits + 1), (right, bits)), (10, (mid, bits), (side, bits + 1)))
            cost = lambda x: rice_parameter(np.abs(np.diff(x, min(2, len(x) - 1))) * 2)[0]
            costs = {id(x): cost(x) for x in (left, right, mid, side)}
            mode, *parts = min(modes, key=lambda m: costs[id(m[1][0])] + costs[id(m[2][0])])
        else:
            mode, parts = channels - 1, [(part[:, c], bits) for c in range(channels)]
        head = bytes([0xFF, 0xF8, 7 << 4 | RATES.get(rate, 0), mode << 4 | DEPTHS.get(bits, 0) << 1]) + utf8_number(number) + struct.pack(">H", len(part) - 1)
        out = BitWriter()
        for x, depth in parts:
            _subframe(out, x, depth)
        body = head + bytes([crc8(head)]) + out.bytes()
        frames.append(body + struct.pack(">H", crc16(body)))
    small, large = (min(map(len, frames)), max(map(len, frames))) if frames else (0, 0)
    info = struct.pack(">HH", block, block) + small.to_bytes(3, "big") + large.to_bytes(3, "big")
    info += (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | n).to_bytes(8, "big") + hashlib.md5(raw).digest()
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    comment = text("framesift") + struct.pack("<I", len(tags)) + b"".join(text(f"{k}={v}") for k, v in tags)
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x84" + len(comment).to_bytes(3, "big") + comment + b"".join(frames)


def _read_residual(r: BitReader, block: int, order: int) -> list[int]:
    wide = 5 if r.get(2) else 4
    po = r.get(4)
    out: list[int] = []
    for i in range(1 << po):
        n = (block >> po) - (order if i == 0 else 0)
        k = r.get(wide)
        if k == (1 << wide) - 1:
            raw = r.get(5)
            out += [r.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            u = r.unary() << k | r.get(k)
            out.append(u >> 1 if not u & 1 else -(u + 1 >> 1))
    return out


def _read_subframe(r: BitReader, block: int, depth: int) -> np.ndarray:
    if r.get(1):
        raise Damaged("flac: a subframe begins with a set bit")
    kind = r.get(6)
    wasted = 0
    if r.get(1):
        wasted = r.unary() + 1
        depth -= wasted
    if kind == 0:
        out = np.full(block, r.signed(depth), np.int64)
    elif kind == 1:
        out = np.array([r.signed(depth) for _ in range(block)], np.int64)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = [r.signed(depth) for _ in range(order)]
        out = np.array(_read_residual(r, block, order), np.int64)
        # each running sum takes back one difference, from the last sample it follows
        for level in range(order - 1, -1, -1):
            first = np.diff(np.array(warm[: level + 1], np.int64), level)[-1] if level else warm[0]
            out = np.cumsum(np.concatenate([[first], out]))
    elif kind >= 32:
        order = kind - 31
        history = [r.signed(depth) for _ in range(order)]
        precision = r.get(4) + 1
        shift = r.signed(5)
        taps = [r.signed(precision) for _ in range(order)]
        for e in _read_residual(r, block, order):
            history.append(e + (sum(c * v for c, v in zip(taps, history[: -order - 1 : -1], strict=True)) >> shift))
        out = np.array(history, np.int64)
    else:
        raise Damaged(f"flac: subframe type {kind}")
    return out << wasted


def decode_flac(data: bytes) -> dict:
    """rate, channels, bits, samples (frames x channels), tags, md5_matches, bad_frames.

    A damaged frame becomes silence of a block's length; the decoder goes on at the next frame header.
    """
    if data[:4] != b"fLaC":
        raise Damaged("flac: no marker")
    at, last, info, tags = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise Damaged("flac: metadata is cut off")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "n": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 4:
            place = 4 + int.from_bytes(body[:4], "little")
            count = int.from_bytes(body[place : place + 4], "little")
            place += 4
            for _ in range(count):
                n = int.from_bytes(body[place : place + 4], "little")
                key, _, value = body[place + 4 : place + 4 + n].decode("utf-8", "replace").partition("=")
                tags.append((key, value))
                place += 4 + n
    if info is None:
        raise Damaged("flac: no stream information")
    blocks, bad = [], 0
    while at + 2 <= len(data):
        if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                break
            continue
        try:
            part, at = _read_frame(data, at, info)
            blocks.append(part)
        except Damaged:
            following = at + 2
            while (following := data.find(b"\xff", following)) >= 0:
                try:
                    _frame_head(data, following, info)
                    break
                except Damaged:
                    following += 1
            bad += 1
            blocks.append(np.zeros((info["block"], info["channels"]), np.int64))
            if following < 0:
                break
            at = following
    samples = np.concatenate(blocks) if blocks else np.zeros((0, info["channels"]), np.int64)
    if info["n"]:
        samples = samples[: info["n"]]
    size = (info["bits"] + 7) // 8
    raw = np.ascontiguousarray(samples).astype("<i8").reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
    known = any(info["md5"])
    return {"rate": info["rate"], "channels": info["channels"], "bits": info["bits"], "samples": samples, "tags": tags, "md5_checked": known, "md5_matches": known and hashlib.md5(raw).digest() == info["md5"], "bad_frames": bad}


def _frame_head(data: bytes, at: int, info: dict) -> tuple[int, int, int, int]:
    """(first byte behind the header, block size, channel mode, depth), its checksum verified."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise Damaged("flac: no frame header")
    size, rate, mode, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    first = data[at + 4]
    place = at + 5 + (0 if first < 128 else 8 - (first ^ 255).bit_length() - 1)
    if size in (6, 7):
        block = int.from_bytes(data[place : place + size - 5], "big") + 1
        place += size - 5
    else:
        block = 192 if size == 1 else 576 << size - 2 if 2 <= size <= 5 else 256 << size - 8 if size >= 8 else 0
    place += 1 if rate == 12 else 2 if rate in (13, 14) else 0
    if not block or mode > 10 or place >= len(data) or crc8(data[at:place]) != data[place]:
        raise Damaged("flac: a bad frame header")
    bits = {v: k for k, v in DEPTHS.items()}.get(depth, info["bits"])
    return place + 1, block, mode, bits


def frame_starts(data: bytes) -> list[int]:
    """Places of frames: every sync code whose whole header has a right checksum and whose frame can be read."""
    info = {"block": 0, "rate": 0, "channels": 2, "bits": 16}
    if data[:4] == b"fLaC":
        packed = int.from_bytes(data[18:26], "big")
        info = {"block": int.from_bytes(data[10:12], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1}
    out, at = [], 0
    while (at := data.find(b"\xff", at)) >= 0:
        try:
            at, found = _read_frame(data, at, info)[1], at
            out.append(found)
        except Damaged:
            at += 1
    return out


def _read_frame(data: bytes, at: int, info: dict) -> tuple[np.ndarray, int]:
    start, block, mode, bits = _frame_head(data, at, info)
    r = BitReader(data, start)
    extra = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(mode, (0,) * 8)
    parts = [_read_subframe(r, block, bits + extra[c]) for c in range(2 if mode >= 8 else mode + 1)]
    end = (r.at + 7) // 8
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise Damaged("flac: a frame checksum differs")
    if mode == 8:
        parts[1] = parts[0] - parts[1]
    elif mode == 9:
        parts[0] = parts[1] + parts[0]
    elif mode == 10:
        m2 = parts[0] << 1 | parts[1] & 1
        parts = [m2 + parts[1] >> 1, m2 - parts[1] >> 1]
    return np.stack(parts, axis=1), end + 2


# transforms


def sine_window(n: int) -> np.ndarray:
    return np.sin(np.pi * (np.arange(n) + 0.5) / n)


def vorbis_window(n: int) -> np.ndarray:
    return np.sin(np.pi / 2 * sine_window(n) ** 2)


def mdct_basis(half: int) -> np.ndarray:
    """half x 2 half: cosines of the modified discrete cosine transform."""
    k, n = np.arange(half)[:, None], np.arange(2 * half)[None]
    return np.cos(np.pi / half * (n + 0.5 + half / 2) * (k + 0.5))


def mdct(x: np.ndarray, half: int) -> np.ndarray:
    """Spectra of blocks of 2 half samples that begin every `half`, from a block before the first sample on."""
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + -len(x) % half)])
    blocks = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)[::half]
    return blocks * vorbis_window(2 * half) @ mdct_basis(half).T


def imdct(spectra: np.ndarray, half: int, n: int) -> np.ndarray:
    """Overlap-add of windowed inverse blocks, the first n samples."""
    blocks = spectra @ mdct_basis(half) * (2 / half) * vorbis_window(2 * half)
    out = np.zeros((len(blocks) + 1) * half)
    for i, b in enumerate(blocks):
        out[i * half : (i + 2) * half] += b
    return out[half : half + n]


def block_types(attacks: np.ndarray) -> np.ndarray:
    """0 long, 1 start, 2 short, 3 stop from the attacks of blocks and their neighbours."""
    a = np.asarray(attacks, bool)
    before, after = np.append(False, a[:-1]), np.append(a[1:], False)
    short = a | before & after
    return np.where(short, 2, np.where(np.append(short[1:], False), 1, np.where(np.append(False, short[:-1]), 3, 0)))


def levinson(r: Sequence[float], order: int) -> list[list[float]]:
    """Predictor coefficients of each order from the autocorrelation."""
    error, taps, out = float(r[0]), [], []
    for i in range(order):
        if error <= 0:
            break
        k = (r[i + 1] - sum(c * r[i - j] for j, c in enumerate(taps))) / error
        taps = [c - k * d for c, d in zip(taps, reversed(taps), strict=True)] + [k]
        error *= 1 - k * k
        out.append(taps)
    return out
