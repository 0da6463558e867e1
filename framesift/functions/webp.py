"""Lossless WebP pictures (VP8L): a full decoder, and an encoder without back references."""

from __future__ import annotations

import struct

import numpy as np

from framesift.functions.codecs import Damaged
from framesift.functions.entropy import LowBitReader, LowBitWriter, canonical, code_lengths, decoding_table
from framesift.sources.containers import riff_chunks

# fixed values of the format: the order in which lengths of the length code are sent
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
#: short distances name places near a pixel, the closest first: left of it in its row, and all of the rows above
NEAR = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


def _prefix_code(r: LowBitReader, size: int) -> dict:
    if r.get(1):
        two = r.get(1)
        symbols = [r.get(8 if r.get(1) else 1)]
        if two:
            symbols.append(r.get(8))
        lengths = [0] * max(size, 256)
        for s in symbols:
            lengths[s] = 1
        return decoding_table(lengths)
    sent = [0] * 19
    for i in range(r.get(4) + 4):
        sent[LENGTH_ORDER[i]] = r.get(3)
    table = decoding_table(sent)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else size
    lengths, last = [], 8
    while len(lengths) < size and left:
        left -= 1
        s = r.symbol(table)
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            lengths += [last] * (3 + r.get(2)) if s == 16 else [0] * (3 + r.get(3) if s == 17 else 11 + r.get(7))
    if len(lengths) > size:
        raise Damaged("webp: too many code lengths")
    return decoding_table(lengths + [0] * (size - len(lengths)))


def _extra(r: LowBitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    bits = prefix - 2 >> 1
    return (2 + (prefix & 1) << bits) + r.get(bits) + 1


def _pixels(r: LowBitReader, width: int, height: int, main: bool) -> list[int]:
    """One entropy-coded picture of packed ARGB values."""
    bits = r.get(4) if r.get(1) else 0
    if bits > 11:
        raise Damaged("webp: a colour cache that is too large")
    cache = [0] * (1 << bits) if bits else []
    tile, groups, which = 0, 1, []
    if main and r.get(1):
        tile = r.get(3) + 2
        which = [p >> 8 & 0xFFFF for p in _pixels(r, -(-width // (1 << tile)), -(-height // (1 << tile)), False)]
        groups = max(which) + 1
    codes = [[_prefix_code(r, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    across = -(-width // (1 << tile)) if tile else 1
    out: list[int] = []
    n, filled = width * height, 0

    def fill() -> None:
        nonlocal filled
        for p in out[filled:]:
            cache[(HASH * p & 0xFFFFFFFF) >> 32 - bits] = p
        filled = len(out)

    while len(out) < n:
        at = len(out)
        green, red, blue, alpha, distance = codes[which[(at // width >> tile) * across + (at % width >> tile)] if tile else 0]
        s = r.symbol(green)
        if s < 256:
            a = r.symbol(red) << 16 | s << 8
            b = r.symbol(blue)
            out.append(r.symbol(alpha) << 24 | a | b)
        elif s < 280:
            length = _extra(r, s - 256)
            d = _extra(r, r.symbol(distance))
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > n:
                raise Damaged("webp: a copy reaches outside the picture")
            for _ in range(length):
                out.append(out[-d])
        else:
            if s - 280 >= len(cache):
                raise Damaged("webp: a colour that is not in the cache")
            fill()
            out.append(cache[s - 280])
        if bits and s < 280:
            fill()
    return out


def _channels(values: list[int], width: int) -> np.ndarray:
    """height x width x 4 in the order alpha, red, green, blue."""
    return np.array(values, ">u4").view(np.uint8).reshape(-1, width, 4).astype(np.int64)


def _unpredict(p: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = p.shape[:2]
    flat = [tuple(int(c) for c in v) for v in p.reshape(-1, 4)]
    half = lambda a, b: tuple(x + y >> 1 for x, y in zip(a, b, strict=True))
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    for i in range(h * w):
        y, x = divmod(i, w)
        if i == 0:
            guess = (255, 0, 0, 0)
        elif y == 0:
            guess = flat[i - 1]
        elif x == 0:
            guess = flat[i - w]
        else:
            mode = modes[y >> bits][x >> bits]
            left, top, corner, right = flat[i - 1], flat[i - w], flat[i - w - 1], flat[i - w + 1]
            if mode == 0 or mode > 13:
                guess = (255, 0, 0, 0)
            elif mode <= 4:
                guess = (left, top, right, corner)[mode - 1]
            elif mode == 5:
                guess = half(half(left, right), top)
            elif mode <= 9:
                guess = half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
            elif mode == 10:
                guess = half(half(left, corner), half(top, right))
            elif mode == 11:
                from_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
                from_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
                guess = left if from_left < from_top else top
            elif mode == 12:
                guess = tuple(clip(a + t - c) for a, t, c in zip(left, top, corner, strict=True))
            else:
                mean = half(left, top)
                guess = tuple(clip(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True))
        flat[i] = tuple(a + b & 255 for a, b in zip(flat[i], guess, strict=True))
    return np.array(flat, np.int64).reshape(h, w, 4)


def decode_vp8l(data: bytes) -> np.ndarray:
    """The RGBA picture of a VP8L chunk."""
    if len(data) < 5 or data[0] != 0x2F:
        raise Damaged("webp: no lossless signature")
    r = LowBitReader(data[1:])
    width, height = r.get(14) + 1, r.get(14) + 1
    has_alpha = r.get(1)
    if r.get(3):
        raise Damaged("webp: an unknown version")
    steps, w = [], width
    while r.get(1):
        kind = r.get(2)
        if kind in [s[0] for s in steps]:
            raise Damaged("webp: a transform comes twice")
        if kind == 2:
            steps.append((2, 0, None, w))
        elif kind == 3:
            n = r.get(8) + 1
            table = np.cumsum(_channels(_pixels(r, n, 1, False), n)[0], axis=0) & 255
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((3, bits, table, w))
            w = -(-w // (1 << bits))
        else:
            bits = r.get(3) + 2
            across = -(-w // (1 << bits))
            steps.append((kind, bits, _channels(_pixels(r, across, -(-height // (1 << bits)), False), across), w))
    p = _channels(_pixels(r, w, height, True), w)
    for kind, bits, extra, w in reversed(steps):
        if kind == 0:
            p = _unpredict(p, extra[..., 2].tolist(), bits)
        elif kind == 2:
            p[..., 1] += p[..., 2]
            p[..., 3] += p[..., 2]
            p &= 255
        elif kind == 1:
            m = np.repeat(np.repeat(extra, 1 << bits, axis=0), 1 << bits, axis=1)[: p.shape[0], : p.shape[1]]
            m = np.where(m > 127, m - 256, m)
            signed = lambda c: np.where(c > 127, c - 256, c)
            green = signed(p[..., 2])
            p[..., 1] = p[..., 1] + (m[..., 3] * green >> 5) & 255
            p[..., 3] = p[..., 3] + (m[..., 2] * green >> 5) + (m[..., 1] * signed(p[..., 1]) >> 5) & 255
        else:
            index = p[..., 2]
            if bits:
                each = 8 >> bits
                parts = index[..., None] >> each * np.arange(1 << bits) & (1 << each) - 1
                index = parts.reshape(index.shape[0], -1)[:, :w]
            whole = np.zeros((256, 4), np.int64)
            whole[: len(extra)] = extra
            p = whole[index]
    out = p[..., [1, 2, 3, 0]].astype(np.uint8)
    if not has_alpha:
        out[..., 3] = 255
    return out


def decode_webp(data: bytes) -> np.ndarray:
    for c in riff_chunks(data):
        if c["kind"] == "VP8L":
            return decode_vp8l(c["data"])
    raise Damaged("webp: no lossless picture")


def _write_code(out: LowBitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    counts = [0] * 19
    for n in lengths:
        counts[n] += 1
    own = code_lengths(counts, 7)
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(own[s], 3)
    out.put(0, 1)
    table = canonical(own)
    single = sum(n > 0 for n in own) == 1
    for n in lengths:
        if not single:
            out.code(*table[n])


def encode_webp(pixels: np.ndarray) -> bytes:
    """A lossless WebP file: green subtracted, left prediction by tiles, one prefix code a channel."""
    h, w = pixels.shape[:2]
    p = pixels[..., [3, 0, 1, 2]].astype(np.int64)
    opaque = bool((p[..., 0] == 255).all())
    p[..., 1] -= p[..., 2]
    p[..., 3] -= p[..., 2]
    p &= 255
    guess = np.zeros_like(p)
    guess[:, 1:] = p[:, :-1]
    guess[1:, 0] = p[:-1, 0]
    guess[0, 0] = (255, 0, 0, 0)
    p = p - guess & 255
    out = LowBitWriter()
    for value, bits in ((w - 1, 14), (h - 1, 14), (int(not opaque), 1), (0, 3), (1, 1), (2, 2), (1, 1), (0, 2), (7, 3)):
        out.put(value, bits)
    # the modes are one picture of equal values: left everywhere
    out.put(0, 1)
    for symbol in (1, 0, 0, 0, 0):
        out.put(0b101, 3)
        out.put(symbol, 8)
    out.put(0, 3)
    counts = [np.bincount(p[..., c].ravel(), minlength=n).tolist() for c, n in ((2, 280), (1, 256), (3, 256), (0, 256))]
    lengths = [code_lengths(c) for c in counts]
    for one in (*lengths, [0] * 40):
        _write_code(out, one)
    tables = [canonical(n) if sum(x > 0 for x in n) > 1 else None for n in lengths]
    for a, r, g, b in p.reshape(-1, 4).tolist():
        for table, value in zip(tables, (g, r, b, a), strict=True):
            if table:
                out.code(*table[value])
    body = b"\x2f" + out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
