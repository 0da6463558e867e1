"""Prefix codes, bit streams with the low bit first, and the range coder of Opus."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from framesift.functions.codecs import Damaged


def code_lengths(counts: Sequence[int], most: int = 15) -> list[int]:
    """Lengths of an optimal prefix code; counts are levelled until no code is over `most` bits.

    A lone symbol has length 1. Ties go to the lower symbol.
    """
    used = [i for i, n in enumerate(counts) if n]
    out = [0] * len(counts)
    if len(used) < 2:
        for i in used:
            out[i] = 1
        return out
    floor = 0
    while True:
        heap = [(max(counts[i], floor), i, (i,)) for i in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in (*a[2], *b[2]):
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for i, d in depth.items():
                out[i] = d
            return out
        floor = max(1, 2 * floor)


def canonical(lengths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits, code), codes in order of length and symbol."""
    code, last, out = 0, 0, {}
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        last = length
        out[symbol] = (length, code)
        code += 1
    return out


class LowBitWriter:
    """Bits, the lowest first; prefix codes go in with their highest bit first."""

    def __init__(self):
        self.acc, self.have, self.out = 0, 0, bytearray()

    def put(self, value: int, bits: int) -> None:
        self.acc |= value << self.have
        self.have += bits
        while self.have >= 8:
            self.out.append(self.acc & 255)
            self.acc >>= 8
            self.have -= 8

    def code(self, bits: int, code: int) -> None:
        self.put(int(format(code, f"0{bits}b")[::-1], 2) if bits else 0, bits)

    def bytes(self) -> bytes:
        return bytes(self.out) + (bytes([self.acc]) if self.have else b"")


class LowBitReader:
    def __init__(self, data: bytes):
        self.bits, self.left = int.from_bytes(data, "little"), len(data) * 8
        self.window, self.kept = 0, 0

    def get(self, n: int) -> int:
        if n > self.kept:
            take = min(4096, self.left)
            self.window |= (self.bits & (1 << take) - 1) << self.kept
            self.bits >>= take
            self.left -= take
            self.kept += take
            if n > self.kept:
                raise Damaged("bits: cut off")
        value = self.window & (1 << n) - 1
        self.window >>= n
        self.kept -= n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        """The next symbol of a code given as (bits, code) -> symbol; a code of no bits has one symbol."""
        bits = code = 0
        while (found := table.get((bits, code))) is None:
            if bits == 15:
                raise Damaged("bits: a code is not in the table")
            code = code << 1 | self.get(1)
            bits += 1
        return found


def decoding_table(lengths: Sequence[int]) -> dict[tuple[int, int], int]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {(0, 0): used[0]}
    return {code: symbol for symbol, code in canonical(lengths).items()}


# the range coder of Opus: 32-bit state, bytes from the front, raw bits from the back

TOP, BOTTOM, SHIFT = 1 << 31, 1 << 23, 23


class RangeEncoder:
    """Symbols by cumulative counts, and raw bits at the end of the packet."""

    def __init__(self):
        self.low, self.range, self.held, self.waiting = 0, TOP, -1, 0
        self.out, self.raw, self.raw_bits = bytearray(), 0, 0

    def _carry(self, c: int) -> None:
        if c == 255:
            self.waiting += 1
            return
        carry = c >> 8
        if self.held >= 0:
            self.out.append(self.held + carry & 255)
        self.out += bytes([255 + carry & 255]) * self.waiting
        self.waiting, self.held = 0, c & 255

    def _normal(self) -> None:
        while self.range <= BOTTOM:
            self._carry(self.low >> SHIFT)
            self.low = self.low << 8 & TOP - 1
            self.range <<= 8

    def put(self, low: int, high: int, total: int) -> None:
        part = self.range // total
        if low:
            self.low += self.range - part * (total - low)
            self.range = part * (high - low)
        else:
            self.range -= part * (total - high)
        self._normal()

    def number(self, value: int, total: int) -> None:
        """A number below total, its bits past the eighth as raw bits."""
        bits = max(0, (total - 1).bit_length() - 8)
        self.put(value >> bits, (value >> bits) + 1, (total - 1 >> bits) + 1)
        if bits:
            self.raw |= (value & (1 << bits) - 1) << self.raw_bits
            self.raw_bits += bits

    def finish(self, size: int) -> bytes:
        bits = 31 - self.range.bit_length() + 1
        mask = (TOP - 1) >> bits
        end = self.low + mask & ~mask
        if end | mask >= self.low + self.range:
            bits += 1
            mask >>= 1
            end = self.low + mask & ~mask
        while bits > 0:
            self._carry(end >> SHIFT)
            end = end << 8 & TOP - 1
            bits -= 8
        if self.held >= 0 or self.waiting:
            self._carry(0)
        front = bytes(self.out)
        back = self.raw.to_bytes(-(-self.raw_bits // 8), "little")[::-1]
        if len(front) + len(back) > size:
            raise Damaged("range coder: the packet is too small")
        return front + bytes(size - len(front) - len(back)) + back


class RangeDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.raw_at = data, 0, 0
        self.rest = self._byte()
        self.range = 1 << 7
        self.value = self.range - 1 - (self.rest >> 1)
        self._normal()

    def _byte(self) -> int:
        b = self.data[self.at] if self.at < len(self.data) else 0
        self.at += 1
        return b

    def _normal(self) -> None:
        while self.range <= BOTTOM:
            self.range <<= 8
            symbol = self.rest
            self.rest = self._byte()
            symbol = (symbol << 8 | self.rest) >> 1
            self.value = (self.value << 8) + (255 & ~symbol) & TOP - 1

    def get(self, cumulative: Sequence[int]) -> int:
        """The symbol i with cumulative[i] <= v < cumulative[i + 1]."""
        total = cumulative[-1]
        part = self.range // total
        v = total - min(self.value // part + 1, total)
        i = next(i for i in range(len(cumulative) - 1) if cumulative[i] <= v < cumulative[i + 1])
        self._take(cumulative[i], cumulative[i + 1], total, part)
        return i

    def _take(self, low: int, high: int, total: int, part: int) -> None:
        skip = part * (total - high)
        self.value -= skip
        self.range = part * (high - low) if low else self.range - skip
        self._normal()

    def number(self, total: int) -> int:
        bits = max(0, (total - 1).bit_length() - 8)
        size = (total - 1 >> bits) + 1
        part = self.range // size
        v = size - min(self.value // part + 1, size)
        self._take(v, v + 1, size, part)
        v <<= bits
        for i in range(bits):
            byte = len(self.data) - 1 - (self.raw_at >> 3)
            v |= (self.data[byte] >> (self.raw_at & 7) & 1 if byte >= 0 else 0) << i
            self.raw_at += 1
        return v
