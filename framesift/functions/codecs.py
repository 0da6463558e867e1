"""Byte codecs of one value at a time; framesift.functions.udfs makes Arrow functions of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash


class Damaged(ValueError):
    """A stream that its format does not allow; the text names the reason."""


# deflate


def deflate(data: bytes, level: int = 6, huffman_only: bool = False) -> bytes:
    """A raw deflate stream."""
    maker = zlib.compressobj(level, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY if huffman_only else zlib.Z_DEFAULT_STRATEGY)
    return maker.compress(data) + maker.flush()


def inflate(data: bytes, most: int = 1 << 31) -> bytes:
    reader = zlib.decompressobj(-15)
    try:
        out = reader.decompress(data, most)
    except zlib.error as error:
        raise Damaged(f"deflate: {error}") from None
    if not reader.eof:
        raise Damaged("deflate: the stream does not end")
    return out


def deflate_blocks(data: bytes, size: int = 1 << 16, level: int = 6) -> list[bytes]:
    """Independent pieces that form one stream when joined: all but the last end on a byte boundary without a final block."""
    parts = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
    out = []
    for i, part in enumerate(parts):
        maker = zlib.compressobj(level, zlib.DEFLATED, -15)
        out.append(maker.compress(part) + maker.flush(zlib.Z_FINISH if i == len(parts) - 1 else zlib.Z_FULL_FLUSH))
    return out


# CRC-32C and Snappy

CRC32C_POLYNOMIAL = 0x82F63B78


def reflected_table(polynomial: int) -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (polynomial if byte & 1 else 0)
        out.append(byte)
    return out


CRC32C = reflected_table(CRC32C_POLYNOMIAL)


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = CRC32C[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def masked_crc32c(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


SNAPPY = pa.Codec("snappy")
SNAPPY_HEAD = b"\xff\x06\x00\x00sNaPpY"
SNAPPY_BLOCK = 65536


def snappy_size(data: bytes) -> int:
    size = 0
    for i, b in enumerate(data[:5]):
        size |= (b & 127) << 7 * i
        if b < 128:
            return size
    raise Damaged("snappy: the length does not end")


def snappy(data: bytes) -> bytes:
    return SNAPPY.compress(data, asbytes=True)


def unsnappy(data: bytes) -> bytes:
    try:
        return SNAPPY.decompress(data, decompressed_size=snappy_size(data), asbytes=True)
    except OSError as error:
        raise Damaged(f"snappy: {error}") from None


def snappy_framed(data: bytes) -> bytes:
    """The framing format: chunks of at most 64 KiB with masked checksums, stored where they don't shrink."""
    out = [SNAPPY_HEAD]
    for i in range(0, len(data), SNAPPY_BLOCK):
        block = data[i : i + SNAPPY_BLOCK]
        small = snappy(block)
        kind, body = (0, small) if len(small) < len(block) - len(block) // 8 else (1, block)
        out.append(bytes([kind]) + (len(body) + 4).to_bytes(3, "little") + masked_crc32c(block).to_bytes(4, "little") + body)
    return b"".join(out)


def snappy_unframed(data: bytes) -> bytes:
    if data[: len(SNAPPY_HEAD)] != SNAPPY_HEAD:
        raise Damaged("snappy: no stream identifier")
    out, at = [], len(SNAPPY_HEAD)
    while at < len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size:
            raise Damaged("snappy: a chunk is cut off")
        if kind in (0, 1):
            block = unsnappy(body[4:]) if kind == 0 else body[4:]
            if masked_crc32c(block) != int.from_bytes(body[:4], "little"):
                raise Damaged("snappy: a checksum differs")
            out.append(block)
        elif kind < 0x80:
            raise Damaged(f"snappy: chunk type {kind} may not be skipped")
    return b"".join(out)


# LZ4 frames

LZ4 = pa.Codec("lz4")
LZ4_MAGIC = 0x184D2204


def lz4(data: bytes) -> bytes:
    """One LZ4 frame."""
    return LZ4.compress(data, asbytes=True)


def lz4_blocks(data: bytes, size: int = 65536) -> bytes:
    """A frame of independent blocks with content size and checksum, written field by field."""
    flags = 0b01101100  # version 1, independent blocks, content size, content checksum
    head = bytes([flags, 4 << 4]) + len(data).to_bytes(8, "little")
    out = [LZ4_MAGIC.to_bytes(4, "little"), head, bytes([xxhash.xxh32_intdigest(head) >> 8 & 255])]
    raw = pa.Codec("lz4_raw")
    for i in range(0, len(data), size):
        block = data[i : i + size]
        small = raw.compress(block, asbytes=True)
        out += [len(small).to_bytes(4, "little"), small] if len(small) < len(block) else [(len(block) | 1 << 31).to_bytes(4, "little"), block]
    return b"".join([*out, bytes(4), xxhash.xxh32_intdigest(data).to_bytes(4, "little")])


def lz4_block(data: bytes, before: bytes = b"") -> bytes:
    """Bytes of one LZ4 block whose matches may reach into `before`."""
    out, at, n = bytearray(before), 0, len(data)
    try:
        while at < n:
            token = data[at]
            at += 1
            size = token >> 4
            if size == 15:
                while data[at] == 255:
                    size += 255
                    at += 1
                size += data[at]
                at += 1
            if at + size > n:
                raise Damaged("lz4: literals are cut off")
            out += data[at : at + size]
            at += size
            if at == n:
                break
            distance = data[at] | data[at + 1] << 8
            at += 2
            size = token & 15
            if size == 15:
                while data[at] == 255:
                    size += 255
                    at += 1
                size += data[at]
                at += 1
            size += 4
            if not 0 < distance <= len(out):
                raise Damaged("lz4: a match begins before the data")
            start = len(out) - distance
            while size:
                piece = out[start : start + min(size, len(out) - start)]
                out += piece
                size -= len(piece)
    except IndexError:
        raise Damaged("lz4: a block is cut off") from None
    return bytes(out[len(before) :])


def unlz4(data: bytes) -> bytes:
    """All frames of data, their checksums verified; skippable frames are skipped."""
    out, at = [], 0
    while at < len(data):
        if at + 7 > len(data):
            raise Damaged("lz4: a frame is cut off")
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & ~15 == 0x184D2A50:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        if magic != LZ4_MAGIC:
            raise Damaged("lz4: no frame")
        flags, first = data[at + 4], at + 4
        if flags >> 6 != 1:
            raise Damaged("lz4: unknown version")
        at += 6 + 8 * (flags >> 3 & 1) + 4 * (flags & 1)
        if xxhash.xxh32_intdigest(data[first:at]) >> 8 & 255 != data[at]:
            raise Damaged("lz4: the header checksum differs")
        size = int.from_bytes(data[first + 2 : first + 10], "little") if flags & 8 else None
        at += 1
        body = bytearray()
        while True:
            n = int.from_bytes(data[at : at + 4], "little")
            at += 4
            if n == 0:
                break
            block = data[at : at + (n & 0x7FFFFFFF)]
            at += n & 0x7FFFFFFF
            if len(block) < n & 0x7FFFFFFF:
                raise Damaged("lz4: a block is cut off")
            if flags & 16:
                if xxhash.xxh32_intdigest(block) != int.from_bytes(data[at : at + 4], "little"):
                    raise Damaged("lz4: a block checksum differs")
                at += 4
            body += block if n >> 31 else lz4_block(block, b"" if flags & 32 else bytes(body[-65536:]))
        if flags & 4:
            if xxhash.xxh32_intdigest(bytes(body)) != int.from_bytes(data[at : at + 4], "little"):
                raise Damaged("lz4: the content checksum differs")
            at += 4
        if size is not None and size != len(body):
            raise Damaged("lz4: the content size differs")
        out.append(bytes(body))
    return b"".join(out)


# LZW as in GIF


def lzw(data: bytes, bits: int = 8) -> bytes:
    """Codes of growing width, low bits first, with a clear code in front and an end code behind."""
    clear = 1 << bits
    acc = have = 0
    out = bytearray()
    table: dict[tuple[int, int], int] = {}
    free, width = clear + 2, bits + 1

    def put(code: int) -> None:
        nonlocal acc, have
        acc |= code << have
        have += width
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8

    put(clear)
    prefix = -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        known = table.get((prefix, b))
        if known is not None:
            prefix = known
            continue
        put(prefix)
        if free < 4096:
            table[prefix, b] = free
            if free == 1 << width:
                width += 1
            free += 1
        else:
            put(clear)
            table.clear()
            free, width = clear + 2, bits + 1
        prefix = b
    if prefix >= 0:
        put(prefix)
        if free == 1 << width and width < 12:
            width += 1
    put(clear + 1)
    if have:
        out.append(acc & 255)
    return bytes(out)


def unlzw(data: bytes, bits: int = 8, most: int = 1 << 31) -> bytes:
    clear = 1 << bits
    words = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, width, acc, have, last = [], bits + 1, 0, 0, None
    size = 0
    for b in data:
        acc |= b << have
        have += 8
        while have >= width:
            code = acc & (1 << width) - 1
            acc >>= width
            have -= width
            if code == clear:
                words = words[: clear + 2]
                width, last = bits + 1, None
                continue
            if code == clear + 1:
                return b"".join(out)
            if code < len(words):
                word = words[code]
            elif code == len(words) and last is not None:
                word = last + last[:1]
            else:
                raise Damaged("lzw: a code is not in the table")
            if last is not None and len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == 1 << width and width < 12:
                    width += 1
            out.append(word)
            size += len(word)
            if size > most:
                raise Damaged("lzw: more data than the picture has")
            last = word
    raise Damaged("lzw: no end code")


# boolean arithmetic coder of VP8 and VP9


class BoolEncoder:
    """Writes bits with probabilities of 1 to 255 for a zero."""

    def __init__(self):
        self.low, self.range, self.count, self.out = 0, 255, -24, bytearray()

    def put(self, bit: int, prob: int = 128) -> None:
        split = 1 + ((self.range - 1) * prob >> 8)
        if bit:
            self.low += split
            self.range -= split
        else:
            self.range = split
        shift = 8 - self.range.bit_length()
        self.range <<= shift
        for _ in range(shift):
            self.low <<= 1
            self.count += 1
            if self.count == 0:
                self._byte()

    def _byte(self) -> None:
        # 32 bits are held: a carry, a byte, and 24 bits that may still change
        if self.low >> 32:
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        self.out.append(self.low >> 24 & 255)
        self.low &= 0xFFFFFF
        self.count = -8

    def literal(self, value: int, bits: int) -> None:
        for i in reversed(range(bits)):
            self.put(value >> i & 1)

    def finish(self) -> bytes:
        for _ in range(32):
            self.put(0)
        return bytes(self.out)


class BoolDecoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.range, self.bits = data, 2, 255, 0
        self.value = int.from_bytes(data[:2].ljust(2, b"\0"), "big")

    def get(self, prob: int = 128) -> int:
        split = 1 + ((self.range - 1) * prob >> 8)
        bit = self.value >= split << 8
        if bit:
            self.value -= split << 8
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range <<= 1
            self.value <<= 1
            self.bits += 1
            if self.bits == 8:
                self.value |= self.data[self.at] if self.at < len(self.data) else 0
                self.at += 1
                self.bits = 0
        return int(bit)

    def literal(self, bits: int) -> int:
        out = 0
        for _ in range(bits):
            out = out << 1 | self.get()
        return out


def bool_code(data: bytes, prob: int = 120) -> bytes:
    """The bits of data through the coder, their number in front."""
    maker = BoolEncoder()
    for b in data:
        for i in range(7, -1, -1):
            maker.put(b >> i & 1, prob)
    return len(data).to_bytes(4, "little") + maker.finish()


def bool_decode(data: bytes, prob: int = 120) -> bytes:
    reader = BoolDecoder(data[4:])
    return bytes(sum(reader.get(prob) << i for i in range(7, -1, -1)) for _ in range(int.from_bytes(data[:4], "little")))


# byte planes


def shuffle(data: bytes, element: int) -> bytes:
    """out[j n + i] = in[i E + j]; a trailing partial element stays."""
    n = len(data) // element
    whole = np.frombuffer(data, np.uint8, n * element).reshape(n, element)
    return whole.T.tobytes() + data[n * element :]


def unshuffle(data: bytes, element: int) -> bytes:
    n = len(data) // element
    whole = np.frombuffer(data, np.uint8, n * element).reshape(element, n)
    return whole.T.tobytes() + data[n * element :]


def bitshuffle(data: bytes, element: int) -> bytes:
    """Bit planes of groups of whole elements, a multiple of eight; the rest stays."""
    n = len(data) // element // 8 * 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * element), bitorder="little").reshape(n, element * 8)
    return np.packbits(bits.T, bitorder="little").tobytes() + data[n * element :]


def bitunshuffle(data: bytes, element: int) -> bytes:
    n = len(data) // element // 8 * 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * element), bitorder="little").reshape(element * 8, n)
    return np.packbits(bits.T, bitorder="little").tobytes() + data[n * element :]


PLANE_CHUNK = 1 << 16


def weightpack(data: bytes, element: int = 2) -> bytes:
    """Byte planes in chunks of entropy-coded deflate without matches, behind a table of their sizes.

    A chunk that does not shrink is stored, which the top bit of its size says.
    """
    n = len(data) // element * element
    planes = shuffle(data[:n], element)
    chunks = []
    for i in range(0, n, PLANE_CHUNK):
        part = planes[i : i + PLANE_CHUNK]
        small = deflate(part, huffman_only=True)
        chunks.append((len(small), small) if len(small) < len(part) else (len(part) | 1 << 31, part))
    head = struct.pack("<4sIQI", b"PLN1", element, len(data), len(chunks)) + b"".join(struct.pack("<I", s) for s, _ in chunks)
    return head + b"".join(c for _, c in chunks) + data[n:]


def weightunpack(data: bytes) -> bytes:
    try:
        magic, element, size, number = struct.unpack_from("<4sIQI", data)
        sizes = struct.unpack_from(f"<{number}I", data, 20)
    except struct.error:
        raise Damaged("planes: the table is cut off") from None
    if magic != b"PLN1":
        raise Damaged("planes: no magic number")
    at, out = 20 + 4 * number, []
    for s in sizes:
        part = data[at : at + (s & 0x7FFFFFFF)]
        out.append(part if s >> 31 else inflate(part))
        at += s & 0x7FFFFFFF
    whole = unshuffle(b"".join(out), element) + data[at:]
    if len(whole) != size:
        raise Damaged("planes: the size differs")
    return whole


# checksums without a built-in


def forward_crc(data: bytes, polynomial: int, bits: int, start: int = 0) -> int:
    """A CRC of 8 bits or more whose highest bit comes first."""
    table, top, mask = [], 1 << bits - 1, (1 << bits) - 1
    for byte in range(256):
        crc = byte << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ (polynomial if crc & top else 0)) & mask
        table.append(crc)
    crc = start
    for b in data:
        crc = (crc << 8 ^ table[(crc >> bits - 8 ^ b) & 255]) & mask
    return crc


def crc8(data: bytes) -> int:
    return forward_crc(data, 0x07, 8)


def crc16(data: bytes) -> int:
    return forward_crc(data, 0x8005, 16)


_ogg: list[int] = []


def ogg_crc(data: bytes) -> int:
    """CRC-32 of Ogg pages: polynomial 04C11DB7, highest bit first, zero at start, no final inversion."""
    if not _ogg:
        for byte in range(256):
            crc = byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
            _ogg.append(crc)
    crc = 0
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _ogg[crc >> 24 ^ b]
    return crc


def xxh32(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh32_intdigest(data, seed)
