"""Container writers: IVF, Ogg, WebM, ISO-BMFF, WAV and AIFF files from packets or samples."""

from __future__ import annotations

import struct
from collections.abc import Sequence

from framesift.functions.codecs import ogg_crc


def ivf(frames: Sequence[tuple[int, bytes]], codec: str = "VP80", width: int = 0, height: int = 0, rate: int = 30, scale: int = 1) -> bytes:
    """A file of (pts, payload) frames."""
    head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, codec.encode("latin-1"), width, height, rate, scale, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(d), p) + d for p, d in frames)


def ogg(packets: Sequence[bytes], serial: int, granules: Sequence[int] | None = None, most: int = 255) -> bytes:
    """One logical stream; a page closes at `most` segments, so a long packet continues on the next."""
    granules = granules or list(range(len(packets)))
    segments: list[tuple[int, bytes, int]] = []
    for packet, granule in zip(packets, granules, strict=True):
        sizes = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for i, size in enumerate(sizes):
            segments.append((size, packet[at : at + size], granule if i == len(sizes) - 1 else -1))
            at += size
    out, number, continued = [], 0, False
    for start in range(0, len(segments), most) or [0]:
        part = segments[start : start + most]
        ends = [g for size, _, g in part if size < 255]
        flags = continued | 2 * (number == 0) | 4 * (start + most >= len(segments))
        head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, ends[-1] if ends else -1, serial, number, 0, len(part)) + bytes(s for s, _, _ in part)
        page = head + b"".join(d for _, d, _ in part)
        out.append(page[:22] + ogg_crc(page).to_bytes(4, "little") + page[26:])
        number, continued = number + 1, bool(part) and part[-1][0] == 255
    return b"".join(out)


def opus_headers(channels: int, pre_skip: int, rate: int, vendor: str = "framesift", tags: Sequence[str] = ()) -> list[bytes]:
    """The two header packets of an Ogg Opus stream."""
    head = struct.pack("<8sBBHIhB", b"OpusHead", 1, channels, pre_skip, rate, 0, 0)
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    return [head, b"OpusTags" + text(vendor) + struct.pack("<I", len(tags)) + b"".join(map(text, tags))]


def vint(value: int, size: int | None = None) -> bytes:
    """An EBML size in the fewest bytes, or in `size` of them."""
    size = size or max(1, -(-(value + 1).bit_length() // 7))
    return (value | 1 << 7 * size).to_bytes(size, "big")


def element(number: int, body: bytes | int | str | float) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, -(-body.bit_length() // 8)), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return number.to_bytes(-(-number.bit_length() // 8), "big") + vint(len(body)) + body


def webm(tracks: Sequence[dict], packets: Sequence[dict], most_ms: int = 5000, most_bytes: int = 5 << 20, least_key_bytes: int = 4096) -> bytes:
    """A file of tracks (track, type, codec, optional width, height, rate, channels, private) and packets in file order.

    A cluster ends at a time or size limit, or before a video key frame once it holds least_key_bytes.
    """
    head = element(0x1A45DFA3, b"".join([element(0x4286, 1), element(0x42F7, 1), element(0x42F2, 4), element(0x42F3, 8), element(0x4282, "webm"), element(0x4287, 4), element(0x4285, 2)]))
    info = element(0x1549A966, element(0x2AD7B1, 1_000_000) + element(0x4D80, "framesift") + element(0x5741, "framesift"))
    entries = []
    for t in tracks:
        body = element(0xD7, t["track"]) + element(0x73C5, t["track"]) + element(0x83, t["type"]) + element(0x86, t["codec"])
        if t.get("private"):
            body += element(0x63A2, t["private"])
        if t["type"] == 1:
            body += element(0xE0, element(0xB0, t.get("width", 0)) + element(0xBA, t.get("height", 0)))
        else:
            body += element(0xE1, element(0xB5, float(t.get("rate", 48000))) + element(0x9F, t.get("channels", 1)))
        entries.append(element(0xAE, body))
    video = {t["track"] for t in tracks if t["type"] == 1}
    clusters, blocks, size, base = [], [], 0, None

    def close() -> None:
        if blocks:
            clusters.append(element(0x1F43B675, element(0xE7, base) + b"".join(blocks)))

    for p in packets:
        late = base is not None and (p["pts"] - base >= most_ms or p["pts"] < base)
        if base is None or late or size >= most_bytes or p["track"] in video and p["key"] and size >= least_key_bytes:
            close()
            blocks, size, base = [], 0, p["pts"]
        blocks.append(element(0xA3, vint(p["track"]) + struct.pack(">hB", p["pts"] - base, 128 * bool(p["key"])) + p["data"]))
        size += len(p["data"])
    close()
    return head + element(0x18538067, info + element(0x1654AE6B, b"".join(entries)) + b"".join(clusters))


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode("latin-1")) + body


def full_box(kind: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def runs(values: Sequence[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [(n, v) for n, v in out]


def mp4(tracks: Sequence[dict], packets: Sequence[dict]) -> bytes:
    """A progressive file: packets are in file order, a chunk is a run of one track, sample tables are aggregates.

    tracks: track, type (1 video, 2 audio), codec (four letters), timescale, width, height, channels, rate.
    packets: track, dts, duration, key, data.
    """
    ftyp = box("ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    media, chunks = bytearray(), {t["track"]: [] for t in tracks}
    last = None
    for p in packets:
        if p["track"] != last:
            chunks[p["track"]].append([len(media), 0])
            last = p["track"]
        chunks[p["track"]][-1][1] += 1
        media += p["data"]
    start = len(ftyp) + 8
    matrix = struct.pack(">9I", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
    traks, longest = [], 0
    for t in tracks:
        own = [p for p in packets if p["track"] == t["track"]]
        length = sum(p["duration"] for p in own)
        longest = max(longest, length * 1000 // t["timescale"])
        if t["type"] == 1:
            entry = box(t["codec"], bytes(6), struct.pack(">H16xHHIIIH32xHh", 1, t.get("width", 0), t.get("height", 0), 72 << 16, 72 << 16, 0, 1, 24, -1))
            media_header, handler = full_box("vmhd", bytes(8), flags=1), b"vide"
        else:
            entry = box(t["codec"], bytes(6), struct.pack(">H8xHHIHH", 1, t.get("channels", 1), 16, 0, 0, 0)[:-2] + struct.pack(">I", t.get("rate", 48000) << 16)[:2] + bytes(2))
            media_header, handler = full_box("smhd", bytes(4)), b"soun"
        table = [
            full_box("stsd", struct.pack(">I", 1), entry),
            full_box("stts", struct.pack(">I", len(r := runs([p["duration"] for p in own]))), *(struct.pack(">II", *x) for x in r)),
            full_box("stsz", struct.pack(">II", 0, len(own)), *(struct.pack(">I", len(p["data"])) for p in own)),
        ]
        counts, first = [], 1
        for n, per in runs([c[1] for c in chunks[t["track"]]]):
            counts.append((first, per, 1))
            first += n
        table.append(full_box("stsc", struct.pack(">I", len(counts)), *(struct.pack(">III", *x) for x in counts)))
        table.append(full_box("co64", struct.pack(">I", len(chunks[t["track"]])), *(struct.pack(">Q", start + c[0]) for c in chunks[t["track"]])))
        keys = [i for i, p in enumerate(own, 1) if p["key"]]
        if len(keys) < len(own):
            table.append(full_box("stss", struct.pack(">I", len(keys)), *(struct.pack(">I", k) for k in keys)))
        dinf = box("dinf", full_box("dref", struct.pack(">I", 1), full_box("url ", flags=1)))
        mdia = box(
            "mdia",
            full_box("mdhd", struct.pack(">IIIIHH", 0, 0, t["timescale"], length, 0x55C4, 0)),
            full_box("hdlr", bytes(4), handler, bytes(12), b"track\0"),
            box("minf", media_header, dinf, box("stbl", *table)),
        )
        size = struct.pack(">II", t.get("width", 0) << 16, t.get("height", 0) << 16)
        tkhd = full_box("tkhd", struct.pack(">IIIII8xHHHH", 0, 0, t["track"], 0, length * 1000 // t["timescale"], 0, 0, 256 * (t["type"] == 2), 0), matrix, size, flags=7)
        traks.append(box("trak", tkhd, mdia))
    mvhd = full_box("mvhd", struct.pack(">IIIIIH10x", 0, 0, 1000, longest, 65536, 256), matrix, bytes(24), struct.pack(">I", len(tracks) + 1))
    return ftyp + box("mdat", bytes(media)) + box("moov", mvhd, *traks)


def wav(samples: Sequence[int], rate: int, channels: int = 1, bits: int = 16) -> bytes:
    size = bits // 8
    body = bytes(s + 128 for s in samples) if bits == 8 else b"".join(int(s).to_bytes(size, "little", signed=True) for s in samples)
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * size, channels * size, bits)
    parts = b"WAVE" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


def aiff(samples: Sequence[int], rate: int, channels: int = 1, bits: int = 16) -> bytes:
    size = bits // 8
    body = b"".join(int(s).to_bytes(size, "big", signed=True) for s in samples)
    shift = rate.bit_length() - 1
    extended = struct.pack(">HQ", 16383 + shift, rate << 63 - shift)
    common = struct.pack(">HIH", channels, len(samples) // channels, bits) + extended
    parts = b"AIFF" + b"COMM" + struct.pack(">I", 18) + common + b"SSND" + struct.pack(">I", len(body) + 8) + bytes(8) + body + bytes(len(body) % 2)
    return b"FORM" + struct.pack(">I", len(parts)) + parts


def leb128(value: int) -> bytes:
    out = bytearray()
    while True:
        out.append(value & 127 | 128 * (value > 127))
        value >>= 7
        if not value:
            return bytes(out)


def obu(kind: int, data: bytes) -> bytes:
    return bytes([kind << 3 | 2]) + leb128(len(data)) + data


def vp9_superframe(frames: Sequence[bytes]) -> bytes:
    """A packet of several frames with an index behind them."""
    if len(frames) == 1:
        return frames[0]
    width = max(1, -(-max(map(len, frames)).bit_length() // 8))
    mark = bytes([0xC0 | width - 1 << 3 | len(frames) - 1])
    return b"".join(frames) + mark + b"".join(len(f).to_bytes(width, "little") for f in frames) + mark
