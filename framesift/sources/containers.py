"""Container formats, one file at a time: walks of IVF, Ogg, Matroska, ISO-BMFF, RIFF, PNG, WAV, AIFF, AV1, VP9, Opus.

A packet is a dict of file position and payload; framesift.sources.media makes rows of it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from framesift.functions.codecs import Damaged, ogg_crc

# IVF


def ivf_header(data: bytes) -> dict:
    if data[:4] != b"DKIF" or len(data) < 32:
        raise Damaged("ivf: no header")
    _, version, size, codec, width, height, rate, scale, frames, _ = struct.unpack_from("<4sHH4sHHIIII", data)
    return {"version": version, "header": size, "codec": codec.decode("latin-1"), "width": width, "height": height, "rate": rate, "scale": scale, "frames": frames}


def ivf_frames(data: bytes) -> Iterator[dict]:
    at, n = ivf_header(data)["header"], 0
    while at + 12 <= len(data):
        size, pts = struct.unpack_from("<IQ", data, at)
        if at + 12 + size > len(data):
            raise Damaged("ivf: a frame is cut off")
        yield {"track": 0, "seq": n, "pts": pts, "key": None, "data": data[at + 12 : at + 12 + size]}
        at, n = at + 12 + size, n + 1


# Ogg


def ogg_pages(data: bytes) -> Iterator[dict]:
    """Pages with a right checksum, found again after damaged bytes."""
    at, n = 0, 0
    while (at := data.find(b"OggS", at)) >= 0:
        if at + 27 > len(data):
            return
        version, flags, granule, serial, number, crc, segments = struct.unpack_from("<BBqIIIB", data, at + 4)
        sizes = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(sizes)
        if version or len(sizes) < segments or end > len(data) or ogg_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            at += 4
            continue
        yield {
            "seq": n, "serial": serial, "page": number, "granule": granule, "continued": bool(flags & 1), "first": bool(flags & 2),
            "last": bool(flags & 4), "sizes": list(sizes), "data": data[end - sum(sizes) : end],
        }
        at, n = end, n + 1


def ogg_packets(data: bytes) -> Iterator[dict]:
    """Segments joined for each serial until one is under 255 bytes; an unfinished tail is dropped."""
    waiting: dict[int, bytearray] = {}
    count: dict[int, int] = {}
    for page in ogg_pages(data):
        serial, at = page["serial"], 0
        if not page["continued"]:
            waiting.pop(serial, None)
        complete = [i for i, s in enumerate(page["sizes"]) if s < 255]
        for i, size in enumerate(page["sizes"]):
            waiting.setdefault(serial, bytearray()).extend(page["data"][at : at + size])
            at += size
            if size < 255:
                n = count[serial] = count.get(serial, -1) + 1
                yield {"track": serial, "seq": n, "pts": page["granule"] if i == complete[-1] else None, "key": None, "data": bytes(waiting.pop(serial))}


# EBML, Matroska and WebM

# element numbers
EBML, SEGMENT, INFO, TRACKS, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, 0xAE, 0xA0, 0xE0, 0xE1, 0x75A1, 0xA6}
UNKNOWN_SIZE = -1


def vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """(value, next place) of an EBML number; all ones without the mark is UNKNOWN_SIZE."""
    if at >= len(data) or not data[at]:
        raise Damaged("ebml: a number is cut off or too long")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise Damaged("ebml: a number is cut off")
    whole = int.from_bytes(data[at : at + size], "big")
    if keep_mark:
        return whole, at + size
    value = whole & (1 << 7 * size) - 1
    return (UNKNOWN_SIZE if value == (1 << 7 * size) - 1 else value), at + size


def ebml_elements(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(depth, id, first byte, end) of every element, masters before their children."""
    end = len(data) if end is None else end
    while at < end:
        number, at = vint(data, at, True)
        size, at = vint(data, at)
        stop = end if size == UNKNOWN_SIZE else min(end, at + size)
        yield depth, number, at, stop
        if number in MASTERS:
            yield from ebml_elements(data, at, stop, depth + 1)
        at = stop


def lacing(data: bytes, flags: int) -> list[bytes]:
    """Frames of a block's payload: no lacing, Xiph, fixed or EBML sizes."""
    kind = flags >> 1 & 3
    if kind == 0:
        return [data]
    n, at = data[0] + 1, 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 2:
        if (len(data) - at) % n:
            raise Damaged("matroska: fixed lacing does not divide the block")
        sizes = [(len(data) - at) // n] * (n - 1)
    elif n > 1:
        size, at = vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            start = at
            step, at = vint(data, at)
            sizes.append(sizes[-1] + step - ((1 << 7 * (at - start) - 1) - 1))
    out = []
    for size in sizes:
        if size < 0 or at + size > len(data):
            raise Damaged("matroska: a laced frame is cut off")
        out.append(data[at : at + size])
        at += size
    return [*out, data[at:]]


def matroska_tracks(data: bytes) -> list[dict]:
    out: list[dict] = []
    scale = 1_000_000
    for _, number, a, b in ebml_elements(data):
        body = data[a:b]
        if number == 0x2AD7B1:
            scale = int.from_bytes(body, "big")
        elif number == 0xAE:
            out.append({"track": None, "type": None, "codec": None, "width": None, "height": None, "rate": None, "channels": None, "default_ns": None, "private": None})
        elif out:
            names = {0xD7: "track", 0x83: "type", 0xB0: "width", 0xBA: "height", 0x9F: "channels", 0x23E383: "default_ns"}
            if number in names:
                out[-1][names[number]] = int.from_bytes(body, "big")
            elif number == 0x86:
                out[-1]["codec"] = body.decode("latin-1").rstrip("\0")
            elif number == 0x63A2:
                out[-1]["private"] = body
            elif number == 0xB5 and len(body) in (4, 8):
                out[-1]["rate"] = struct.unpack(">f" if len(body) == 4 else ">d", body)[0]
    return [{**t, "scale_ns": scale} for t in out]


def matroska_packets(data: bytes) -> Iterator[dict]:
    """Frames in order of cluster and block; pts counts the segment's time scale."""
    time, n, group = 0, 0, None
    for _, number, a, b in ebml_elements(data):
        body = data[a:b]
        if number == 0xE7:
            time = int.from_bytes(body, "big")
        elif number == 0xA0:
            # a group without a reference is a key frame
            group = not any(x[1] == 0xFB for x in ebml_elements(data, a, b))
        elif number in (0xA3, 0xA1):
            track, at = vint(body, 0)
            if at + 3 > len(body):
                raise Damaged("matroska: a block is cut off")
            relative, flags = struct.unpack_from(">hB", body, at)
            key = bool(flags & 128) if number == 0xA3 else group
            for frame in lacing(body[at + 3 :], flags):
                yield {"track": track, "seq": n, "pts": time + relative, "key": key, "data": frame}
                n += 1


# ISO base media

HOLDERS = frozenset(b"moov trak mdia minf stbl dinf edts udta moof traf mvex".split())


def mp4_boxes(data: bytes, at: int = 0, end: int | None = None, path: str = "") -> Iterator[dict]:
    """Every box with its path, payload place and size; holders before their children."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Damaged("mp4: a box is cut off")
        name = f"{path}/{kind.decode('latin-1')}"
        yield {"path": name, "offset": at + head, "size": size - head, "data": b"" if kind in HOLDERS else data[at + head : at + size]}
        if kind in HOLDERS:
            yield from mp4_boxes(data, at + head, at + size, name)
        at += size


def mp4_find(data: bytes, path: str) -> bytes | None:
    return next((b["data"] for b in mp4_boxes(data) if b["path"] == path), None)


# RIFF, IFF, PNG


def riff_chunks(data: bytes) -> Iterator[dict]:
    if data[:4] not in (b"RIFF", b"FORM"):
        raise Damaged("riff: no header")
    order = "<" if data[:4] == b"RIFF" else ">"
    at, n = 12, 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}4sI", data, at)
        yield {"seq": n, "kind": kind.decode("latin-1"), "offset": at + 8, "data": data[at + 8 : at + 8 + size]}
        at, n = at + 8 + size + size % 2, n + 1


def png_chunks(data: bytes) -> Iterator[dict]:
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Damaged("png: no signature")
    at, n = 8, 0
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise Damaged("png: a chunk is cut off")
        good = zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        yield {"seq": n, "kind": kind.decode("latin-1"), "offset": at + 8, "good": good, "data": body}
        at, n = at + 12 + size, n + 1


def jpeg_markers(data: bytes) -> Iterator[dict]:
    """Marker segments; entropy-coded data follows SOS up to the next marker that is not a restart."""
    if data[:2] != b"\xff\xd8":
        raise Damaged("jpeg: no start marker")
    at, n = 2, 0
    while at + 4 <= len(data):
        if data[at] != 255:
            raise Damaged("jpeg: no marker where one must be")
        kind = data[at + 1]
        if kind == 255:
            at += 1
            continue
        if kind == 0xD9:
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        end = at + 2 + size
        scan = b""
        if kind == 0xDA:
            stop = end
            while (stop := data.find(b"\xff", stop)) >= 0 and stop + 1 < len(data) and (data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7):
                stop += 2
            stop = len(data) if stop < 0 else stop
            scan, end = data[end:stop], stop
        yield {"seq": n, "marker": kind, "offset": at + 4, "data": data[at + 4 : at + 2 + size], "scan": scan}
        at, n = end, n + 1


def exif_orientation(tiff: bytes) -> int:
    """Tag 0x0112 of the first directory of a TIFF block, 1 where it is missing or damaged."""
    tiff = tiff.removeprefix(b"Exif\0\0")
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        if order is None or struct.unpack_from(f"{order}H", tiff, 2)[0] != 42:
            return 1
        at = struct.unpack_from(f"{order}I", tiff, 4)[0]
        for i in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
            tag, kind, number = struct.unpack_from(f"{order}HHI", tiff, at + 2 + 12 * i)
            if tag == 0x0112 and kind == 3 and number >= 1:
                value = struct.unpack_from(f"{order}H", tiff, at + 10 + 12 * i)[0]
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


# audio files


def wav(data: bytes) -> dict:
    """rate, channels, bits and interleaved samples of a PCM WAV file; 8-bit samples are centred on 0."""
    form = body = None
    for c in riff_chunks(data):
        if c["kind"] == "fmt ":
            form = c["data"]
        elif c["kind"] == "data":
            body = c["data"]
    if form is None or body is None or data[8:12] != b"WAVE":
        raise Damaged("wav: no format or no data")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
    if tag == 0xFFFE:
        tag = struct.unpack_from("<H", form, 24)[0]
    if tag != 1 or bits not in (8, 16, 24, 32):
        raise Damaged(f"wav: format {tag} with {bits} bits")
    size = bits // 8
    body = body[: len(body) // (size * channels) * size * channels]
    samples = [b - 128 for b in body] if bits == 8 else [int.from_bytes(body[i : i + size], "little", signed=True) for i in range(0, len(body), size)]
    return {"rate": rate, "channels": channels, "bits": bits, "samples": samples}


def aiff(data: bytes) -> dict:
    """The same for an AIFF file."""
    form = body = None
    for c in riff_chunks(data):
        if c["kind"] == "COMM":
            form = c["data"]
        elif c["kind"] == "SSND":
            body = c["data"][8:]
    if form is None or body is None or data[8:12] != b"AIFF":
        raise Damaged("aiff: no common chunk or no sound")
    channels, frames, bits = struct.unpack_from(">HIH", form)
    exponent, mantissa = struct.unpack_from(">HQ", form, 8)
    rate = int(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63))
    size = (bits + 7) // 8
    body = body[: frames * channels * size]
    return {"rate": rate, "channels": channels, "bits": bits, "samples": [int.from_bytes(body[i : i + size], "big", signed=True) for i in range(0, len(body), size)]}


# packets of codecs


def leb128(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for i in range(8):
        if at >= len(data):
            raise Damaged("leb128: cut off")
        b = data[at]
        at += 1
        value |= (b & 127) << 7 * i
        if b < 128:
            return value, at
    raise Damaged("leb128: too long")


def av1_obus(data: bytes) -> Iterator[dict]:
    """Open bitstream units of one temporal unit."""
    at, n = 0, 0
    while at < len(data):
        head = data[at]
        kind, extended, sized = head >> 3 & 15, head >> 2 & 1, head >> 1 & 1
        layer = data[at + 1] if extended else 0
        at += 1 + extended
        size, at = leb128(data, at) if sized else (len(data) - at, at)
        if at + size > len(data):
            raise Damaged("obu: cut off")
        yield {"seq": n, "kind": kind, "temporal": layer >> 5, "spatial": layer >> 3 & 3, "data": data[at : at + size]}
        at, n = at + size, n + 1


def vp9_superframe(data: bytes) -> list[bytes]:
    """The frames of a packet: those its index names, or the packet itself."""
    if data and data[-1] & 0xE0 == 0xC0:
        n, width = (data[-1] & 7) + 1, (data[-1] >> 3 & 3) + 1
        index = 2 + n * width
        if len(data) >= index and data[-index] == data[-1]:
            out, at = [], 0
            for i in range(n):
                place = len(data) - index + 1 + i * width
                size = int.from_bytes(data[place : place + width], "little")
                if at + size > len(data) - index:
                    raise Damaged("vp9: a superframe index goes too far")
                if size:
                    out.append(data[at : at + size])
                at += size
            return out
    return [data]


def vp9_frame(data: bytes) -> dict:
    """The first fields of an uncompressed VP9 header."""
    bits = int.from_bytes(data[:16].ljust(16, b"\0"), "big")
    at = 0

    def get(n: int) -> int:
        nonlocal at
        at += n
        return bits >> 128 - at & (1 << n) - 1

    if get(2) != 2:
        raise Damaged("vp9: no frame marker")
    low, high = get(1), get(1)
    profile = high << 1 | low
    if profile == 3:
        get(1)
    out = {"profile": profile, "show_existing": bool(get(1)), "key": False, "shown": True, "width": None, "height": None}
    if out["show_existing"]:
        return out
    out["key"], out["shown"] = get(1) == 0, bool(get(1))
    get(1)
    if out["key"]:
        if get(24) != 0x498342:
            raise Damaged("vp9: no sync code")
        if profile >= 2:
            get(1)
        if get(3) != 7:
            get(1)
            if profile in (1, 3):
                get(3)
        elif profile in (1, 3):
            get(1)
        out["width"], out["height"] = get(16) + 1, get(16) + 1
    return out


def vp8_frame(data: bytes) -> dict:
    """The frame tag and, of a key frame, the size."""
    if len(data) < 3:
        raise Damaged("vp8: no frame tag")
    tag = int.from_bytes(data[:3], "little")
    out = {"key": not tag & 1, "version": tag >> 1 & 7, "shown": bool(tag >> 4 & 1), "first_part": tag >> 5, "width": None, "height": None}
    if out["key"]:
        if data[3:6] != b"\x9d\x01\x2a" or len(data) < 10:
            raise Damaged("vp8: no start code")
        w, h = struct.unpack_from("<HH", data, 6)
        out["width"], out["height"] = w & 0x3FFF, h & 0x3FFF
    return out


OPUS_SILK, OPUS_HYBRID, OPUS_CELT = (10_000, 20_000, 40_000, 60_000), (10_000, 20_000), (2_500, 5_000, 10_000, 20_000)


def opus_toc(toc: int) -> dict:
    """Mode, bandwidth, frame duration in microseconds, and channels of an Opus packet."""
    config = toc >> 3
    if config < 12:
        mode, band, us = "silk", ("narrow", "medium", "wide")[config // 4], OPUS_SILK[config % 4]
    elif config < 16:
        mode, band, us = "hybrid", ("superwide", "full")[(config - 12) // 2], OPUS_HYBRID[config % 2]
    else:
        mode, band, us = "celt", ("narrow", "wide", "superwide", "full")[(config - 16) // 4], OPUS_CELT[config % 4]
    return {"mode": mode, "bandwidth": band, "frame_us": us, "channels": 1 + (toc >> 2 & 1), "code": toc & 3}


def opus_frames(data: bytes) -> dict:
    """The table of contents and the frames of an Opus packet, codes 0 to 3."""
    if not data:
        raise Damaged("opus: an empty packet")
    toc = opus_toc(data[0])

    def length(at: int) -> tuple[int, int]:
        if at >= len(data) or data[at] >= 252 and at + 1 >= len(data):
            raise Damaged("opus: a length is cut off")
        return (data[at], at + 1) if data[at] < 252 else (4 * data[at + 1] + data[at], at + 2)

    at, end, sizes = 1, len(data), []
    if toc["code"] == 0:
        sizes = [end - at]
    elif toc["code"] == 1:
        if (end - at) % 2:
            raise Damaged("opus: two equal frames of odd length")
        sizes = [(end - at) // 2] * 2
    elif toc["code"] == 2:
        first, at = length(at)
        sizes = [first, end - at - first]
    else:
        if end < 2:
            raise Damaged("opus: no frame count")
        flags, at = data[1], 2
        n = flags & 63
        if not n or n * toc["frame_us"] > 120_000:
            raise Damaged("opus: a bad frame count")
        if flags & 64:
            padding = 0
            while at < end and data[at] == 255:
                padding, at = padding + 254, at + 1
            if at >= end:
                raise Damaged("opus: padding is cut off")
            padding, at = padding + data[at], at + 1
            end -= padding
        if flags & 128:
            for _ in range(n - 1):
                size, at = length(at)
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
        else:
            if (end - at) % n or end < at:
                raise Damaged("opus: equal frames do not divide the packet")
            sizes = [(end - at) // n] * n
    if any(s < 0 or s > 1275 for s in sizes):
        raise Damaged("opus: a frame length is not allowed")
    frames = []
    for size in sizes:
        frames.append(data[at : at + size])
        at += size
    return {**toc, "frames": frames}


def vorbis_identification(data: bytes) -> dict:
    """Channels, rate, bitrates and block sizes of a Vorbis identification header."""
    if data[:7] != b"\x01vorbis" or len(data) < 30:
        raise Damaged("vorbis: no identification header")
    version, channels, rate, most, nominal, least, sizes = struct.unpack_from("<IBIiiiB", data, 7)
    short, long = 1 << (sizes & 15), 1 << (sizes >> 4)
    if version or not channels or not rate or not 64 <= short <= long <= 8192 or not data[29] & 1:
        raise Damaged("vorbis: a bad identification header")
    return {"channels": channels, "rate": rate, "max": most, "nominal": nominal, "min": least, "short": short, "long": long}
