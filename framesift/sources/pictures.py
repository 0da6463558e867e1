"""Image and audio files as tables: header probes without decoding, decoded frames, PCM, and encoders as functions."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from framesift.functions import audio, images, vorbis, webp
from framesift.functions.codecs import Damaged
from framesift.sources import containers as C

INFO = "width long, height long, has_alpha boolean, bit_depth long, frame_count long, orientation long, is_interlaced boolean, reason string"
FRAMES = "index long, x long, y long, width long, height long, delay_ms long, dispose long, pixels binary, reason string"
PCM = "rate long, channels long, bits long, samples array<long>, tags array<struct<key:string,value:string>>, md5_matches boolean, bad_frames long, reason string"


def image_info(format_: str, data: bytes) -> dict:
    """Facts of an image file from its headers."""
    out = {"frame_count": 1, "orientation": 1, "is_interlaced": False, "bit_depth": 8}
    try:
        if format_ == "png":
            kinds = {c["kind"] for c in C.png_chunks(data)}
            width, height, depth, color, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
            return out | {"width": width, "height": height, "bit_depth": depth, "has_alpha": color in (4, 6) or "tRNS" in kinds, "is_interlaced": bool(interlaced)}
        if format_ == "jpeg":
            for m in C.jpeg_markers(data):
                if m["marker"] == 0xE1 and m["data"][:6] == b"Exif\0\0":
                    out["orientation"] = C.exif_orientation(m["data"])
                if 0xC0 <= m["marker"] <= 0xCF and m["marker"] not in (0xC4, 0xC8, 0xCC):
                    depth, height, width = struct.unpack_from(">BHH", m["data"])
                    return out | {"width": width, "height": height, "bit_depth": depth, "has_alpha": False, "is_interlaced": m["marker"] == 0xC2}
            raise Damaged("jpeg: no frame")
        if format_ == "gif":
            frames = images.decode_gif(data)
            width, height = struct.unpack_from("<HH", data, 6)
            return out | {"width": width, "height": height, "has_alpha": any((f["pixels"][..., 3] < 255).any() for f in frames), "frame_count": len(frames)}
        if format_ == "bmp":
            width, height, _, bits = struct.unpack_from("<iiHH", data, 18)
            return out | {"width": width, "height": abs(height), "bit_depth": min(8, bits), "has_alpha": bits == 32}
        if format_ == "webp":
            for c in C.riff_chunks(data):
                if c["kind"] == "VP8L":
                    packed = int.from_bytes(c["data"][1:5], "little")
                    return out | {"width": (packed & 0x3FFF) + 1, "height": (packed >> 14 & 0x3FFF) + 1, "has_alpha": bool(packed >> 28 & 1)}
                if c["kind"] == "VP8 ":
                    frame = C.vp8_frame(c["data"])
                    return out | {"width": frame["width"], "height": frame["height"], "has_alpha": False}
    except struct.error:
        raise Damaged(f"{format_}: a header is cut off") from None
    raise Damaged(f"no picture in {format_}")


def frames_of(format_: str, data: bytes) -> Iterator[dict]:
    """Decoded RGBA frames of any picture that can be decoded."""
    if format_ == "gif":
        for i, f in enumerate(images.decode_gif(data)):
            h, w = f["pixels"].shape[:2]
            yield {"index": i, "x": f["x"], "y": f["y"], "width": w, "height": h, "delay_ms": f["delay_ms"], "dispose": f["dispose"], "pixels": f["pixels"].tobytes()}
        return
    decode = {"png": images.decode_png, "jpeg": images.decode_jpeg, "bmp": images.decode_bmp, "webp": webp.decode_webp}.get(format_)
    if decode is None:
        raise Damaged(f"no picture in {format_}")
    pixels = decode(data)
    yield {"index": 0, "x": 0, "y": 0, "width": pixels.shape[1], "height": pixels.shape[0], "delay_ms": 0, "dispose": 0, "pixels": pixels.tobytes()}


def pcm_of(format_: str, data: bytes) -> Iterator[dict]:
    """Interleaved samples of a WAV, AIFF, FLAC or Ogg Vorbis file, the last at 16 bits."""
    if format_ == "flac":
        f = audio.decode_flac(data)
        tags = [{"key": k, "value": v} for k, v in f["tags"]]
        yield {k: f[k] for k in ("rate", "channels", "bits", "md5_matches", "bad_frames")} | {"samples": f["samples"].ravel().tolist(), "tags": tags}
    elif format_ in ("wav", "aiff"):
        yield (C.wav if format_ == "wav" else C.aiff)(data) | {"tags": [], "md5_matches": None, "bad_frames": 0}
    elif format_ == "ogg":
        f = vorbis.decode_ogg(data)
        whole = np.clip(np.rint(f["samples"].T.ravel() * 32768), -32768, 32767).astype(int)
        yield {"rate": f["rate"], "channels": f["channels"], "bits": 16, "samples": whole.tolist(), "tags": [], "md5_matches": None, "bad_frames": 0}
    else:
        raise Damaged(f"no audio in {format_}")


def _table(rows: DataFrame, keys: list[str], walk: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """keys and the walk's rows of each file with format and content; a damaged file gives its reason."""
    kept = rows.select(*keys, "format", "content")
    made = kept.sparkSession.createDataFrame([], schema).schema
    full = kept.select(*keys).schema
    for field in made:
        full = full.add(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(full)
        for batch in batches:
            for row in batch.to_pylist():
                if row["content"] is None:
                    continue
                key = {k: row[k] for k in keys}
                empty = dict.fromkeys(made.names)
                try:
                    found = [key | empty | f for f in walk(row["format"], row["content"])]
                except Damaged as error:
                    found = [key | empty | {"reason": str(error)}]
                # a frame may be large, so each file is a batch of its own
                yield pa.RecordBatch.from_pylist(found, target)

    return kept.mapInArrow(work, full)


def info(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _table(rows, keys, lambda f, d: iter([image_info(f, d)]), INFO)


def frames(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _table(rows, keys, frames_of, FRAMES)


def pcm(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _table(rows, keys, pcm_of, PCM)


def _encoder(work: Callable[[np.ndarray], bytes]):
    @F.arrow_udf(BinaryType())
    def run(pixels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for p, w, h in zip(pixels.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True):
            whole = p is not None and w and h and len(p) == 4 * w * h
            out.append(work(np.frombuffer(p, np.uint8).reshape(h, w, 4)) if whole else None)
        return pa.array(out, pa.binary())

    return run


#: column functions of RGBA pixels, width and height; null where the three don't fit
encode_png, encode_jpeg, encode_webp = _encoder(images.encode_png), _encoder(images.encode_jpeg), _encoder(webp.encode_webp)
encode_bmp, encode_gif = _encoder(lambda p: images.encode_bmp(p, True)), _encoder(lambda p: images.encode_gif([p]))
