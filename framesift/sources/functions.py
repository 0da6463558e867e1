"""SQL surface: codecs as functions and container walks as table functions of one session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from framesift.functions import udfs
from framesift.functions.codecs import Damaged
from framesift.sources import containers as C

FUNCTIONS = (
    "deflate", "inflate", "snappy", "unsnappy", "snappy_framed", "snappy_unframed", "lz4", "unlz4", "lzw", "unlzw", "bool_code", "bool_decode",
    "weightpack", "weightunpack", "crc8", "crc16", "crc32c", "ogg_crc", "xxh32",
)
PACKET = "track long, seq long, pts long, key boolean, data binary"
CHUNK = "seq long, kind string, offset long, data binary"


def _table(walk: Callable[[bytes], Iterator[dict]], schema: str):
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    class Walk:
        """Rows of one value; a damaged one gives the rows up to the damage, null gives none."""

        def eval(self, data: bytes):
            if data is None:
                return
            try:
                for row in walk(bytes(data)):
                    yield tuple(row.get(n) for n in names)
            except Damaged:
                return

    return udtf(Walk, returnType=schema)


def _boxes(data: bytes) -> Iterator[dict]:
    for i, b in enumerate(C.mp4_boxes(data)):
        yield {"seq": i, "kind": b["path"], "offset": b["offset"], "data": b["data"]}


def _markers(data: bytes) -> Iterator[dict]:
    for m in C.jpeg_markers(data):
        yield {"seq": m["seq"], "kind": f"{m['marker']:02X}", "offset": m["offset"], "data": m["data"]}


def _frames(data: bytes) -> Iterator[dict]:
    from framesift.functions.images import decode_gif

    for i, f in enumerate(decode_gif(data)):
        yield {"seq": i, **{k: f[k] for k in ("x", "y", "w", "h", "delay_ms", "dispose")}}


def _obus(data: bytes) -> Iterator[dict]:
    for o in C.av1_obus(data):
        yield {"seq": o["seq"], "kind": str(o["kind"]), "offset": None, "data": o["data"]}


def _superframe(data: bytes) -> Iterator[dict]:
    for i, f in enumerate(C.vp9_superframe(data)):
        yield {"seq": i, "kind": "frame", "offset": None, "data": f}


TABLES = {
    "ivf_frames": (C.ivf_frames, PACKET),
    "ogg_packets": (C.ogg_packets, PACKET),
    "ogg_pages": (C.ogg_pages, "seq long, serial long, page long, granule long, continued boolean, first boolean, last boolean, data binary"),
    "matroska_packets": (C.matroska_packets, PACKET),
    "png_chunks": (C.png_chunks, CHUNK),
    "riff_chunks": (C.riff_chunks, CHUNK),
    "mp4_boxes": (_boxes, CHUNK),
    "jpeg_markers": (_markers, CHUNK),
    "gif_frames": (_frames, "seq long, x long, y long, w long, h long, delay_ms long, dispose long"),
    "av1_obus": (_obus, CHUNK),
    "vp9_frames": (_superframe, CHUNK),
}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS and TABLES known to spark.sql."""
    for name in FUNCTIONS:
        spark.udf.register(f"media_{name}", getattr(udfs, name))
    for name, (walk, schema) in TABLES.items():
        spark.udtf.register(name, _table(walk, schema))
