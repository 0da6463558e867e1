"""Queries of codecs and containers: what was written is read again, over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framesift.functions import udfs as U
from framesift.operators.pixels import from_vectors
from framesift.plans.common import EV, PIX, samples, table
from framesift.sources import media


def _text(c: str):
    return F.encode(F.col(c), "UTF-8")


def _again(encode, decode, name: str, key: str, column: str):
    def query(spark, sf):
        keys = key.split(", ")
        made = table(spark, sf, name).select(*keys, decode(encode(_text(column))).alias("data"))
        return made.select(*keys, F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("n"))

    return query


def _mapped(work, out: pa.Schema):
    """A map over rows of (key, value) that yields dicts of `out`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = [d for row in batch.slice(at, 64).to_pylist() for d in work(row)]
                yield pa.RecordBatch.from_pylist(found, out)

    return run


def _pictures(spark, sf):
    """vec_id and 64 bytes: the block as a grey 8 x 8 picture."""
    made = from_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 8).withColumn("v", F.pmod("v", F.lit(256)))
    return made.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("v"))


def _image_again(codec: str):
    def work(row: dict) -> list[dict]:
        from framesift.functions import images as I

        grey = np.array(row["v"], np.uint8).reshape(8, 8)
        whole = np.dstack([grey, grey, grey, np.full_like(grey, 255)])
        if codec == "png":
            back = I.decode_png(I.encode_png(whole))
        elif codec == "webp":
            from framesift.functions import webp

            back = webp.decode_webp(webp.encode_webp(whole))
        elif codec == "bmp":
            back = I.decode_bmp(I.encode_bmp(whole))
        else:
            back = I.decode_gif(I.encode_gif([whole]))[0]["pixels"]
        return [{"vec_id": row["vec_id"], "i": i, "v": int(v)} for i, v in enumerate(back[..., 0].ravel())]

    out = pa.schema([("vec_id", pa.int64()), ("i", pa.int64()), ("v", pa.int64())])
    return lambda spark, sf: _pictures(spark, sf).mapInArrow(_mapped(work, out), "vec_id long, i long, v long")


png_encode_decode, bmp_encode_decode, gif_encode_decode, webp_encode_decode = (_image_again(c) for c in ("png", "bmp", "gif", "webp"))


def range_coder_roundtrip(spark, sf):
    """Bytes as symbols of a uniform model and as numbers with raw bits, through the range coder."""

    def work(row: dict) -> list[dict]:
        from framesift.functions.entropy import RangeDecoder, RangeEncoder

        data = row["text"].encode()
        maker = RangeEncoder()
        for b in data:
            maker.put(b, b + 1, 256)
            maker.number(b * 7, 2000)
        reader = RangeDecoder(maker.finish(4 * len(data) + 8))
        flat, back = list(range(257)), bytearray()
        for _ in data:
            b = reader.get(flat)
            if reader.number(2000) == b * 7:
                back.append(b)
        return [{"item_id": row["item_id"], "text": back.decode("utf-8", "replace")}]

    out = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
    return table(spark, sf, "benchmark").select("item_id", "text").mapInArrow(_mapped(work, out), "item_id long, text string")


def huffman_code(spark, sf):
    """Per language, whether a prefix code over byte counts is complete and within a bit a symbol of the entropy."""
    from framesift.operators.bytestreams import byte_histogram

    counts = byte_histogram(table(spark, sf, "documents"), ["lang"], _text("text"))
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("b", "n")).alias("c"))

    def work(row: dict) -> list[dict]:
        from framesift.functions.entropy import code_lengths

        n = np.zeros(256, np.int64)
        for c in row["c"]:
            n[c["b"]] = c["n"]
        lengths = np.array(code_lengths(n.tolist(), 32))
        used = n > 0
        entropy = float(-(n[used] * np.log2(n[used] / n.sum())).sum())
        bits = float((n * lengths).sum())
        return [{"lang": row["lang"], "complete": bool((2.0 ** -lengths[used]).sum() == 1), "near_entropy": bool(entropy <= bits < entropy + n.sum())}]

    out = pa.schema([("lang", pa.string()), ("complete", pa.bool_()), ("near_entropy", pa.bool_())])
    return rows.mapInArrow(_mapped(work, out), "lang string, complete boolean, near_entropy boolean")


def jpeg_quality(spark, sf):
    """Whether each block comes back within two steps of every channel."""

    def work(row: dict) -> list[dict]:
        from framesift.functions import images as I

        grey = np.array(row["v"], np.uint8).reshape(8, 8)
        back = I.decode_jpeg(I.encode_jpeg(np.dstack([grey, grey, grey, np.full_like(grey, 255)]), 99))
        return [{"vec_id": row["vec_id"], "close": bool(np.abs(back[..., 0].astype(int) - grey).max() <= 8), "pixels": int(back.shape[0] * back.shape[1])}]

    out = pa.schema([("vec_id", pa.int64()), ("close", pa.bool_()), ("pixels", pa.int64())])
    return _pictures(spark, sf).mapInArrow(_mapped(work, out), "vec_id long, close boolean, pixels long")


def _tracks(spark, sf):
    rows = samples(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "x"))).alias("s"))
    return rows.select("user_id", F.transform("s", lambda p: p["x"]).alias("x"))


def flac_roundtrip(spark, sf):
    def work(row: dict) -> list[dict]:
        from framesift.functions.audio import decode_flac, encode_flac

        found = decode_flac(encode_flac(np.array(row["x"]), 48000, 24))
        if not found["md5_matches"]:
            return []
        return [{"user_id": row["user_id"], "i": i, "x": int(v)} for i, v in enumerate(found["samples"][:, 0])]

    out = pa.schema([("user_id", pa.int64()), ("i", pa.int64()), ("x", pa.int64())])
    return _tracks(spark, sf).mapInArrow(_mapped(work, out), "user_id long, i long, x long")


def wav_roundtrip(spark, sf):
    def work(row: dict) -> list[dict]:
        from framesift.sources import containers, writers

        a = containers.wav(writers.wav(row["x"], 48000, 1, 24))["samples"]
        b = containers.aiff(writers.aiff(row["x"], 48000, 1, 24))["samples"]
        return [{"user_id": row["user_id"], "i": i, "x": v} for i, v in enumerate(a)] if a == b else []

    out = pa.schema([("user_id", pa.int64()), ("i", pa.int64()), ("x", pa.int64())])
    return _tracks(spark, sf).mapInArrow(_mapped(work, out), "user_id long, i long, x long")


def mdct_overlap_add(spark, sf):
    def work(row: dict) -> list[dict]:
        from framesift.functions.audio import imdct, mdct

        x = np.array(row["x"], float)
        back = np.rint(imdct(mdct(x, 16), 16, len(x))).astype(int)
        return [{"user_id": row["user_id"], "i": i, "x": int(v)} for i, v in enumerate(back)]

    out = pa.schema([("user_id", pa.int64()), ("i", pa.int64()), ("x", pa.int64())])
    return _tracks(spark, sf).mapInArrow(_mapped(work, out), "user_id long, i long, x long")


def _muxed(spark, sf, format_: str):
    """conv_id, format, content: each conversation as a file with a packet a turn."""
    rows = table(spark, sf, "conversations").select("conv_id", F.struct("turn", "role", _text("text").alias("data")).alias("p"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))

    def work(row: dict) -> list[dict]:
        from framesift.sources import writers as W

        turns = row["p"]
        if format_ == "ivf":
            content = W.ivf([(p["turn"], p["data"]) for p in turns])
        elif format_ == "ogg":
            content = W.ogg([p["data"] for p in turns], 1, [p["turn"] for p in turns])
        else:
            roles = ["system", "user", "assistant"]
            number = lambda p: roles.index(p["role"]) + 1 if p["role"] in roles else 4
            tracks = [{"track": n, "type": 2, "codec": "S_TEXT", "rate": 1000.0} for n in sorted({number(p) for p in turns})]
            content = W.webm(tracks, [{"track": number(p), "pts": p["turn"], "key": True, "data": p["data"]} for p in turns])
        return [{"conv_id": row["conv_id"], "format": format_, "content": content}]

    out = pa.schema([("conv_id", pa.int64()), ("format", pa.string()), ("content", pa.binary())])
    return grouped.mapInArrow(_mapped(work, out), "conv_id long, format string, content binary")


def _demuxed(format_: str):
    def query(spark, sf):
        found = media.packets(_muxed(spark, sf, format_), ["conv_id"])
        return found.select("conv_id", "seq", F.md5("data").alias("digest"))

    return query


ivf_packets, ogg_packets, matroska_packets = (_demuxed(f) for f in ("ivf", "ogg", "matroska"))


def matroska_tracks(spark, sf):
    found = media.tracks(_muxed(spark, sf, "matroska"), ["conv_id"])
    return found.select("conv_id", "track", "codec", F.col("rate").cast("long").alias("rate"))


def weightpack_roundtrip(spark, sf):
    def work(row: dict) -> list[dict]:
        from framesift.functions.codecs import bitshuffle, bitunshuffle, weightpack, weightunpack

        raw = np.array(row["embedding"], "<f4").tobytes()
        back = np.frombuffer(bitunshuffle(bitshuffle(weightunpack(weightpack(raw, 4)), 4), 4), "<f4")
        return [{"vec_id": row["vec_id"], "i": i, "v": float(v)} for i, v in enumerate(back)]

    out = pa.schema([("vec_id", pa.int64()), ("i", pa.int64()), ("v", pa.float64())])
    made = table(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(_mapped(work, out), "vec_id long, i long, v double")
    return made.select("vec_id", "i", F.round(F.col("v") * 100).cast("long").alias("v"))


def bc4_texture(spark, sf):
    """The end points of BC4 blocks: the least and greatest value of each 4 x 4 block come back exactly."""

    def work(row: dict) -> list[dict]:
        from framesift.functions.images import decode_texture, encode_bc4

        grey = np.array(row["v"], np.uint8).reshape(8, 8)
        back = decode_texture(encode_bc4(grey), 8, 8, "bc4")[..., 0].reshape(2, 4, 2, 4).transpose(0, 2, 1, 3).reshape(4, 16)
        return [{"vec_id": row["vec_id"], "block": i, "low": int(b.min()), "high": int(b.max())} for i, b in enumerate(back)]

    out = pa.schema([("vec_id", pa.int64()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    return _pictures(spark, sf).mapInArrow(_mapped(work, out), "vec_id long, block long, low long, high long")


def checksums(spark, sf):
    made = table(spark, sf, "benchmark").withColumn("data", _text("text"))
    return made.select("item_id", U.crc8("data").alias("crc8"), U.crc16("data").alias("crc16"), U.crc32c("data").alias("crc32c"), U.ogg_crc("data").alias("ogg_crc"), U.xxh32("data").alias("xxh32"))


TEXTS = {
    "deflate_roundtrip": (U.deflate, U.inflate, "documents", "doc_id", "text"),
    "snappy_roundtrip": (U.snappy, U.unsnappy, "documents", "doc_id", "text"),
    "snappy_framed_roundtrip": (U.snappy_framed, U.snappy_unframed, "benchmark", "item_id", "text"),
    "lz4_roundtrip": (U.lz4, U.unlz4, "pages", "page_id", "html"),
    "lz4_blocks_roundtrip": (U.lz4_blocks, U.unlz4, "conversations", "conv_id, turn", "text"),
    "lzw_roundtrip": (U.lzw, U.unlzw, "conversations", "conv_id, turn", "text"),
    "boolcoder_roundtrip": (U.bool_code, U.bool_decode, "benchmark", "item_id", "text"),
}
P8 = f"(SELECT vec_id, i, x, y, ((v % 256) + 256) % 256 AS v FROM {PIX})"
TRACK = f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, x FROM {EV}"
PACKET = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, md5(text) AS digest FROM conversations"
SQL = {name: f"SELECT {key}, md5({c}) AS digest, CAST(strlen({c}) AS BIGINT) AS n FROM {t}" for name, (_, _, t, key, c) in TEXTS.items()} | {
    "png_encode_decode": f"SELECT vec_id, i, v FROM {P8}",
    "bmp_encode_decode": f"SELECT vec_id, i, v FROM {P8}",
    "gif_encode_decode": f"SELECT vec_id, i, v FROM {P8}",
    "webp_encode_decode": f"SELECT vec_id, i, v FROM {P8}",
    "range_coder_roundtrip": "SELECT item_id, text FROM benchmark",
    "huffman_code": "SELECT DISTINCT lang, true AS complete, true AS near_entropy FROM documents",
    "jpeg_quality": "SELECT vec_id, true AS close, CAST(64 AS BIGINT) AS pixels FROM embeddings",
    "flac_roundtrip": TRACK,
    "wav_roundtrip": TRACK,
    "mdct_overlap_add": TRACK,
    "ivf_packets": PACKET,
    "ogg_packets": PACKET,
    "matroska_packets": PACKET,
    "matroska_tracks": """
        SELECT DISTINCT conv_id, CAST(CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 4 END AS BIGINT) AS track,
               'S_TEXT' AS codec, CAST(1000 AS BIGINT) AS rate FROM conversations
    """,
    "weightpack_roundtrip": f"SELECT vec_id, i, v FROM {PIX}",
    "bc4_texture": f"SELECT vec_id, y // 4 * 2 + x // 4 AS block, min(v) AS low, max(v) AS high FROM {P8} GROUP BY vec_id, y // 4 * 2 + x // 4",
}
QUERIES = {name: _again(*of) for name, of in TEXTS.items()} | {name: globals()[name] for name in SQL if name not in TEXTS} | {"checksums": checksums}
