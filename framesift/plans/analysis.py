"""Queries of bands, candidate lists, exact timing, clustering and pieces."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from framesift.operators import analysis as A
from framesift.plans.codecs import _mapped, _tracks
from framesift.plans.common import EV, PIX, samples, table
from framesift.plans.media import NUM, numbered
from framesift.plans.pixels import bytes_of, pix

EDGES = (2, 4, 8, 16, 32)
SCALES = {0: 1000, 1: 48000, 2: 90000}


def band_bits(spark, sf):
    return A.band_bits(pix(spark, sf), "vec_id", "i", "v", EDGES, 16)


def candidate_lists(spark, sf):
    return A.candidate_lists(numbered(spark, sf), "user_id", "i", "x", 6, 3)


def fixed_log2(spark, sf):
    return samples(spark, sf).where("x >= 1").select("event_id", A.fixed_log2(F.col("x")).alias("log"))


def mux_rational(spark, sf):
    made = numbered(spark, sf).select("user_id", "i", (F.col("event_id") % 3).cast("int").alias("track"), "x")
    out = A.exact_merge(made.withColumn("file", F.col("user_id") % 7), "file", "x", "track", "i", SCALES)
    return out.groupBy("file", "position").agg(F.min("x").alias("x"), F.min("track").alias("track"))


def opus_trim(spark, sf):
    made = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return A.trimmed(made, "conv_id", ["turn"], "n", 312, 100).select("conv_id", "turn", "start", "keep")


def tile_groups(spark, sf):
    frames = bytes_of(pix(spark, sf)).withColumn("frame", F.floor(F.col("vec_id") / 16).cast("long"))
    wide = frames.withColumn("x", F.col("x") + 8 * (F.col("vec_id") % 4)).withColumn("y", F.col("y") + 8 * F.floor(F.col("vec_id") % 16 / 4).cast("long"))
    return A.tile_groups(wide, "frame", 4, 8)


def level_segments(spark, sf):
    def work(row: dict) -> list[dict]:
        import numpy as np

        values = np.array(row["x"]) // 400 % 256
        centres, of = A.segments(values)
        return [{"user_id": row["user_id"], "segment": s, "n": int((of[values] == s).sum())} for s in range(len(centres))]

    out = pa.schema([("user_id", pa.int64()), ("segment", pa.int64()), ("n", pa.int64())])
    found = _tracks(spark, sf).mapInArrow(_mapped(work, out), "user_id long, segment long, n long")
    # every sample is in one segment
    return found.groupBy("user_id").agg(F.sum("n").cast("long").alias("n"), (F.max("segment") < 4).alias("few"))


def crc_pieces(spark, sf):
    def work(row: dict) -> list[dict]:
        import zlib

        data = row["text"].encode()
        crc = 0
        for i in range(0, len(data), 64):
            piece = data[i : i + 64]
            crc = A.crc32_joined(crc, zlib.crc32(piece), len(piece))
        return [{"item_id": row["item_id"], "same": crc == zlib.crc32(data)}]

    out = pa.schema([("item_id", pa.int64()), ("same", pa.bool_())])
    return table(spark, sf, "benchmark").select("item_id", "text").mapInArrow(_mapped(work, out), "item_id long, same boolean")


def flac_frames(spark, sf):
    """Frames that a search for headers at every byte finds in each track's FLAC file, in blocks of 16."""

    def work(row: dict) -> list[dict]:
        import numpy as np

        from framesift.functions.audio import decode_flac, encode_flac, frame_starts

        data = encode_flac(np.array(row["x"]), 48000, 24, 16)
        return [{"user_id": row["user_id"], "frames": len(frame_starts(data)), "samples": len(decode_flac(data)["samples"])}]

    out = pa.schema([("user_id", pa.int64()), ("frames", pa.int64()), ("samples", pa.int64())])
    return _tracks(spark, sf).mapInArrow(_mapped(work, out), "user_id long, frames long, samples long")


BAND = " + ".join(f"CASE WHEN i >= {e} THEN 1 ELSE 0 END" for e in EDGES)
SQL = {
    "band_bits": f"""
        SELECT vec_id, {BAND} AS band, count(*) AS n, CAST(sum(v * v) AS BIGINT) AS energy, round(sum(log2(1 + abs(v) // 16)), 4) + 0.0::DOUBLE AS bits FROM {PIX} GROUP BY 1, 2
    """,
    "candidate_lists": f"""
        WITH c AS (SELECT a.user_id, a.i, a.i - b.i AS distance, abs(a.x - b.x) AS cost FROM {NUM} a JOIN {NUM} b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 6 AND a.i - 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY cost, distance) - 1 AS rank FROM c)
        SELECT user_id, i, CAST(rank AS INT) AS rank, CAST(distance AS INT) AS distance, cost FROM r WHERE rank < 3
    """,
    "fixed_log2": f"""
        WITH t AS (SELECT event_id, x, length(bin(x)) - 1 AS t FROM {EV} WHERE x >= 1),
        f AS (SELECT event_id, t, (CASE WHEN t >= 7 THEN x >> (t - 7) ELSE x << (7 - t) END) & 127 AS f FROM t)
        SELECT event_id, CAST(t * 128 + f + ((f * (128 - f) * 179) >> 16) AS BIGINT) AS log FROM f
    """,
    "mux_rational": f"""
        WITH p AS (SELECT user_id % 7 AS file, i, CAST(event_id % 3 AS INT) AS track, x, x * CAST(720000 // CASE event_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 48000 ELSE 90000 END AS HUGEINT) AS k FROM {NUM}),
        r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k, track, i) AS position FROM p)
        SELECT file, position, x, track FROM r
    """,
    "opus_trim": """
        WITH e AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e, sum(length(text)) OVER (PARTITION BY conv_id) AS w FROM conversations),
        k AS (SELECT conv_id, turn, greatest(e - n, 312) AS low, least(e, w - 100) AS high FROM e)
        SELECT conv_id, turn, CAST(low - 312 AS BIGINT) AS start, CAST(high - low AS BIGINT) AS keep FROM k WHERE high > low
    """,
    "level_segments": f"SELECT user_id, count(*) AS n, true AS few FROM {EV} GROUP BY 1",
    "crc_pieces": "SELECT item_id, true AS same FROM benchmark",
    "flac_frames": f"SELECT user_id, (count(*) + 15) // 16 AS frames, count(*) AS samples FROM {EV} GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in (*SQL, "tile_groups")}
