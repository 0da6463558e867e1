"""Queries of images and transforms: embeddings are 8 x 8 blocks, lineitem and part hold colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import scalars as S
from framesift.operators import pixels as X
from framesift.operators import transforms as T
from framesift.plans.common import EV, PIX, samples, table

#: palette of the nearest-colour query: entries of four coordinates made by a rule
PALETTE = [[(37 * e + 11 * c) % 60 - 30 for c in range(4)] for e in range(24)]
LEVELS = [(50_000, 10), (100_000, 20), (150_000, 30), (200_000, 40), (300_000, 50)]


def pix(spark, sf):
    return X.from_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 8)


def parts_of(spark, sf, size):
    """vec_id, block, part: every `size` elements of a vector, in order."""
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / size).cast("int") - 1), lambda b: F.slice("embedding", b * size + 1, F.lit(size)))
    return table(spark, sf, "embeddings").where(F.size("embedding") >= size).select("vec_id", F.posexplode(cut).alias("block", "part"))


def bytes_of(pixels):
    return pixels.withColumn("v", F.pmod("v", F.lit(256)))


def color_histogram_555(spark, sf):
    rows = table(spark, sf, "lineitem")
    channel = lambda c, k: (F.col(c).cast("long") * k % 256).cast("long")
    return X.histogram_555(rows, ["l_returnflag"], channel("l_quantity", 5), channel("l_partkey", 3), channel("l_suppkey", 7))


def exact_palette(spark, sf):
    return X.exact_palette(table(spark, sf, "part"), F.col("p_size") * 65536 + F.length("p_brand"))


def nearest_palette(spark, sf):
    """Every four elements of a vector are a point."""
    point = F.transform("part", lambda x: F.round(x.cast("double") * 100).cast("long"))
    return X.nearest_color(parts_of(spark, sf, 4).withColumn("point", point), ["vec_id", "block"], "point", PALETTE)


def downsample_2x2(spark, sf):
    return X.box_downsample(pix(spark, sf), "vec_id")


def png_filter_pick(spark, sf):
    return X.filter_choice(bytes_of(pix(spark, sf)), "vec_id")


def psnr_sse(spark, sf):
    a = bytes_of(pix(spark, sf))
    b = a.withColumn("vec_id", F.col("vec_id") - 1).select("vec_id", "i", "v")
    return X.squared_error(a.select("vec_id", "i", "v"), b, ["vec_id", "i"], "vec_id").withColumn("psnr", F.coalesce("psnr", F.lit(-1.0)))


def motion_search(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    made = samples(spark, sf).select("user_id", n.cast("long").alias("at"), F.floor(F.col("x") / 100).cast("long").alias("v"))
    kept = made.withColumn("block", F.floor(F.col("at") / 8).cast("long"))
    shifted = made.withColumn("at", F.col("at") + 3)
    return X.motion_search(kept, shifted, "user_id", "block", "at")


def pad_crop(spark, sf):
    return X.pad_plane(pix(spark, sf).where("x < 6 and y < 6"), "vec_id", 8, 7)


def orientation(spark, sf):
    parts = None
    for o in range(1, 9):
        one = X.oriented(pix(spark, sf), 8, 8, o).groupBy("vec_id").agg(F.sum(F.col("v") * (F.col("y") * 8 + F.col("x"))).cast("long").alias("moment"))
        one = one.withColumn("orientation", F.lit(o))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def opaque_grey(spark, sf):
    made = bytes_of(pix(spark, sf)).withColumn("q", F.col("i") % 4)
    pixel = made.groupBy("vec_id", F.floor(F.col("i") / 4).cast("long").alias("p")).agg(*(F.max(F.when(F.col("q") == k, F.col("v"))).alias(c) for k, c in enumerate("rgba")))
    return pixel.groupBy("vec_id").agg(
        F.bool_and(F.col("a") >= 128).alias("opaque"), F.bool_and((F.col("r") == F.col("g")) & (F.col("r") == F.col("b"))).alias("grey"),
        F.count(F.when(F.col("a") < 128, 1)).cast("long").alias("clear"),
    )


def luma_of(spark, sf):
    made = bytes_of(pix(spark, sf)).groupBy("vec_id", F.floor(F.col("i") / 4).cast("long").alias("p")).agg(
        *(F.max(F.when(F.col("i") % 4 == k, F.col("v"))).alias(c) for k, c in enumerate("rgb"))
    )
    return made.select("vec_id", "p", S.luma(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("luma"))


def changed_rect(spark, sf):
    made = pix(spark, sf).withColumn("track", F.col("vec_id") % 5)
    out = X.changed_region(made, "track", "vec_id", 200)
    edges = [c for c in out.columns if c not in ("track", "vec_id", "n")]
    return out.select("track", "vec_id", "n", *(F.coalesce(c, F.lit(-1)).alias(c) for c in edges))


def bayer_dither(spark, sf):
    made = bytes_of(pix(spark, sf))
    return made.select("vec_id", "i", X.ordered_dither(F.col("x"), F.col("y"), F.col("v")).alias("v"))


def chroma_subsample(spark, sf):
    made = bytes_of(pix(spark, sf)).withColumn("w", 255 - F.col("v"))
    return X.chroma_means(made, "vec_id", ["v", "w"])


def dc_predict(spark, sf):
    return X.dc_prediction(bytes_of(pix(spark, sf)), "vec_id")


def block_stats(spark, sf):
    return pix(spark, sf).groupBy("vec_id", F.shiftright("x", 2).alias("bx"), F.shiftright("y", 2).alias("by")).agg(
        F.count(F.when(F.col("v") >= 0, 1)).cast("long").alias("visible"), F.coalesce(F.sum(F.when(F.col("v") >= 0, F.col("v"))), F.lit(0)).cast("long").alias("luma")
    )


def to_rgba8(spark, sf):
    made = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return made.select("vec_id", F.col("i").cast("long").alias("i"), S.to_byte(F.col("e").cast("double")).alias("b"), S.to_s16(F.col("e").cast("double")).cast("int").alias("s16"))


def haar_wht4(spark, sf):
    groups = pix(spark, sf).groupBy("vec_id", F.shiftright("i", 2).alias("g")).agg(*(F.max(F.when(F.col("i") % 4 == k, F.col("v"))).alias(f"v{k}") for k in range(4)))
    out = T.walsh4(*(F.col(f"v{k}") for k in range(4)))
    return groups.select("vec_id", "g", *(c.cast("long").alias(f"w{k}") for k, c in enumerate(out)))


def dct_basis_join(spark, sf):
    """Every eight elements of a vector are a block."""
    out = T.basis_transform(parts_of(spark, sf, 8), ["vec_id", "block"], "part", T.cosine_basis(8))
    return out.select("vec_id", "block", "k", (F.round("coef", 4) + 0.0).alias("coef"))


def quantize_deadzone(spark, sf):
    return T.quantise(pix(spark, sf), "i", "v", 6, 9).select("vec_id", "i", "q", "r")


def zero_run_tokens(spark, sf):
    made = T.quantise(pix(spark, sf), "i", "v", 12, 16)
    return T.zero_run_tokens(made, "vec_id", "i", "q")


def spectrum_peaks(spark, sf):
    made = table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("long")))
    return T.band_peaks(made, "vec_id", "v")


def overlap_add(spark, sf):
    return T.overlap_add(pix(spark, sf), "vec_id", "i", "v", 16)


def level_lookup(spark, sf):
    made = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return T.level_of(made, "o_totalprice", LEVELS, 62).select("o_orderkey", "level")


P8 = f"(SELECT vec_id, i, x, y, ((v % 256) + 256) % 256 AS v FROM {PIX})"
PAL = ", ".join(f"({e}, {', '.join(map(str, p))})" for e, p in enumerate(PALETTE))
COST = "CASE WHEN ({0} & 255) < 128 THEN ({0} & 255) ELSE 256 - ({0} & 255) END"
PAETH = """CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END"""
MOVES = {1: ("x", "y"), 2: ("7 - x", "y"), 3: ("7 - x", "7 - y"), 4: ("x", "7 - y"), 5: ("y", "x"), 6: ("7 - y", "x"), 7: ("7 - y", "7 - x"), 8: ("y", "7 - x")}
PIXEL4 = f"""(SELECT vec_id, i // 4 AS p, max(v) FILTER (i % 4 = 0) AS r, max(v) FILTER (i % 4 = 1) AS g, max(v) FILTER (i % 4 = 2) AS b, max(v) FILTER (i % 4 = 3) AS a
    FROM {P8} GROUP BY vec_id, i // 4)"""
BAYER = "(CAST((xor(x, y) & 1) * 32 + (y & 1) * 16 + (xor(x, y) >> 1 & 1) * 8 + (y >> 1 & 1) * 4 + (xor(x, y) >> 2 & 1) * 2 + (y >> 2 & 1) AS BIGINT))"
DZ = "CAST(sign(v) * ((abs(v) + (CASE WHEN i = 0 THEN {0} ELSE {1} END) // 2) // (CASE WHEN i = 0 THEN {0} ELSE {1} END)) AS BIGINT)"
SQL = {
    "color_histogram_555": """
        WITH c AS (SELECT l_returnflag, CAST(trunc(l_quantity) AS BIGINT) * 5 % 256 AS r, l_partkey * 3 % 256 AS g, l_suppkey * 7 % 256 AS b FROM lineitem)
        SELECT l_returnflag, CAST(((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS BIGINT) AS bin, count(*) AS n,
               CAST(sum(r & 7) AS BIGINT) AS r_low, CAST(sum(g & 7) AS BIGINT) AS g_low, CAST(sum(b & 7) AS BIGINT) AS b_low FROM c GROUP BY 1, 2
    """,
    "exact_palette": """
        WITH d AS (SELECT DISTINCT CAST(p_size * 65536 + length(p_brand) AS BIGINT) AS color FROM part)
        SELECT CAST(row_number() OVER (ORDER BY color) - 1 AS INT) AS rank, color FROM d QUALIFY count(*) OVER () <= 256
    """,
    "nearest_palette": f"""
        WITH b AS (SELECT vec_id, embedding, CAST(unnest(range(len(embedding) // 4)) AS INT) AS block FROM embeddings),
        p AS (SELECT vec_id, block, {", ".join(f"CAST(round(CAST(embedding[block * 4 + {k + 1}] AS DOUBLE) * 100) AS BIGINT) AS c{k}" for k in range(4))} FROM b),
        d AS (SELECT vec_id, block, e, {" + ".join(f"(c{k} - p{k}) * (c{k} - p{k})" for k in range(4))} AS d FROM p, (VALUES {PAL}) t(e, p0, p1, p2, p3))
        SELECT vec_id, block, CAST(e AS INT) AS entry, CAST(d AS BIGINT) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id, block ORDER BY d, e) = 1
    """,
    "downsample_2x2": f"SELECT vec_id, x >> 1 AS x, y >> 1 AS y, CAST((sum(v) + 2) >> 2 AS BIGINT) AS v FROM {PIX} GROUP BY vec_id, x >> 1, y >> 1",
    "png_filter_pick": f"""
        WITH n AS (SELECT vec_id, x, y, v, coalesce(lag(v) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS a, coalesce(lag(v) OVER (PARTITION BY vec_id, x ORDER BY y), 0) AS b FROM {P8}),
        c AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS c FROM n),
        e AS (SELECT vec_id, y, v AS e0, v - a AS e1, v - b AS e2, v - ((a + b) >> 1) AS e3, v - ({PAETH}) AS e4 FROM c),
        s AS (SELECT vec_id, y, {", ".join(f"sum({COST.format(f'e{k}')}) AS s{k}" for k in range(5))} FROM e GROUP BY 1, 2),
        u AS ({" UNION ALL ".join(f"SELECT vec_id, y, {k} AS f, s{k} AS cost FROM s" for k in range(5))})
        SELECT vec_id, y, CAST(f AS INT) AS filter, CAST(cost AS BIGINT) AS cost FROM u QUALIFY row_number() OVER (PARTITION BY vec_id, y ORDER BY cost, f) = 1
    """,
    "psnr_sse": f"""
        WITH s AS (SELECT a.vec_id, count(*) AS n, CAST(sum((a.v - b.v) * (a.v - b.v)) AS BIGINT) AS sse FROM {P8} a JOIN {P8} b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1)
        SELECT vec_id, n, sse, CASE WHEN sse > 0 THEN round(10 * log10(65025.0::DOUBLE * n / sse), 4) ELSE -1 END AS psnr FROM s
    """,
    "motion_search": f"""
        WITH m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS at0, CAST(floor(x / 100) AS BIGINT) AS v FROM {EV}),
        z AS (SELECT user_id, at0 // 8 AS block, count(*) AS size FROM m GROUP BY 1, 2),
        j AS (SELECT a.user_id, a.at0 // 8 AS block, o - 8 AS off0, count(*) AS n, sum(abs(a.v - b.v)) AS sad
              FROM m a, range(17) r(o), m b WHERE a.user_id = b.user_id AND b.at0 + 3 = a.at0 + o - 8 GROUP BY 1, 2, 3),
        c AS (SELECT j.user_id, j.block, off0, 16 * sad + abs(off0) * 4 AS cost FROM j JOIN z ON j.user_id = z.user_id AND j.block = z.block AND n = size)
        SELECT user_id, block, CAST(off0 AS INT) AS "offset", CAST(cost AS BIGINT) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY user_id, block ORDER BY cost, off0) = 1
    """,
    "pad_crop": f"""
        SELECT g.vec_id, g.x, g.y, coalesce(p.v, 0) AS v FROM (SELECT vec_id, x, y FROM (SELECT vec_id FROM embeddings), range(8) a(x), range(7) b(y)) g
        LEFT JOIN (SELECT * FROM {PIX} WHERE x < 6 AND y < 6) p USING (vec_id, x, y)
    """,
    "orientation": " UNION ALL ".join(
        f"SELECT vec_id, CAST(sum(v * (({y}) * 8 + ({x}))) AS BIGINT) AS moment, {o} AS orientation FROM {PIX} GROUP BY vec_id" for o, (x, y) in MOVES.items()
    ),
    "opaque_grey": f"SELECT vec_id, bool_and(a >= 128) AS opaque, bool_and(r = g AND r = b) AS grey, count(*) FILTER (a < 128) AS clear FROM {PIXEL4} GROUP BY 1",
    "luma_of": f"SELECT vec_id, p, CAST((16839 * r + 33059 * g + 6420 * b + 32768 + 16 * 65536) >> 16 AS BIGINT) AS luma FROM {PIXEL4}",
    "changed_rect": f"""
        WITH d AS (SELECT vec_id % 5 AS track, vec_id, x, y, abs(v - lag(v) OVER (PARTITION BY vec_id % 5, x, y ORDER BY vec_id)) > 200 AS c FROM {PIX})
        SELECT track, vec_id, count(*) FILTER (c) AS n, coalesce(min(x) FILTER (c), -1) AS min_x, coalesce(max(x) FILTER (c), -1) AS max_x,
               coalesce(min(y) FILTER (c), -1) AS min_y, coalesce(max(y) FILTER (c), -1) AS max_y FROM d GROUP BY 1, 2
    """,
    "bayer_dither": f"SELECT vec_id, i, greatest(0, least(255, v + (((2 * {BAYER} - 63) * 16) >> 6))) AS v FROM {P8}",
    "chroma_subsample": f"""
        SELECT vec_id, x >> 1 AS x, y >> 1 AS y, CAST((sum(v) * 2 + 4) // 8 AS BIGINT) AS v, CAST((sum(255 - v) * 2 + 4) // 8 AS BIGINT) AS w
        FROM {P8} GROUP BY vec_id, x >> 1, y >> 1
    """,
    "dc_predict": f"""
        WITH p AS (SELECT * FROM {P8}), e AS (
            SELECT vec_id, x // 4 AS bx, y // 4 + 1 AS by0, v FROM p WHERE y % 4 = 3 UNION ALL SELECT vec_id, x // 4 + 1, y // 4, v FROM p WHERE x % 4 = 3
        ), s AS (SELECT vec_id, bx, by0, (2 * sum(v) + count(*)) // (2 * count(*)) AS dc FROM e GROUP BY 1, 2, 3)
        SELECT b.vec_id, b.bx, b.by0 AS "by", CAST(coalesce(dc, 128) AS BIGINT) AS dc
        FROM (SELECT DISTINCT vec_id, x // 4 AS bx, y // 4 AS by0 FROM p) b LEFT JOIN s USING (vec_id, bx, by0)
    """,
    "block_stats": f"""
        SELECT vec_id, x >> 2 AS bx, y >> 2 AS "by", count(*) FILTER (v >= 0) AS visible, CAST(coalesce(sum(v) FILTER (v >= 0), 0) AS BIGINT) AS luma
        FROM {PIX} GROUP BY vec_id, x >> 2, y >> 2
    """,
    "to_rgba8": """
        SELECT vec_id, i, CAST(trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, e * 255))) AS INT) AS b, CAST(greatest(-32768, least(32767, round_even(e * 32768, 0))) AS INT) AS s16
        FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)
    """,
    "haar_wht4": f"""
        WITH g AS (SELECT vec_id, i >> 2 AS g, {", ".join(f"max(v) FILTER (i % 4 = {k}) AS v{k}" for k in range(4))} FROM {PIX} GROUP BY vec_id, i >> 2)
        SELECT vec_id, g, v0 + v1 + v2 + v3 AS w0, v0 - v1 + v2 - v3 AS w1, v0 + v1 - v2 - v3 AS w2, v0 - v1 - v2 + v3 AS w3 FROM g
    """,
    "dct_basis_join": """
        WITH u AS (SELECT vec_id, unnest(range(len(embedding) // 8 * 8)) AS p, CAST(unnest(embedding[1:len(embedding) // 8 * 8]) AS DOUBLE) AS x FROM embeddings),
        e AS (SELECT vec_id, CAST(p // 8 AS INT) AS block, p % 8 AS i, x FROM u)
        SELECT vec_id, block, CAST(k AS INT) AS k, round(sum(x * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 8.0::DOUBLE) * cos(pi() * (2 * i + 1) * k / 16)), 4) + 0.0::DOUBLE AS coef
        FROM e, range(8) r(k) GROUP BY vec_id, block, k
    """,
    "quantize_deadzone": f"SELECT vec_id, i, {DZ.format(6, 9)} AS q, {DZ.format(6, 9)} * (CASE WHEN i = 0 THEN 6 ELSE 9 END) AS r FROM {PIX}",
    "zero_run_tokens": f"""
        WITH q AS (SELECT vec_id, i, {DZ.format(12, 16)} AS q FROM {PIX})
        SELECT vec_id, i, i - coalesce(lag(i) OVER (PARTITION BY vec_id ORDER BY i), -1) - 1 AS run, q FROM q WHERE q <> 0
    """,
    "spectrum_peaks": f"SELECT vec_id, max(abs(v)) FILTER (i < 32) AS low, max(abs(v)) FILTER (i >= 32) AS high FROM {PIX} GROUP BY 1",
    "overlap_add": f"SELECT vec_id, i AS t, CAST(v * 32 AS BIGINT) AS v FROM {PIX}",
    "level_lookup": f"""
        SELECT o_orderkey, CAST(coalesce((SELECT min(n) FROM (VALUES {", ".join(f"({a}, {b})" for a, b in LEVELS)}) l(most, n) WHERE o_totalprice <= most), 62) AS INT) AS level FROM orders
    """,
}
QUERIES = {name: globals()[name] for name in SQL}
