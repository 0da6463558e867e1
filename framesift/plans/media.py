"""Queries of colour, block prediction, filters and container timing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framesift.functions import scalars as S
from framesift.operators import color as C
from framesift.operators import signal as G
from framesift.plans.common import EV, PIX, millis, samples, table
from framesift.plans.pixels import bytes_of, pix

ORDER = ["ts", "event_id"]
TAPS = (3, -9, 21, 34, 21, -9, 3)
PALETTE = [(i * 2654435761) % 16777216 for i in range(100)]


def rgb(spark, sf):
    """l_orderkey, l_linenumber and three byte channels of each row."""
    channel = lambda c, k, n: (F.col(c).cast("long") * k % 256).alias(n)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", channel("l_quantity", 5, "r"), channel("l_partkey", 3, "g"), channel("l_suppkey", 7, "b"))


def numbered(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1
    return samples(spark, sf).withColumn("i", n.cast("long"))


def rgb_to_yuv(spark, sf):
    r, g, b = (F.col(c) for c in "rgb")
    u, v = C.chroma(r, g, b)
    return rgb(spark, sf).select("l_orderkey", "l_linenumber", S.luma(r, g, b).cast("long").alias("y"), u.cast("long").alias("u"), v.cast("long").alias("v"))


def yuv_to_rgb(spark, sf):
    out = C.to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, sf).select("l_orderkey", "l_linenumber", *(c.cast("long").alias(n) for c, n in zip(out, ("red", "green", "blue"), strict=True)))


def green_and_cross(spark, sf):
    r, g, b = (F.col(c) for c in "rgb")
    r1, b1 = C.subtract_green(r, g, b)
    made = rgb(spark, sf).select("l_orderkey", "l_linenumber", "r", "g", "b", r1.alias("r1"), b1.alias("b1"))
    r2, b2 = C.add_green(F.col("r1"), F.col("g"), F.col("b1"))
    r3, b3 = C.cross_color(r, g, b, F.lit(13), F.lit(-7), F.lit(5))
    return made.select("l_orderkey", "l_linenumber", "r1", "b1", r2.alias("r2"), b2.alias("b2"), r3.cast("long").alias("r3"), b3.cast("long").alias("b3"))


def chroma_upsample(spark, sf):
    return C.upsampled(bytes_of(pix(spark, sf)), "vec_id", 16, 16)


def inverse_coupling(spark, sf):
    a, b = C.inverse_coupling(F.col("x") - 5000, F.col("user_id") - 70)
    return samples(spark, sf).select("event_id", a.cast("long").alias("first"), b.cast("long").alias("second"))


def intra_modes(spark, sf):
    return C.predicted_blocks(bytes_of(pix(spark, sf)), "vec_id")


def edge_filter(spark, sf):
    return C.edge_filter(bytes_of(pix(spark, sf)), "vec_id").select("vec_id", "x", "y", "v")


def inter_residual(spark, sf):
    frames = pix(spark, sf).withColumn("track", F.col("vec_id") % 4).withColumn("frame", F.floor(F.col("vec_id") / 4).cast("long"))
    return C.compensated(frames, "track", "frame", F.lit(2), F.lit(-1), 8, 8)


def tile_predictors(spark, sf):
    return C.tile_predictors(bytes_of(pix(spark, sf)), "vec_id")


def palette_lookup(spark, sf):
    made = samples(spark, sf).select("event_id", (F.col("x") % 128).alias("index"))
    return C.palette_lookup(made, "index", PALETTE)


def global_palette(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("c"))
    lines = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("c"))
    both = parts.unionByName(lines).distinct()
    # the colours are byte values, so the rank's one partition has 256 rows at most
    return both.where("c BETWEEN 0 AND 255").select((F.row_number().over(Window.orderBy("c")) - 1).cast("int").alias("rank"), "c")


def fir_filter(spark, sf):
    return G.fir(samples(spark, sf), "user_id", ORDER, "x", TAPS, 6)


def decimate(spark, sf):
    return G.fir(samples(spark, sf), "user_id", ORDER, "x", (1, 2, 1), 2, 2)


def block_switching(spark, sf):
    return G.block_types(G.attacks(samples(spark, sf), "user_id", ORDER, "x", 4, 2), "user_id")


def pair_energy(spark, sf):
    return G.pair_energy(numbered(spark, sf), "user_id", "i", "x", 6)


def cross_fade(spark, sf):
    w = F.shiftright(F.col("i") * F.col("i") * 7 % 32768, 0)
    old = F.lag("x").over(Window.partitionBy("user_id").orderBy("i"))
    made = numbered(spark, sf).withColumn("old", F.coalesce(old, F.lit(0)))
    return made.select("event_id", G.cross_fade(F.col("old"), F.col("x"), w).cast("long").alias("v"))


def windowed_product(spark, sf):
    """Samples of blocks of 16 times an integer window that a small table holds."""
    window = spark.range(16).select(F.col("id").alias("k"), (F.col("id") * (15 - F.col("id")) + 1).alias("w"))
    made = numbered(spark, sf).withColumn("k", F.col("i") % 16)
    # the window has 16 rows
    return made.join(F.broadcast(window), "k").select("event_id", (F.col("x") * F.col("w")).alias("v"))


def floor_residue(spark, sf):
    floor = pix(spark, sf).select("vec_id", "i", F.abs("v").alias("f"))
    residue = pix(spark, sf).select((F.col("vec_id") + 1).alias("vec_id"), "i", F.col("v").alias("r"))
    return floor.join(residue, ["vec_id", "i"]).select("vec_id", "i", (F.col("f") * F.col("r")).alias("v"))


def interleave_channels(spark, sf):
    """Four channels a file: track 4 f + c is channel c of file f; what a channel lacks at a place is silence."""
    made = numbered(spark, sf).select(F.floor(F.col("user_id") / 4).cast("long").alias("file"), F.pmod("user_id", F.lit(4)).alias("c"), "i", "x")
    whole = made.groupBy("file", "i").agg(*(F.coalesce(F.max(F.when(F.col("c") == c, F.col("x"))), F.lit(0)).alias(f"c{c}") for c in range(4)))
    each = F.posexplode(F.array(*(f"c{c}" for c in range(4)))).alias("c", "v")
    return whole.select("file", "i", each).select("file", (F.col("i") * 4 + F.col("c")).cast("long").alias("at"), "v")


def widen_16(spark, sf):
    return bytes_of(pix(spark, sf)).select("vec_id", "i", (F.col("v") * 257).alias("v"))


def crf_qindex(spark, sf):
    made = table(spark, sf, "orders").withColumn("crf", F.pmod("o_orderkey", F.lit(64)))
    return made.select("o_orderkey", S.qindex_of_crf(F.col("crf")).alias("qindex"))


def video_times(spark, sf):
    made = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return G.sample_times(made, "k", 30000 * 4, 30000, 1001)


def cluster_cuts(spark, sf):
    made = samples(spark, sf).withColumn("t", F.floor(millis(F.col("ts")) / 3600).cast("long")).withColumn("key", F.col("event_type") == "purchase")
    return G.cluster_cuts(made, "user_id", ORDER, "t", "x", "key", 50_000_000, 60_000, 20_000)


def bit_reservoir(spark, sf):
    return G.reservoir(samples(spark, sf), "user_id", ORDER, "x", 5000, 8000)


def dc_reject(spark, sf):
    return G.first_order(samples(spark, sf), "user_id", ORDER, "x", 0.5).select("user_id", "n", (F.round("y", 3) + 0.0).alias("y"))


def tile_entropy(spark, sf):
    made = bytes_of(pix(spark, sf)).withColumn("s", F.shiftright("v", 5))
    counts = made.groupBy("vec_id", "s").agg(F.count("*").alias("n"))
    return counts.groupBy("vec_id").agg((F.round(F.sum(-F.col("n") * F.log2(F.col("n") / 64)), 4) + 0.0).alias("bits"))


RGB = "(SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) * 5 % 256 AS r, l_partkey * 3 % 256 AS g, l_suppkey * 7 % 256 AS b FROM lineitem)"
NUM = f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM {EV})"
P8 = f"(SELECT vec_id, i, x, y, ((v % 256) + 256) % 256 AS v FROM {PIX})"
SGN = "(CASE WHEN {0} > 127 THEN {0} - 256 ELSE {0} END)"
CLIP = "greatest(0, least(255, {0}))"
FIR = " + ".join(f"{t} * coalesce(lag(x, {i}) OVER o, 0)" for i, t in enumerate(TAPS))
SQL = {
    "rgb_to_yuv": f"""
        SELECT l_orderkey, l_linenumber, CAST((16839 * r + 33059 * g + 6420 * b + 1081344) >> 16 AS BIGINT) AS y,
               CAST((-9719 * r - 19081 * g + 28800 * b + 8421376) >> 16 AS BIGINT) AS u, CAST((28800 * r - 24116 * g - 4684 * b + 8421376) >> 16 AS BIGINT) AS v FROM {RGB}
    """,
    "yuv_to_rgb": f"""
        SELECT l_orderkey, l_linenumber, {CLIP.format("(19077 * (r - 16) + 26149 * (b - 128) + 8192) >> 14")} AS red,
               {CLIP.format("(19077 * (r - 16) - 6419 * (g - 128) - 13320 * (b - 128) + 8192) >> 14")} AS green,
               {CLIP.format("(19077 * (r - 16) + 33050 * (g - 128) + 8192) >> 14")} AS blue FROM {RGB}
    """,
    "green_and_cross": f"""
        SELECT l_orderkey, l_linenumber, (r - g) & 255 AS r1, (b - g) & 255 AS b1, r AS r2, b AS b2, (r - ((13 * {SGN.format("g")}) >> 5)) & 255 AS r3,
               (b - ((-7 * {SGN.format("g")}) >> 5) - ((5 * {SGN.format("r")}) >> 5)) & 255 AS b3 FROM {RGB}
    """,
    "chroma_upsample": f"""
        WITH s AS (SELECT vec_id, 2 * x + d1 AS px, 2 * y + d2 AS py, w1 * w2 AS w, v FROM {P8}, (VALUES (-1, 1), (0, 3), (1, 3), (2, 1)) a(d1, w1), (VALUES (-1, 1), (0, 3), (1, 3), (2, 1)) b(d2, w2))
        SELECT vec_id, CAST(px AS BIGINT) AS x, CAST(py AS BIGINT) AS y, CAST((2 * sum(w * v) + sum(w)) // (2 * sum(w)) AS BIGINT) AS v
        FROM s WHERE px BETWEEN 0 AND 15 AND py BETWEEN 0 AND 15 GROUP BY 1, 2, 3
    """,
    "inverse_coupling": f"""
        WITH c AS (SELECT event_id, x - 5000 AS m, user_id - 70 AS a FROM {EV})
        SELECT event_id, CASE WHEN m > 0 THEN CASE WHEN a > 0 THEN m ELSE m + a END ELSE CASE WHEN a > 0 THEN m - a ELSE m END END AS first,
               CASE WHEN m > 0 THEN CASE WHEN a > 0 THEN m - a ELSE m END ELSE CASE WHEN a > 0 THEN m ELSE m + a END END AS second FROM c
    """,
    "intra_modes": f"""
        WITH p AS (SELECT *, x // 4 AS bx, y // 4 AS b0 FROM {P8}),
        n AS (SELECT p.*, CASE WHEN b0 = 0 THEN 127 ELSE u.v END AS up, CASE WHEN p.bx = 0 THEN 129 ELSE l.v END AS lf,
                     CASE WHEN b0 = 0 THEN 127 WHEN p.bx = 0 THEN 129 ELSE c.v END AS co
              FROM p LEFT JOIN {P8} u ON u.vec_id = p.vec_id AND u.x = p.x AND u.y = p.b0 * 4 - 1
              LEFT JOIN {P8} l ON l.vec_id = p.vec_id AND l.x = p.bx * 4 - 1 AND l.y = p.y
              LEFT JOIN {P8} c ON c.vec_id = p.vec_id AND c.x = p.bx * 4 - 1 AND c.y = p.b0 * 4 - 1),
        d AS (SELECT *, (sum(CASE WHEN y = b0 * 4 THEN up ELSE 0 END) OVER w + sum(CASE WHEN x = bx * 4 THEN lf ELSE 0 END) OVER w + 4) // 8 AS dc
              FROM n WINDOW w AS (PARTITION BY vec_id, bx, b0)),
        s AS (SELECT vec_id, bx, b0, sum(abs(v - dc)) AS m0, sum(abs(v - up)) AS m1, sum(abs(v - lf)) AS m2, sum(abs(v - {CLIP.format("lf + up - co")})) AS m3 FROM d GROUP BY 1, 2, 3),
        a AS ({" UNION ALL ".join(f"SELECT vec_id, bx, b0, {k} AS mode, m{k} AS cost FROM s" for k in range(4))})
        SELECT vec_id, bx, b0 AS "by", mode, CAST(cost AS BIGINT) AS cost FROM a QUALIFY row_number() OVER (PARTITION BY vec_id, bx, b0 ORDER BY cost, mode) = 1
    """,
    "edge_filter": f"""
        WITH n AS (SELECT *, lag(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS l, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS r FROM {P8}),
        o AS (SELECT *, CASE WHEN x % 4 = 0 AND x > 0 THEN l WHEN x % 4 = 3 THEN r END AS o FROM n)
        SELECT vec_id, x, y, CASE WHEN o IS NOT NULL AND abs(o - v) <= 60 THEN v + ((o - v) >> 2) ELSE v END AS v FROM o
    """,
    "inter_residual": f"""
        WITH f AS (SELECT vec_id % 4 AS track, vec_id // 4 AS frame, x, y, v FROM {PIX})
        SELECT a.track, a.frame, a.x, a.y, a.v - b.v AS residual FROM f a JOIN f b ON a.track = b.track AND b.frame + 1 = a.frame AND b.x = least(7, a.x + 2) AND b.y = greatest(0, a.y - 1)
    """,
    "tile_predictors": f"""
        WITH n AS (SELECT vec_id, x, y, v, coalesce(lag(v) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS l, coalesce(lag(v) OVER (PARTITION BY vec_id, x ORDER BY y), 0) AS t FROM {P8}),
        c AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS c FROM n),
        e AS (SELECT vec_id, x // 4 AS tx, y // 4 AS ty, v, unnest([l, t, (l + t) >> 1, {CLIP.format("l + t - c")}]) AS g, unnest([0, 1, 2, 3]) AS predictor FROM c),
        s AS (SELECT vec_id, tx, ty, predictor, sum(least((v - g) & 255, 256 - ((v - g) & 255))) AS cost FROM e GROUP BY ALL)
        SELECT vec_id, tx, ty, predictor, CAST(cost AS BIGINT) AS cost FROM s QUALIFY row_number() OVER (PARTITION BY vec_id, tx, ty ORDER BY cost, predictor) = 1
    """,
    "palette_lookup": f'SELECT event_id, x % 128 AS "index", CASE WHEN x % 128 BETWEEN 0 AND 99 THEN (x % 128) * 2654435761 % 16777216 ELSE 0 END AS color FROM {EV}',
    "global_palette": """
        WITH c AS (SELECT CAST(p_size AS BIGINT) AS c FROM part UNION SELECT CAST(trunc(l_quantity) AS BIGINT) FROM lineitem)
        SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS rank, c FROM c WHERE c BETWEEN 0 AND 255
    """,
    "fir_filter": f"SELECT user_id, row_number() OVER o - 1 AS n, ({FIR} + 32) >> 6 AS y FROM {EV} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "decimate": f"""
        WITH f AS (SELECT user_id, row_number() OVER o - 1 AS n, (x + 2 * coalesce(lag(x) OVER o, 0) + coalesce(lag(x, 2) OVER o, 0) + 2) >> 2 AS y
                   FROM {EV} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, n // 2 AS n, y FROM f WHERE n % 2 = 0
    """,
    "block_switching": f"""
        WITH e AS (SELECT user_id, i // 4 AS block, sum(x * x) AS e FROM {NUM} GROUP BY 1, 2),
        a AS (SELECT user_id, block, count(e) OVER w > 0 AND e > 1 AND e * count(e) OVER w > 2 * coalesce(sum(e) OVER w, 0) AS a
              FROM e WINDOW w AS (PARTITION BY user_id ORDER BY block ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
        s AS (SELECT user_id, block, a OR (coalesce(lag(a) OVER o, false) AND coalesce(lead(a) OVER o, false)) AS s FROM a WINDOW o AS (PARTITION BY user_id ORDER BY block))
        SELECT user_id, block, CASE WHEN s THEN 2 WHEN coalesce(lead(s) OVER o, false) THEN 1 WHEN coalesce(lag(s) OVER o, false) THEN 3 ELSE 0 END AS type
        FROM s WINDOW o AS (PARTITION BY user_id ORDER BY block)
    """,
    "pair_energy": f"""
        WITH p AS (SELECT user_id, i // 2 AS p, CAST(sum(x * x) AS BIGINT) AS e FROM {NUM} GROUP BY 1, 2) SELECT user_id, CAST(sum(e >> 6) AS BIGINT) AS energy FROM p GROUP BY 1
    """,
    "cross_fade": f"""
        WITH n AS (SELECT event_id, x, i * i * 7 % 32768 AS w, coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY i), 0) AS o FROM {NUM})
        SELECT event_id, (w * x + (32767 - w) * o) >> 15 AS v FROM n
    """,
    "windowed_product": f"SELECT event_id, x * ((i % 16) * (15 - i % 16) + 1) AS v FROM {NUM}",
    "floor_residue": f"SELECT a.vec_id, a.i, abs(a.v) * b.v AS v FROM {PIX} a JOIN {PIX} b ON b.vec_id + 1 = a.vec_id AND a.i = b.i",
    "interleave_channels": f"""
        WITH g AS (SELECT DISTINCT CAST(floor(user_id / 4.0) AS BIGINT) AS file, i FROM {NUM})
        SELECT g.file, CAST(g.i * 4 + c AS BIGINT) AS "at", coalesce(n.x, 0) AS v FROM g CROSS JOIN range(4) r(c) LEFT JOIN {NUM} n ON n.user_id = g.file * 4 + c AND n.i = g.i
    """,
    "widen_16": f"SELECT vec_id, i, v * 257 AS v FROM {P8}",
    "crf_qindex": """
        SELECT o_orderkey, CAST(CASE o_orderkey % 64 WHEN 63 THEN 255 WHEN 62 THEN 249 WHEN 0 THEN 1 ELSE 4 * (o_orderkey % 64) END AS INT) AS qindex FROM orders
    """,
    "video_times": "SELECT o_orderkey AS k, o_orderkey * 4 * 1001 AS dts, CAST(4004 AS BIGINT) AS duration FROM orders",
    "dc_reject": f"""
        SELECT user_id, i AS n, round((SELECT sum((b.x - b.p) * pow(0.5, a.i - b.i)) FROM (SELECT *, coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY i), 0) AS p FROM {NUM}) b
               WHERE b.user_id = a.user_id AND b.i <= a.i), 3) + 0.0::DOUBLE AS y FROM {NUM} a
    """,
    "tile_entropy": f"""
        WITH c AS (SELECT vec_id, v >> 5 AS s, count(*) AS n FROM {P8} GROUP BY 1, 2) SELECT vec_id, round(sum(-n * log2(n / 64.0::DOUBLE)), 4) + 0.0::DOUBLE AS bits FROM c GROUP BY 1
    """,
}
QUERIES = {name: globals()[name] for name in (*SQL, "cluster_cuts", "bit_reservoir")}
