"""Queries of audio prediction: residuals, Rice costs, stereo, autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions.scalars import zigzag
from framesift.operators import prediction as P
from framesift.plans.common import EV, samples, table

ORDER = ["ts", "event_id"]


def fixed_predictor_cost(spark, sf):
    return P.fixed_predictor_cost(samples(spark, sf), "user_id", ORDER, "x")


def rice_best_param(spark, sf):
    return P.best_rice_parameter(samples(spark, sf), "user_id", "x")


def rice_partition_rollup(spark, sf):
    return P.partition_sums(samples(spark, sf).withColumn("at", F.pmod(F.col("event_id"), F.lit(64))), "event_type", "at", "x")


def wasted_bits(spark, sf):
    return P.wasted_bits(samples(spark, sf).withColumn("y", F.shiftleft("x", 3)), "user_id", "y")


def constant_subframe(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return P.constant_groups(lines, "l_orderkey", "q").withColumn("constant", F.coalesce("constant", F.lit(-1)))


def mid_side(spark, sf):
    pair = samples(spark, sf).select("event_id", F.col("x").alias("l"), F.col("user_id").alias("r"))
    mid, side = P.mid_side(F.col("l"), F.col("r"))
    made = pair.select("event_id", "l", "r", mid.alias("mid"), side.alias("side"))
    left, right = P.left_right(F.col("mid"), F.col("side"))
    return made.select("event_id", "mid", "side", left.alias("left_again"), right.alias("right_again"))


def stereo_mode_choice(spark, sf):
    x, y = F.col("x"), F.col("user_id")
    mid, side = P.mid_side(x, y)
    total = lambda e: F.sum(zigzag(e))
    sums = samples(spark, sf).groupBy("event_type").agg(total(x).alias("left"), total(y).alias("right"), total(mid).alias("mid"), total(side).alias("side"))
    return P.stereo_choice(sums, "event_type")


def autocorr_lags(spark, sf):
    return P.autocorrelation(samples(spark, sf), "user_id", ORDER, "x")


def lpc_residual(spark, sf):
    made = P.residual_of_lpc(samples(spark, sf), "user_id", ORDER, "x", (29, -17, 5), 4)
    return made.groupBy("user_id").agg(F.count("*").cast("long").alias("n"), F.sum(zigzag(F.col("residual"))).cast("long").alias("s"))


def rebuild_first_order(spark, sf):
    made = P.fixed_residuals(samples(spark, sf), "user_id", ORDER, "x", 1)
    first = made.where("(ord = 1) or (ord = 0 and n = 1)").select("user_id", "n", "residual")
    return P.first_order_rebuild(first, "user_id", "n", "residual").select("user_id", F.col("n").cast("long").alias("n"), F.col("sample").cast("long").alias("sample"))


Z = "CASE WHEN {0} >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END"
BITS = "(m * ({k} + 1) + greatest(0, CAST(floor((2 * s - m * (CAST(pow(2, {k}) AS BIGINT) - 1)) / pow(2, {k} + 1)) AS BIGINT)))"

SQL = {
    "fixed_predictor_cost": f"""
        WITH w AS (
            SELECT user_id, x, lag(x, 1) OVER o AS a, lag(x, 2) OVER o AS b, lag(x, 3) OVER o AS c, lag(x, 4) OVER o AS d
            FROM {EV} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)
        ), r AS (
            SELECT user_id, 0 AS ord, x AS e FROM w UNION ALL SELECT user_id, 1, x - a FROM w UNION ALL
            SELECT user_id, 2, x - 2 * a + b FROM w UNION ALL SELECT user_id, 3, x - 3 * a + 3 * b - c FROM w UNION ALL
            SELECT user_id, 4, x - 4 * a + 6 * b - 4 * c + d FROM w
        ), t AS (
            SELECT user_id, ord, count(e) AS m, CAST(sum({Z.format("e")}) AS BIGINT) AS s FROM r WHERE e IS NOT NULL GROUP BY ALL
        ), k AS (
            SELECT *, CASE WHEN s // m >= 2 THEN least(30, length(bin(s // m)) - 2) ELSE 0 END AS k0 FROM t
        ), c AS (
            SELECT user_id, ord, k0, {BITS.format(k="k0")} AS b0, {BITS.format(k="greatest(k0 - 1, 0)")} AS b1, {BITS.format(k="least(k0 + 1, 30)")} AS b2 FROM k
        ), e AS (
            SELECT user_id, ord, k0, b2, CASE WHEN k0 > 0 AND b1 < b0 THEN b1 ELSE b0 END AS low, CASE WHEN k0 > 0 AND b1 < b0 THEN k0 - 1 ELSE k0 END AS k1 FROM c
        ), f AS (
            SELECT user_id, ord, least(low, b2) + 32 * ord AS bits, CASE WHEN b2 < low THEN least(k0 + 1, 30) ELSE k1 END AS k FROM e
        )
        SELECT user_id, CAST(ord AS INT) AS ord, CAST(k AS INT) AS k, CAST(bits AS BIGINT) AS bits
        FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY bits, ord) = 1
    """,
    "rice_best_param": f"""
        WITH u AS (SELECT user_id, {Z.format("x")} AS u FROM {EV}),
        c AS (SELECT user_id, k, sum(u >> CAST(k AS BIGINT)) + count(*) * (k + 1) AS bits FROM u, range(15) AS r(k) GROUP BY user_id, k)
        SELECT user_id, CAST(k AS INT) AS k, CAST(bits AS BIGINT) AS bits FROM c
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY bits, k) = 1
    """,
    "rice_partition_rollup": f"""
        SELECT event_type, CAST(level AS INT) AS level, CAST(((event_id % 64) * 8 // 64) >> (3 - level) AS INT) AS part,
               count(*) AS n, CAST(sum({Z.format("x")}) AS BIGINT) AS s
        FROM {EV}, range(4) AS r(level) GROUP BY ALL
    """,
    "wasted_bits": f"""
        WITH b AS (SELECT user_id, bit_or(x << 3) AS f FROM (SELECT user_id, x FROM {EV} WHERE x >= 0 UNION ALL SELECT user_id, x FROM {EV} WHERE x < 0) GROUP BY 1)
        SELECT user_id, CAST(CASE WHEN f = 0 THEN 0 ELSE length(bin(f & -f)) - 1 END AS INT) AS wasted FROM b
    """,
    "constant_subframe": """
        SELECT l_orderkey, count(*) AS n, min(q) = max(q) AS is_constant, CASE WHEN min(q) = max(q) THEN min(q) ELSE -1 END AS constant
        FROM (SELECT l_orderkey, CAST(trunc(l_quantity) AS BIGINT) AS q FROM lineitem) GROUP BY 1
    """,
    "mid_side": f"SELECT event_id, (x + user_id) >> 1 AS mid, x - user_id AS side, x AS left_again, user_id AS right_again FROM {EV}",
    "stereo_mode_choice": f"""
        WITH s AS (
            SELECT event_type, sum({Z.format("x")}) AS l, sum({Z.format("user_id")}) AS r, sum({Z.format("((x + user_id) >> 1)")}) AS m, sum({Z.format("(x - user_id)")}) AS d
            FROM {EV} GROUP BY 1
        ), c AS (
            SELECT event_type, 0 AS i, 'independent' AS mode, l + r AS cost FROM s UNION ALL SELECT event_type, 1, 'left_side', l + d FROM s
            UNION ALL SELECT event_type, 2, 'side_right', d + r FROM s UNION ALL SELECT event_type, 3, 'mid_side', m + d FROM s
        )
        SELECT event_type, mode, CAST(cost AS BIGINT) AS cost FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY cost, i) = 1
    """,
    "autocorr_lags": f"""
        WITH n AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {EV})
        SELECT a.user_id, CAST(l AS INT) AS lag, CAST(coalesce(sum(a.x * b.x), 0) AS BIGINT) AS r
        FROM n a CROSS JOIN range(5) AS t(l) LEFT JOIN n b ON a.user_id = b.user_id AND b.i = a.i - l GROUP BY ALL
    """,
    "lpc_residual": f"""
        WITH w AS (SELECT user_id, x, lag(x, 1) OVER o AS a, lag(x, 2) OVER o AS b, lag(x, 3) OVER o AS c FROM {EV} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
        e AS (SELECT user_id, x - ((29 * a - 17 * b + 5 * c) >> 4) AS e FROM w WHERE c IS NOT NULL)
        SELECT user_id, count(*) AS n, CAST(sum({Z.format("e")}) AS BIGINT) AS s FROM e GROUP BY 1
    """,
    "rebuild_first_order": f"SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, x AS sample FROM {EV}",
}
QUERIES = {name: globals()[name] for name in SQL}
