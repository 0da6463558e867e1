"""Queries of packet layout: offsets, interleaving, runs, key frames, gaps, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import layout as L
from framesift.plans.common import EV, millis, samples, table

ORDER = ["ts", "event_id"]


def frame_offsets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return L.exclusive_offsets(docs, ["doc_id"], "n").select("doc_id", "n", "offset")


def track_offsets(spark, sf):
    talk = table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n"))
    return L.exclusive_offsets(talk, ["turn"], "n", "conv_id").select("conv_id", "turn", "offset")


def mux_interleave(spark, sf):
    made = samples(spark, sf).withColumn("day", F.to_date("ts"))
    out = L.interleave(made, ["day"], ["ts"], "user_id", "event_id")
    return out.select("event_id", "user_id", "position")


def chunk_runs(spark, sf):
    talk = table(spark, sf, "conversations").withColumn("n", F.octet_length("text"))
    return L.chunk_runs(talk, ["conv_id"], ["turn"], "role", "n").select("conv_id", "chunk", "role", "n", "bytes")


def sample_table_stts(spark, sf):
    return L.duration_runs(samples(spark, sf), "user_id", ORDER, F.floor(millis(F.col("ts")) / 60000))


def sync_samples(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    made = samples(spark, sf).withColumn("sample", n.cast("long"))
    return made.where("event_type = 'purchase'").select("user_id", "sample")


def keyframe_groups(spark, sf):
    return L.running_groups(samples(spark, sf), "user_id", ORDER, F.col("event_type") == "purchase").select("event_id", "gop")


def track_stats(spark, sf):
    made = samples(spark, sf).withColumn("t", millis(F.col("ts")))
    seconds = (F.max("t") - F.min("t")) / 1000
    bits = F.sum(F.abs("x")).cast("long")
    return made.groupBy("user_id").agg(
        F.count("*").cast("long").alias("packets"), bits.alias("size"), (F.max("t") - F.min("t")).cast("long").alias("millis"),
        F.max(F.abs("x")).cast("long").alias("largest"), F.when(seconds > 0, F.floor(8 * bits / seconds)).cast("long").alias("bitrate"),
    )


def demux_join(spark, sf):
    tracks = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("codec"))
    joined = samples(spark, sf).join(tracks, "user_id")
    return joined.groupBy("codec", "event_type").agg(F.count("*").cast("long").alias("n"), F.sum("x").cast("long").alias("s"))


def alpha_left_join(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", "n_chars", F.col("quality").isNotNull().alias("has_alpha"), F.coalesce("quality", F.lit(-1)).alias("quality"))


def loss_gaps(spark, sf):
    return L.gaps(samples(spark, sf), "user_id", ORDER, millis(F.col("ts")), 3_600_000, 1_800_000)


def carry_forward(spark, sf):
    made = samples(spark, sf).withColumn("shown", F.when(F.col("event_type") == "view", F.col("x")))
    return L.carry_forward(made, "user_id", ORDER, "shown", "canvas").select("event_id", F.coalesce("canvas", F.lit(-1)).alias("canvas"))


def drop_repeats(spark, sf):
    return L.merge_repeats(samples(spark, sf), "user_id", ORDER, "event_type", "x").select("user_id", "first", "frames", "duration")


def tumbling_20s(spark, sf):
    made = samples(spark, sf).withColumn("at", F.floor(millis(F.col("ts")) / 20000).cast("long"))
    return made.groupBy("user_id", "at").agg(F.count("*").cast("long").alias("n"), F.sum("x").cast("long").alias("s"))


def sliding_half_overlap(spark, sf):
    half = F.floor(millis(F.col("ts")) / 3_600_000).cast("long")
    made = samples(spark, sf).select("event_type", "x", F.explode(F.array(half, half - 1)).alias("block"))
    return made.groupBy("event_type", "block").agg(F.count("*").cast("long").alias("n"), F.sum("x").cast("long").alias("s"))


def probability_adapt(spark, sf):
    from framesift.operators.transforms import adapted

    made = samples(spark, sf).select("user_id", (F.col("x") >= 5000).alias("one"))
    return adapted(made.select("user_id", F.when(~F.col("one"), 1).otherwise(0).alias("z"), F.when(F.col("one"), 1).otherwise(0).alias("o")), ["user_id"], "z", "o")


MS = "(epoch_us(ts) // 1000)"
SQL = {
    "frame_offsets": """
        SELECT doc_id, n, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents)
    """,
    "track_offsets": """
        SELECT conv_id, turn, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM conversations
    """,
    "mux_interleave": f"SELECT event_id, user_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, user_id, event_id) AS position FROM {EV}",
    "chunk_runs": """
        WITH m AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations),
        c AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chunk FROM m)
        SELECT conv_id, CAST(chunk AS BIGINT) AS chunk, role, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM c GROUP BY ALL
    """,
    "sample_table_stts": f"""
        WITH g AS (SELECT user_id, ts, event_id, lead({MS} // 60000) OVER o - {MS} // 60000 AS d FROM {EV} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
        f AS (SELECT user_id, ts, event_id, coalesce(d, lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS d FROM g),
        m AS (SELECT *, CASE WHEN d IS DISTINCT FROM lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM f),
        r AS (SELECT user_id, d, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, CAST(min(d) AS BIGINT) AS duration FROM r GROUP BY ALL
    """,
    "sync_samples": f"""
        SELECT user_id, sample FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample FROM {EV})
        WHERE event_type = 'purchase'
    """,
    "keyframe_groups": f"""
        SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gop
        FROM {EV}
    """,
    "track_stats": f"""
        WITH s AS (SELECT user_id, count(*) AS packets, CAST(sum(abs(x)) AS BIGINT) AS size, max({MS}) - min({MS}) AS millis, max(abs(x)) AS largest FROM {EV} GROUP BY 1)
        SELECT user_id, packets, size, CAST(millis AS BIGINT) AS millis, CAST(largest AS BIGINT) AS largest,
               CASE WHEN millis > 0 THEN CAST(floor(8 * size / (millis / 1000)) AS BIGINT) END AS bitrate FROM s
    """,
    "demux_join": f"""
        SELECT c_mktsegment AS codec, event_type, count(*) AS n, CAST(sum(x) AS BIGINT) AS s
        FROM {EV} JOIN customer ON c_custkey = user_id GROUP BY ALL
    """,
    "alpha_left_join": "SELECT doc_id, n_chars, quality IS NOT NULL AS has_alpha, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "loss_gaps": f"""
        WITH g AS (SELECT user_id, {MS} AS t0, lead({MS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {EV})
        SELECT user_id, CAST(t0 AS BIGINT) AS "at", CAST((nxt - t0 - 1) // 1800000 AS BIGINT) AS lost FROM g WHERE nxt - t0 > 3600000
    """,
    "carry_forward": f"""
        SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN x END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS canvas
        FROM {EV}
    """,
    "drop_repeats": f"""
        WITH n AS (SELECT *, row_number() OVER o AS i, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER o THEN 1 ELSE 0 END AS new
                   FROM {EV} WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM n)
        SELECT user_id, CAST(min(i) AS BIGINT) AS first, count(*) AS frames, CAST(sum(x) AS BIGINT) AS duration FROM r GROUP BY user_id, island
    """,
    "tumbling_20s": f"SELECT user_id, CAST({MS} // 20000 AS BIGINT) AS at, count(*) AS n, CAST(sum(x) AS BIGINT) AS s FROM {EV} GROUP BY ALL",
    "sliding_half_overlap": f"""
        SELECT event_type, CAST({MS} // 3600000 - k AS BIGINT) AS block, count(*) AS n, CAST(sum(x) AS BIGINT) AS s FROM {EV}, range(2) AS r(k) GROUP BY ALL
    """,
    "probability_adapt": f"""
        WITH c AS (SELECT user_id, count(*) FILTER (x < 5000) AS n0, count(*) FILTER (x >= 5000) AS n1 FROM {EV} GROUP BY 1),
        p AS (SELECT *, greatest(1, least(255, (256 * n0 + (n0 + n1) // 2) // (n0 + n1))) AS p, 128 * least(n0 + n1, 20) // 20 AS f FROM c)
        SELECT user_id, n0, n1, CAST((128 * (256 - f) + p * f + 128) >> 8 AS BIGINT) AS prob FROM p
    """,
}
QUERIES = {name: globals()[name] for name in SQL}
