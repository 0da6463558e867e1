"""Views of the supplied tables as media tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.scalars import quantised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: track user_id, time ts, integer x."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", quantised(F.col("value")).alias("x"))


def millis(ts):
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


#: the same views in the oracle's dialect
EV = "(SELECT event_id, user_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS x FROM events)"
PIX = """(SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(i % 8 AS BIGINT) AS x, CAST(i // 8 AS BIGINT) AS y, CAST(round(CAST(e AS DOUBLE) * 100) AS BIGINT) AS v
    FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM embeddings))"""
