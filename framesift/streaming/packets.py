"""Packet streams with Structured Streaming: windows, interleaving, stateful decoding, loss concealment."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of an events table: event time `at`, track user_id, integer sample x."""
    schema = spark.read.parquet(path).schema
    # a glob, as a path that is one file is no base folder for a stream
    raw = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    # the table's times have no zone; they are read as UTC whatever the session's zone is
    at = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return raw.select("event_id", at.alias("at"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("x"))


def blocks(packets: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """track, start (seconds), n, s of tumbling or sliding windows; packets later than `late` are dropped."""
    timed = packets.withWatermark("at", late)
    window = F.window("at", size, slide) if slide else F.window("at", size)
    sums = timed.groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    return sums.select("user_id", F.col("w.start").cast("long").alias("start"), "n", "s")


def interleaved(left: DataFrame, right: DataFrame, late: str = "1 hour", apart: str = "10 minutes") -> DataFrame:
    """Packets of two tracks of one user that lie within `apart`: the state leaves once both watermarks have passed.

    The session's watermark policy is the minimum, so a pair waits until every track has moved on.
    """
    a = left.withWatermark("at", late).select(F.col("user_id").alias("a_user"), F.col("at").alias("a_at"), F.col("event_id").alias("a_id"))
    b = right.withWatermark("at", late).select(F.col("user_id").alias("b_user"), F.col("at").alias("b_at"), F.col("event_id").alias("b_id"))
    near = F.expr(f"a_user = b_user AND b_at >= a_at AND b_at <= a_at + INTERVAL {apart}")
    return a.join(b, near).select(F.col("a_user").alias("user_id"), "a_id", "b_id")


DECODED = "user_id long, event_id long, sample long, residual long, gap long"
STATE = "last long, at double"


def _decode(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Residuals to the sample before, across batches, and the whole seconds since that sample."""
    last, at = state.get if state.exists else (None, None)
    rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
    if rows.empty:
        return
    times = rows["at"].astype("int64") // 1000 if rows["at"].dtype == "datetime64[us]" else rows["at"].astype("int64") // 1_000_000
    before = rows["x"].shift(1)
    earlier = times.shift(1)
    if last is not None:
        before.iloc[0], earlier.iloc[0] = last, at
    state.update((int(rows["x"].iloc[-1]), float(times.iloc[-1])))
    yield pd.DataFrame(
        {
            "user_id": key[0],
            "event_id": rows["event_id"].astype("int64"),
            "sample": rows["x"].astype("int64"),
            "residual": (rows["x"] - before.fillna(0)).astype("int64"),
            "gap": ((times - earlier).fillna(0) // 1000).astype("int64"),
        }
    )


def decoded(packets: DataFrame) -> DataFrame:
    """One stateful decoder a track: state is the last sample and its time."""
    return packets.groupBy("user_id").applyInPandasWithState(_decode, DECODED, STATE, "append", GroupStateTimeout.NoTimeout)


def distinct_packets(packets: DataFrame, late: str = "1 hour") -> DataFrame:
    """Packets without those whose id came before within the watermark."""
    return packets.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def drained(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and returns its result, written as Parquet under folder."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
