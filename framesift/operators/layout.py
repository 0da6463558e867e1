"""Layout, interleaving and runs of packets: windows over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_offsets(rows: DataFrame, order_by: Sequence[str], size: str, group: str | None = None, ranges: int = 64) -> DataFrame:
    """rows with `offset`, the sum of size over earlier rows of the group.

    Without a group the order is global: rows are dealt by ranges of the first order column, a window runs
    inside each range, and the ranges' own offsets come from their totals, a table of `ranges` rows at
    most. So no task sees all rows. That column must be a number without nulls.
    """
    if group is not None:
        w = Window.partitionBy(group).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
    key = order_by[0]
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.withColumn("offset", F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // ranges))
    part = F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int")
    dealt = rows.withColumn("_part", part)
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum(size).over(w), F.lit(0)))
    # at most `ranges` rows are broadcast
    return inside.join(F.broadcast(before), "_part").withColumn("offset", (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_before", "_inside")


def islands(rows: DataFrame, partition: Sequence[str], order_by: Sequence[str], changed: Column, name: str = "island") -> DataFrame:
    """rows with the number of the run they are in; `changed` may use lag over the same order."""
    w = Window.partitionBy(*partition).orderBy(*order_by)
    marked = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).when(changed, 1).otherwise(0))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def interleave(packets: DataFrame, file: Sequence[str], time: Sequence[str | Column], track: str, seq: str) -> DataFrame:
    """packets with `position` in file order: by decode time, ties to the lower track, then the sequence number."""
    w = Window.partitionBy(*file).orderBy(*time, track, seq)
    return packets.withColumn("position", F.row_number().over(w).cast("long"))


def chunk_runs(packets: DataFrame, file: Sequence[str], order_by: Sequence[str], track: str, size: str) -> DataFrame:
    """file, chunk, track, n, bytes: a new chunk wherever the track changes in file order."""
    w = Window.partitionBy(*file).orderBy(*order_by)
    made = islands(packets, file, order_by, F.col(track) != F.lag(track).over(w), "chunk")
    return made.groupBy(*file, "chunk", track).agg(F.count("*").cast("long").alias("n"), F.sum(size).cast("long").alias("bytes"))


def duration_runs(packets: DataFrame, track: str, order_by: Sequence[str], time: Column) -> DataFrame:
    """track, run, n, duration: run lengths of the gaps to the next packet; the last packet has its predecessor's."""
    w = Window.partitionBy(track).orderBy(*order_by)
    gap = packets.withColumn("_t", time).withColumn("_d", F.lead("_t").over(w) - F.col("_t"))
    gap = gap.withColumn("_d", F.coalesce("_d", F.lag("_d").over(w), F.lit(0)))
    made = islands(gap, [track], order_by, F.col("_d") != F.lag("_d").over(w), "run")
    return made.groupBy(track, "run").agg(F.count("*").cast("long").alias("n"), F.min("_d").cast("long").alias("duration"))


def running_groups(packets: DataFrame, track: str, order_by: Sequence[str], starts: Column) -> DataFrame:
    """packets with `gop`: how many group starts there are up to each; 0 before the first."""
    w = Window.partitionBy(track).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return packets.withColumn("gop", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def carry_forward(rows: DataFrame, track: str, order_by: Sequence[str], value: str, out: str) -> DataFrame:
    """rows with the last value that is not null so far: what a canvas shows when frames only bring changes."""
    w = Window.partitionBy(track).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def merge_repeats(frames: DataFrame, track: str, order_by: Sequence[str], content: str, duration: str) -> DataFrame:
    """track, island, first place, frames, duration: equal neighbours become one frame of their joint duration."""
    w = Window.partitionBy(track).orderBy(*order_by)
    made = islands(frames.withColumn("_n", F.row_number().over(w)), [track], order_by, ~F.col(content).eqNullSafe(F.lag(content).over(w)))
    return made.groupBy(track, "island").agg(
        F.min("_n").cast("long").alias("first"), F.count("*").cast("long").alias("frames"), F.sum(duration).cast("long").alias("duration")
    )


def gaps(packets: DataFrame, track: str, order_by: Sequence[str], time: Column, most: int, step: int) -> DataFrame:
    """track, at, lost: where the next packet is over `most` later, and the packets of `step` that fit between."""
    w = Window.partitionBy(track).orderBy(*order_by)
    made = packets.select(track, time.alias("at"), F.lead(time).over(w).alias("then"))
    lost = F.floor((F.col("then") - F.col("at") - 1) / step).cast("long")
    return made.where(F.col("then") - F.col("at") > most).select(track, F.col("at").cast("long").alias("at"), lost.alias("lost"))
