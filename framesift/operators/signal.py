"""Filters, cross-fades, block switching and stateful cuts over ordered samples and packets."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fir(samples: DataFrame, track: str, order_by: Sequence[str], value: str, taps: Sequence[int], shift: int, step: int = 1) -> DataFrame:
    """track, n, y = rounded (sum of taps[i] x[n - i]) >> shift, zero before the start; every `step`-th sample."""
    w = Window.partitionBy(track).orderBy(*order_by)
    total = sum((int(t) * F.coalesce(F.lag(value, i).over(w), F.lit(0)) for i, t in enumerate(taps)), F.lit(0).cast("long"))
    made = samples.select(track, (F.row_number().over(w) - 1).cast("long").alias("n"), F.shiftright((total + (1 << shift - 1)).cast("long"), shift).alias("y"))
    return made.where(F.col("n") % step == 0).withColumn("n", F.floor(F.col("n") / step).cast("long"))


def first_order(samples: DataFrame, track: str, order_by: Sequence[str], value: str, keep: float) -> DataFrame:
    """track, n, y: y[n] = x[n] - x[n - 1] + keep y[n - 1], a recursion that needs its track in order in one place."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order_by))
        out, last, y = [], 0.0, 0.0
        for x in rows[value].tolist():
            y = x - last + keep * y
            last = x
            out.append(y)
        return pd.DataFrame({track: rows[track].to_numpy(), "n": range(len(out)), "y": out})

    kept = samples.select(track, *order_by, value)
    return kept.groupBy(track).applyInPandas(run, f"{track} long, n long, y double")


def attacks(samples: DataFrame, track: str, order_by: Sequence[str], value: str, size: int = 8, ratio: int = 8, floor: int = 1) -> DataFrame:
    """track, block, attack: blocks whose energy is over `ratio` times the mean of the four before and above a floor."""
    n = F.row_number().over(Window.partitionBy(track).orderBy(*order_by)) - 1
    energy = samples.withColumn("block", F.floor(n / size).cast("long")).groupBy(track, "block").agg(F.sum(F.col(value) * F.col(value)).alias("e"))
    before = Window.partitionBy(track).orderBy("block").rowsBetween(-4, -1)
    past, number = F.coalesce(F.sum("e").over(before), F.lit(0)), F.count("e").over(before)
    return energy.select(track, "block", ((F.col("e") * number > ratio * past) & (number > 0) & (F.col("e") > floor)).alias("attack"))


def block_types(blocks: DataFrame, track: str) -> DataFrame:
    """track, block, type: 2 short at an attack or between two, 1 before a short one, 3 after one, else 0."""
    w = Window.partitionBy(track).orderBy("block")
    near = lambda c, f: F.coalesce(f(c).over(w), F.lit(False))
    short = blocks.withColumn("short", F.col("attack") | near("attack", F.lag) & near("attack", F.lead))
    kind = F.when(F.col("short"), 2).when(near("short", F.lead), 1).when(near("short", F.lag), 3).otherwise(0)
    return short.select(track, "block", kind.alias("type"))


def cross_fade(old: Column, new: Column, weight: Column) -> Column:
    """(w new + (32767 - w) old) >> 15 with w in Q15."""
    return F.shiftright(weight * new + (32767 - weight) * old, 15)


def pair_energy(samples: DataFrame, track: str, place: str, value: str, shift: int) -> DataFrame:
    """track, energy: each pair of squares is shifted before it is added."""
    pairs = samples.groupBy(track, F.floor(F.col(place) / 2).alias("p")).agg(F.sum(F.col(value) * F.col(value)).cast("long").alias("e"))
    return pairs.groupBy(track).agg(F.sum(F.shiftright("e", shift)).cast("long").alias("energy"))


def cluster_cuts(packets: DataFrame, file: str, order_by: Sequence[str], time: str, size: str, key: str, most_ms: int = 5000, most_bytes: int = 5 << 20, least_key: int = 4096) -> DataFrame:
    """file, cluster, first, n, bytes: a new cluster at the time or size limit, or at a key packet once there is enough.

    The cut depends on the cuts before it, so a file is walked in order in one place.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order_by))
        out: list[list] = []
        for t, n, k in zip(rows[time].tolist(), rows[size].tolist(), rows[key].tolist(), strict=True):
            if not out or t - out[-1][0] >= most_ms or out[-1][2] >= most_bytes or k and out[-1][2] >= least_key:
                out.append([t, 0, 0])
            out[-1][1] += 1
            out[-1][2] += n
        return pd.DataFrame([(rows[file].iloc[0], i, *c) for i, c in enumerate(out)], columns=[file, "cluster", "first", "n", "bytes"])

    kept = packets.select(file, *dict.fromkeys([*order_by, time, size, key]))
    return kept.groupBy(file).applyInPandas(run, f"{file} long, cluster long, first long, n long, bytes long")


def reservoir(packets: DataFrame, track: str, order_by: Sequence[str], used: str, given: int, most: int) -> DataFrame:
    """track, n, saved: bits left over after each packet, never under 0 or above `most`."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order_by))
        out, saved = [], 0
        for bits in rows[used].tolist():
            saved = min(most, max(0, saved + given - bits))
            out.append(saved)
        return pd.DataFrame({track: rows[track].to_numpy(), "n": range(len(out)), "saved": out})

    kept = packets.select(track, *dict.fromkeys([*order_by, used]))
    return kept.groupBy(track).applyInPandas(run, f"{track} long, n long, saved long")


def sample_times(frames: DataFrame, number: str, timescale: int, num: int, den: int) -> DataFrame:
    """frames with dts = floor(k timescale den / num) and the duration up to the next frame."""
    at = lambda k: F.floor(k.cast("decimal(38,0)") * timescale * den / num).cast("long")
    return frames.withColumn("dts", at(F.col(number))).withColumn("duration", at(F.col(number) + 1) - F.col("dts"))
