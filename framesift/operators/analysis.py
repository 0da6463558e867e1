"""Clustering, segments, bands, candidate lists and exact timing."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_bits(spectra: DataFrame, id_col: str, place: str, value: str, edges: Sequence[int], floor: int) -> DataFrame:
    """id, band, n, energy, bits: bits that values above a noise floor need, log2(1 + |x| / floor) summed by band."""
    band = F.lit(0)
    for e in edges:
        band = band + F.when(F.col(place) >= e, 1).otherwise(0)
    need = F.log2(1 + F.floor(F.abs(value) / floor))
    return spectra.groupBy(id_col, band.alias("band")).agg(
        F.count("*").cast("long").alias("n"), F.sum(F.col(value) * F.col(value)).cast("long").alias("energy"), (F.round(F.sum(need), 4) + 0.0).alias("bits")
    )


def candidate_lists(blocks: DataFrame, track: str, place: str, value: str, reach: int, most: int) -> DataFrame:
    """track, place, rank, distance: the `most` earlier blocks within `reach` whose value is closest, the nearest on ties.

    Lags bring the earlier blocks into the row, so nothing is joined and a row makes `reach` candidates at most.
    """
    w = Window.partitionBy(track).orderBy(place)
    tries = F.array(*(F.struct(F.abs(F.col(value) - F.lag(value, d).over(w)).alias("cost"), F.lit(d).alias("distance")) for d in range(1, reach + 1)))
    listed = blocks.select(track, place, F.slice(F.array_sort(F.filter(tries, lambda t: t["cost"].isNotNull())), 1, most).alias("c"))
    each = listed.select(track, place, F.posexplode("c").alias("rank", "c"))
    return each.select(track, place, F.col("rank").cast("int").alias("rank"), F.col("c.distance").alias("distance"), F.col("c.cost").alias("cost"))


def fixed_log2(x: Column) -> Column:
    """128 log2(x) for x >= 1 in integers: the exponent and a parabola over the seven bits behind the leading one."""
    top = F.length(F.bin(x)) - 1
    frac = F.when(top >= 7, F.floor(x / F.pow(F.lit(2), top - 7))).otherwise(x * F.pow(F.lit(2), 7 - top)).cast("long").bitwiseAND(F.lit(127).cast("long"))
    return (top * 128 + frac + F.shiftright(frac * (128 - frac) * 179, 16)).cast("long")


def exact_merge(packets: DataFrame, file: str, time: str, track: str, seq: str, scales: dict[int, int]) -> DataFrame:
    """packets with `position` by time / timescale, exactly: times are brought to the least common multiple of the scales."""
    common = math.lcm(*scales.values())
    factor = F.lit(None)
    for number, scale in scales.items():
        factor = F.when(F.col(track) == number, common // scale).otherwise(factor)
    key = F.col(time).cast("decimal(38,0)") * factor
    return packets.withColumn("position", F.row_number().over(Window.partitionBy(file).orderBy(key, track, seq)).cast("long"))


def trimmed(packets: DataFrame, stream: str, order_by: Sequence[str], duration: str, head: int, tail: int) -> DataFrame:
    """packets with start and keep: samples left of each after `head` are dropped in front and `tail` at the end."""
    w = Window.partitionBy(stream).orderBy(*order_by)
    whole = F.sum(duration).over(Window.partitionBy(stream))
    end = F.sum(duration).over(w.rowsBetween(Window.unboundedPreceding, 0))
    begin = end - F.col(duration)
    low, high = F.greatest(begin, F.lit(head)), F.least(end, whole - tail)
    made = packets.withColumn("start", (low - head).cast("long")).withColumn("keep", F.greatest(F.lit(0), high - low).cast("long"))
    return made.where("keep > 0")


def frame_rate(frames: int, ticks: int, timescale: int, most: int = 1001) -> tuple[int, int]:
    """The rational of the least denominator up to `most` whose truncated duration matches."""
    for den in range(1, most + 1):
        num = -(-frames * timescale * den // (ticks + 1)) if ticks else 0
        for n in (num, num + 1):
            if n > 0 and frames * timescale * den // n == ticks:
                return n, den
    exact = Fraction(frames * timescale, max(1, ticks)).limit_denominator(most)
    return exact.numerator, exact.denominator


def segments(values: np.ndarray, most: int = 4, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the segment of each of 256 levels: one-dimensional k-means over a histogram."""
    counts = np.bincount(values, minlength=256)
    used = np.flatnonzero(counts)
    k = min(most, len(used))
    if not k:
        return np.zeros(0), np.zeros(256, np.int64)
    centres = np.linspace(used[0], used[-1], 2 * k + 1)[1::2]
    level = np.arange(256)
    for _ in range(rounds):
        of = np.abs(level[:, None] - centres[None]).argmin(axis=1)
        total, n = np.bincount(of, counts * level, k), np.bincount(of, counts, k)
        moved = np.where(n > 0, total / np.maximum(n, 1), centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres, np.abs(level[:, None] - centres[None]).argmin(axis=1)


def farthest_groups(histograms: np.ndarray, most: int = 8, rounds: int = 10) -> np.ndarray:
    """The group of each histogram: centres seeded farthest from those before, then k-means rounds; ties go low."""
    centres = [histograms.sum(axis=1).argmax()]
    away = np.abs(histograms - histograms[centres[0]]).sum(axis=1)
    while len(centres) < most and away.max() > 0:
        centres.append(int(away.argmax()))
        away = np.minimum(away, np.abs(histograms - histograms[centres[-1]]).sum(axis=1))
    middle = histograms[centres].astype(float)
    for _ in range(rounds):
        of = np.stack([np.abs(histograms - m).sum(axis=1) for m in middle], axis=1).argmin(axis=1)
        fresh = np.array([histograms[of == g].mean(axis=0) if (of == g).any() else m for g, m in enumerate(middle)])
        if np.allclose(fresh, middle):
            break
        middle = fresh
    return of


def tile_groups(pixels: DataFrame, frame: str, tile: int, bins: int, most: int = 8) -> DataFrame:
    """frame, tx, ty, grp: tiles of a frame in groups of like histograms. Histograms are aggregates; a frame's tiles,
    not its pixels, meet in one place."""
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    counts = pixels.groupBy(frame, at("x").alias("tx"), at("y").alias("ty"), F.floor(F.col("v") * bins / 256).cast("int").alias("b")).agg(F.count("*").alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index=["tx", "ty"], columns="b", values="n", fill_value=0).sort_index()
        of = farthest_groups(wide.to_numpy(), most)
        out = wide.index.to_frame(index=False)
        out.insert(0, frame, rows[frame].iloc[0])
        out["grp"] = of
        return out

    return counts.groupBy(frame).applyInPandas(run, f"{frame} long, tx long, ty long, grp long")


def crc32_joined(a: int, b: int, size: int) -> int:
    """The CRC-32 of two pieces from those of each: a's polynomial is moved over b's bytes by squaring in GF(2)."""
    poly = 0xEDB88320

    def times(x: int, y: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if y >> i & 1:
                out ^= x
            x = x >> 1 ^ (poly if x & 1 else 0)
        return out

    power, shift, n = 1 << 31, 1 << 23, size
    while n:
        if n & 1:
            power = times(shift, power)
        shift = times(shift, shift)
        n >>= 1
    return times(a, power) ^ b
