"""Block transforms, quantisation, tokens, overlap-add and probability adaptation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.scalars import deadzone, merge_prob


def cosine_basis(n: int) -> list[list[float]]:
    """Rows of the orthonormal type-II cosine transform of n points."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def basis_transform(vectors: DataFrame, id_cols: str | Sequence[str], vector: str, basis: Sequence[Sequence[float]]) -> DataFrame:
    """ids, k, coef = sum over i of basis[k][i] x[i], as one projection: the basis is a literal, nothing is joined."""
    table = F.array(*(F.array(*(F.lit(float(b)) for b in row)) for row in basis))
    dot = F.transform(
        table,
        lambda row: F.aggregate(F.zip_with(F.col(vector), row, lambda x, b: x.cast("double") * b), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))),
    )
    ids = [id_cols] if isinstance(id_cols, str) else [*id_cols]
    return vectors.select(*ids, F.posexplode(dot).alias("k", "coef"))


def walsh4(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    """The 4-point Walsh-Hadamard butterfly in integers."""
    s, t, u, v = a + b, a - b, c + d, c - d
    return s + u, t + v, s - u, t - v


def quantise(blocks: DataFrame, place: str, value: str, dc: int, ac: int) -> DataFrame:
    """blocks with q (quantised, half away from zero) and r (rebuilt); place 0 has its own step."""
    step = F.when(F.col(place) == 0, dc).otherwise(ac)
    return blocks.withColumn("q", deadzone(F.col(value), step)).withColumn("r", (F.col("q") * step).cast("long"))


def zero_run_tokens(coefficients: DataFrame, block: str, place: str, value: str) -> DataFrame:
    """block, place, run, value: each value that is not zero with the zeros before it; trailing zeros have no token."""
    w = Window.partitionBy(block).orderBy(place)
    kept = coefficients.where(F.col(value) != 0)
    return kept.select(block, place, (F.col(place) - F.coalesce(F.lag(place).over(w), F.lit(-1)) - 1).cast("long").alias("run"), value)


def overlap_add(samples: DataFrame, track: str, place: str, value: str, half: int) -> DataFrame:
    """track, t, v: blocks of 2 half samples that begin every `half` are windowed by a triangle and summed at their time.

    Each sample lies in two blocks; both shares are emitted at its absolute time, so no block waits for another.
    """
    block = F.floor(F.col(place) / half)
    shares = F.array(
        F.struct(((F.col(place) - block * half) * 2 + 1).alias("weight")), F.struct(((half - (F.col(place) - block * half)) * 2 - 1).alias("weight"))
    )
    each = samples.select(track, F.col(place).alias("t"), F.col(value).alias("x"), F.explode(shares).alias("e"))
    return each.groupBy(track, "t").agg(F.sum(F.col("x") * F.col("e.weight")).cast("long").alias("v"))


def adapted(counts: DataFrame, keys: Sequence[str], zeros: str, ones: str, prior: int = 128) -> DataFrame:
    """keys and the prior probability moved towards the summed counts of all tiles."""
    sums = counts.groupBy(*keys).agg(F.sum(zeros).cast("long").alias("n0"), F.sum(ones).cast("long").alias("n1"))
    return sums.withColumn("prob", merge_prob(F.lit(prior), F.col("n0"), F.col("n1")).cast("long"))


def level_of(rows: DataFrame, size: str, levels: Sequence[tuple[int, int]], beyond: int) -> DataFrame:
    """rows with the lowest level whose limit is not below size: a range join to a short literal table, as CASE."""
    level = None
    for limit, number in sorted(levels):
        level = F.when(F.col(size) <= limit, number) if level is None else level.when(F.col(size) <= limit, number)
    return rows.withColumn("level", level.otherwise(beyond).cast("int"))


def band_peaks(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, low, high: the largest magnitude of the lower and of the upper half of a spectrum."""
    half = F.floor(F.size(vector) / 2).cast("int")
    top = lambda part: F.array_max(F.transform(part, lambda x: F.abs(x)))
    return vectors.select(id_col, top(F.slice(vector, F.lit(1), half)).alias("low"), top(F.slice(vector, half + 1, F.size(vector) - half)).alias("high"))
