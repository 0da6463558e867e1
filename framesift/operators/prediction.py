"""Prediction residuals and their coding cost, as windows and aggregates over ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.scalars import rice_choice, zigzag

# binomial coefficients of the finite differences of order 0 to 4
FIXED = ((1,), (1, -1), (1, -2, 1), (1, -3, 3, -1), (1, -4, 6, -4, 1))


def fixed_residuals(samples: DataFrame, track: str, order_by: Sequence[str], value: str, orders: int = 4) -> DataFrame:
    """Long form: track, n (place), ord, residual. The first `ord` samples of a track have no residual.

    One shuffle by track; the orders are an explode of lags that one window makes.
    """
    w = Window.partitionBy(track).orderBy(*order_by)
    lags = samples.select(
        track, F.row_number().over(w).alias("n"), F.col(value).alias("x0"), *(F.lag(value, i).over(w).alias(f"x{i}") for i in range(1, orders + 1))
    )
    terms = [sum((c * F.col(f"x{i}") for i, c in enumerate(FIXED[o])), F.lit(0).cast("long")) for o in range(orders + 1)]
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), t.cast("long").alias("residual")) for o, t in enumerate(terms)))).alias("e")
    return lags.select(track, "n", each).select(track, "n", "e.ord", "e.residual").where("residual is not null")


def fixed_predictor_cost(samples: DataFrame, track: str, order_by: Sequence[str], value: str, warm_bits: int = 32) -> DataFrame:
    """track, ord, k, bits: the fixed predictor with the fewest estimated bits, the lowest order on ties."""
    sums = (
        fixed_residuals(samples, track, order_by, value)
        .groupBy(track, "ord")
        .agg(F.count("*").alias("m"), F.sum(zigzag(F.col("residual"))).alias("s"))
    )
    cost = sums.withColumn("c", rice_choice(F.col("m"), F.col("s")))
    best = cost.groupBy(track).agg(F.min(F.struct((F.col("c.bits") + warm_bits * F.col("ord")).alias("bits"), "ord", "c.k", "m")).alias("b"))
    return best.select(track, F.col("b.ord").cast("int").alias("ord"), F.col("b.k").cast("int").alias("k"), F.col("b.bits").cast("long").alias("bits"))


def best_rice_parameter(residuals: DataFrame, group: str, value: str, most: int = 14) -> DataFrame:
    """group, k, bits: argmin over k of sum(zigzag >> k) + n (k + 1), the least k on ties.

    All parameters are columns of one aggregate, so rows are not multiplied.
    """
    u = zigzag(F.col(value))
    sums = residuals.groupBy(group).agg(
        F.count(value).alias("n"), *(F.sum(F.shiftright(u, k)).alias(f"s{k}") for k in range(most + 1))
    )
    choices = F.array(*(F.struct((F.col(f"s{k}") + F.col("n") * (k + 1)).alias("bits"), F.lit(k).alias("k")) for k in range(most + 1)))
    return sums.select(group, F.array_min(choices).alias("b")).select(group, F.col("b.k").cast("int").alias("k"), F.col("b.bits").cast("long").alias("bits"))


def partition_sums(residuals: DataFrame, group: str, place: str, value: str, finest: int = 3, size: int = 64) -> DataFrame:
    """group, level, part, n, s: zigzag sums of 2**level partitions; coarser ones are rollups of the finest."""
    fine = residuals.withColumn("p", F.floor(F.col(place) * (1 << finest) / size).cast("int"))
    base = fine.groupBy(group, "p").agg(F.count("*").alias("n"), F.sum(zigzag(F.col(value))).alias("s"))
    levels = F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.shiftright("p", finest - v).alias("part")) for v in range(finest + 1)))).alias("l")
    return (
        base.select(group, "n", "s", levels)
        .groupBy(group, F.col("l.level").alias("level"), F.col("l.part").alias("part"))
        .agg(F.sum("n").cast("long").alias("n"), F.sum("s").cast("long").alias("s"))
    )


def wasted_bits(samples: DataFrame, group: str, value: str) -> DataFrame:
    """group, wasted: low bits that are zero in every sample; 0 where all samples are."""
    folded = samples.groupBy(group).agg(F.bit_or(value).alias("bits"))
    low = F.col("bits").bitwiseAND(-F.col("bits"))
    return folded.select(group, F.when(F.col("bits") == 0, 0).otherwise(F.length(F.bin(low)) - 1).cast("int").alias("wasted"))


def constant_groups(samples: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, is_constant, value where the group is constant."""
    found = samples.groupBy(group).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
    same = F.col("a") == F.col("b")
    return found.select(group, F.col("n").cast("long").alias("n"), same.alias("is_constant"), F.when(same, F.col("a")).alias("constant"))


def mid_side(left: Column, right: Column) -> tuple[Column, Column]:
    return F.shiftright(left + right, 1), left - right


def left_right(mid: Column, side: Column) -> tuple[Column, Column]:
    """The inverse of mid_side: the bit that mid has lost is side's lowest."""
    m2 = F.shiftleft(mid, 1).bitwiseOR(side.bitwiseAND(F.lit(1).cast("long")))
    return F.shiftright(m2 + side, 1), F.shiftright(m2 - side, 1)


def stereo_choice(sums: DataFrame, group: str) -> DataFrame:
    """Of columns left, right, mid, side (costs): the cheapest pair; independent, left/side, side/right, mid/side on ties."""
    modes = (("independent", "left", "right"), ("left_side", "left", "side"), ("side_right", "side", "right"), ("mid_side", "mid", "side"))
    options = F.array(*(F.struct((F.col(a) + F.col(b)).alias("cost"), F.lit(i).alias("i"), F.lit(name).alias("mode")) for i, (name, a, b) in enumerate(modes)))
    return sums.select(group, F.array_min(options).alias("b")).select(group, F.col("b.mode").alias("mode"), F.col("b.cost").cast("long").alias("cost"))


def autocorrelation(samples: DataFrame, group: str, order_by: Sequence[str], value: str, lags: int = 4) -> DataFrame:
    """group, lag, r: sum of x[i] x[i - lag] for lags 0 to `lags`, from one window and one aggregate."""
    w = Window.partitionBy(group).orderBy(*order_by)
    made = samples.select(group, F.col(value).alias("x"), *(F.lag(value, i).over(w).alias(f"x{i}") for i in range(1, lags + 1)))
    sums = made.groupBy(group).agg(F.sum(F.col("x") * F.col("x")).alias("r0"), *(F.coalesce(F.sum(F.col("x") * F.col(f"x{i}")), F.lit(0)).alias(f"r{i}") for i in range(1, lags + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("lag"), F.col(f"r{i}").cast("long").alias("r")) for i in range(lags + 1)))).alias("e")
    return sums.select(group, each).select(group, "e.lag", "e.r")


def first_order_rebuild(residuals: DataFrame, track: str, place: str, value: str) -> DataFrame:
    """Samples from their first differences: a running sum."""
    w = Window.partitionBy(track).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return residuals.withColumn("sample", F.sum(value).over(w))


def residual_of_lpc(samples: DataFrame, track: str, order_by: Sequence[str], value: str, coefficients: Sequence[int], shift: int) -> DataFrame:
    """track, n, residual = x - (sum of coefficient * lag >> shift), an arithmetic shift; warm-up samples have none."""
    w = Window.partitionBy(track).orderBy(*order_by)
    predicted = sum((int(c) * F.lag(value, i).over(w) for i, c in enumerate(coefficients, 1)), F.lit(0).cast("long"))
    out = samples.select(track, F.row_number().over(w).alias("n"), (F.col(value) - F.shiftright(predicted.cast("long"), shift)).alias("residual"))
    return out.where("residual is not null")
