"""Colour transforms and block prediction over pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BYTE = 255


def byte(c: Column) -> Column:
    return c.bitwiseAND(F.lit(BYTE).cast("long"))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(BYTE).cast("long"), c))


def signed(c: Column) -> Column:
    """A byte as a number from -128 to 127."""
    return F.when(c > 127, c - 256).otherwise(c)


def subtract_green(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    return byte(r - g), byte(b - g)


def add_green(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    return byte(r + g), byte(b + g)


def cross_color(r: Column, g: Column, b: Column, green_red: Column, green_blue: Column, red_blue: Column) -> tuple[Column, Column]:
    """Red and blue less what signed multipliers in 1/32 predict of them."""
    part = lambda m, c: F.shiftright(m * signed(c), 5)
    return byte(r - part(green_red, g)), byte(b - part(green_blue, g) - part(red_blue, r))


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Studio-range chroma of 8-bit colours with 16 fraction bits."""
    u = -9719 * r - 19081 * g + 28800 * b
    v = 28800 * r - 24116 * g - 4684 * b
    half = (1 << 15) + (128 << 16)
    return F.shiftright(u + half, 16), F.shiftright(v + half, 16)


def to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Studio-range luma and chroma as colours: 14-bit factors, clamped."""
    scaled = 19077 * (y - 16)
    d, e = u - 128, v - 128
    shift = lambda c: clamp(F.shiftright(c + (1 << 13), 14))
    return shift(scaled + 26149 * e), shift(scaled - 6419 * d - 13320 * e), shift(scaled + 33050 * d)


def upsampled(plane: DataFrame, id_col: str, width: int, height: int) -> DataFrame:
    """A chroma plane at twice the size: 9, 3, 3 and 1 sixteenths of the four nearest samples, edges repeated.

    Every sample is emitted to the pixels it reaches with its weight, so one aggregate replaces four joins.
    """
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((-1, 1), (0, 3), (1, 3), (2, 1))))
    x = F.col("x") * 2 + F.col("sx.d")
    y = F.col("y") * 2 + F.col("sy.d")
    spread = plane.withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps))
    inside = spread.select(id_col, x.alias("px"), y.alias("py"), (F.col("sx.w") * F.col("sy.w")).alias("w"), "v")
    kept = inside.where(f"px >= 0 AND py >= 0 AND px < {width} AND py < {height}")
    sums = kept.groupBy(id_col, F.col("px").cast("long").alias("x"), F.col("py").cast("long").alias("y"))
    # at an edge the missing samples' weights go to those that are there
    return sums.agg(F.floor((F.sum(F.col("w") * F.col("v")) * 2 + F.sum("w")) / (2 * F.sum("w"))).cast("long").alias("v"))


def inverse_coupling(m: Column, a: Column) -> tuple[Column, Column]:
    """Magnitude and angle back to two channels."""
    first = F.when((m > 0) & (a > 0) | (m <= 0) & (a <= 0), m).otherwise(F.when(m > 0, m + a).otherwise(m - a))
    second = F.when(m > 0, F.when(a > 0, m - a).otherwise(m)).otherwise(F.when(a > 0, m).otherwise(m + a))
    return first, second


def predicted_blocks(pixels: DataFrame, id_col: str, size: int = 4) -> DataFrame:
    """id, bx, by, mode, cost: DC, vertical, horizontal or gradient prediction with the least absolute error.

    Above is the last row of the block above (127 outside), left the last column of the block left (129), the
    corner the pixel between (127 above the picture, 129 left of it). Ties go to the first mode.
    """
    across, down = Window.partitionBy(id_col, "y").orderBy("x"), Window.partitionBy(id_col, "x").orderBy("y")

    def before_block(c: str, w, at: Column) -> Column:
        """The last value before the block that a row is in, by how far inside the block the row is."""
        out = F.lit(None)
        for k in range(size):
            out = F.when(at == k, F.lag(c, k + 1).over(w)).otherwise(out)
        return out

    x0, y0 = F.floor(F.col("x") / size) * size, F.floor(F.col("y") / size) * size
    rows = pixels.withColumn("bx", F.floor(F.col("x") / size).cast("long")).withColumn("by", F.floor(F.col("y") / size).cast("long"))
    rows = rows.withColumn("u", before_block("v", down, F.col("y") % size)).withColumn("l", before_block("v", across, F.col("x") % size))
    rows = rows.withColumn("c", before_block("u", across, F.col("x") % size))
    up = F.when(F.col("by") == 0, 127).otherwise(F.col("u"))
    left = F.when(F.col("bx") == 0, 129).otherwise(F.col("l"))
    corner = F.when(F.col("by") == 0, 127).when(F.col("bx") == 0, 129).otherwise(F.col("c"))
    near = rows.select(id_col, "x", "y", "v", "bx", "by", up.alias("u"), left.alias("l"), corner.alias("c"))
    block = Window.partitionBy(id_col, "bx", "by")
    total = F.sum(F.when(F.col("y") == y0, F.col("u")).otherwise(0)).over(block) + F.sum(F.when(F.col("x") == x0, F.col("l")).otherwise(0)).over(block)
    dc = F.floor((total + size) / (2 * size))
    made = near.withColumn("dc", dc)
    guesses = (F.col("dc"), F.col("u"), F.col("l"), clamp((F.col("l") + F.col("u") - F.col("c")).cast("long")))
    sums = made.groupBy(id_col, "bx", "by").agg(*(F.sum(F.abs(F.col("v") - g)).cast("long").alias(f"m{i}") for i, g in enumerate(guesses)))
    best = F.array_min(F.array(*(F.struct(F.col(f"m{i}").alias("cost"), F.lit(i).alias("mode")) for i in range(4))))
    return sums.select(id_col, "bx", "by", best.alias("b")).select(id_col, "bx", "by", F.col("b.mode").alias("mode"), F.col("b.cost").alias("cost"))


def edge_filter(pixels: DataFrame, id_col: str, size: int = 4, limit: int = 60) -> DataFrame:
    """pixels with the two next to each vertical block edge moved a quarter of their step together, where it is small."""
    w = Window.partitionBy(id_col, "y").orderBy("x")
    left, right = F.lag("v").over(w), F.lead("v").over(w)
    q, p = (F.col("x") % size == 0) & (F.col("x") > 0), (F.col("x") % size == size - 1) & right.isNotNull()
    towards = lambda other: F.when(F.abs(other - F.col("v")) <= limit, F.col("v") + F.shiftright((other - F.col("v")).cast("long"), 2)).otherwise(F.col("v"))
    return pixels.withColumn("v", F.when(q, towards(left)).when(p, towards(right)).otherwise(F.col("v")))


def compensated(frames: DataFrame, track: str, frame: str, dx: Column, dy: Column, width: int, height: int) -> DataFrame:
    """track, frame, x, y, residual to the frame before at (x + dx, y + dy), clamped to the picture: an equi-join."""
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("long")
    now = frames.select(track, frame, "x", "y", "v", clip(F.col("x") + dx, width).alias("rx"), clip(F.col("y") + dy, height).alias("ry"))
    before = frames.select(track, (F.col(frame) + 1).alias(frame), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("v").alias("w"))
    return now.join(before, [track, frame, "rx", "ry"]).select(track, frame, "x", "y", (F.col("v") - F.col("w")).alias("residual"))


def tile_predictors(pixels: DataFrame, id_col: str, tile: int = 4) -> DataFrame:
    """id, tx, ty, predictor, cost: of left, top, their mean, and left + top - corner, that with the least wrapped error."""
    across, down = Window.partitionBy(id_col, "y").orderBy("x"), Window.partitionBy(id_col, "x").orderBy("y")
    zero = F.lit(0).cast("long")
    near = pixels.withColumn("l", F.coalesce(F.lag("v").over(across), zero)).withColumn("t", F.coalesce(F.lag("v").over(down), zero))
    near = near.withColumn("c", F.coalesce(F.lag("t").over(across), zero))
    guesses = (F.col("l"), F.col("t"), F.shiftright(F.col("l") + F.col("t"), 1), clamp(F.col("l") + F.col("t") - F.col("c")))
    error = lambda g: F.least(byte(F.col("v") - g), 256 - byte(F.col("v") - g))
    sums = near.groupBy(id_col, F.floor(F.col("x") / tile).cast("long").alias("tx"), F.floor(F.col("y") / tile).cast("long").alias("ty")).agg(
        *(F.sum(error(g)).cast("long").alias(f"p{i}") for i, g in enumerate(guesses))
    )
    best = F.array_min(F.array(*(F.struct(F.col(f"p{i}").alias("cost"), F.lit(i).alias("predictor")) for i in range(4))))
    return sums.select(id_col, "tx", "ty", best.alias("b")).select(id_col, "tx", "ty", F.col("b.predictor").alias("predictor"), F.col("b.cost").alias("cost"))


def palette_lookup(indices: DataFrame, index: str, palette: Sequence[int]) -> DataFrame:
    """indices with the colour of each; an index beyond the palette is clear black (0), as a literal lookup."""
    table = F.array(*(F.lit(int(c)).cast("long") for c in palette))
    return indices.withColumn("color", F.coalesce(F.get(table, F.col(index).cast("int")), F.lit(0).cast("long")))
