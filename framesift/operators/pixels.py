"""Per-pixel projections, histograms, palettes and block search over pixel tables.

A pixel table has an image id, x, y and integer channels; every operator keeps to that grain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.scalars import filter_cost, paeth


def from_vectors(vectors: DataFrame, id_col: str, vector: str, width: int, scale: int = 100) -> DataFrame:
    """id, i, x, y, v: the elements of a vector as the pixels of a block, quantised half away from zero."""
    each = F.posexplode(vector).alias("i", "e")
    rounded = F.round(F.col("e").cast("double") * scale).cast("long")
    return vectors.select(id_col, each).select(id_col, F.col("i").cast("long").alias("i"), (F.col("i") % width).cast("long").alias("x"), F.floor(F.col("i") / width).cast("long").alias("y"), rounded.alias("v"))


def box_downsample(pixels: DataFrame, id_col: str) -> DataFrame:
    """id, x, y, v of the half-size image: (sum of 2 x 2 + 2) >> 2."""
    small = pixels.groupBy(id_col, F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
    return small.agg(F.shiftright(F.sum("v") + 2, 2).alias("v"))


def filter_choice(pixels: DataFrame, id_col: str) -> DataFrame:
    """id, y, filter, cost: the row filter (none, sub, up, average, Paeth) with the least sum; lowest type on ties.

    v holds bytes, 0 to 255. One shuffle by image serves the neighbours in both directions.
    """
    across = Window.partitionBy(id_col, "y").orderBy("x")
    down = Window.partitionBy(id_col, "x").orderBy("y")
    zero = F.lit(0).cast("long")
    near = pixels.withColumn("a", F.coalesce(F.lag("v").over(across), zero)).withColumn("b", F.coalesce(F.lag("v").over(down), zero))
    near = near.withColumn("c", F.coalesce(F.lag("b").over(across), zero))
    v, a, b, c = (F.col(k) for k in "vabc")
    costs = [v, v - a, v - b, v - F.shiftright(a + b, 1), v - paeth(a, b, c)]
    sums = near.groupBy(id_col, "y").agg(*(F.sum(filter_cost(x)).alias(f"f{i}") for i, x in enumerate(costs)))
    best = F.array_min(F.array(*(F.struct(F.col(f"f{i}").alias("cost"), F.lit(i).alias("filter")) for i in range(5))))
    return sums.select(id_col, "y", best.alias("b")).select(id_col, "y", F.col("b.filter").cast("int").alias("filter"), F.col("b.cost").cast("long").alias("cost"))


def histogram_555(pixels: DataFrame, keys: Sequence[str], r: Column, g: Column, b: Column) -> DataFrame:
    """keys, bin, n and the sums of the low three bits of each channel, for bins of five bits a channel."""
    low = lambda c: c.bitwiseAND(F.lit(7).cast("long"))
    index = F.shiftleft(F.shiftright(r, 3), 10).bitwiseOR(F.shiftleft(F.shiftright(g, 3), 5)).bitwiseOR(F.shiftright(b, 3))
    return pixels.groupBy(*keys, index.cast("long").alias("bin")).agg(
        F.count("*").cast("long").alias("n"), F.sum(low(r)).cast("long").alias("r_low"), F.sum(low(g)).cast("long").alias("g_low"), F.sum(low(b)).cast("long").alias("b_low")
    )


def exact_palette(pixels: DataFrame, color: Column, limit: int = 256) -> DataFrame:
    """rank, color: the different colours in ascending order, or no row where there are more than `limit`.

    At most limit + 1 colours leave the distinct aggregate, so the rank's single partition is bounded.
    """
    few = pixels.select(color.cast("long").alias("color")).distinct().limit(limit + 1)
    ranked = few.select((F.row_number().over(Window.orderBy("color")) - 1).cast("int").alias("rank"), "color", F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    return ranked.where(F.col("n") <= limit).select("rank", "color")


def nearest_color(points: DataFrame, id_cols: str | Sequence[str], point: str, palette: Sequence[Sequence[int]]) -> DataFrame:
    """ids, entry, distance: the palette entry at the least squared distance, the lowest on ties.

    The palette is a literal of 256 entries at most, so nothing is joined: one projection per row.
    """
    table = F.array(*(F.array(*(F.lit(int(c)).cast("long") for c in entry)) for entry in palette))
    squared = F.transform(
        table,
        lambda entry, i: F.struct(
            F.aggregate(F.zip_with(F.col(point), entry, lambda p, q: (p - q) * (p - q)), F.lit(0).cast("long"), lambda s, d: s + d).alias("distance"), i.alias("entry")
        ),
    )
    ids = [id_cols] if isinstance(id_cols, str) else [*id_cols]
    return points.select(*ids, F.array_min(squared).alias("b")).select(*ids, F.col("b.entry").cast("int").alias("entry"), F.col("b.distance").alias("distance"))


def squared_error(a: DataFrame, b: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """group, n, sse, psnr (peak 255) of two planes that are joined on keys."""
    joined = a.join(b.withColumnRenamed("v", "w"), list(keys))
    sums = joined.groupBy(group).agg(F.count("*").cast("long").alias("n"), F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).cast("long").alias("sse"))
    peak = 255.0 * 255.0
    return sums.withColumn("psnr", F.when(F.col("sse") > 0, F.round(10 * F.log10(peak * F.col("n") / F.col("sse")), 4)))


def motion_search(blocks: DataFrame, reference: DataFrame, track: str, block: str, place: str, reach: int = 8, length_cost: int = 4) -> DataFrame:
    """track, block, offset, cost: argmin over |offset| <= reach of 16 SAD + |offset| length_cost.

    blocks and reference have track, `place` and v; blocks also the block number. Offsets outside the
    reference are not candidates; ties go to the lowest offset. The join is an equi-join on track and
    place: each sample meets one reference sample for each of the 2 reach + 1 offsets, no more.
    """
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")
    moved = blocks.select(track, block, "v", F.col(place), offsets).withColumn("at", F.col(place) + F.col("offset"))
    joined = moved.join(reference.select(track, F.col(place).alias("at"), F.col("v").alias("w")), [track, "at"])
    size = blocks.groupBy(track, block).agg(F.count("*").alias("size"))
    sums = joined.groupBy(track, block, "offset").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("v") - F.col("w"))).alias("sad"))
    whole = sums.join(size, [track, block]).where("n = size")
    cost = (16 * F.col("sad") + F.abs("offset") * length_cost).cast("long")
    best = whole.groupBy(track, block).agg(F.min(F.struct(cost.alias("cost"), "offset")).alias("b"))
    return best.select(track, block, F.col("b.offset").cast("int").alias("offset"), F.col("b.cost").alias("cost"))


def pad_plane(pixels: DataFrame, id_col: str, width: int, height: int) -> DataFrame:
    """id, x, y, v on a grid of width x height: zero where the plane has no pixel; pixels outside are cropped."""
    xs, ys = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (width, height))
    grid = pixels.select(id_col).distinct().withColumn("x", xs).withColumn("y", ys)
    return grid.join(pixels.select(id_col, "x", "y", "v"), [id_col, "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))


def oriented(pixels: DataFrame, width: int, height: int, orientation: int) -> DataFrame:
    """pixels with x and y moved as an EXIF orientation of 1 to 8 asks."""
    x, y = F.col("x"), F.col("y")
    flip_x, flip_y = width - 1 - x, height - 1 - y
    to = {1: (x, y), 2: (flip_x, y), 3: (flip_x, flip_y), 4: (x, flip_y), 5: (y, x), 6: (flip_y, x), 7: (flip_y, flip_x), 8: (y, flip_x)}[orientation]
    return pixels.select(*(c for c in pixels.columns if c not in ("x", "y")), to[0].cast("long").alias("x"), to[1].cast("long").alias("y"))


def changed_region(pixels: DataFrame, track: str, frame: str, most: int = 0) -> DataFrame:
    """track, frame, n and the bounds of the pixels that differ from the frame before by over `most`."""
    w = Window.partitionBy(track, "x", "y").orderBy(frame)
    seen = pixels.withColumn("_d", F.abs(F.col("v") - F.lag("v").over(w)))
    inside = F.col("_d") > most
    edge = lambda f, c: f(F.when(inside, F.col(c))).alias(f"{f.__name__}_{c}")
    return seen.groupBy(track, frame).agg(F.count(F.when(inside, 1)).cast("long").alias("n"), edge(F.min, "x"), edge(F.max, "x"), edge(F.min, "y"), edge(F.max, "y"))


def ordered_dither(x: Column, y: Column, v: Column) -> Column:
    """v plus a threshold of the 8 x 8 Bayer matrix, which bit interleaving of x ^ y and y gives, clamped to a byte."""
    index = F.lit(0).cast("long")
    for bit in range(3):
        one = F.lit(1).cast("long")
        b = F.shiftright(y, bit).bitwiseAND(one)
        a = F.shiftright(x.bitwiseXOR(y), bit).bitwiseAND(one)
        index = index + F.shiftleft(a, 5 - 2 * bit) + F.shiftleft(b, 4 - 2 * bit)
    t = F.shiftright((2 * index - 63) * 16, 6)
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), v + t))


def chroma_means(pixels: DataFrame, id_col: str, channels: Sequence[str]) -> DataFrame:
    """id, x, y and the rounded mean of each channel over 2 x 2 pixels; odd edges average what there is."""
    small = pixels.groupBy(id_col, F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
    return small.agg(*(F.floor((F.sum(c) * 2 + F.count("*")) / (2 * F.count("*"))).cast("long").alias(c) for c in channels))


def dc_prediction(pixels: DataFrame, id_col: str, size: int = 4) -> DataFrame:
    """id, bx, by, dc: the rounded mean of the row above and the column left of each block; 128 without either."""
    bx, by = F.floor(F.col("x") / size).cast("long"), F.floor(F.col("y") / size).cast("long")
    above = pixels.where((F.col("y") + 1) % size == 0).select(id_col, bx.alias("bx"), (by + 1).alias("by"), "v")
    left = pixels.where((F.col("x") + 1) % size == 0).select(id_col, (bx + 1).alias("bx"), by.alias("by"), "v")
    own = pixels.groupBy(id_col, bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("_n"))
    sums = above.unionByName(left).groupBy(id_col, "bx", "by").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    mean = F.floor((2 * F.col("s") + F.col("n")) / (2 * F.col("n"))).cast("long")
    return own.join(sums, [id_col, "bx", "by"], "left").select(id_col, "bx", "by", F.coalesce(mean, F.lit(128).cast("long")).alias("dc"))
