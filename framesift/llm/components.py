"""Connected components of a link table by alternating star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import checkpoint_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node that each linked node reaches, for nodes that aren't their own root.

    A step replaces the links of each node by links to its least neighbour. Least neighbours are partial
    aggregates; the join back to the links is one that adaptive execution splits where a node has many.
    Each round is a checkpoint in the session's shared folder, so lineage stays short.
    """
    checkpoint_dir(links.sparkSession)
    edges = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
        .checkpoint()
    )
    before = _state(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small, "hi")
        edges = (
            joined.where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(small.select("hi", F.col("m").alias("lo")))
            .distinct()
            .checkpoint()
        )
        now = _state(edges)
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
