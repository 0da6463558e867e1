"""Byte-level operators: histograms, checksums, permutations and match candidates, without UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADLER = 65521


def byte_values(data: Column) -> Column:
    """array<long> of the bytes of a binary column."""
    text = F.hex(data)
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    values = F.transform(places, lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.octet_length(data) > 0, values).otherwise(F.expr("cast(array() AS array<bigint>)"))


def byte_characters(data: Column) -> Column:
    """array<string> of a binary column's bytes, each as the character of its value; ascii() gives the value back."""
    return F.split(F.decode(data, "ISO-8859-1"), "")


def byte_rows(rows: DataFrame, keys: Sequence[str], data: Column) -> DataFrame:
    """keys, i, b: one row a byte, for operators that have no other form."""
    each = rows.select(*keys, F.posexplode(byte_characters(data)).alias("i", "c")).where("c <> ''")
    return each.select(*keys, F.col("i").cast("long").alias("i"), F.ascii("c").cast("long").alias("b"))


def byte_histogram(rows: DataFrame, keys: Sequence[str], data: Column) -> DataFrame:
    """keys, b, n: how often each byte occurs; partial counts leave the map side, never bytes."""
    each = rows.select(*keys, F.explode(byte_characters(data)).alias("c")).where("c <> ''")
    counts = each.groupBy(*keys, "c").agg(F.count("*").cast("long").alias("n"))
    return counts.select(*keys, F.ascii("c").cast("int").alias("b"), "n")


def adler32(rows: DataFrame, key: str, data: Column) -> DataFrame:
    """key, adler: one fold over the bytes of a row, so no byte becomes a row and nothing is shuffled.

    a = 1 + sum(b) and c = sum of a after each byte, modulo 65521; adler = c * 65536 + a.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def step(sums: Column, c: Column) -> Column:
        a = (sums["a"] + F.ascii(c)) % ADLER
        return F.struct(a.alias("a"), ((sums["c"] + a) % ADLER).alias("c"))

    characters = F.filter(byte_characters(data), lambda c: c != "")
    folded = F.aggregate(characters, F.struct(one.alias("a"), zero.alias("c")), step, lambda sums: sums["c"] * 65536 + sums["a"])
    return rows.select(key, folded.alias("adler"))


def shuffled(data: Column, element: int) -> Column:
    """out[j n + i] = in[i E + j] as a hex text; a trailing partial element stays as it is."""
    text = F.hex(data)
    n = F.floor(F.octet_length(data) / element).cast("int")
    whole = F.transform(
        F.sequence(F.lit(0), n * element - 1), lambda k: F.substring(text, ((k % n) * element + F.floor(k / n).cast("int")) * 2 + 1, F.lit(2))
    )
    rest = F.substring(text, n * element * 2 + 1, F.lit(2 * element))
    return F.when(n > 0, F.concat(F.array_join(whole, ""), rest)).otherwise(text)


def repeated_grams(rows: DataFrame, key: str, text: str, size: int, window: int) -> DataFrame:
    """key, at, distance: places whose text of `size` characters occurred before within `window`: the nearest such match.

    A window over equal strings replaces the self-join, so a frequent string costs its rows once, not their pairs.
    """
    places = F.explode(F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.expr("cast(array() AS array<int>)"))).alias("at")
    grams = rows.select(key, places, F.col(text)).select(key, "at", F.expr(f"substring({text}, at, {size})").alias("gram"))
    w = Window.partitionBy(key, "gram").orderBy("at")
    near = grams.withColumn("distance", F.col("at") - F.lag("at").over(w))
    return near.where(F.col("distance") <= window).select(key, F.col("at").cast("long").alias("at"), F.col("distance").cast("long").alias("distance"))


def deflate_symbols(matches: DataFrame, keys: Sequence[str], distance: str) -> DataFrame:
    """keys, code, extra, n: how often each distance code of deflate occurs, and the extra bits that follow one.

    Above a distance of 4 a code is the length of distance - 1 in bits and the bit below the highest.
    """
    less = F.col(distance) - 1
    bits = F.length(F.bin(less)) - 2
    below = F.expr(f"shiftright({distance} - 1, cast(greatest(length(bin({distance} - 1)) - 2, 0) AS int)) & 1")
    code = F.when(less < 2, less).otherwise(2 * (bits + 1) + below)
    extra = F.when(less < 4, 0).otherwise(bits)
    counted = matches.select(*keys, code.cast("int").alias("code"), extra.cast("int").alias("extra"))
    return counted.groupBy(*keys, "code", "extra").agg(F.count("*").cast("long").alias("n"))


def joined_bytes(parts: DataFrame, keys: Sequence[str], order_by: str, data: str, out: str = "data") -> DataFrame:
    """keys and the ordered concatenation of binary parts."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_by), F.col(data))))
    grouped = parts.groupBy(*keys).agg(F.transform(ordered, lambda p: p[data]).alias("_parts"))
    return grouped.select(*keys, F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p)), "")).alias(out))
