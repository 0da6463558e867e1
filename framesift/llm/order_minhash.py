"""Order MinHash fingerprints with DataFrame functions only.

The items of a text are its k-mers of words, each with its occurrence number, which counts equal 64-bit
hashes. CIRCLES independent hashes order the items; each serves m / CIRCLES hash functions: function j of a
circle is the hash less a share j of the hash range, round the circle, which is as uniform as any other, so
its `l` minimal items are the first `l` from that point of the sorted circle. They are put back in text
order, and the hash of the tuple of k-mers is an entry of the signature. Two signatures agree where the same
k-mers are minimal and in the same order, as edits rarely leave them.

Neighbouring documents meet inside ranges of ids: a range also gets a copy of the first document of the
next one (the last range: of the first), so a window over each range sees every document's successor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
L = 2
M = 64
#: independent hashes, each turned M / CIRCLES ways
CIRCLES = 4
SPACE = r"[\\x20\\x09-\\x0D]+"
#: low bits of an item that hold its place in the text
PLACE = 30
MASK = (1 << PLACE) - 1
#: more ranges than tasks, so that tasks hold about as many rows each
RANGES_PER_TASK = 4


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and body with it by name."""
    return f"transform(array({value}), {name} -> {body})[0]"


NO_ITEMS = "cast(array() AS array<bigint>)"


def signature_sql(text: str, k: int = K, take: int = L, m: int = M, circles: int = CIRCLES) -> str:
    """SQL of the signature of a text column: an array of m longs below 2**32, empty for a text without words."""
    turns = m // circles
    words = f"array_remove(split({text}, '{SPACE}'), '')"
    kmer = ", ".join(f"ws[i + {d}]" for d in range(k))
    hashes = (
        f"CASE WHEN size(ws) = 0 THEN {NO_ITEMS} WHEN size(ws) < {k} THEN array(xxhash64(array_join(ws, ' '))) "
        f"ELSE transform(sequence(0, size(ws) - {k}), i -> xxhash64({kmer})) END"
    )
    # top of the hash and place of every item; where hashes repeat, those after the first are hashed with their number
    top = f"shiftleft(shiftright(%s, {PLACE}), {PLACE}) | cast(%s AS bigint)"
    packed = f"sort_array(transform(hs, (h, i) -> {top % ('h', 'i')}))"
    # only neighbours with one top can repeat a hash
    same_top = " OR ".join(f"shiftright(x, {PLACE}) = shiftright(get(ps, i {d} 1), {PLACE})" for d in "-+")
    alike = f"CASE WHEN size(array_distinct(hs)) < size(hs) THEN filter(ps, (x, i) -> {same_top}) ELSE {NO_ITEMS} END"
    place = f"cast(x & {MASK}L AS int)"
    runs = "filter(sequence(0, size(ss) - 1), i -> i = 0 OR ss[i].h <> ss[greatest(i - 1, 0)].h)"
    numbered = (
        "flatten(transform(rs, (a, r) -> transform("
        "slice(ss, a + 1, (CASE WHEN r + 1 < size(rs) THEN rs[r + 1] ELSE size(ss) END) - a), "
        f"(x, c) -> {top % ('CASE WHEN c = 0 THEN x.h ELSE xxhash64(x.h, c) END', 'x.p')})))"
    )
    repeated = let(f"sort_array(transform(ds, x -> struct(hs[{place}] AS h, {place} AS p)))", "ss", let(runs, "rs", numbered))
    items = f"CASE WHEN size(ds) = 0 THEN ps ELSE sort_array(concat(array_except(ps, ds), {repeated})) END"
    turned_items = f"sort_array(transform(ts, x -> {top % (f'xxhash64(shiftright(x, {PLACE}), %d)', f'(x & {MASK}L)')}))"
    circle = [("ts" if q == 0 else f"us{q}", turned_items % q if q else items) for q in range(circles)]
    halves = f"filter(array({', '.join(str(1 << i) for i in range(PLACE, -1, -1))}), n -> n <= size(ts))"
    # the first item at or after the start of each turn, found by halving; past the end the circle begins again
    least = (1 << 64) // turns
    start = "aggregate(ns, 0, (a, n) -> CASE WHEN get(%s, a + n - 1) < b THEN a + n ELSE a END)"
    bounds = f"array({', '.join('-9223372036854775807L - 1L' if j == 0 else f'{j * least - (1 << 63)}L' for j in range(turns))})"
    places = f"sort_array(transform(sequence(0, least({take}, size(%s)) - 1), d -> %s[(a + d) % size(%s)] & {MASK}L))"
    signed = []
    for name, _ in circle:
        there = places.replace("% size", "%% size") % (name, name, name)
        entry = f"xxhash64(transform({there}, p -> hs[cast(p AS int)])) & 4294967295L"
        signed.append(f"transform({bounds}, b -> {let(start % name, 'a', entry)})")
    whole = f"CASE WHEN size(hs) = 0 THEN {NO_ITEMS} ELSE concat({', '.join(signed)}) END"
    for name, step in reversed([("ws", words), ("hs", hashes), ("ps", packed), ("ds", alike), *circle[:1], ("ns", halves), *circle[1:]]):
        whole = let(step, name, whole)
    return whole


def likeness(a: str, b: str) -> Column:
    """The share of equal entries; 1 for two empty signatures, 0 for one."""
    return F.expr(
        f"CASE WHEN size({a}) = 0 OR size({b}) = 0 THEN cast(size({a}) = size({b}) AS double) "
        f"ELSE size(filter({a}, (x, i) -> x = {b}[i])) / cast(size({a}) AS double) END"
    )


def as_text(signature: str) -> Column:
    return F.expr(f"array_join(transform({signature}, x -> lower(lpad(hex(x), 8, '0'))), '')")


def range_bounds(docs: DataFrame, key: str, ranges: int) -> list[int]:
    """Least keys of ranges of about equal numbers of rows, each the key of a row; at most `ranges` numbers."""
    cuts = docs.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    rough = sorted({-(1 << 63), *(int(min(x, (1 << 63) - 1024)) for x in cuts)})
    # quantiles are doubles, so the least key of each range is looked up
    return sorted(r[0] for r in docs.groupBy(range_of(F.col(key), rough)).agg(F.min(key)).select(f"min({key})").collect())


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of the last bound that is not above key, found in two levels."""
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(g[0]) for g in groups))
    table = F.array(*(F.array(*(F.lit(x) for x in g)) for g in groups))
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    group = F.greatest(below(heads), F.lit(1))
    return (group - 1) * step + F.greatest(below(F.element_at(table, group)), F.lit(1)) - 1


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_text, signature, edited_signature, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next
    document in ascending order of id, the last document's next being the first. Null counts as empty. A
    missing id sorts before all others, by a hash of its text among the ids below -2**62; rows with one id are in order of a
    hash of their texts, then of the texts. Texts of up to 2**30 words are fingerprinted whole. A single row is its own next. A text of one or two words is one k-mer. An empty table gives no rows.
    """
    spark = docs.sparkSession
    missing = F.lit(-(1 << 63)) + F.pmod(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(1 << 62))
    key = F.coalesce(F.col(id_col).cast("long"), missing)
    ranges = ranges or RANGES_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs.select(key.alias("key")), "key", ranges) or [0]
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = len(bounds)
    own = range_of(F.col("key"), bounds)
    at = F.struct(own.alias("part"), F.lit(False).alias("copy"))
    copy = F.struct(F.pmod(own - 1, F.lit(n)).alias("part"), F.lit(True).alias("copy"))
    is_first = F.col("key").isin(bounds)
    placed = row.withColumn("at", F.explode(F.when(is_first, F.array(at, copy)).otherwise(F.array(at))))
    placed = placed.select("doc_id", "key", "text", "at.part", "at.copy", F.xxhash64("text").alias("tie"))
    # a copy for a range stands after its rows; the copy of a range's own only row stands there as well
    order = Window.partitionBy("part").orderBy("copy", "key", "tie", "text")
    n_chars = F.length("text")
    changed = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) AS int))"), F.substring(F.col("next_text"), F.lit(1), changed))
    paired = placed.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    signed = paired.select(
        "doc_id", "part", "copy", "key", "tie", "text", n_chars.cast("long").alias("n_chars"), edited.alias("edited_text"),
        F.expr(signature_sql("text")).alias("signature"),
    )
    nexted = signed.withColumn("next_signature", F.lead("signature").over(order)).where(~F.col("copy"))
    done = nexted.select("doc_id", "n_chars", "edited_text", "signature", "next_signature", F.expr(signature_sql("edited_text")).alias("edited_signature"))
    return done.select(
        "doc_id", "n_chars", "edited_text", "signature", "edited_signature",
        likeness("signature", "edited_signature").alias("near_edited"), likeness("signature", "next_signature").alias("near_next"),
    )
