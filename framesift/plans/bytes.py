"""Queries over byte payloads: whole texts, no prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import scalars as S
from framesift.operators import bytestreams as Y
from framesift.plans.common import EV, samples, table


def utf8(c: str):
    return F.encode(F.col(c), "UTF-8")


def adler32_rel(spark, sf):
    return Y.adler32(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", utf8("text"))


def byte_histogram(spark, sf):
    return Y.byte_histogram(table(spark, sf, "documents"), ["lang"], utf8("text"))


def chunk_byte_planes(spark, sf):
    data = F.concat(*(F.unhex(F.lpad(F.hex(c), 8, "0")) for c in ("o_orderkey", "o_custkey")), utf8("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", Y.shuffled(data, 4).alias("planes"))


def zigzag_vint_len(spark, sf):
    made = samples(spark, sf).withColumn("d", F.col("x") - F.col("user_id") * 50)
    return made.select("event_id", S.zigzag(F.col("d")).alias("z"), S.vint_length(S.zigzag(F.col("d"))).alias("leb"), S.ebml_length(S.zigzag(F.col("d"))).alias("ebml"))


def lz_match_candidates(spark, sf):
    return Y.repeated_grams(table(spark, sf, "benchmark"), "item_id", "text", 4, 64)


def deflate_distance_codes(spark, sf):
    matches = Y.repeated_grams(table(spark, sf, "benchmark"), "item_id", "text", 4, 32768)
    return Y.deflate_symbols(matches, ["item_id"], "distance")


def format_sniff(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), utf8("text").alias("data"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), utf8("html").alias("data"))
    both = docs.unionByName(pages)
    html = F.hex(F.substring("data", 1, 9)) == "3C21444F4354595045"
    return both.select("id", "kind", F.when(html, "html").otherwise(S.sniff(F.col("data"))).alias("format"))


def md5_payload(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(utf8("text")).alias("digest"), F.octet_length("text").cast("long").alias("n"))


def crc32_payload(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.crc32(utf8("text")).alias("crc"))


def ordered_concat(spark, sf):
    parts = table(spark, sf, "conversations").select("conv_id", "turn", utf8("text").alias("data"))
    made = Y.joined_bytes(parts, ["conv_id"], "turn", "data")
    return made.select("conv_id", F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("n"))


B = "(SELECT {key}, CAST(i AS BIGINT) AS i, CAST(('0x' || substring(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT) AS b, n FROM (SELECT {key}, hex(encode({text})) AS h, strlen({text}) AS n, unnest(range(strlen({text}))) AS i FROM {table}))"
DOC_BYTES = B.format(key="doc_id, lang", text="text", table="documents")
ZZ = "(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END)"
SQL = {
    "adler32_rel": f"""
        WITH s AS (SELECT doc_id, sum(b) AS s, sum((n - i) * b) AS t FROM {DOC_BYTES} GROUP BY 1)
        SELECT doc_id, CAST((strlen(text) + coalesce(t, 0)) % 65521 * 65536 + (1 + coalesce(s, 0)) % 65521 AS BIGINT) AS adler FROM documents LEFT JOIN s USING (doc_id)
    """,
    "byte_histogram": f"SELECT lang, CAST(b AS INT) AS b, count(*) AS n FROM {DOC_BYTES} GROUP BY 1, 2",
    "chunk_byte_planes": """
        WITH h AS (SELECT o_orderkey, lpad(upper(to_hex(o_orderkey)), 8, '0') AS a, lpad(upper(to_hex(o_custkey)), 8, '0') AS c, upper(hex(encode(o_orderstatus))) AS s FROM orders)
        SELECT o_orderkey, a[1:2] || c[1:2] || a[3:4] || c[3:4] || a[5:6] || c[5:6] || a[7:8] || c[7:8] || s AS planes FROM h
    """,
    "zigzag_vint_len": f"""
        WITH z AS (SELECT event_id, {ZZ} AS z FROM (SELECT event_id, x - user_id * 50 AS d FROM {EV}))
        SELECT event_id, z, CAST(greatest(1, ceil((CASE WHEN z > 0 THEN length(bin(z)) ELSE 0 END) / 7)) AS INT) AS leb, CAST(greatest(1, ceil(length(bin(z + 1)) / 7)) AS INT) AS ebml FROM z
    """,
    "lz_match_candidates": """
        WITH g AS (SELECT item_id, p + 1 AS a, substring(text, CAST(p + 1 AS BIGINT), 4) AS g FROM (SELECT item_id, text, unnest(range(greatest(0, length(text) - 3))) AS p FROM benchmark)),
        d AS (SELECT item_id, a, a - lag(a) OVER (PARTITION BY item_id, g ORDER BY a) AS d FROM g)
        SELECT item_id, CAST(a AS BIGINT) AS "at", CAST(d AS BIGINT) AS distance FROM d WHERE d <= 64
    """,
    "deflate_distance_codes": """
        WITH g AS (SELECT item_id, p + 1 AS a, substring(text, CAST(p + 1 AS BIGINT), 4) AS g FROM (SELECT item_id, text, unnest(range(greatest(0, length(text) - 3))) AS p FROM benchmark)),
        d AS (SELECT item_id, a - lag(a) OVER (PARTITION BY item_id, g ORDER BY a) - 1 AS d FROM g),
        c AS (SELECT item_id, CASE WHEN d < 4 THEN 0 ELSE CAST(floor(log2(d)) AS INT) - 1 END AS extra, d FROM d WHERE d < 32768)
        SELECT item_id, CAST(CASE WHEN d < 4 THEN d ELSE 2 * extra + (d >> extra) END AS INT) AS code, CAST(extra AS INT) AS extra, count(*) AS n FROM c GROUP BY 1, 2, 3
    """,
    "format_sniff": """
        WITH b AS (SELECT doc_id AS id, 'document' AS kind, text AS t FROM documents UNION ALL SELECT page_id, 'page', html FROM pages)
        SELECT id, kind, CASE WHEN starts_with(t, '<!DOCTYPE') THEN 'html' WHEN starts_with(t, 'BM') THEN 'bmp' WHEN starts_with(t, 'GIF89a') OR starts_with(t, 'GIF87a') THEN 'gif'
               WHEN starts_with(t, 'fLaC') THEN 'flac' WHEN starts_with(t, 'OggS') THEN 'ogg' WHEN starts_with(t, 'DKIF') THEN 'ivf' ELSE 'unknown' END AS format FROM b
    """,
    "md5_payload": "SELECT doc_id, md5(text) AS digest, CAST(strlen(text) AS BIGINT) AS n FROM documents",
    "ordered_concat": """
        SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest, CAST(sum(strlen(text)) AS BIGINT) AS n FROM conversations GROUP BY 1
    """,
}
QUERIES = {name: globals()[name] for name in (*SQL, "crc32_payload")}
