from __future__ import annotations

import numpy as np
import pytest

from framesift.functions.images import encode_gif, encode_png
from framesift.plans import catalogue
from framesift.sources import functions, writers


@pytest.fixture(scope="module")
def sql(spark):
    functions.register(spark)
    return spark.sql


def test_functions(sql):
    row = sql("SELECT media_inflate(media_deflate(d)) = d AS a, media_unlz4(media_lz4(d)) = d AS b, media_unlz4(d) AS c, media_crc32c(CAST('123456789' AS BINARY)) AS e FROM (SELECT CAST(repeat('ab', 99) AS BINARY) AS d)").first()
    assert (row.a, row.b, row.c, row.e) == (True, True, None, 0xE3069283)


def test_tables(spark, sql):
    pictures = [np.full((2, 2, 4), 255, np.uint8)] * 2
    rows = [("ivf", writers.ivf([(5, b"ab"), (6, b"c")])), ("png", encode_png(pictures[0])), ("gif", encode_gif(pictures)), ("none", None), ("bad", b"xx")]
    spark.createDataFrame(rows, "name string, body binary").createOrReplaceTempView("media")
    packets = sql("SELECT name, seq, pts, data FROM media, LATERAL ivf_frames(body) ORDER BY seq").collect()
    assert [(r.name, r.pts, bytes(r.data)) for r in packets] == [("ivf", 5, b"ab"), ("ivf", 6, b"c")]
    assert [r.kind for r in sql("SELECT kind FROM media, LATERAL png_chunks(body) ORDER BY seq").collect()] == ["IHDR", "IDAT", "IEND"]
    assert [r.delay_ms for r in sql("SELECT delay_ms FROM media, LATERAL gif_frames(body)").collect()] == [100, 100]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in catalogue.queries() if not n.startswith("stream_")))
def test_plan(spark, name):
    """No query pairs all rows, and a scan reads the columns it needs only."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ("fixed_predictor_cost", "frame_offsets", "byte_histogram", "color_histogram_555", "level_lookup"):
        assert "ReadSchema" in plan and "props" not in plan and "l_tax" not in plan and "o_orderdate" not in plan
