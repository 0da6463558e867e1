from __future__ import annotations

import numpy as np

from framesift.functions import audio, images
from framesift.functions.scalars import sniff
from framesift.sources import pictures as P
from framesift.sources import writers


def test_tables(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 2, (5, 7, 4), dtype=np.uint8) * 200
    p[..., 3] = 255
    encoders = {"png": P.encode_png, "jpeg": P.encode_jpeg, "webp": P.encode_webp, "bmp": P.encode_bmp, "gif": P.encode_gif}
    raw = spark.createDataFrame([(p.tobytes(), 7, 5), (b"x", 7, 5), (None, 1, 1)], "pixels binary, width int, height int")
    parts = None
    for name, encode in encoders.items():
        from pyspark.sql import functions as F

        one = raw.select(F.lit(name).alias("name"), encode("pixels", "width", "height").alias("content"))
        parts = one if parts is None else parts.unionByName(one)
    files = parts.where("content IS NOT NULL").withColumn("format", sniff(parts.content)).cache()
    assert sorted((r.name, r.format) for r in files.collect()) == sorted((n, n) for n in encoders)
    facts = {r.name: r for r in P.info(files, ["name"]).collect()}
    assert {(r.width, r.height, r.frame_count, r.orientation, r.reason) for r in facts.values()} == {(7, 5, 1, 1, None)}
    assert not facts["png"].has_alpha and facts["bmp"].has_alpha
    decoded = {r.name: np.frombuffer(r.pixels, np.uint8).reshape(5, 7, 4) for r in P.frames(files, ["name"]).collect()}
    for name in ("png", "webp", "bmp", "gif"):
        assert (decoded[name] == p).all()
    assert np.abs(decoded["jpeg"].astype(int) - p).mean() < 9


def test_audio_and_damage(spark):
    x = np.arange(-50, 50).reshape(-1, 2)
    rows = [
        ("a", "flac", audio.encode_flac(x, 8000, tags=[("K", "v")])), ("b", "wav", writers.wav(x.ravel().tolist(), 8000, 2)), ("c", "aiff", writers.aiff(x.ravel().tolist(), 8000, 2)),
        ("d", "flac", b"fLaC"), ("e", "ogg", b"OggS"), ("f", "png", images.encode_png(np.zeros((2, 2, 4), np.uint8))[:30]),
    ]
    files = spark.createDataFrame(rows, "name string, format string, content binary")
    got = {r.name: r for r in P.pcm(files, ["name"]).collect()}
    assert all(got[n].samples == x.ravel().tolist() and got[n].rate == 8000 and got[n].channels == 2 for n in "abc")
    assert [(t.key, t.value) for t in got["a"].tags] == [("K", "v")] and got["a"].md5_matches
    assert all(got[n].reason for n in "def")
    assert all(r.reason for r in P.frames(files, ["name"]).collect())
