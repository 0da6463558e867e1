from __future__ import annotations

import random

import pytest

from framesift.functions.codecs import Damaged
from framesift.sources import containers as C
from framesift.sources import writers as W

RNG = random.Random(3)
PAYLOADS = [bytes(RNG.randrange(256) for _ in range(n)) for n in (0, 1, 254, 255, 256, 510, 3000, 7)]
VIDEO = {"track": 1, "type": 1, "codec": "V_VP9", "width": 64, "height": 48}
SOUND = {"track": 2, "type": 2, "codec": "A_OPUS", "rate": 48000, "channels": 2}
PACKETS = [{"track": 1 + i % 2, "pts": i * 700, "key": i % 4 == 0, "data": d} for i, d in enumerate(PAYLOADS)]


def test_ivf():
    assert [(p["pts"], p["data"]) for p in C.ivf_frames(W.ivf(list(enumerate(PAYLOADS))))] == list(enumerate(PAYLOADS))
    with pytest.raises(Damaged, match="cut off"):
        list(C.ivf_frames(W.ivf([(0, b"abcdef")])[:-1]))


@pytest.mark.parametrize("most", [1, 5, 255])
def test_ogg(most):
    file = W.ogg(PAYLOADS, 7, most=most)
    assert [p["data"] for p in C.ogg_packets(file)] == PAYLOADS
    hurt = bytearray(file)
    hurt[40] ^= 1
    assert len(list(C.ogg_pages(bytes(hurt)))) == len(list(C.ogg_pages(file))) - 1


def test_webm():
    file = W.webm([VIDEO, SOUND], PACKETS)
    assert [{k: p[k] for k in ("track", "pts", "key", "data")} for p in C.matroska_packets(file)] == PACKETS
    video, sound = C.matroska_tracks(file)
    assert (video["codec"], video["width"], sound["rate"], sound["channels"]) == ("V_VP9", 64, 48000.0, 2)


def test_lacing():
    assert C.lacing(b"\x02\x05\x03" + b"aaaaabbbc", 2) == [b"aaaaa", b"bbb", b"c"]
    assert C.lacing(b"\x02" + b"aabbcc", 4) == [b"aa", b"bb", b"cc"]
    assert C.lacing(b"\x02\x85\xbd" + b"aaaaabbbc", 6) == [b"aaaaa", b"bbb", b"c"]
    with pytest.raises(Damaged):
        C.lacing(b"\x02" + b"aabbc", 4)


def test_mp4_tables():
    tracks = [{"track": 1, "type": 1, "codec": "vp09", "timescale": 1000, "width": 4, "height": 4}, {"track": 2, "type": 2, "codec": "Opus", "timescale": 48000}]
    file = W.mp4(tracks, [{**p, "dts": p["pts"], "duration": 700} for p in PACKETS])
    boxes = list(C.mp4_boxes(file))
    stsz = [b["data"] for b in boxes if b["path"].endswith("/stsz")]
    sizes = [[int.from_bytes(b[i : i + 4], "big") for i in range(12, len(b), 4)] for b in stsz]
    assert sizes == [[len(p["data"]) for p in PACKETS if p["track"] == t] for t in (1, 2)]
    offsets = next(b["data"] for b in boxes if b["path"].endswith("/co64"))
    assert file[int.from_bytes(offsets[16:24], "big") :].startswith(PACKETS[2]["data"])
    with pytest.raises(Damaged):
        list(C.mp4_boxes(file[:-3]))


@pytest.mark.parametrize("bits", [16, 24])
def test_pcm_files(bits):
    samples = [RNG.randint(-30000, 30000) for _ in range(101)]
    for write, read in ((W.wav, C.wav), (W.aiff, C.aiff)):
        found = read(write(samples, 44100, 1, bits))
        assert (found["samples"], found["rate"], found["bits"]) == (samples, 44100, bits)


def test_video_packets():
    parts = [p for p in PAYLOADS if p]
    assert C.vp9_superframe(W.vp9_superframe(parts)) == parts
    assert [o["data"] for o in C.av1_obus(b"".join(W.obu(5, p) for p in PAYLOADS))] == PAYLOADS


def test_opus_packets():
    assert C.opus_toc(0xFC) == {"mode": "celt", "bandwidth": "full", "frame_us": 20000, "channels": 2, "code": 0}
    assert C.opus_frames(bytes([0xF9]) + b"aabb")["frames"] == [b"aa", b"bb"]
    assert C.opus_frames(bytes([0xFA, 1]) + b"abb")["frames"] == [b"a", b"bb"]
    assert C.opus_frames(bytes([0xFB, 0x43, 2]) + b"abc" + bytes(2))["frames"] == [b"a", b"b", b"c"]
    with pytest.raises(Damaged):
        C.opus_frames(bytes([0xF9]) + b"abc")


def test_exif():
    assert C.exif_orientation(b"Exif\0\0II*\0\x08\0\0\0\1\0\x12\1\3\0\1\0\0\0\6\0\0\0") == 6
    assert C.exif_orientation(b"junk") == 1


def test_media_tables(spark, tmp_path):
    from framesift.sources import media

    media.register(spark)
    rows = [("a.ivf", W.ivf([(0, b"x"), (9, b"yy")])), ("b.webm", W.webm([VIDEO, SOUND], PACKETS)), ("c.ogg", W.ogg(PAYLOADS, 3)), ("d.ivf", W.ivf([(0, b"abc")])[:-1]), ("e.txt", b"text")]
    spark.createDataFrame(rows, "name string, content binary").write.format("media_files").option("path", f"{tmp_path}/files").mode("append").save()
    files = media.files(spark, f"{tmp_path}/files")
    assert {r.path.rpartition("/")[2]: r.format for r in files.collect()} == {"a.ivf": "ivf", "b.webm": "matroska", "c.ogg": "ogg", "d.ivf": "ivf", "e.txt": "unknown"}
    packets = media.packets(files, ["path"]).collect()
    count = lambda name: sum(r.path.endswith(name) and r.reason is None for r in packets)
    assert (count("a.ivf"), count("b.webm"), count("c.ogg"), count("d.ivf")) == (2, 8, 8, 0)
    assert {r.reason for r in packets if r.reason} == {"ivf: a frame is cut off", "no packets in unknown"}
    assert {r.codec for r in media.tracks(files.where("format = 'matroska'"), ["path"]).collect()} == {"V_VP9", "A_OPUS"}
    assert media.chunks(files.where("format = 'matroska'"), ["path"]).count() > 8
