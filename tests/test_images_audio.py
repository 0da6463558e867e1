from __future__ import annotations

import numpy as np
import pytest

from framesift.functions import audio as A
from framesift.functions import images as I  # noqa: E741
from framesift.functions.codecs import Damaged
from framesift.functions.webp import decode_webp, encode_webp

RNG = np.random.default_rng(4)


def pictures():
    for h, w in ((1, 1), (7, 13), (16, 24)):
        whole = RNG.integers(0, 256, (h, w, 4), dtype=np.uint8)
        opaque, grey = whole.copy(), whole.copy()
        opaque[..., 3] = 255
        grey[..., :3] = grey[..., :1]
        yield from (whole, opaque, grey, np.cumsum(np.cumsum(whole // 60, 0), 1).astype(np.uint8))


def test_lossless():
    for p in pictures():
        assert (I.decode_png(I.encode_png(p)) == p).all()
        assert (I.decode_bmp(I.encode_bmp(p, True)) == p).all()
        assert (decode_webp(encode_webp(p)) == p).all()
        few = p // 128 * 100
        few[..., 3] = 255
        frames = I.decode_gif(I.encode_gif([few, few[::-1]], [50, 70]))
        assert (frames[0]["pixels"] == few).all() and (frames[1]["pixels"] == few[::-1]).all() and frames[1]["delay_ms"] == 70


def test_png_color_types():
    p = np.full((2, 2, 4), 255, np.uint8)
    assert [I.encode_png(x)[25] for x in (p, p * [1, 1, 1, 0], p * [1, 0, 1, 1], p * [1, 0, 1, 0])] == [0, 4, 2, 6]
    with pytest.raises(Damaged):
        I.decode_png(I.encode_png(p)[:-20])


def test_jpeg_is_close():
    y, x = np.mgrid[0:30, 0:45]
    p = np.dstack([x * 5, y * 8, x + y, np.full_like(x, 255)]).astype(np.uint8)
    assert np.abs(I.decode_jpeg(I.encode_jpeg(p, 95)).astype(int) - p).max() <= 4
    noise = RNG.integers(0, 256, (21, 34, 4), dtype=np.uint8)
    for picture in (p, noise, p * 0, np.repeat(noise[:, :1], 30, axis=1)):
        for quality in (60, 95):
            assert (I.decode_jpeg(I.encode_jpeg(picture, quality, True)) == I.decode_jpeg(I.encode_jpeg(picture, quality))).all()


def test_textures():
    values = RNG.integers(0, 256, (9, 10))
    back = I.decode_texture(I.encode_bc4(values), 10, 9, "bc4")[..., 0].astype(int)
    assert np.abs(back - values).max() <= 19
    block = bytes([0, 248, 31, 0, *[0b11100100] * 4])
    assert I.decode_texture(block, 4, 4, "bc1")[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255], [170, 0, 85, 255], [85, 0, 170, 255]]


def test_palette():
    colors = RNG.integers(0, 256, (999, 3))
    palette = I.median_cut(colors, np.ones(999, np.int64), 16)
    assert 2 <= len(palette) <= 16 and (I.nearest(palette, palette) == np.arange(len(palette))).all()
    assert I.dither(np.full((3, 3, 4), 127, np.uint8), np.array([[0] * 3, [255] * 3])).sum() in (4, 5)


@pytest.mark.parametrize("orientation", range(1, 9))
def test_orientation_is_a_permutation(orientation):
    p = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    assert sorted(I.turned(p, orientation).ravel()) == list(range(24))


@pytest.mark.parametrize("channels", [1, 2, 3])
def test_flac(channels):
    for n in (1, 5, 4096, 5000):
        t = np.arange(n)[:, None]
        smooth = (8000 * np.sin(t / 20 + np.arange(channels)) + RNG.normal(0, 50, (n, channels))).astype(np.int64)
        for x in (smooth, smooth * 0 + 7, smooth // 8 * 8, RNG.integers(-32768, 32768, (n, channels))):
            found = A.decode_flac(A.encode_flac(x, 44100, tags=[("A", "b=c"), ("A", "d")]))
            assert (found["samples"] == x).all() and found["md5_matches"] and found["tags"] == [("A", "b=c"), ("A", "d")]


def test_damaged_flac_keeps_its_length():
    file = bytearray(A.encode_flac(RNG.integers(-99, 99, (9000, 2)), 48000))
    file[len(file) // 2] ^= 255
    found = A.decode_flac(bytes(file))
    assert found["bad_frames"] == 1 and len(found["samples"]) == 9000 and not found["md5_matches"]


def test_transforms():
    x = RNG.normal(size=1000)
    assert np.abs(A.imdct(A.mdct(x, 64), 64, 1000) - x).max() < 1e-9
    assert A.block_types([0, 1, 0, 1, 0, 0, 0]).tolist() == [1, 2, 2, 2, 3, 0, 0]
    assert A.levinson([1, 0.5, 0.25], 2) == [[0.5], [0.5, 0.0]]
