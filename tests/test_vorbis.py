"""Vorbis packets that are written bit by bit come back as the spectra and samples that the format defines."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest

from framesift.functions import vorbis as V
from framesift.functions.codecs import Damaged
from framesift.functions.entropy import LowBitWriter
from framesift.sources import writers


def identification(channels: int, short: int = 6, long: int = 6) -> bytes:
    return b"\x01vorbis" + struct.pack("<IBIiiiB", 0, channels, 8000, 0, 0, 0, long << 4 | short) + b"\x01"


def number(value: int) -> int:
    return (value < 0) << 31 | 788 << 21 | abs(value)


def setup(channels: int, coupled: bool, kind: int) -> bytes:
    w = LowBitWriter()
    w.put(2 - 1, 8)
    w.put(0x564342, 24), w.put(1, 16), w.put(2, 24), w.put(0, 1), w.put(0, 1)
    w.put(0, 5), w.put(0, 5), w.put(0, 4)
    w.put(0x564342, 24), w.put(2, 16), w.put(16, 24), w.put(1, 1), w.put(3, 5), w.put(16, 5)
    w.put(1, 4), w.put(number(-2), 32), w.put(number(1), 32), w.put(1, 4), w.put(0, 1)
    for v in range(4):
        w.put(v, 2)
    w.put(0, 6), w.put(0, 16)
    w.put(0, 6), w.put(1, 16), w.put(0, 5), w.put(0, 2), w.put(5, 4)
    w.put(0, 6), w.put(kind, 16), w.put(0, 24), w.put(32 * (channels if kind == 2 else 1), 24), w.put(7, 24), w.put(1, 6), w.put(0, 8)
    w.put(0, 3), w.put(0, 1), w.put(1, 3), w.put(0, 1), w.put(1, 8)
    w.put(0, 6), w.put(0, 16), w.put(0, 1), w.put(int(coupled), 1)
    if coupled:
        w.put(0, 8), w.put(0, 1), w.put(1, 1)
    w.put(0, 2), w.put(0, 8), w.put(0, 8), w.put(0, 8)
    w.put(0, 6), w.put(0, 1), w.put(0, 16), w.put(0, 16), w.put(0, 8)
    w.put(1, 1)
    return b"\x05vorbis" + w.bytes()


def packet(points: list[tuple[int, int]], classes: list[list[int]], entries: list[int]) -> bytes:
    """Floors of each channel, then the parts' classes and vectors in the order in which they are read."""
    w = LowBitWriter()
    w.put(0, 1)
    for a, b in points:
        w.put(1, 1), w.put(a, 8), w.put(b, 8)
    left = iter(entries)
    for part in classes:
        for c in part:
            w.put(c, 1)
        for c in part:
            for _ in range(4 * c):
                e = next(left)
                for bit in (3, 2, 1, 0):
                    w.put(e >> bit & 1, 1)
    return w.bytes()


def vector(e: int) -> list[int]:
    return [e % 4 - 2, e // 4 - 2]


def curve(a: int, b: int) -> np.ndarray:
    steps = [a + (1 if b >= a else -1) * (abs(b - a) * x // 32) for x in range(32)]
    return np.array([10 ** (-(255 - s) * 140 / 256 / 20) for s in steps])


def test_mono():
    rng = random.Random(4)
    decoder = V.Decoder(identification(1), setup(1, False, 1))
    blocks = []
    for k in range(5):
        points, classes = [(rng.randint(100, 250), rng.randint(100, 250))], [[rng.randint(0, 1)] for _ in range(4)]
        entries = [rng.randrange(16) for _ in range(4 * sum(c[0] for c in classes))]
        left, plain = iter(entries), []
        for (c,) in classes:
            plain += [v for _ in range(4) for v in vector(next(left))] if c else [0] * 8
        want = np.array(plain) * curve(*points[0])
        data = packet(points, classes, entries)
        assert np.allclose(decoder.spectrum(data)[0][0], want)
        i, b = np.arange(64)[:, None], np.arange(32)[None]
        window = np.sin(np.pi / 2 * np.sin(np.pi * (np.arange(64) + 0.5) / 64) ** 2)
        blocks.append((np.cos(np.pi / 128 * (2 * i + 1 + 32) * (2 * b + 1)) * want).sum(axis=1) * window)
        got = decoder.decode(data)
        assert got.shape == ((1, 0) if k == 0 else (1, 32))
        if k:
            assert np.allclose(got[0], blocks[-2][32:] + blocks[-1][:32])


def test_coupled_stereo_of_interleaved_residue():
    rng = random.Random(5)
    decoder = V.Decoder(identification(2), setup(2, True, 2))
    points = [(200, 200), (220, 180)]
    entries = [rng.randrange(16) for _ in range(4 * 8)]
    plain = np.array([v for e in entries for v in vector(e)])
    magnitude, angle = plain[0::2], plain[1::2]
    left, right = [], []
    for m, a in zip(magnitude.tolist(), angle.tolist(), strict=True):
        if m > 0:
            left.append(m if a > 0 else m + a), right.append(m - a if a > 0 else m)
        else:
            left.append(m if a > 0 else m - a), right.append(m + a if a > 0 else m)
    got = decoder.spectrum(packet(points, [[1]] * 8, entries))[0]
    assert np.allclose(got[0], np.array(left) * curve(*points[0])) and np.allclose(got[1], np.array(right) * curve(*points[1]))


def test_file_and_damage():
    silent = packet([(0, 0)], [[0]] * 4, [])
    file = writers.ogg([identification(1), b"\x03vorbis" + bytes(9), setup(1, False, 1), *[silent] * 4], 5)
    found = V.decode_ogg(file)
    assert found["rate"] == 8000 and found["samples"].shape == (1, 96) and not found["samples"].any()
    with pytest.raises(Damaged):
        V.setup_header(setup(1, False, 1)[:30], 1)
    assert math.isclose(V.DECIBELS[0], 1.0649863e-07, rel_tol=1e-6)
