from __future__ import annotations

import random
import zlib

import numpy as np

from framesift.operators import analysis as A


def test_crc32_joined():
    rng = random.Random(1)
    for _ in range(30):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))) for _ in range(2))
        assert A.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_frame_rate():
    for frames, ticks, scale in ((300, 10010, 1000), (250, 10000, 1000), (1, 41, 1000), (90, 3003, 1000)):
        num, den = A.frame_rate(frames, ticks, scale)
        assert frames * scale * den // num == ticks and den <= 1001
    assert A.frame_rate(250, 10000, 1000) == (25, 1)


def test_segments_and_groups():
    values = np.repeat([3, 5, 100, 104, 200], 9)
    centres, of = A.segments(values, 3)
    assert sorted(round(c) for c in centres) == [4, 102, 200] and len({of[3], of[100], of[200]}) == 3 and of[3] == of[5]
    histograms = np.array([[9, 0, 0], [8, 1, 0], [0, 9, 0], [0, 0, 9], [0, 1, 8]])
    of = A.farthest_groups(histograms, 3)
    assert of[0] == of[1] and of[3] == of[4] and len(set(of)) == 3
    assert A.segments(np.zeros(0, np.int64))[0].size == 0
