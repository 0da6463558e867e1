from __future__ import annotations

import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framesift.functions import codecs as C

RNG = random.Random(2)
DATA = [b"", b"a", b"abcabcabc" * 99, bytes(RNG.randrange(256) for _ in range(5000)), bytes(RNG.choice(b"ab") for _ in range(70000))]
PAIRS = [
    (C.deflate, C.inflate), (C.snappy, C.unsnappy), (C.snappy_framed, C.snappy_unframed), (C.lz4, C.unlz4), (C.lz4_blocks, C.unlz4),
    (C.lzw, C.unlzw), (C.weightpack, C.weightunpack),
]


@pytest.mark.parametrize("encode,decode", PAIRS)
def test_round_trip(encode, decode):
    for data in DATA:
        assert decode(encode(data)) == data


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes(data):
    for encode, decode in [*PAIRS, (C.bool_code, C.bool_decode)]:
        assert decode(encode(data)) == data
    for element in (1, 2, 3, 4, 8):
        assert C.unshuffle(C.shuffle(data, element), element) == data
        assert C.bitunshuffle(C.bitshuffle(data, element), element) == data


@pytest.mark.parametrize("encode,decode", [p for p in PAIRS if p[0] is not C.snappy])
def test_damage_has_a_reason(encode, decode):
    coded = encode(DATA[3])
    with pytest.raises(C.Damaged, match=".+: .+"):
        decode(coded[: len(coded) // 2])


def test_shuffle_places():
    assert C.shuffle(bytes([1, 2, 3, 4, 5, 6, 7]), 2) == bytes([1, 3, 5, 2, 4, 6, 7])


def test_other_readers_agree():
    assert zlib.decompress(b"".join(C.deflate_blocks(DATA[4], 999)), -15) == DATA[4]
    assert pa.Codec("lz4").decompress(C.lz4_blocks(DATA[4]), decompressed_size=len(DATA[4]), asbytes=True) == DATA[4]


def test_known_checksums():
    check = b"123456789"
    assert (C.crc8(check), C.crc16(check), C.crc32c(check), C.xxh32(b"")) == (0xF4, 0xFEE8, 0xE3069283, 0x02CC5D05)


def test_bool_coder_with_changing_probabilities():
    rng = random.Random(1)
    bits = [(int(rng.random() < 0.3), rng.randint(1, 255)) for _ in range(5000)]
    out = C.BoolEncoder()
    for bit, prob in bits:
        out.put(bit, prob)
    reader = C.BoolDecoder(out.finish())
    assert all(reader.get(prob) == bit for bit, prob in bits)
