from __future__ import annotations

import random

from framesift.functions.entropy import LowBitReader, LowBitWriter, RangeDecoder, RangeEncoder, canonical, code_lengths, decoding_table


def test_range_coder():
    rng = random.Random(1)
    for _ in range(50):
        cumulative = [0]
        for _ in range(rng.randint(2, 9)):
            cumulative.append(cumulative[-1] + rng.randint(1, 40))
        symbols = [rng.randrange(len(cumulative) - 1) for _ in range(rng.randint(0, 200))]
        numbers = [(rng.randrange(t), t) for t in (rng.randint(2, 100_000) for _ in range(10))]
        out = RangeEncoder()
        for s in symbols:
            out.put(cumulative[s], cumulative[s + 1], cumulative[-1])
        for v, t in numbers:
            out.number(v, t)
        reader = RangeDecoder(out.finish(600))
        assert [reader.get(cumulative) for _ in symbols] == symbols
        assert [reader.number(t) for _, t in numbers] == [v for v, _ in numbers]


def test_prefix_codes():
    rng = random.Random(2)
    for most in (4, 7, 15):
        counts = [rng.choice([0, 1, 5, 1000, 10**6]) for _ in range(14)]
        counts[0] = counts[1] = 1
        lengths = code_lengths(counts, most)
        assert max(lengths) <= most and sum(2.0**-n for n in lengths if n) == 1
        table, out = canonical(lengths), LowBitWriter()
        symbols = [rng.choice([s for s, n in enumerate(counts) if n]) for _ in range(300)]
        for s in symbols:
            out.code(*table[s])
        reader = LowBitReader(out.bytes())
        assert [reader.symbol(decoding_table(lengths)) for _ in symbols] == symbols
