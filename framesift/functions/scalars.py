"""Scalar functions as Column expressions: all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(value: Column, scale: int = 100) -> Column:
    """A double as an integer sample, half away from zero."""
    return F.round(value * scale).cast("long")


def zigzag(e: Column) -> Column:
    """2e for e >= 0, else -2e - 1."""
    return F.when(e >= 0, 2 * e).otherwise(-2 * e - 1).cast("long")


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1)).cast("long")


def bit_length(x: Column) -> Column:
    """Bits of a number >= 0 without leading zeros; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def vint_length(x: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits, one at least."""
    return F.greatest(F.lit(1), F.ceil(bit_length(x) / 7)).cast("int")


def ebml_length(x: Column) -> Column:
    """Bytes of an EBML size: all ones is reserved, so a full group needs another byte."""
    return F.greatest(F.lit(1), F.ceil(bit_length(x + 1) / 7)).cast("int")


def rice_bits(m: Column, s: Column, k: Column) -> Column:
    """Estimated bits of m residuals with zigzag sum s at parameter k."""
    over = 2 * s - m * (F.expr("1L") * F.pow(F.lit(2), k).cast("long") - 1)
    return (m * (k + 1) + F.greatest(F.lit(0).cast("long"), F.floor(over / F.pow(F.lit(2), k + 1)).cast("long"))).cast("long")


def rice_start(m: Column, s: Column) -> Column:
    """The largest k with m << (k + 1) <= s, 0 where there is none, 30 at most."""
    share = F.when(m > 0, F.expr("0L") + F.floor(s / F.greatest(m, F.lit(1)))).otherwise(0).cast("long")
    return F.least(F.lit(30), F.greatest(F.lit(0), bit_length(share) - 2)).cast("int")


def rice_choice(m: Column, s: Column) -> Column:
    """struct(bits, k): the start parameter, or its lower, then its upper neighbour where strictly fewer bits."""
    k0 = rice_start(m, s)
    low = F.greatest(k0 - 1, F.lit(0))
    b0, b1 = rice_bits(m, s, k0), rice_bits(m, s, low)
    k1 = F.when((k0 > 0) & (b1 < b0), low).otherwise(k0)
    up = F.least(k0 + 1, F.lit(30))
    b2 = rice_bits(m, s, up)
    best = F.least(b0, F.when(k0 > 0, b1).otherwise(b0))
    return F.struct(F.least(best, b2).cast("long").alias("bits"), F.when(b2 < best, up).otherwise(k1).cast("int").alias("k"))


def paeth(a: Column, b: Column, c: Column) -> Column:
    """The neighbour closest to a + b - c; left, then up, then diagonal on ties."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def filter_cost(difference: Column) -> Column:
    """Cost of one filtered byte: its absolute value as a signed byte."""
    f = difference.bitwiseAND(F.lit(255).cast("long"))
    return F.when(f < 128, f).otherwise(256 - f)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Studio-range luma of 8-bit colours with 16 fraction bits."""
    return F.shiftright(16839 * r + 33059 * g + 6420 * b + (1 << 15) + (16 << 16), 16)


def to_byte(x: Column) -> Column:
    """A float in 0..1 as a byte: times 255, clamped, truncated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * 255)).cast("int")


def to_s16(x: Column) -> Column:
    """A float sample as a saturated 16-bit integer, half to even; NaN gives the least value."""
    scaled = F.rint(x * 32768)
    return F.when(F.isnan(x) | (scaled >= 2147483648.0) | (scaled < -2147483648.0), -32768).otherwise(
        F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), scaled)).cast("int")
    )


def qindex_of_crf(crf: Column) -> Column:
    """The base quantiser index of a quality from 0 to 63; null outside."""
    # fixed values: steps of 4 up to 61, then 249 and 255; index 0, lossless, is not used
    index = F.when(crf == 62, 249).when(crf == 63, 255).otherwise(F.greatest(crf * 4, F.lit(1)))
    return F.when(crf.between(0, 63), index).cast("int")


def deadzone(v: Column, step: Column) -> Column:
    """sign(v) * ((|v| + step / 2) / step): half away from zero for even steps."""
    return (F.signum(v) * F.floor((F.abs(v) + F.floor(step / 2)) / step)).cast("long")


def get_prob(n0: Column, den: Column) -> Column:
    """Probability of a zero in 1..255 from counts; 128 without any."""
    return F.when(den == 0, 128).otherwise(F.greatest(F.lit(1), F.least(F.lit(255), F.floor((256 * n0 + F.floor(den / 2)) / F.greatest(den, F.lit(1)))))).cast("long")


def merge_prob(pre: Column, n0: Column, n1: Column, most: int = 20, rate: int = 128) -> Column:
    """The prior probability moved towards the counted one, the more so the more was counted."""
    factor = F.floor(rate * F.least(n0 + n1, F.lit(most)) / most)
    return F.shiftright((pre * (256 - factor) + get_prob(n0, n0 + n1) * factor + 128).cast("long"), 8)


def sniff(head: Column) -> Column:
    """Media type of a file's first bytes by magic numbers."""
    is_hex = lambda start, text: F.hex(F.substring(head, start, len(text) // 2)) == text
    # magic numbers of the formats
    return (
        F.when(is_hex(1, "89504E470D0A1A0A"), "png")
        .when(is_hex(1, "FFD8FF"), "jpeg")
        .when(is_hex(1, "52494646") & is_hex(9, "57454250"), "webp")
        .when(is_hex(1, "474946383761") | is_hex(1, "474946383961"), "gif")
        .when(is_hex(1, "424D"), "bmp")
        .when(is_hex(5, "66747970") & (is_hex(9, "61766966") | is_hex(9, "61766973")), "avif")
        .when(is_hex(1, "444B4946"), "ivf")
        .when(is_hex(1, "4F676753"), "ogg")
        .when(is_hex(1, "1A45DFA3"), "matroska")
        .when(is_hex(5, "66747970"), "mp4")
        .when(is_hex(1, "664C6143"), "flac")
        .when(is_hex(1, "52494646") & is_hex(9, "57415645"), "wav")
        .when(is_hex(1, "464F524D") & is_hex(9, "41494646"), "aiff")
        .otherwise("unknown")
    )
