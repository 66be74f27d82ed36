"""Scalar models and codes: quantiser tables, rate and distortion, angles, vectors, sizes, checksums, variable-length bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .fixed import clamp, div

# 64 / tan(angle) as the angles' grid has it, by angle in degrees.
DERIVATIVES = {
    3: 1023, 6: 547, 9: 372, 14: 273, 17: 215, 20: 178, 23: 151, 26: 132, 29: 116, 32: 102, 36: 90, 39: 80, 42: 71, 45: 64,
    48: 57, 51: 51, 54: 45, 58: 40, 61: 35, 64: 31, 67: 27, 70: 23, 73: 19, 76: 15, 81: 11, 84: 7, 87: 3,
}
#: Fixed value: the reversed polynomial of CRC-32C (Castagnoli).
CASTAGNOLI = 0x82F63B78


def log2_floor(x: Column) -> Column:
    """Place of the highest bit of a positive integer."""
    return (F.length(F.bin(x)) - 1).cast("int")


def quantiser_row(step: Column, q: Column) -> dict[str, Column]:
    """What a quantiser needs for a step: reciprocal and shift of it, dead zone and rounding."""
    high = log2_floor(step)
    one = F.lit(1).cast("bigint")
    power = lambda n: F.call_function("shiftleft", one, n)
    zone = F.when(q == 0, 64).when(step < 148, 84).otherwise(80)
    return {
        "quant": div(power(high + 16), step) + 1 - 65536,
        "shift": power(16 - high),
        "zbin": F.shiftright(zone * step + 64, 7),
        "round": F.shiftright(F.when(q == 0, 64).otherwise(48) * step, 7),
        "quant_fp": div(F.lit(65536).cast("bigint"), step),
        "round_fp": F.shiftright(step * 64, 7),
    }


def interpolated_laplacian(entries: int = 104) -> list[tuple[int, int, int]]:
    """(x, rate, distortion), all in 1/1024, of a Laplacian source by squared step over variance x.

    The grid has eight points an octave: x = (((8 + i mod 8) << i div 8) - 8) * 4. Rate is the entropy of a uniform
    quantiser's levels, in bits; distortion the share of the variance that is lost.
    """
    out = []
    for i in range(entries):
        x = (((8 + i % 8) << (i // 8)) - 8) * 4
        step = math.sqrt(2 * x / 1024)
        ratio = math.exp(-step)
        zero = 1 - math.exp(-step / 2)
        bits = lambda p: 0.0 if p <= 0 or p >= 1 else -p * math.log2(p) - (1 - p) * math.log2(1 - p)
        rate = 16.0 if x == 0 else bits(zero) + (1 - zero) * (1 + bits(ratio) / (1 - ratio))
        lost = 1 - math.exp(-x / 1024 / 12)
        out.append((x, round(rate * 1024), round(lost * 1024)))
    return out


def model_rate_distortion(variance: Column, area_bits: int, step: Column) -> tuple[Column, Column]:
    """(rate in 1/512 bits, distortion) of a block of 2^``area_bits`` samples, between the points of ``interpolated_laplacian``."""
    points = interpolated_laplacian()
    table = lambda k: F.array(*(F.lit(p[k]).cast("bigint") for p in points))
    most = points[-2][0]
    x = F.least(div(F.shiftleft(step * step, area_bits + 10) + F.shiftright(variance, 1), variance), F.lit(most)).cast("bigint")
    t = F.shiftright(x, 2) + 8
    octave = log2_floor(t) - 3
    i = (octave * 8 + F.call_function("shiftright", t, octave).bitwiseAND(7)).cast("int")
    a = F.call_function("shiftright", F.shiftleft(x - F.get(table(0), i), 10), octave + 2)
    mean = lambda k: F.shiftright(F.get(table(k), i) * (1024 - a) + F.get(table(k), i + 1) * a, 10)
    flat = variance == 0
    return F.when(flat, 0).otherwise(F.shiftright(F.shiftleft(mean(1), area_bits) + 1, 1)).cast("bigint"), F.when(flat, 0).otherwise(F.shiftright(variance * mean(2) + 512, 10)).cast("bigint")


def cubic(points: list[float], x: Column) -> Column:
    """The curve through equally spaced points (at 0, 1, ...), by cubics through four of them; ``x`` from 1 to their number less 2."""
    table = F.array(*map(F.lit, points))
    i = F.floor(x).cast("int")
    p = [F.get(table, i + k) for k in (-1, 0, 1, 2)]
    f = x - i
    return p[1] + F.lit(0.5) * f * (p[2] - p[0] + f * (F.lit(2.0) * p[0] - F.lit(5.0) * p[1] + F.lit(4.0) * p[2] - p[3] + f * (F.lit(3.0) * (p[1] - p[2]) + p[3] - p[0])))


def angle_derivatives(angle: Column) -> tuple[Column, Column]:
    """(dx, dy) of a prediction angle in degrees; 1 where there is none, null for an angle off the grid."""
    table = F.create_map(*(F.lit(x) for pair in DERIVATIVES.items() for x in pair))
    of = lambda a: F.element_at(table, a)
    dx = F.when(angle < 90, of(angle)).when((angle > 90) & (angle < 180), of(180 - angle)).otherwise(1)
    dy = F.when((angle > 90) & (angle < 180), of(angle - 90)).when(angle > 180, of(270 - angle)).otherwise(1)
    return dx, dy


def vector_class(x: Column) -> Column:
    """Class of a vector component's size: doubling ranges from 16 on; null for 0."""
    z = F.abs(x) - 1
    return F.when(x == 0, F.lit(None)).otherwise(F.when(z < 16, 0).otherwise(F.least(log2_floor(F.greatest(F.shiftright(z, 3), F.lit(1))), F.lit(10))))


def vector_joint(row: Column, col: Column) -> Column:
    """0: no component, 1: the column's, 2: the row's, 3: both."""
    return (row != 0).cast("int") * 2 + (col != 0).cast("int")


def coded_width(width: Column, denominator: Column) -> Column:
    """Width before upscaling by ``denominator`` / 8."""
    return F.when(denominator <= 8, width).otherwise(div(width * 8 + div(denominator, 2), denominator))


def upscale_step(coded: Column, width: Column) -> Column:
    """Source samples a target sample, in 1/16384."""
    return div(F.shiftleft(coded, 14) + div(width, 2), width)


def crc32c(data: Column) -> Column:
    """CRC-32C of a binary column, as a long: one look-up a byte in a table made from the polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (CASTAGNOLI if i & 1 else 0)
        table.append(i)
    entries = F.array(*(F.lit(x).cast("bigint") for x in table))
    digits = F.hex(data)
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    start = F.lit(0xFFFFFFFF).cast("bigint")
    step = lambda crc, x: F.shiftright(crc, 8).bitwiseXOR(F.get(entries, crc.bitwiseXOR(x).bitwiseAND(255).cast("int")))
    return F.aggregate(octets, start, step, lambda crc: crc.bitwiseXOR(start))


def leb128_value(digits: Column, most: int = 2**32 - 1) -> Column:
    """The number that a string of hex digits holds in groups of seven bits; null above ``most``, beyond 8 bytes or if cut short.

    The bytes are taken as characters of one byte each, once a row, and these are read by place.
    """

    def value(text: Column) -> Column:
        n = F.length(text)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        octets = F.transform(places, lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"))
        start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("at"), F.lit(False).alias("ended"), F.lit(True).alias("good"))
        step = lambda s, x: F.struct((s["v"] + F.call_function("shiftleft", x.bitwiseAND(127), s["at"])).alias("v"), (s["at"] + 7).alias("at"), (x < 128).alias("ended"), (s["good"] & ~s["ended"]).alias("good"))
        done = lambda s: F.when(s["good"] & s["ended"] & (s["v"] <= most), s["v"])
        return F.when((n > 0) & (n <= 8), F.aggregate(octets, start, step, done))

    return let(F.decode(F.unhex(digits), "ISO-8859-1"), value)


def is_chroma_block(row: Column, col: Column, width: Column, height: Column, sub_x: int, sub_y: int) -> Column:
    """Whether a block (place and size in units) has the chroma of its place: odd ones do, and those of even size."""
    along = lambda at, size, sub: (at.bitwiseAND(1) == 1) | (size.bitwiseAND(1) == 0) if sub else F.lit(True)
    return along(row, height, sub_y) & along(col, width, sub_x)


def quality_index(quality: Column) -> Column:
    """Quantiser index of a quality from 0 to 63: four times it, the last two closing up to 255."""
    q = clamp(quality, 0, 63)
    return F.when(q < 62, q * 4).otherwise(q * 6 - 123).cast("bigint")
