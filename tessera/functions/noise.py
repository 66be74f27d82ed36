"""A shift register's states by jumps: each row reaches its own by powers of a matrix over GF(2), without stepping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: Bits of the register and the places whose sum is shifted in.
BITS, TAPS = 16, (0, 1, 3, 12)


def step_matrix() -> list[int]:
    """One step: for each bit of the next state, which bits of this one it is the sum of."""
    return [1 << (i + 1) for i in range(BITS - 1)] + [sum(1 << t for t in TAPS)]


def times(a: list[int], b: list[int]) -> list[int]:
    """The matrix that does b, then a."""
    out = []
    for row in a:
        mixed = 0
        for i in range(BITS):
            if row >> i & 1:
                mixed ^= b[i]
        out.append(mixed)
    return out


def powers(n: int) -> list[list[int]]:
    """The matrices of 1, 2, 4, ... steps."""
    out = [step_matrix()]
    while len(out) < n:
        out.append(times(out[-1], out[-1]))
    return out


def state_after(seed: Column | int, steps: Column, bits: int = 20) -> Column:
    """The register's state, as a long, ``steps`` (below 2^``bits``) after ``seed``: one matrix for each bit set in ``steps``."""
    table = F.array(*(F.array(*(F.lit(row) for row in m)) for m in powers(bits)))
    places = F.array(*map(F.lit, range(BITS)))
    seed = seed if isinstance(seed, Column) else F.lit(seed)

    def jump(state: Column, k: Column, n: Column) -> Column:
        bit = lambda i: F.call_function("shiftleft", F.bit_count(F.get(F.get(table, k), i).bitwiseAND(state)).bitwiseAND(1).cast("bigint"), i)
        jumped = F.aggregate(F.transform(places, bit), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return F.when(F.call_function("shiftright", n, k).bitwiseAND(1) == 1, jumped).otherwise(state)

    digits = F.array(*map(F.lit, range(bits)))
    return let(steps.cast("bigint"), lambda n: F.aggregate(digits, seed.cast("bigint"), lambda state, k: jump(state, k, n)))
