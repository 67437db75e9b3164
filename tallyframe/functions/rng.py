"""Hash seeds and linear congruential streams in closed form, so that any draw is a function of its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 1 << 32
#: Multiplier and increment of the 32-bit stream, and the seed of the report's bootstrap.
MULTIPLIER, INCREMENT = 1664525, 1013904223
BOOTSTRAP_SEED = 2988610046
#: Fixed value: seed of the 31-bit stream.
NET_WIN_SEED = 987654321


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points of ASCII text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(MODULUS - 1)))


def _jumps(bits: int) -> list[tuple[int, int, int, int]]:
    """(bit, upper half, lower half, increment) of the affine map that jumps 2^i steps, for each bit i."""
    a, c, out = MULTIPLIER, INCREMENT, []
    for i in range(bits):
        out.append((1 << i, a >> 16, a & 0xFFFF, c))
        a, c = a * a % MODULUS, (a * c + c) % MODULUS
    return out


def lcg_state(place: Column, seed: int = BOOTSTRAP_SEED, bits: int = 31) -> Column:
    """The state after ``place`` steps. Products are split in 16-bit halves, so nothing overflows 64 bits."""
    table = F.array(*[F.struct(F.lit(b).cast("long").alias("bit"), F.lit(hi).cast("long").alias("hi"), F.lit(lo).cast("long").alias("lo"), F.lit(c).cast("long").alias("inc")) for b, hi, lo, c in _jumps(bits)])
    mask = F.lit(MODULUS - 1)

    def step(s: Column, j: Column) -> Column:
        jumped = ((s * j["hi"]).bitwiseAND(F.lit(0xFFFF)) * 65536 + s * j["lo"] + j["inc"]).bitwiseAND(mask)
        return F.when(place.bitwiseAND(j["bit"]) != 0, jumped).otherwise(s)

    return F.aggregate(table, F.lit(seed).cast("long"), step)


def lcg_index(place: Column, n: int | Column, seed: int = BOOTSTRAP_SEED) -> Column:
    """floor(u * n) for the draw at ``place`` (from 1)."""
    return F.floor(lcg_state(place, seed) / float(MODULUS) * n).cast("int")


def lcg31_step(state: Column) -> Column:
    """The 31-bit generator whose product is rounded to double precision."""
    return (state.cast("double") * 1103515245.0 + 12345.0).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def lcg31_list(seed: int, n: int) -> list[int]:
    """The first n states, on the driver."""
    out, s = [], seed
    for _ in range(n):
        s = int(float(s) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        out.append(s)
    return out


def lcg31_cycle(seed: int, most: int = 1 << 22) -> tuple[list[int], int]:
    """All states that the stream from ``seed`` ever takes, in order, and the place at which it comes back to after the last.

    Rounding loses bits, so the stream runs into a cycle soon: from the usual seed after 5,355 of 15,821 different states. A
    stream of more than ``most`` states is refused.
    """
    seen: dict[int, int] = {}
    s = seed
    while s not in seen:
        if len(seen) >= most:
            raise ValueError("the stream has too many states for a table")
        seen[s] = len(seen)
        s = int(float(s) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
    return list(seen), seen[s]


def lcg31_slot(place: Column, states: int, back: int) -> Column:
    """Where in the table of ``lcg31_cycle`` the state after ``place`` steps stands."""
    return F.when(place < states, place).otherwise(back + (place - back) % (states - back)).cast("int")
