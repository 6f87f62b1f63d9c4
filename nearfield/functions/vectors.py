"""Vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm2(v: Column) -> Column:
    """Sum of squares."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def normalized(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = F.sqrt(norm2(v))
    return F.when(n == 0, doubles(v)).otherwise(F.transform(v, lambda x: x.cast("double") / F.when(n != 0, n)))


def plus(a: Column, b: Column, factor: float = 1.0) -> Column:
    """a + factor * b."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double") * factor)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def remapped(v: Column, sources: list[int]) -> Column:
    """Element i is v[sources[i]], 0 for a source of -1."""
    return F.transform(F.array(*map(F.lit, sources)), lambda i: F.when(i < 0, F.lit(0.0)).otherwise(F.get(v, F.greatest(i, F.lit(0))).cast("double")))


def k_smallest(v: Column, k: int, largest: bool = False) -> Column:
    """The k smallest (largest) of a row as structs (value, place), best first, ties by place."""
    sign = -1.0 if largest else 1.0
    pairs = F.transform(v, lambda x, i: F.struct((x.cast("double") * sign).alias("s"), i.alias("place")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(best, lambda p: F.struct((p["s"] * sign).alias("value"), p["place"].alias("place")))


def argsorted(v: Column) -> Column:
    """Places of a row's elements by rising value, ties by place."""
    return F.transform(F.array_sort(F.transform(v, lambda x, i: F.struct(x.cast("double").alias("x"), i.alias("place")))), lambda p: p["place"])


def seeded(row: Column, d: int, seed: int = 1234, normal: bool = False) -> Column:
    """d pseudo-random numbers for a row's key: uniform in [0, 1), or normal. The same for the same key and seed, anywhere."""
    def u(i: Column, turn: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed + turn), row, i), 11).cast("double") + 0.5) * (2.0**-53)

    def one(i: Column) -> Column:
        return F.sqrt(-2 * F.log(u(i, 0))) * F.cos(u(i, 1) * 6.283185307179586) if normal else u(i, 0)

    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), one)


def bits(v: Column, strict: bool = False) -> Column:
    """1 where x >= 0 (strict: x > 0), element by element."""
    return F.transform(v, lambda x: ((x > 0) if strict else (x >= 0)).cast("int"))


def words(bit_array: Column, n: int) -> Column:
    """Bits packed, lowest first, into longs of 32 bits each."""
    return F.array(*(
        F.aggregate(F.slice(bit_array, at + 1, 32), F.struct(F.lit(0).cast("long").alias("w"), F.lit(1).cast("long").alias("p")),
                    lambda s, b: F.struct((s["w"] + s["p"] * b).alias("w"), (s["p"] * 2).alias("p")))["w"]
        for at in range(0, n, 32)
    ))


def unpacked(packed: Column, n: int) -> Column:
    """The first n bits of an array of words, 0 or 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(F.get(packed, F.floor(i / 32).cast("int")), i % 32).cast("int"))


def packed_codes(code: Column, bits_: int, n: int) -> Column:
    """n codes of bits_ bits each, lowest first, as one array of words."""
    every = F.flatten(F.transform(code, lambda c: F.transform(F.sequence(F.lit(0), F.lit(bits_ - 1)), lambda i: F.getbit(c.cast("long"), i).cast("int"))))
    return words(every, bits_ * n)


def unpacked_codes(packed: Column, bits_: int, n: int) -> Column:
    """The codes that packed_codes packed."""
    every = F.transform(F.array(unpacked(packed, bits_ * n)), lambda b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.aggregate(
        F.sequence(F.lit(0), F.lit(bits_ - 1)), F.lit(0), lambda s, i: s + F.get(b, j * bits_ + i) * F.pow(F.lit(2), i).cast("int"))))
    return F.get(every, F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def differing(a: Column, b: Column) -> Column:
    """Differing elements of two code arrays (generalized Hamming)."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda t: t))


def real(bit_array: Column) -> Column:
    """-1 and 1 for bits 0 and 1."""
    return F.transform(bit_array, lambda b: (2 * b - 1).cast("double"))
