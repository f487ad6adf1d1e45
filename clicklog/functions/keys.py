"""Universal hashing of ids to compressed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1
#: Default coefficients; all products stay in 64 bits for 32-bit ids.
COEFFICIENTS = (12345, 1103515245, 69069, 1664525)
#: What is added after each squaring of a draw.
SQUARES = (12345, 1013904223)


def residue(*values: Column, coefficients: tuple[int, ...] = COEFFICIENTS, prime: int = PRIME) -> Column:
    """(w0 + w1 x1 + ...) mod prime. Each term is reduced first, so that sums cannot overflow."""
    out = F.lit(coefficients[0] % prime).cast("long")
    for w, x in zip(coefficients[1:], values, strict=False):
        out = out + F.pmod(F.lit(w).cast("long") * F.pmod(x.cast("long"), F.lit(prime).cast("long")), F.lit(prime).cast("long"))
    return F.pmod(out, F.lit(prime).cast("long"))


def universal_hash(size: int, *values: Column, coefficients: tuple[int, ...] = COEFFICIENTS, prime: int = PRIME) -> Column:
    """A bucket in 0 .. size - 1: the residue scaled down."""
    return F.floor(residue(*values, coefficients=coefficients, prime=prime) / F.lit(float(prime)) * size).cast("long")


def uniform(*values: Column, coefficients: tuple[int, ...] = COEFFICIENTS) -> Column:
    """A reproducible draw in [0, 1) that depends on nothing but its arguments.

    The residue is linear in its arguments, so that draws for neighbouring ranks or salts would move together; two
    squarings modulo the prime part them. Products stay below 2^62.
    """
    prime = F.lit(PRIME).cast("long")
    out = residue(*values, coefficients=coefficients)
    for add in SQUARES:
        out = F.pmod(out * out + F.lit(add).cast("long"), prime)
    return out / F.lit(float(PRIME))


def hash_trick(key: Column, size: int, ratio: int = 10, feature: int = 0) -> tuple[Column, Column]:
    """``(bucket, sign)`` with ceil(size / ratio) buckets."""
    buckets = -(-size // ratio)
    return universal_hash(buckets, key), 2 * universal_hash(2, key, F.lit(feature)) - 1


def quotient_remainder(key: Column, size: int, ratio: int = 10) -> tuple[Column, Column]:
    """The shuffled id's quotient and remainder by ``ratio``."""
    mixed = universal_hash(size, key)
    return F.floor(mixed / ratio).cast("long"), F.pmod(mixed, F.lit(ratio).cast("long"))


def robe(key: Column, size: int, features: int, ratio: int = 1000) -> tuple[Column, Column]:
    """Positions in a shared array of max(1, size * features div ratio) values, and their signs."""
    slots = max(1, size * features // ratio)
    start = universal_hash(slots, key)
    offsets = F.sequence(F.lit(0), F.lit(features - 1))
    at = F.transform(offsets, lambda o: F.pmod(start + o, F.lit(slots).cast("long")))
    return at, F.transform(offsets, lambda o: 2 * universal_hash(2, key, o) - 1)


def signed(logit: Column, sign: Column) -> Column:
    """A looked-up value of the hash trick: keys that share a bucket differ in sign."""
    return sign * logit


def combined(quotient: Column, remainder: Column, how: str = "product") -> Column:
    """One vector from those of a key's quotient and remainder: elementwise ``product`` or ``sum``, or both (``concat``)."""
    if how == "concat":
        return F.concat(quotient, remainder)
    return F.zip_with(quotient, remainder, (lambda a, b: a * b) if how == "product" else (lambda a, b: a + b))


def gathered(shared: Column, at: Column, signs: Column) -> Column:
    """A key's vector out of an array that all keys share, by its positions (from 0) and signs."""
    return F.zip_with(F.transform(at, lambda i: F.element_at(shared, (i + 1).cast("int"))), signs, lambda v, s: v * s)
