"""Hashes and bloom-filter arithmetic as column expressions.

Strings are hashed by UTF-16 code units, of which a character beyond the basic plane has two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of FNV-1a, start and factor of djb2, 32 bits.
FNV_START, FNV_PRIME = 2166136261, 16777619
DJB_START, DJB_FACTOR = 5381, 33
BITS = 4294967295


def code_units(text: Column) -> Column:
    """The UTF-16 code units of a string, as numbers."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(4))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(4)), 16, 10).cast("long"))


def _folded(text: Column, start: int, step) -> Column:
    return F.aggregate(code_units(text), F.lit(start).cast("long"), step)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a as a long."""
    return _folded(text, FNV_START, lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(BITS)))


def djb2(text: Column) -> Column:
    """32-bit djb2 as a long."""
    return _folded(text, DJB_START, lambda h, c: (h * DJB_FACTOR + c).bitwiseAND(F.lit(BITS)))


def bloom_indices(h1: Column, h2: Column, bits: int, hashes: int) -> Column:
    """The filter's bit numbers by double hashing; some may be equal."""
    odd = h2.bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: (h1 + i * odd).bitwiseAND(F.lit(BITS)) % bits)


def clamped(keys: Column, rate: Column) -> tuple[Column, Column]:
    return F.greatest(keys, F.lit(1)), F.least(F.greatest(rate, F.lit(1e-6)), F.lit(0.5))


def bloom_bits(keys: Column, rate: Column) -> Column:
    """Bits of a filter for so many keys at that rate of false positives."""
    n, p = clamped(keys, rate)
    return F.ceil(-n * F.log(p) / F.lit(math.log(2) ** 2)).cast("long")


def bloom_hashes(keys: Column, rate: Column) -> Column:
    n, _ = clamped(keys, rate)
    return F.greatest(F.lit(1), F.floor(bloom_bits(keys, rate) / n * math.log(2) + 0.5)).cast("int")


def bloom_bytes(bits: Column) -> Column:
    return F.ceil(bits / 8).cast("long")


def estimated_rate(bits: Column, hashes: Column, inserted: Column) -> Column:
    """The expected rate of false positives after so many insertions."""
    return F.when(inserted == 0, F.lit(0.0)).otherwise(F.pow(1 - F.exp(-hashes * inserted / bits), hashes))


def oversaturated(rate: Column, configured: Column) -> Column:
    return rate > 2 * configured
