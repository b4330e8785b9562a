"""Distances of hashes and vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hexadecimal hashes; 999 where they are no such hashes or differ in length."""
    whole = r"^[0-9a-fA-F]{1,16}$"
    good = a.rlike(whole) & b.rlike(whole) & (F.length(a) == F.length(b))
    return F.when(F.coalesce(good, F.lit(False)), F.bit_count(_bits(a).bitwiseXOR(_bits(b)))).otherwise(999)


def _bits(h: Column) -> Column:
    return F.conv(F.when(h.rlike(r"^[0-9a-fA-F]{1,16}$"), h), 16, -10).cast("long")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0)))
