"""Seeded random numbers derived from row keys.

`rand(seed)` depends on the partition a row sits in, so a stage that is rerun after an
executor loss may draw other numbers. Hashing a stable row key gives every row the same
draw in every run and for every partitioning. The hash is the MD5 digest of the keys as
text, which any SQL engine reproduces, so that draws can be checked row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_PI = 2.0 * math.pi
#: Bits of a key: 15 hexadecimal digits of the digest.
KEY_BITS = 60


def hash_key(keys: list[Column], *salt: Column | int) -> Column:
    """60 bits from the digest of salt and keys, joined by bars; null counts as empty."""
    parts = [s if isinstance(s, Column) else F.lit(s) for s in salt] + list(keys)
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def hash_uniform(keys: list[Column], *salt: Column | int) -> Column:
    """Uniform double in (0, 1) from the top 52 bits of the hash."""
    bits = F.shiftright(hash_key(keys, *salt), KEY_BITS - 52)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def hash_normal(keys: list[Column], *salt: Column | int) -> Column:
    """Standard normal draw (Box-Muller on two independent hashed uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(hash_uniform(keys, *salt, 1)))
    return radius * F.cos(F.lit(TWO_PI) * hash_uniform(keys, *salt, 2))


def hash_index(n: Column, keys: list[Column], *salt: Column | int) -> Column:
    """Uniform integer in [0, n)."""
    return F.least(F.floor(hash_uniform(keys, *salt) * n), n.cast("long") - 1)
