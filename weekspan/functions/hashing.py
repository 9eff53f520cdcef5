"""Counter-based random numbers: a row's draw depends on its key and the seed, never on its partition.

A lost executor or another partitioning therefore repeats exactly the same draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from weekspan.functions.scalars import col

HASH_BITS = 32


def hash_digits(keys: str | Column | Sequence[str | Column], seed: str | int) -> Column:
    """First 8 hex digits of md5(key|...|seed): they sort as their numbers do."""
    parts = [keys] if isinstance(keys, (str, Column)) else list(keys)
    text = F.concat_ws("|", *[col(k).cast("string") for k in parts], F.lit(str(seed)))
    return F.substring(F.md5(text), 1, 8)


def hash32(keys: str | Column | Sequence[str | Column], seed: str | int) -> Column:
    """First 8 hex digits of md5(key|...|seed) as an integer in [0, 2**32)."""
    return F.conv(hash_digits(keys, seed), 16, 10).cast("long")


def uniform(keys: str | Column | Sequence[str | Column], seed: str | int) -> Column:
    """Uniform number in [0, 1)."""
    return hash32(keys, seed) / F.lit(float(2**HASH_BITS))


def fast_uniform(keys: Sequence[str | Column], seed: str | int) -> Column:
    """Uniform number in [0, 1) from a 64-bit hash: for the many draws of a noise array."""
    bits = F.xxhash64(*[col(k) for k in keys], F.lit(str(seed)))
    return F.shiftrightunsigned(bits, 11) / F.lit(float(2**53))


def gaussian(keys: Sequence[str | Column], seed: str | int) -> Column:
    """Standard normal draw by the Box-Muller transform of two hashed uniforms."""
    u = F.lit(1.0) - fast_uniform(keys, f"{seed}|a")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * fast_uniform(keys, f"{seed}|b"))
