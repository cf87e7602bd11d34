"""Seeded, engine-independent pseudo-randomness.

Every shuffle, sample and draw is a function of (seed, salt, key), so a retried task or a second
evaluation of the plan sees the same values, whatever the partitioning.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52
HASH_SPAN = 1 << HASH_BITS


def hash_int(seed: int, salt: str, *keys: Column | str) -> Column:
    """Uniform integer in [0, 2**52): the first 13 hex digits of an md5."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def hash_constant(seed: int, salt: str) -> int:
    """A whole number below 2**104 that depends on seed and salt alone."""
    digest = hashlib.md5(f"{seed}|{salt}".encode()).hexdigest()
    return int(digest[:26], 16)


def uniform(seed: int, salt: str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1); exact, because 52 bits fit a double."""
    return hash_int(seed, salt, *keys).cast("double") / F.lit(float(HASH_SPAN))


def hash_mod(n: Column | int, seed: int, salt: str, *keys: Column | str) -> Column:
    """Uniform integer in [0, n)."""
    n = F.lit(n) if isinstance(n, int) else n
    return hash_int(seed, salt, *keys) % n.cast("bigint")
