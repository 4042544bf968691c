"""Stable, engine-neutral hashes."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def md5_key(*parts) -> Column:
    """md5 of the parts joined by ':' -- a seeded, reproducible order over rows."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def md5_int(text: Column) -> Column:
    """The first 32 bits of the md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_bucket(text: Column, dimension: int) -> Column:
    """Unsigned feature hashing to a fixed width."""
    return F.pmod(md5_int(text), F.lit(dimension))


def set_fingerprint(member: Column) -> Column:
    """Order-free fingerprint of a set of distinct strings as a mergeable aggregate.

    Count, a 64-bit xor and an exact sum of a second 64-bit hash: the state has a fixed size, so the
    members of one group are never gathered anywhere.
    """
    return F.concat_ws(
        "-",
        F.count(member).cast("string"),
        F.bit_xor(F.xxhash64(member)).cast("string"),
        F.sum(F.xxhash64(F.lit("b"), member).cast("decimal(20,0)")).cast("string"),
    )
