"""Deterministic id hashes and partition-independent random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ord_sum(text: Column) -> Column:
    """Sum of the character codes of an id."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"),
                       lambda acc, ch: acc + F.ascii(ch).cast("long"))


def uniform(seed: int, *keys: Column) -> Column:
    """U[0,1) that depends on the keys and the seed only, never on how rows are partitioned: 52 bits of an md5 digest."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniform_sql(seed: int, *keys: str) -> str:
    """The same draw as check SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}, '{seed}')), 1, 13))::BIGINT / {1 << 52}e0)"


def normal(seed: int, *keys: Column) -> Column:
    """Standard normal by Box-Muller over two keyed uniforms."""
    u1 = F.greatest(uniform(seed, *keys, F.lit("a")), F.lit(1e-15))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * 3.141592653589793 * uniform(seed, *keys, F.lit("b")))


def normal_sql(seed: int, *keys: str) -> str:
    u1, u2 = uniform_sql(seed, *keys, "'a'"), uniform_sql(seed, *keys, "'b'")
    return f"(sqrt(-2 * ln(greatest({u1}, 1e-15))) * cos(2 * 3.141592653589793e0 * {u2}))"


def exponential_sql(seed: int, mean: str, *keys: str) -> str:
    return f"(-ln(1 - {uniform_sql(seed, *keys)}) * {mean})"


def exponential(seed: int, mean: Column, *keys: Column) -> Column:
    return -F.log(1 - uniform(seed, *keys)) * mean
