"""Canonical hashes, derived integers and little-endian blobs as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(**fields: Column | str) -> Column:
    """Compact JSON with its fields in sorted order."""
    pick = lambda v: F.col(v) if isinstance(v, str) else v
    return F.to_json(F.struct(*(pick(fields[k]).alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def content_hash(**fields: Column | str) -> Column:
    return F.sha2(canonical(**fields), 256)


def short(h: Column | str, n: int = 12) -> Column:
    return F.substring(h, 1, n)


def derived_seed(*parts: Column | str | int) -> Column:
    """60 bits of the SHA-256 of the parts, a non-negative long."""
    text = F.concat_ws(":", *((F.lit(p) if not isinstance(p, Column) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def derived_int(bound: int, *parts: Column | str | int) -> Column:
    if bound <= 0:
        raise ValueError("bound must be positive")
    return F.pmod(derived_seed(*parts), F.lit(bound))


def le_uint32(tokens: Column | str) -> Column:
    """A token array as little-endian unsigned 32-bit bytes."""

    def one(t: Column) -> Column:
        big = F.lpad(F.hex(t.cast("long")), 8, "0")
        return F.concat(*(F.substring(big, k, 2) for k in (7, 5, 3, 1)))

    return F.unhex(F.array_join(F.transform(tokens, one), ""))


def fold_chain(payloads: Column | str, start: str = GENESIS) -> Column:
    """Head of the hash chain over an ordered array of payload strings."""
    return F.aggregate(payloads, F.lit(start), lambda h, p: F.sha2(F.concat(p, h), 256))


def byte_bigram_cell(a: Column, b: Column, cells: int = 8192) -> Column:
    """Cell of a pair of bytes, in 64-bit arithmetic that cannot overflow."""
    return ((a.cast("long") * 257 + b.cast("long") * 1013904223).bitwiseAND(F.lit(0x7FFFFFFF))) % cells


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)
