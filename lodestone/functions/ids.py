"""Identifiers, choices and draws that follow from SHA-256 of their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts with NUL between them."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("\0", *columns), 256)


def hash64(value: Column, word: int = 0) -> Column:
    """Unsigned number of the word-th 16 hex digits of a digest."""
    return F.conv(F.substring(value, 1 + 16 * word, 16), 16, 10).cast("decimal(20,0)")


def choice(value: Column, n: Column | int) -> Column:
    """Number below n that the digest picks."""
    n = F.lit(n) if isinstance(n, int) else n
    return (hash64(value) % n.cast("decimal(20,0)")).cast("long")


def uniform(value: Column, word: int = 0) -> Column:
    """Number of [0, 1) from the first 13 hex digits of a word of the digest, exactly a double."""
    return F.conv(F.substring(value, 1 + 16 * word, 13), 16, 10).cast("double") / float(1 << 52)


def opaque(value: Column, length: int = 20) -> Column:
    return F.substring(value, 1, length)
