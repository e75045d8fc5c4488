"""Hashes on which engines agree, and choices drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_text(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def pair_hash(claim: Column, passage: Column) -> Column:
    """SHA-1 of the two texts' SHA-1 with a bar between them."""
    return F.sha1(F.concat_ws("|", F.sha1(claim), F.sha1(passage)))


def hex_number(c: Column, digits: int = 8) -> Column:
    """The first hex digits (15 at most) of a digest as BIGINT."""
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("long")


def uniform(*parts: Column | str, grid: int = 1000) -> Column:
    """A reproducible number in [0, 1) on a grid, from an MD5 of the parts with bars between them."""
    return (hex_number(F.md5(F.concat_ws("|", *[_c(p).cast("string") for p in parts]))) % grid) / F.lit(float(grid))


def choice(n: Column | str, *parts: Column) -> Column:
    """BIGINT below ``n`` (null where it is 0): the first 16 hex digits of a SHA-256 of the parts, with bars between them, modulo ``n``."""
    return drawn(n, F.sha2(F.concat_ws("|", *parts), 256))


def drawn(n: Column | str, digest: Column) -> Column:
    """BIGINT below ``n`` (null where it is 0): the first 16 hex digits of a digest modulo ``n``."""
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(_c(n) > 0, (number % _c(n)).cast("long"))


def fingerprint(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``rows``, ``fingerprint``: a digest of a table that doesn't depend on partitions.

    Each row's digest (of its order key too) is added up in four parts modulo 2 ** 64, so nothing
    is gathered in one place; the sums are hashed. Null differs from ''.
    """
    told = F.concat_ws("\x1f", F.col(order).cast("string"), *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])
    rows = df.select(F.sha2(told, 256).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 16 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = rows.agg(F.count("*").alias("rows"), *parts)
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("fingerprint"))
