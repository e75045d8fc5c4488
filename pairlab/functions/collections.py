"""Collections that were exported as text in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_id

#: Words that stand for a missing value.
MISSING = ("", "nan", "none", "null")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_collection(c: Column | str) -> Column:
    """ARRAY<STRING> of distinct items, sorted: a bracketed list of quoted items is split at its
    commas, plain text at blanks, commas, semicolons and bars. Null, '[]' and words for 'missing'
    give an empty array. Items hold no brackets and no quotes of their own."""
    t = F.trim(F.coalesce(_c(c), F.lit("")))
    listed = t.rlike(r"^[\[({].*[\])}]$")
    inner = F.regexp_replace(t, r"^[\[({]|[\])}]$", "")
    items = F.when(listed, F.split(inner, ",")).otherwise(F.split(t, r"[;,|\s]+"))
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda x: ~F.lower(x).isin(*MISSING))))


def parse_codes(c: Column | str) -> Column:
    """Classification codes cut to their subclass (such as B41J), others as they are; sorted, distinct."""
    codes = F.transform(parse_collection(c), lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9/]", ""))
    cut = F.transform(codes, lambda x: F.when(x.rlike("^[A-HY][0-9]{2}[A-Z]"), F.substring(x, 1, 4)).otherwise(x))
    return F.array_sort(F.array_distinct(F.filter(cut, lambda x: x != "")))


def parse_references(c: Column | str) -> Column:
    """Base forms of the identifiers in a collection; sorted, distinct."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(parse_collection(c), base_id), lambda x: x != "")))


def join_sorted(c: Column | str, separator: str = "|") -> Column:
    """The sorted items with ``separator`` between them."""
    return F.array_join(F.array_sort(_c(c)), separator)
