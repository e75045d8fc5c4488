"""Labels, flags and candidate types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

#: Words for cited and uncited rows in a label column, and for uncited ones in a column of candidate types.
CITED = ("1", "true", "cited", "citation", "positive", "x", "a", "examiner_cited")
UNCITED = ("0", "false", "u", "hard_u", "random_u", "uncited", "negative")
UNCITED_TYPES = ("u", "hard_u", "random_u", "dense_hard_u", "uncited", "negative")
TRUE = ("1", "true", "t", "yes", "y")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unknown(c: Column) -> Column:
    return F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c.cast("string"), F.lit("null"))))


def decode_label(c: Column | str, strict: bool = True) -> Column:
    """INT class of a label in words or digits; an unknown one is an error, or null if not ``strict``."""
    t = F.lower(F.trim(_c(c).cast("string")))
    out = F.when(t.isin("a", "0"), 0).when(t.isin("x", "1"), 1).when(t.isin("u", "2"), 2)
    return out.otherwise(_unknown(_c(c)).cast("int")) if strict else out


def cited(c: Column | str, strict: bool = True) -> Column:
    """1 for cited, 0 for uncited words of a label column; unknown ones are an error, or null if not ``strict``."""
    t = normalize_text(_c(c).cast("string"))
    out = F.when(t.isin(*CITED), 1).when(t.isin(*UNCITED), 0)
    return out.otherwise(_unknown(_c(c)).cast("int")) if strict else out


def cited_type(c: Column | str) -> Column:
    """0 for the candidate types of uncited rows, 1 for all else, null too."""
    return F.when(normalize_text(_c(c).cast("string")).isin(*UNCITED_TYPES), 0).otherwise(1)


def cited_of_class(c: Column | str) -> Column:
    """1 for the classes 0 and 1, 0 for class 2."""
    return (_c(c) != 2).cast("int")


def parse_bool(c: Column | str) -> Column:
    """True for the usual words, false for all else and null."""
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin(*TRUE), F.lit(False))
