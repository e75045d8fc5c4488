"""Dates from text; nothing here fails on what can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Notations tried in this order.
FORMATS = ("yyyyMMdd", "yyyy-MM-dd", "dd MMM yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy/MM/dd")


def parse_date(c: Column | str, formats: tuple[str, ...] = FORMATS) -> Column:
    """DATE of the first notation that fits the trimmed text without its time of day, else null."""
    t = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), "[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+]00:00)?$", "")
    # A pattern first: the parser is lenient about the number of digits.
    shape = {"y": "[0-9]", "M": "[0-9]", "d": "[0-9]"}

    def fits(f: str) -> str:
        return "^" + "".join(shape.get(ch, "\\" + ch if ch in "./" else ch) for ch in f.replace("MMM", "@")).replace("@", "[A-Za-z]{3}") + "$"

    return F.coalesce(*[F.when(t.rlike(fits(f)), F.try_to_timestamp(t, F.lit(f)).cast("date")) for f in formats])


def choose_date(columns: list[str]) -> tuple[Column, Column]:
    """The first readable date of the columns, and the name of the column it came from."""
    dates = [parse_date(F.col(c).cast("string")) for c in columns]
    name = F.lit(None).cast("string")
    for c, d in reversed(list(zip(columns, dates))):
        name = F.when(d.isNotNull(), c).otherwise(name)
    return F.coalesce(*dates), name


def strict_date(c: Column | str) -> Column:
    """As parse_date, but text that can't be read is an error; null stays null."""
    t = F.col(c) if isinstance(c, str) else c
    d = parse_date(t)
    return F.when(t.isNull() | d.isNotNull(), d).otherwise(F.raise_error(F.concat(F.lit("unreadable date: "), t)).cast("date"))


def date_split(d: Column | str, train_end: str, validation_end: str) -> Column:
    """train up to ``train_end``, validation up to ``validation_end`` (both included), else test; null without a date."""
    d = F.col(d) if isinstance(d, str) else d
    return F.when(d <= F.lit(train_end).cast("date"), "train").when(d <= F.lit(validation_end).cast("date"), "validation").when(d.isNotNull(), "test")


def days_since(d: Column | str, anchor: str) -> Column:
    return F.datediff(F.col(d) if isinstance(d, str) else d, F.lit(anchor).cast("date"))


def first_date_column(present: list[str]) -> str:
    """The first usual date column that a table has."""
    return next(c for c in ("target_date", "publication_date", "date", "_date") if c in present)
