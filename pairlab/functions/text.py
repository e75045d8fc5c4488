"""Text and identifier expressions; all are built-in columns and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character that is neither letter nor digit of Unicode.
NOT_ALNUM = r"[^\p{L}\p{N}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """The longest runs of letters and digits of the lower-cased text; null gives null."""
    return F.filter(F.split(F.lower(_c(c)), NOT_ALNUM + "+"), lambda w: w != "")


def word_key(c: Column | str) -> Column:
    """The words of a text with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), NOT_ALNUM + "+", " "))


def field_key(c: Column | str) -> Column:
    """What is left of a text when white space, letter case, punctuation and the order of its
    ``|`` fields don't count; null gives null, a text without letters and digits ''."""
    pieces = F.transform(F.split(F.lower(_c(c)), r"\|"), lambda p: F.regexp_replace(p, NOT_ALNUM + "+", ""))
    return F.array_join(F.array_sort(F.filter(pieces, lambda p: p != "")), "|")


def base_id(c: Column | str) -> Column:
    """An identifier in upper case, A-Z and 0-9 only, without the kind code behind
    'two letters, digits'; null gives null."""
    kept = F.regexp_replace(F.upper(_c(c)), "[^A-Z0-9]", "")
    return F.regexp_replace(kept, "^([A-Z]{2}[0-9]+)[A-Z][0-9]?$", "$1")


def component(c: Column | str) -> Column:
    """A component label without outer blanks; null where it stands for 'missing'."""
    t = F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")
    return F.when(~F.lower(t).isin("", "nan", "none", "null"), t)


def normalize_text(c: Column | str, lower: bool = True, null: str | None = "") -> Column:
    """White space (of Unicode) collapsed to one blank and trimmed, in lower case unless told otherwise.

    ``null`` is what a null becomes; None keeps it null."""
    t = _c(c)
    t = F.lower(t) if lower else t
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return t if null is None else F.coalesce(t, F.lit(null))


def normalize_id(c: Column | str) -> Column:
    """Upper case, A-Z and 0-9 only; null gives ''."""
    return F.coalesce(F.regexp_replace(F.upper(_c(c)), "[^A-Z0-9]", ""), F.lit(""))


def tokens(c: Column | str) -> Column:
    """Runs of two or more letters, digits or underscores of the lower-cased text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), F.array().cast("array<string>"))


def ngrams_1_2(toks: Column) -> Column:
    """The tokens, followed by each two neighbours with a blank between them."""
    # Neighbours by shifting the array: inside a lambda the tokens would be made again for each element.
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.concat(toks, F.zip_with(F.slice(toks, F.lit(1), n), F.slice(toks, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def mask_numbers(c: Column | str) -> Column:
    """Digits replaced by <num>."""
    return F.regexp_replace(_c(c), "[0-9]+", "<num>")


def content_only(c: Column | str) -> Column:
    """Number-masked words in lower case, without reference signs and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"\([0-9]+[a-z]?\)|[0-9]+", " "), NOT_ALNUM + "+", " "))


def clip_words(c: Column | str, n: int) -> Column:
    """The first ``n`` blank-separated words of a text."""
    return F.array_join(F.slice(F.split(normalize_text(c, lower=False), " "), 1, n), " ")


def balanced_caps(n_query: Column, n_document: Column, budget: int) -> tuple[Column, Column]:
    """How many tokens of a pair stay within ``budget``: half for each, and what one leaves goes to the other."""
    fits = n_query + n_document <= budget
    half = budget // 2
    query = F.least(n_query, F.greatest(F.lit(half), F.lit(budget) - n_document))
    document = F.least(n_document, F.greatest(F.lit(budget - half), F.lit(budget) - n_query))
    return F.when(fits, n_query).otherwise(query), F.when(fits, n_document).otherwise(document)


def prompt(query: Column | str, passage: Column | str, template: str) -> Column:
    """``template`` with its two %s filled in."""
    return F.format_string(template, F.coalesce(_c(query), F.lit("")), F.coalesce(_c(passage), F.lit("")))
