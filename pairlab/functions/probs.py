"""Arithmetic on class probabilities; three classes are three columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(cols: Sequence[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def softmax(logits: Sequence[Column | str]) -> list[Column]:
    """Softmax of a row's logits, shifted by the largest."""
    cols = [_c(c) for c in logits]
    top = F.greatest(*cols)
    total = _sum([F.exp(c - top) for c in cols])
    return [F.exp(c - top) / total for c in cols]


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def two_logits(c: Column | str) -> tuple[Column, Column]:
    """A single logit as the two of a binary head."""
    return -_c(c), _c(c)


def hierarchical(p_cited: Column | str, p_x_given_cited: Column | str, renormalize: bool = True) -> list[Column]:
    """P(A), P(X), P(U) from the two stages."""
    cited, x = _c(p_cited), _c(p_x_given_cited)
    parts = [cited * (F.lit(1.0) - x), cited * x, F.lit(1.0) - cited]
    return renormalized(parts) if renormalize else parts


def renormalized(probabilities: Sequence[Column | str], floor: float = 1e-12) -> list[Column]:
    """Probabilities divided by their sum, which counts as ``floor`` at least; null where one isn't finite."""
    cols = [_c(c) for c in probabilities]
    total = _sum(cols)
    finite = ~F.isnan(total) & (F.abs(total) != float("inf"))
    return [F.when(finite, c / F.greatest(total, F.lit(floor))) for c in cols]


def cited_score(p_a: Column | str, p_x: Column | str) -> Column:
    return _c(p_a) + _c(p_x)


def x_score(p_a: Column | str, p_x: Column | str) -> Column:
    return _c(p_x) / (_c(p_a) + _c(p_x) + F.lit(1e-12))


def graded_score(p_a: Column | str, p_x: Column | str) -> Column:
    return _c(p_a) + F.lit(2.0) * _c(p_x)


def argmax_class(probabilities: Sequence[Column | str]) -> Column:
    """INT number of the largest; the lowest number on ties."""
    cols = [_c(c) for c in probabilities]
    top = F.greatest(*cols)
    out = F.lit(len(cols) - 1)
    for i in reversed(range(len(cols) - 1)):
        out = F.when(cols[i] == top, i).otherwise(out)
    return out


def at_least(c: Column | str, threshold: float = 0.5) -> Column:
    return (_c(c) >= threshold).cast("int")


def relevance(label: Column | str) -> Column:
    """2 for class 1 (X), 1 for class 0 (A), 0 for class 2 (U)."""
    return F.when(_c(label) == 1, 2).when(_c(label) == 0, 1).otherwise(0)


def close(a: Column | str, b: Column | str, atol: float = 1e-8) -> Column:
    return F.abs(_c(a) - _c(b)) <= atol
