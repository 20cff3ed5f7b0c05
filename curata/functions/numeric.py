"""Scalar numeric functions on columns (F5, F6 and the stable BCE term of A10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the decision cut of the reference's predictions (inclusive).
THRESHOLD = 0.5


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(z: Column | str) -> Column:
    """probability from a logit."""
    return 1.0 / (1.0 + F.exp(-_c(z)))


def threshold(p: Column | str, cut: float = THRESHOLD) -> Column:
    """1.0 when p >= cut else 0.0."""
    return (_c(p) >= F.lit(cut)).cast("double")


def bce_with_logits(z: Column | str, y: Column | str) -> Column:
    """Binary cross-entropy of a logit against a 0/1 target, in the overflow-free form."""
    z, y = _c(z), _c(y)
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two equal-length double arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
