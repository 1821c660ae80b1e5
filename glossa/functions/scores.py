"""Scalar score functions of the three model families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision thresholds and the renormalisation epsilon.
PROBABILITY_THRESHOLD = 0.5
RENORM_EPSILON = 1e-9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(z) -> Column:
    """B18 (first half): logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def sigmoid_label(z) -> Column:
    """``sigmoid(z) >= 0.5``; a logit of exactly 0 is positive."""
    return (sigmoid(z) >= F.lit(PROBABILITY_THRESHOLD)).cast("tinyint")


def svm_label(score) -> Column:
    """``score > 0`` -> 1; exactly 0 is negative (decision-function rule)."""
    return (_c(score) > F.lit(0.0)).cast("tinyint")


def softmax(logits) -> Column:
    """Softmax over an array of class logits (shifted by the max)."""
    lg = _c(logits)
    m = F.array_max(lg)
    e = F.transform(lg, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def positive_probability(probs) -> Column:
    """Three classes (neg, neutral, pos) -> ``p_pos / (p_neg + p_pos + 1e-9)``;
    two classes -> the second entry."""
    p = _c(probs)
    three = p[2] / (p[0] + p[2] + F.lit(RENORM_EPSILON))
    return F.when(F.size(p) == 3, three).otherwise(p[1])


def probability_label(p) -> Column:
    """``p >= 0.5`` -> 1."""
    return (_c(p) >= F.lit(PROBABILITY_THRESHOLD)).cast("tinyint")


def bce_with_logits(z, y) -> Column:
    """Numerically stable binary cross-entropy on a logit."""
    zc, yc = _c(z), _c(y).cast("double")
    return F.greatest(zc, F.lit(0.0)) - zc * yc + F.log1p(F.exp(-F.abs(zc)))
