"""Column functions over class probability arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def recovered_logits(proba: Column) -> Column:
    """``ln(p + 1e-12)`` per class."""
    return F.transform(proba, lambda p: F.log(p + F.lit(EPS)))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Softmax of ``logits / T``, shifted by the maximum.

    The maximum and the sum enter ``zip_with`` as repeated arrays, so each is
    computed once per row.
    """
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    n = F.size(logits)
    scaled = F.zip_with(logits, F.array_repeat(t, n), lambda x, tt: x / tt)
    lifted = F.zip_with(scaled, F.array_repeat(F.array_max(scaled), n), lambda x, m: F.exp(x - m))
    total = F.aggregate(lifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(lifted, F.array_repeat(total, n), lambda x, s: x / s)


def calibrated(proba: Column, temperature: Column | float) -> Column:
    """Probabilities after temperature scaling of the recovered logits."""
    return softmax(recovered_logits(proba), temperature)


def argmax(proba: Column, places: int = 9) -> Column:
    """Index of the largest entry; the first wins a tie.

    Entries are compared after rounding, so two that are equal but for the order
    of floating-point summation count as a tie on every engine.
    """
    rounded = F.transform(proba, lambda p: F.round(p, places))
    return (F.array_position(rounded, F.array_max(rounded)) - 1).cast("int")


def negative_log_likelihood(p_true: Column) -> Column:
    """``-ln(p)`` with ``p`` clipped to [1e-12, 1]."""
    return -F.log(F.greatest(F.least(p_true, F.lit(1.0)), F.lit(EPS)))
