"""Column expressions over scores, logits and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow for large x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def weighted_loss(logit: Column, label: Column, pos_weight: float | Column = 1.0) -> Column:
    """Cross entropy of one row from its logit, positives weighted."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return weight * label * softplus(-logit) + (1 - label) * softplus(logit)


def exceeds(score: Column, threshold: float | Column, space: str = "logit") -> Column:
    """``logit``: strictly above, as in live use. ``probability``: at or above, as in evaluation."""
    if space == "logit":
        hit = score > threshold
    elif space == "probability":
        hit = score >= threshold
    else:
        raise ValueError(f"space must be 'logit' or 'probability', not {space!r}")
    return hit & ~F.isnan(score)


def doubles(values: Sequence[float]) -> Column:
    """An array of fixed numbers."""
    return F.expr(f"array({', '.join(_double(v) for v in values)})")


def _double(value: float) -> str:
    return f"double('{float(value)!r}')"


def splits_reached(value: str, splits: Sequence[float]) -> Column:
    """How many of the ascending ``splits`` are at or below column ``value`` (null and NaN reach none).

    A balanced tree of comparisons: seven per row for 81 splits, inside generated code.
    """

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        low, high = tree(lo, mid), tree(mid + 1, hi)
        return f"CASE WHEN `{value}` < {_double(splits[mid])} THEN {low} ELSE {high} END"

    known = F.col(value).isNotNull() & ~F.isnan(value)
    return F.when(known, F.expr(tree(0, len(splits)))).otherwise(0)
