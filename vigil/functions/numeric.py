"""Ratios and metric formulas over the four confusion counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that is used inside a lambda function would otherwise be copied into
    it and computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def f1_macro(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    wrong = fp + fn
    seen1 = (tp + wrong > 0).cast("int")
    seen0 = (tn + wrong > 0).cast("int")
    return ratio(f1(tp, fp, fn) + f1(tn, fn, fp), seen1 + seen0)


def binary_metric_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_binary": f1(tp, fp, fn),
        "f1_macro": f1_macro(tn, fp, fn, tp),
    }


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def argmax(probabilities: Column) -> Column:
    """Index of the first maximum, from 0."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def decide(score: Column, threshold=0.5) -> Column:
    """1 where the score reaches the threshold."""
    return (score >= threshold).cast("int")


def printed(c: Column, digits: int) -> Column:
    """Fixed decimals, rounded by the exact binary value; exact ties to the even digit.

    ``round`` and ``format_string`` round the shortest decimal text of a double,
    which turns 35.825 (in truth a little more) into a tie. The product with the
    power of ten is therefore split into its double and the exact remainder.
    """
    scale = 10.0**digits

    def halves(x):
        wide = x * 134217729.0
        high = wide - (wide - x)
        return high, x - high

    a = F.abs(c)
    product = a * scale
    (ah, al), (sh, sl) = halves(a), halves(scale)
    rest = ((ah * sh - product) + ah * sl + al * sh) + al * sl
    low = F.floor(product)
    part = product - low
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 == 1))))
    number = F.format_string(f"%.{digits}f", (low + up.cast("int")) / scale)
    return F.concat(F.when(c < 0, "-").otherwise(""), number)
