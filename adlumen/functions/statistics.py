"""Aggregates that stay defined on constant columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pearson(a: Column, b: Column) -> Column:
    """Correlation of the pairs without nulls; null when either side is constant.

    ``F.corr`` divides by zero there, which ANSI mode turns into an error.
    """
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b)))
