"""Forecast error measures as aggregate expressions. The three sMAPE definitions differ where values are zero or signs differ."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def smape_half(y: Column, yhat: Column) -> Column:
    """Mean of |y - yhat| over the mean of |y| and |yhat|, in per cent; a zero denominator counts as 1."""
    half = (F.abs(y) + F.abs(yhat)) / 2
    return 100 * F.avg(F.abs(y - yhat) / F.when(half == 0, 1.0).otherwise(half))


def smape_eps(y: Column, yhat: Column) -> Column:
    return 100 * F.avg(2 * F.abs(y - yhat) / (F.abs(y) + F.abs(yhat) + 1e-8))


def smape_row(y: Column, yhat: Column) -> Column:
    """Of one row, over the plain sum; null where that is zero."""
    return 200 * F.abs(y - yhat) / F.nullif(y + yhat, F.lit(0.0))


def mae(y: Column, yhat: Column) -> Column:
    return F.avg(F.abs(y - yhat))


def rmse(y: Column, yhat: Column) -> Column:
    return F.sqrt(F.avg((y - yhat) * (y - yhat)))
