"""Date windows, list and month filters, and row caps."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def half_open(column: str, start: date, end: date) -> Column:
    """From ``start`` up to and with ``end``, written as [start, end + 1 day) so that times on the last day count."""
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end + timedelta(days=1)))


def between(column: str, start: str, end: str) -> Column:
    return F.col(column).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))


def month_bounds(year_month: str) -> tuple[Column, Column]:
    """First day of a 'YYYY-MM' month and of the month after."""
    first = F.to_date(F.lit(f"{year_month}-01"))
    return first, F.add_months(first, 1)


def in_months(column: str, first: str, last: str, exclusive: bool = False) -> Column:
    """A 'YYYY-MM' text column within months; text order is time order."""
    c = F.col(column)
    return (c >= first) & ((c < last) if exclusive else (c <= last))


def dual(partition: str, column: str, start: date, end: date) -> Column:
    """The exact date range together with the month range of the partition column, so that a scan skips partitions."""
    return in_months(partition, f"{start:%Y-%m}", f"{end:%Y-%m}") & half_open(column, start, end)


def last_months(column: str, as_of: date, months: int = 3) -> Column:
    return F.col(column) >= F.add_months(F.lit(as_of), -months)


def in_list(column: str, values: list) -> Column:
    return F.col(column).isin(*values) if values else F.lit(False)


def capped(df: DataFrame, rows: int = 10_000, most: int = 5_000) -> DataFrame:
    """At most ``rows`` rows and never over ``most``: a limit on what is shown, not on what is computed."""
    return df.limit(min(rows, most))


def pick_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of the candidate names that the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {candidates} among {df.columns}")
