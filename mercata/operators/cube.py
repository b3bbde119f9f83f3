"""Cube queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cube_query(
    df: DataFrame, date_column: str, grain: str, dims: list[str], measures: dict[str, Column], start: str | None = None, end: str | None = None,
    where: Column | None = None, mode: str = "plain", limit: int | None = None,
) -> DataFrame:
    """Measures by time bucket and ``dims``.

    ``mode``: plain, rollup, or sets (the grouping sets (bucket, dims...), each with one dimension less, and the total). Totals read ``ALL`` by
    their grouping id, so a real null in a dimension stays null. Without dims, rollup and sets have buckets and a total.
    ``start`` and ``end`` are inclusive days; ``limit`` cuts the ordered result for display.
    """
    rows = df
    if start is not None:
        rows = rows.where(F.col(date_column) >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col(date_column) < F.date_add(F.to_date(F.lit(end)), 1))
    if where is not None:
        rows = rows.where(where)
    rows = rows.withColumn("bucket", F.to_date(F.date_trunc(grain, date_column)).cast("string"))
    keys = ["bucket", *dims]
    if mode == "plain":
        out = rows.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    else:
        sums = [m.alias(n) for n, m in measures.items()]
        marks = [F.grouping(k).alias(f"_all_{k}") for k in keys]
        if mode == "rollup":
            out = rows.rollup(*keys).agg(*marks, *sums)
        else:
            sets = [keys[:n] for n in range(len(keys), -1, -1)]
            out = rows.groupingSets([[F.col(k) for k in one] for one in sets], *[F.col(k) for k in keys]).agg(*marks, *sums)
        out = out.withColumns({k: F.when(F.col(f"_all_{k}") == 1, "ALL").otherwise(F.col(k)) for k in keys}).drop(*[f"_all_{k}" for k in keys])
    if limit is not None:
        out = out.orderBy(*[F.asc_nulls_last(k) for k in keys]).limit(limit)
    return out
