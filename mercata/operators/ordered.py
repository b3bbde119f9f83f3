"""Ranks, running sums and exact quantiles of whole tables, without a task that reads all or all of one value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mercata.sources.shared import stored


def prefix_sums(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` plus rank, running sum and total in descending order of ``value`` (nulls last), then ``key``.

    Rows are dealt by ranges of (value, key), so rows of equal value are split as evenly as any others, and written once: ranges come from a
    sample, and what a range holds must not change when a task runs again. Sums and counts of the ranges, a row for each, give each its base; windows run inside a range.
    """
    ranged = stored(df.repartitionByRange(F.desc_nulls_last(value), F.asc_nulls_first(key)).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(
        "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_sum").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("_range").orderBy(F.desc_nulls_last(value), F.asc_nulls_first(key))
    out = ranged.join(F.broadcast(bases), "_range")  # as many rows as ranges
    out = out.repartitionByRange("_range")  # a task a range; dealt by hash, several may meet
    return out.withColumns(
        {
            "rank": F.col("_before") + F.row_number().over(inside),
            "running": F.col("_base") + F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)),
        }
    ).drop("_range", "_base", "_before")


def exact_quantiles(df: DataFrame, value: Column | str, at: list[float], most: int = 100_000, accuracy: int = 10_000) -> list[float | None]:
    """The exact quantiles of ``value`` at the shares ``at``, interpolated between neighbours; null for no values. Null values are left out.

    An interval that holds the ranks sought is narrowed between approximate quantiles, whose error is known, until it has at most ``most`` distinct
    values; those are counted and ranked, and only rows of the interval are read for it. ``df`` is read a few times, so pass a written table.
    """
    rows = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v IS NOT NULL")
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    return [_quantile(rows, share, n, low, high, most, accuracy) if n else None for share in at]


def _quantile(rows: DataFrame, share: float, n: int, low: float, high: float, most: int, accuracy: int) -> float:
    place = share * (n - 1)
    first, last = math.floor(place), math.ceil(place)
    below, inside, part = 0, n, rows
    while part.agg(F.approx_count_distinct("v")).first()[0] > most:
        edges = [max(0.0, (first - below) / inside - 2 / accuracy), min(1.0, (last + 1 - below) / inside + 2 / accuracy)]
        a, b = part.agg(F.approx_percentile("v", edges, accuracy)).first()[0]
        a, b = low if edges[0] == 0 else a, high if edges[1] == 1 else b
        fewer, within = part.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
        if below + fewer > first or below + fewer + within <= last or within == inside:
            break  # no narrower interval is known to hold both ranks
        below, inside, low, high = below + fewer, within, a, b
        part = rows.where(F.col("v").between(a, b))
    counts = part.groupBy("v").count()
    upto = F.lit(below) + F.sum("count").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto)
    x, y = ranked.agg(F.min(F.when(F.col("upto") > first, F.col("v"))), F.min(F.when(F.col("upto") > last, F.col("v")))).first()
    return x + (y - x) * (place - first)

