"""Approximate distinct counts by mergeable sketches: stored once a period, united over any window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Three standard deviations of a united sketch of 2^14 registers, 1.04 / sqrt(2^14) each, and as much again for its rounding.
LG_REGISTERS, BOUND = 14, 0.03


def period_sketches(df: DataFrame, period: Column | str, value: str, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(period, sketch): a sketch of the distinct values of each period, some kilobytes whatever their number. Null values count for nothing."""
    return df.groupBy((F.col(period) if isinstance(period, str) else period).alias("period")).agg(F.hll_sketch_agg(value, F.lit(lg_registers)).alias("sketch"))


def distinct_in_windows(sketches: DataFrame, periods: int, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(period, estimate): distinct values in each period together with the ``periods`` - 1 before it.

    Periods are whole numbers. Only sketches are read and shuffled, each as often as windows hold it; missing periods count as empty, and windows end at periods that exist.
    """
    ends = sketches.select("period", F.explode(F.sequence(F.col("period"), F.col("period") + periods - 1)).alias("end"), "sketch")
    united = ends.groupBy("end").agg(F.hll_union_agg("sketch").alias("sketch"), F.max(F.col("period") == F.col("end")).alias("own"))
    return united.where("own").select(F.col("end").alias("period"), F.hll_sketch_estimate("sketch").alias("estimate"))
