"""Table layout: clustered writes, compaction of partitions, small-file reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_clustered(df: DataFrame, path: str, partition: str, hot: list[str], files: int = 128) -> None:
    """Rows range-split and sorted by the hot columns within each partition value, so that row groups can be skipped by their bounds."""
    keys = [partition, *hot]
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_optimized(df: DataFrame, path: str, partition: str, hot: list[str] | None = None, files: int = 128) -> None:
    """As ``write_clustered``; without hot columns rows are only brought together by partition value."""
    if hot:
        write_clustered(df, path, partition, hot, files)
    else:
        df.repartition(files, partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def files_of(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """(partition, file_path, file_size): the data files by partition value."""
    meta = spark.read.parquet(path).select(F.col(partition).cast("string").alias("partition"), "_metadata.file_path", "_metadata.file_size")
    return meta.distinct()


def small_files(spark: SparkSession, path: str, partition: str, most: int = 50, small: int = 32 << 20) -> DataFrame:
    """Files by partition, those under ``small`` bytes, and whether there are over ``most``."""
    by = files_of(spark, path, partition).groupBy("partition").agg(
        F.count("*").alias("num_files"), F.count_if(F.col("file_size") < small).alias("num_small"), F.sum("file_size").alias("bytes")
    )
    return by.withColumn("needs_compaction", F.col("num_files") > most).orderBy(F.desc("num_files"), "partition")


def compact(spark: SparkSession, path: str, staging: str, partition: str, values: list[str], files: int = 16, sort: list[str] | None = None) -> DataFrame:
    """Rewrite the partitions ``values`` to at most ``files`` files each, sorted; returns files before and after.

    Rows go to ``staging`` first and only those partitions are then replaced, so a failed rewrite leaves the table whole.
    """
    before = files_of(spark, path, partition).where(F.col("partition").isin(*values)).groupBy("partition").agg(F.count("*").alias("files_before"))
    held = {r["partition"]: r["files_before"] for r in before.collect()}
    chosen = spark.read.parquet(path).where(F.col(partition).cast("string").isin(*values))
    order = [partition, *(sort or [])]
    even = chosen.repartition(files * max(1, len(values)), partition, F.pmod(F.xxhash64(*chosen.columns), F.lit(files))) if not sort else chosen.repartitionByRange(files * max(1, len(values)), *order)
    even.sortWithinPartitions(*order).write.mode("overwrite").partitionBy(partition).parquet(staging)
    staged = spark.read.parquet(staging)
    piece = [F.pmod(F.xxhash64(*staged.columns), F.lit(files))] if files > 1 else []  # by content: a task that runs again deals alike
    staged.repartition(F.col(partition), *piece).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition).parquet(path)
    after = files_of(spark, path, partition).where(F.col("partition").isin(*values)).groupBy("partition").agg(F.count("*").alias("files_after"))
    known = spark.createDataFrame(list(held.items()) or [("", 0)], "partition string, files_before long").where("partition <> ''")
    return known.join(after, "partition", "left").select("partition", "files_before", F.coalesce("files_after", F.lit(0)).alias("files_after"))


def compact_each(
    spark: SparkSession, path: str, staging: str, partition: str, values: list[str], files: int = 16, sort: list[str] | None = None, at_once: int = 4
) -> DataFrame:
    """``compact`` for each of ``values`` by itself, ``at_once`` side by side: (partition, files_before, files_after, error).

    A partition whose rewrite fails keeps its files and reports the error; the others are compacted all the same. Values without files have no row.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(value: str) -> list:
        folder = fs_path(f"{path}/{partition}={value}")
        return [f for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")] if fs.exists(folder) else []

    def swap(place, fresh, aside) -> None:
        """The staged folder, whole, takes the place of the partition's; if it can't, the old one comes back."""
        if not fs.rename(place, aside):
            raise OSError(f"could not move {place}")
        if not fs.rename(fresh, place):
            fs.rename(aside, place)
            raise OSError(f"could not move {fresh}")
        fs.delete(aside, True)

    def one(value: str) -> tuple:
        before = listed(value)
        if not before:
            return value, None, None, None
        try:
            rows = spark.read.parquet(f"{path}/{partition}={value}")
            staged = f"{staging}/{value}"
            ordered = rows.repartitionByRange(files, *sort).sortWithinPartitions(*sort) if sort else rows.repartition(files)
            ordered.write.mode("overwrite").parquet(staged)
            swap(fs_path(f"{path}/{partition}={value}"), fs_path(staged), fs_path(f"{staging}/old-{value}"))
            return value, len(before), len(listed(value)), None
        except Exception as e:  # reported with its partition
            return value, len(before), len(listed(value)), str(e).split("\n")[0][:200]

    with ThreadPoolExecutor(at_once) as pool:
        told = [r for r in pool.map(inheritable_thread_target(spark)(one), values) if r[1] is not None]
    return spark.createDataFrame(told, "partition string, files_before long, files_after long, error string")


def recent_values(as_of: date, months: int) -> list[str]:
    """The last ``months`` 'YYYY-MM' values up to ``as_of``."""
    n = as_of.year * 12 + as_of.month - 1
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(n - months + 1, n + 1)]


def recent_days(as_of: date, days: int) -> list[str]:
    """The last ``days`` 'YYYY-MM-DD' values up to ``as_of``."""
    return [str(as_of - timedelta(days=k)) for k in range(days - 1, -1, -1)]


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose Parquet scans answer counts, minima and maxima from the files' footers."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def first_with_rows(spark: SparkSession, paths: dict[str, str]) -> str | None:
    """The name of the first Parquet table that exists and has rows."""
    for name, path in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) and spark.read.parquet(path).agg(F.count("*")).first()[0]:
            return name
    return None


def row_counts(tables: dict[str, DataFrame], most: int | None = None) -> DataFrame:
    """Rows and columns of tables, largest first; empty tables are left out."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where("row_count > 0").orderBy(F.desc("row_count"), "table_name")
    return out.limit(most) if most else out


def coverage(spark: SparkSession, paths: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """(source, first_day, last_day) from the footers of the first table of ``paths`` that exists and has rows, over its date column; no row if none has."""
    own = footer_session(spark)
    name = first_with_rows(own, paths)
    if name is None:
        return own.createDataFrame([], "source string, first_day date, last_day date")
    days = own.read.parquet(paths[name]).agg(F.min(columns[name]).alias("first_day"), F.max(columns[name]).alias("last_day"))
    return days.select(F.lit(name).alias("source"), "first_day", "last_day")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)
