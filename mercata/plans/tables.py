"""Sources, sinks and table layout: each query writes a table to a scratch folder that executors share and reads it back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, Observation, functions as F

from mercata.operators import layout, marts
from mercata.sources import readers
from mercata.sources.shared import new_path
from mercata.sources.star import Star

from .layers import FO_SQL, doubles
from .registry import register

MONTH_SQL = "strftime(full_date, '%Y-%m')"


def scratch(s: Star) -> str:
    return new_path(s.spark)


@register("src_csv", "SELECT product_id, product_category_name, product_weight_g, product_length_cm FROM b_product")
def src_csv(s: Star) -> DataFrame:
    path = readers.export_csv(s.b_product, f"{scratch(s)}/product")
    return readers.read_csv(s.spark, path, "product").select("product_id", "product_category_name", "product_weight_g", "product_length_cm")


@register("src_layer", f"SELECT {FO_SQL} FROM fo")
def src_layer(s: Star) -> DataFrame:
    base = scratch(s)
    readers.write_layer(doubles(s.fact_order), base, "gold", "fact_order")
    return readers.read_layer(s.spark, base, "gold", "fact_order")


@register("sink_layer", "SELECT customer_state, CAST(count(*) AS BIGINT) AS n FROM b_customer GROUP BY 1")
def sink_layer(s: Star) -> DataFrame:
    base = scratch(s)
    path = readers.write_layer(s.dim_customer, base, "gold", "dim_customer")
    readers.write_layer(s.dim_customer, base, "gold", "dim_customer")
    return s.spark.read.parquet(path).groupBy("customer_state").agg(F.count("*").alias("n"))


@register(
    "sink_append_merge",
    """SELECT seller_id, seller_state, CAST(NULL AS VARCHAR) AS note FROM b_seller UNION ALL SELECT seller_id, seller_state, 'again' FROM b_seller""",
)
def sink_append_merge(s: Star) -> DataFrame:
    base, rows = scratch(s), s.b_seller.select("seller_id", "seller_state")
    readers.append_layer(rows, base, "gold", "seller_log")
    readers.append_layer(rows.withColumn("note", F.lit("again")), base, "gold", "seller_log")
    return readers.read_layer(s.spark, base, "gold", "seller_log", merge_schema=True)


@register("sink_export", "SELECT payment_type, CAST(orders AS BIGINT) AS orders, year_month FROM mart_pay")
def sink_export(s: Star) -> DataFrame:
    rows = marts.payment_mix(s.fact_payment, s.fact_order, s.dim_date).select("payment_type", "orders", "year_month")
    path = readers.export_csv(rows, f"{scratch(s)}/export")
    return readers.read_csv(s.spark, path, schema="payment_type string, orders long, year_month string")


def monthly_orders(s: Star) -> DataFrame:
    return s.fact_order.select("order_id", "customer_id", F.col("payment_total").cast("double").alias("v"), marts.month().alias("year_month"))


COUNTS_SQL = f"SELECT {MONTH_SQL} AS year_month, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(payment_total AS DOUBLE)), 2) AS v FROM fo GROUP BY 1"


def counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("year_month").cast("string").alias("year_month")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("v"))


@register("write_clustered", COUNTS_SQL)
def write_clustered(s: Star) -> DataFrame:
    path = scratch(s)
    layout.write_clustered(monthly_orders(s), path, "year_month", ["customer_id"], files=8)
    return counts(s.spark.read.parquet(path))


@register("write_optimized", COUNTS_SQL)
def write_optimized(s: Star) -> DataFrame:
    path = scratch(s)
    layout.write_optimized(monthly_orders(s), path, "year_month", files=8)
    return counts(s.spark.read.parquet(path))


def write_in_pieces(s: Star, partition: F.Column, path: str) -> None:
    """Orders written once in five files a partition value, dealt by a hash of the order."""
    rows = s.fact_order.select("order_id", "customer_id", F.col("payment_total").cast("double").alias("v"), partition.alias("part"))
    piece = F.pmod(F.xxhash64("order_id"), F.lit(5))
    cut = rows.withColumn("piece", piece).repartition("part", "piece").sortWithinPartitions("part", "piece").write
    cut.partitionBy("part", "piece").parquet(f"{path}-pieces")
    pieces = s.spark.read.parquet(f"{path}-pieces")
    for k in range(5):  # five daily appends
        pieces.where(F.col("piece") == k).drop("piece").repartition("part").write.mode("append").partitionBy("part").parquet(path)


def compacted(s: Star, partition: F.Column, values: list[str], rewrite) -> DataFrame:
    """Partitions of five files or fewer compacted to one file each: their rows stay, and what became of their files."""
    path = scratch(s)
    write_in_pieces(s, partition, path)
    files = rewrite(s.spark, path, f"{path}-staging", "part", values, files=1, sort=["customer_id"])
    table = s.spark.read.schema("order_id string, customer_id string, v double, part string").parquet(path)
    kept = table.groupBy(F.col("part").alias("partition")).agg(F.count("*").alias("n"))
    return kept.join(files, "partition", "left")


@register("compact_partition", f"SELECT {MONTH_SQL} AS partition, CAST(count(*) AS BIGINT) AS n, CASE WHEN {MONTH_SQL} = '1997-03' THEN CAST(5 AS BIGINT) END AS files_before, CASE WHEN {MONTH_SQL} = '1997-03' THEN CAST(1 AS BIGINT) END AS files_after FROM fo GROUP BY 1")
def compact_partition(s: Star) -> DataFrame:
    return compacted(s, marts.month(), ["1997-03"], layout.compact).select("partition", "n", "files_before", "files_after")


@register(
    "compact_recent",
    f"""SELECT {MONTH_SQL} AS partition, CAST(count(*) AS BIGINT) AS n, CASE WHEN {MONTH_SQL} BETWEEN '1997-05' AND '1997-06' THEN CAST(5 AS BIGINT) END AS files_before,
        CASE WHEN {MONTH_SQL} BETWEEN '1997-05' AND '1997-06' THEN CAST(1 AS BIGINT) END AS files_after, CAST(NULL AS VARCHAR) AS error FROM fo GROUP BY 1""",
)
def compact_recent(s: Star) -> DataFrame:
    """The last two months, side by side, each failing for itself."""
    return compacted(s, marts.month(), layout.recent_values(date(1997, 6, 15), 2), layout.compact_each).select("partition", "n", "files_before", "files_after", "error")


@register("small_files", f"SELECT {MONTH_SQL} AS partition, CAST(4 AS BIGINT) AS num_files, CAST(4 AS BIGINT) AS num_small, true AS needs_compaction FROM fo GROUP BY 1")
def small_files(s: Star) -> DataFrame:
    path = scratch(s)
    rows = monthly_orders(s)
    for _ in range(4):  # four daily appends leave four files in each partition
        rows.repartition("year_month").write.mode("append").partitionBy("year_month").parquet(path)
    return layout.small_files(s.spark, path, "year_month", most=3).drop("bytes")


@register("file_lineage", "SELECT 'orders.parquet' AS file, CAST(count(*) AS BIGINT) AS n FROM orders")
def file_lineage(s: Star) -> DataFrame:
    return s.raw("orders").select(layout.file_name(F.col("_metadata.file_path")).alias("file")).groupBy("file").agg(F.count("*").alias("n"))


@register("sample_rows")
def sample_rows(s: Star) -> DataFrame:
    return s.raw("lineitem").select("l_orderkey", "l_linenumber").sample(0.1, seed=42)


@register("table_sample", "SELECT order_id, customer_id FROM fo ORDER BY order_id LIMIT 5")
def table_sample(s: Star) -> DataFrame:
    return s.fact_order.select("order_id", "customer_id").orderBy("order_id").limit(5)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
COLUMNS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6}


@register("table_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count, {COLUMNS[t]} AS column_count FROM {t}" for t in TABLES))
def table_stats(s: Star) -> DataFrame:
    """Counts from the footers: no column is read."""
    own = layout.footer_session(s.spark)
    return layout.row_counts({t: own.read.parquet(f"{s.sf_dir}/{t}.parquet") for t in TABLES})


@register("shape_log", "SELECT 'fact_order' AS table_name, CAST(count(*) AS BIGINT) AS row_count, 12 AS column_count FROM fo")
def shape_log(s: Star) -> DataFrame:
    """Rows seen while the table is written once: an observation, not a second pass."""
    seen, facts = Observation(), s.fact_order
    facts.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{scratch(s)}/fact_order")
    return s.spark.createDataFrame([("fact_order", seen.get["rows"], len(facts.columns))], "table_name string, row_count long, column_count int")


@register("date_coverage", "SELECT 'fact_order' AS source, min(full_date) AS first_day, max(full_date) AS last_day FROM fo")
def date_coverage(s: Star) -> DataFrame:
    """The days that the facts cover, from the footers of the stored layer: of orders, else of items, else of the forecast."""
    base = scratch(s)
    readers.write_layer(s.fact_order.select("order_id", "full_date"), base, "gold", "fact_order")
    order = {"fact_order": ("gold", "full_date"), "fact_order_item": ("gold", "full_date"), "forecast": ("platinum", "forecast_date")}
    return layout.coverage(s.spark, {t: readers.layer_path(base, layer, t) for t, (layer, _) in order.items()}, {t: c for t, (_, c) in order.items()})


@register("src_jdbc", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey IN (1, 3, 5) AND c_acctbal > 0")
def src_jdbc(s: Star) -> DataFrame:
    """Customers of three nations from a relational table, read by four connections between its own bounds; the filter runs in the database.

    The database is the embedded one of Spark's own jars, in memory, so this query needs a local master.
    """
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    s.raw("customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast("double")).write.format("jdbc").options(url=url, dbtable="customer", **readers.DERBY).save()
    table = readers.read_jdbc_by(s.spark, url, "customer", "c_custkey", 4, **readers.DERBY)
    return table.where(F.col("c_nationkey").isin(1, 3, 5) & (F.col("c_acctbal") > 0))
