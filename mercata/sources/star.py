"""Retail source tables from the order-line star schema of the driver tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from mercata.operators import gold, silver

MONEY = "decimal(18,2)"


class Star:
    """Lazy DataFrames of all layers: source (``b_*``), cleaned (``s_*``), dimensions, facts. Nothing runs until used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        return self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def b_customer(self) -> DataFrame:
        c = self.raw("customer").join(F.broadcast(self.places), F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_custkey").cast("string").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("n_name").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )

    @cached_property
    def b_seller(self) -> DataFrame:
        s = self.raw("supplier").join(F.broadcast(self.places), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(
            F.col("s_suppkey").cast("string").alias("seller_id"),
            F.col("s_nationkey").alias("seller_zip_code_prefix"),
            F.col("n_name").alias("seller_city"),
            F.col("r_name").alias("seller_state"),
        )

    @cached_property
    def b_product(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").cast("string").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.length("p_brand").alias("product_description_lenght"),
            F.lit(1).alias("product_photos_qty"),
            F.col("p_size").alias("product_weight_g"),
            F.length("p_name").alias("product_length_cm"),
            (F.col("p_size") + 1).alias("product_height_cm"),
            (F.col("p_size") + 2).alias("product_width_cm"),
        )

    @cached_property
    def b_product_category(self) -> DataFrame:
        names = self.raw("part").select(F.col("p_type").alias("product_category_name")).distinct()
        return names.withColumn("product_category_name_english", F.lower("product_category_name"))

    @cached_property
    def b_order(self) -> DataFrame:
        shipped = self.raw("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("delivered"))
        o = self.raw("orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "shipped").otherwise("canceled")
        return o.select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.col("delivered").alias("order_delivered_customer_date"),
            (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("order_estimated_delivery_date"),
        )

    @cached_property
    def b_order_item(self) -> DataFrame:
        amount, one = F.col("l_extendedprice").cast(MONEY), F.lit(1).cast("decimal(4,2)")
        return self.raw("lineitem").select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_suppkey").cast("string").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.round(amount * (one - F.col("l_discount").cast("decimal(4,2)")), 2).cast(MONEY).alias("price"),
            F.round(amount * F.col("l_tax").cast("decimal(4,2)"), 2).cast(MONEY).alias("freight_value"),
        )

    @cached_property
    def b_payment(self) -> DataFrame:
        o = self.raw("orders")
        kind = (
            F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"), "credit_card")
            .when(F.col("o_orderpriority") == "2-HIGH", "boleto")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "voucher")
            .otherwise("debit_card")
        )
        first = F.struct(
            F.lit(1).alias("n"), kind.alias("t"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("i"), F.col("o_totalprice").cast(MONEY).alias("v")
        )
        second = F.struct(F.lit(2).alias("n"), F.lit("voucher").alias("t"), F.lit(1).alias("i"), F.lit("10.00").cast(MONEY).alias("v"))
        rows = F.when(F.col("o_orderkey") % 4 == 0, F.array(first, second)).otherwise(F.array(first))
        return o.select(F.col("o_orderkey").cast("string").alias("order_id"), F.explode(rows).alias("p")).select(
            "order_id",
            F.col("p.n").alias("payment_sequential"),
            F.col("p.t").alias("payment_type"),
            F.col("p.i").alias("payment_installments"),
            F.col("p.v").alias("payment_value"),
        )

    @cached_property
    def b_order_review(self) -> DataFrame:
        made = F.timestamp_add("DAY", (F.col("o_orderkey") % 30).cast("int"), F.col("o_orderdate"))
        return self.raw("orders").where(F.col("o_orderkey") % 3 != 0).select(
            F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("review_id"),
            F.col("o_orderkey").cast("string").alias("order_id"),
            (F.col("o_orderkey") % 5 + 1).cast("int").alias("review_score"),
            F.lit("t").alias("review_comment_title"),
            F.lit("m").alias("review_comment_message"),
            made.alias("review_creation_date"),
            made.alias("review_answer_timestamp"),
        )

    @cached_property
    def b_geolocation(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("geolocation_zip_code_prefix"),
            (F.col("n_nationkey") * 2.0 - 40).alias("geolocation_lat"),
            (F.col("n_nationkey") - 70.0).alias("geolocation_lng"),
            F.col("n_name").alias("geolocation_city"),
            F.col("n_name").alias("geolocation_state"),
        )

    # cleaned tables
    s_customer = cached_property(lambda self: silver.customer(self.b_customer))
    s_seller = cached_property(lambda self: silver.seller(self.b_seller))
    s_product = cached_property(lambda self: silver.product(self.b_product))
    s_order = cached_property(lambda self: silver.order(self.b_order))
    s_order_item = cached_property(lambda self: silver.order_item(self.b_order_item))
    s_payment = cached_property(lambda self: silver.payment(self.b_payment))
    s_order_review = cached_property(lambda self: silver.order_review(self.b_order_review))
    s_product_category = cached_property(lambda self: silver.product_category(self.b_product_category))
    s_date = cached_property(lambda self: silver.date(self.b_order))
    s_geolocation = cached_property(lambda self: silver.geolocation(self.b_geolocation))

    # dimensions and facts
    dim_customer = cached_property(lambda self: gold.dim_customer(self.s_customer))
    dim_seller = cached_property(lambda self: gold.dim_seller(self.s_seller))
    dim_product = cached_property(lambda self: gold.dim_product(self.s_product))
    dim_product_category = cached_property(lambda self: gold.dim_product_category(self.s_product_category))
    dim_date = cached_property(lambda self: gold.dim_date(self.s_date))
    dim_geolocation = cached_property(lambda self: gold.dim_geolocation(self.s_geolocation))
    fact_order_item = cached_property(lambda self: gold.fact_order_item(self.s_order_item, self.s_order))
    fact_order = cached_property(lambda self: gold.fact_order(self.s_order, self.s_payment, self.fact_order_item))
    fact_payment = cached_property(lambda self: gold.fact_payment(self.s_payment))
    fact_review = cached_property(lambda self: gold.fact_review(self.s_order_review))

    @cached_property
    def items_by_category(self) -> DataFrame:
        """Order items with their product's category, English name and month; unmatched items stay."""
        return gold.items_with_category(self.fact_order_item, self.dim_product, self.dim_product_category)
