"""Queries of the cleaned tables, dimensions, facts and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mercata.operators import gold, marts
from mercata.sources.star import Star

from .registry import register


def ratio(part: Column, whole: Column, places: int = 2) -> Column:
    """An amount in cents over a count, half up to ``places``, in whole numbers; null where the count is zero."""
    unit = 10**places
    scaled = (part.cast("decimal(28,2)") * unit).cast("long")
    return F.call_function("div", 2 * scaled + whole, F.nullif(2 * whole, F.lit(0))) / F.lit(float(unit))

EDGES = (10000, 25000, 50000, 75000)


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times as text, as results leave the library."""
    kinds = {c: t for c, t in df.dtypes}
    return df.select(
        *[
            F.col(c).cast("double").alias(c) if t.startswith("decimal")
            else F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp")
            else F.col(c)
            for c, t in kinds.items()
        ]
    )


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


STAMP = "'%Y-%m-%d %H:%M:%S'"


@register("silver_customer", "SELECT * FROM b_customer WHERE customer_id IS NOT NULL")
def silver_customer(s: Star) -> DataFrame:
    return s.s_customer


@register("silver_seller", "SELECT * FROM b_seller")
def silver_seller(s: Star) -> DataFrame:
    return s.s_seller


@register(
    "silver_product",
    """SELECT DISTINCT product_id, product_category_name, product_length_cm AS product_name_length,
       CAST(length(brand) AS INTEGER) AS product_description_length, 1 AS product_photos_qty,
       product_weight_g, product_length_cm, product_height_cm, product_width_cm FROM b_product""",
)
def silver_product(s: Star) -> DataFrame:
    return s.s_product


@register(
    "silver_order",
    f"""SELECT order_id, customer_id, order_status, strftime(bought, {STAMP}) AS order_purchase_timestamp,
        strftime(delivered, {STAMP}) AS order_delivered_customer_date, strftime(due, {STAMP}) AS order_estimated_delivery_date FROM s_order""",
)
def silver_order(s: Star) -> DataFrame:
    return doubles(s.s_order)


@register(
    "silver_order_item",
    f"""SELECT order_id, order_item_id, product_id, seller_id, strftime(shipping_limit_date, {STAMP}) AS shipping_limit_date,
        CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value FROM s_item""",
)
def silver_order_item(s: Star) -> DataFrame:
    return doubles(s.s_order_item)


@register(
    "silver_payment",
    """SELECT DISTINCT order_id, payment_sequential, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value
       FROM b_payment""",
)
def silver_payment(s: Star) -> DataFrame:
    return doubles(s.s_payment)


@register(
    "silver_order_review",
    f"""SELECT review_id, order_id, review_score, 'm' AS review_comment_message, strftime(created, {STAMP}) AS review_creation_date,
        strftime(created, {STAMP}) AS review_answer_timestamp FROM b_review""",
)
def silver_order_review(s: Star) -> DataFrame:
    return doubles(s.s_order_review)


@register("silver_product_category", "SELECT product_category_name, english AS product_category_name_english FROM b_category")
def silver_product_category(s: Star) -> DataFrame:
    return s.s_product_category


DAY_SQL = """full_date, CAST(year(full_date) AS INTEGER) AS year, CAST(month(full_date) AS INTEGER) AS month,
  CAST(day(full_date) AS INTEGER) AS day, dayname(full_date) AS day_of_week"""


@register("silver_date", f"SELECT {DAY_SQL} FROM days")
def silver_date(s: Star) -> DataFrame:
    return s.s_date


@register(
    "silver_geolocation",
    """SELECT zip AS geolocation_zip_code_prefix, CAST(lat AS DOUBLE) AS geolocation_lat, CAST(lng AS DOUBLE) AS geolocation_lng,
       city AS geolocation_city, state AS geolocation_state FROM s_geo""",
)
def silver_geolocation(s: Star) -> DataFrame:
    return s.s_geolocation


@register("dim_customer", "SELECT *, concat_ws(', ', customer_city, customer_state) AS city_state FROM b_customer")
def dim_customer(s: Star) -> DataFrame:
    return s.dim_customer


@register("dim_seller", "SELECT *, concat_ws(', ', seller_city, seller_state) AS city_state FROM b_seller")
def dim_seller(s: Star) -> DataFrame:
    return s.dim_seller


@register("dim_product", "SELECT product_id, product_category_name, product_weight_g, product_length_cm FROM b_product")
def dim_product(s: Star) -> DataFrame:
    return s.dim_product.select("product_id", "product_category_name", "product_weight_g", "product_length_cm")


@register("dim_product_category", "SELECT product_category_name, english AS product_category_name_english FROM b_category")
def dim_product_category(s: Star) -> DataFrame:
    return s.dim_product_category


@register(
    "dim_date",
    f"""SELECT {DAY_SQL}, strftime(full_date, '%Y-%m') AS year_month, CAST(quarter(full_date) AS INTEGER) AS quarter,
        CAST(week(full_date) AS INTEGER) AS week_of_year FROM days""",
)
def dim_date(s: Star) -> DataFrame:
    return s.dim_date


@register(
    "dim_geolocation",
    """SELECT zip AS geolocation_zip_code_prefix, CAST(lat AS DOUBLE) AS geolocation_lat, CAST(lng AS DOUBLE) AS geolocation_lng,
       city AS geolocation_city, state AS geolocation_state, concat_ws(', ', city, state) AS city_state FROM s_geo""",
)
def dim_geolocation(s: Star) -> DataFrame:
    return s.dim_geolocation


@register(
    "fact_order_item",
    f"""SELECT order_id, order_item_id, product_id, seller_id, customer_id, full_date, CAST(price AS DOUBLE) AS price,
        CAST(freight_value AS DOUBLE) AS freight_value, strftime(shipping_limit_date, {STAMP}) AS shipping_limit_date, order_status FROM foi""",
)
def fact_order_item(s: Star) -> DataFrame:
    return doubles(s.fact_order_item)


FO_SQL = """order_id, customer_id, full_date, CAST(items_count AS BIGINT) AS items_count, CAST(sum_price AS DOUBLE) AS sum_price,
  CAST(sum_freight AS DOUBLE) AS sum_freight, CAST(payment_total AS DOUBLE) AS payment_total, payment_installments_max,
  primary_payment_type, CAST(delivered_days AS INTEGER) AS delivered_days, delivered_on_time, is_canceled"""


@register("fact_order", f"SELECT {FO_SQL} FROM fo")
def fact_order(s: Star) -> DataFrame:
    return doubles(s.fact_order)


@register(
    "fact_payment",
    "SELECT order_id, payment_sequential, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value FROM b_payment",
)
def fact_payment(s: Star) -> DataFrame:
    return doubles(s.fact_payment)


@register("fact_review", f"SELECT review_id, order_id, review_score, strftime(created, {STAMP}) AS review_creation_date FROM b_review")
def fact_review(s: Star) -> DataFrame:
    return doubles(s.fact_review.drop("review_answer_timestamp"))


@register(
    "agg_order_items",
    """SELECT order_id, CAST(items_count AS BIGINT) AS items_count, CAST(sum_price AS DOUBLE) AS sum_price,
       CAST(sum_freight AS DOUBLE) AS sum_freight FROM item_sums""",
)
def agg_order_items(s: Star) -> DataFrame:
    return doubles(gold.agg_order_items(s.s_order_item))


@register(
    "agg_order_payments",
    """SELECT order_id, CAST(payment_total AS DOUBLE) AS payment_total, payment_installments_max, primary_payment_type FROM pay_sums""",
)
def agg_order_payments(s: Star) -> DataFrame:
    return doubles(gold.agg_order_payments(s.s_payment))


@register(
    "der_delivery",
    """SELECT order_id, CAST(CAST(delivered AS DATE) - CAST(bought AS DATE) AS INTEGER) AS delivered_days,
       coalesce(delivered <= due, false) AS delivered_on_time, order_status = 'canceled' AS is_canceled FROM b_order""",
)
def der_delivery(s: Star) -> DataFrame:
    return gold.delivery(s.b_order).select("order_id", "delivered_days", "delivered_on_time", "is_canceled")


@register(
    "dm_sales_monthly_category",
    """SELECT year_month, category AS product_category_name_english, CAST(gmv AS DOUBLE) AS gmv, CAST(orders AS BIGINT) AS orders,
       CAST(units AS BIGINT) AS units, CAST((2 * CAST(10000 * CAST(gmv AS DECIMAL(28,2)) AS HUGEINT) + orders) // nullif(2 * orders, 0) AS DOUBLE) / 10000 AS aov FROM mart_sales""",
)
def dm_sales_monthly_category(s: Star) -> DataFrame:
    mart = marts.sales_monthly_category(s.items_by_category, s.dim_date)
    return doubles(mart.withColumn("aov", ratio(F.col("gmv"), F.col("orders"), 4)))


SELLER_SQL = """
WITH sold AS (SELECT seller_id, sum(price) AS gmv, count(DISTINCT order_id) AS orders, count(*) AS units FROM foi GROUP BY 1),
score AS (SELECT seller_id, avg(review_score) AS s FROM b_review r LEFT JOIN foi i ON r.order_id = i.order_id GROUP BY 1),
done AS (SELECT seller_id, avg(CASE WHEN delivered_on_time THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN is_canceled THEN 1.0 ELSE 0.0 END) AS c
         FROM fo LEFT JOIN foi i ON fo.order_id = i.order_id GROUP BY 1),
kpi AS (SELECT b.*, CAST(gmv AS DOUBLE) AS gmv, CAST(orders AS BIGINT) AS orders, CAST(units AS BIGINT) AS units,
               round(s, 4) AS avg_review_score, round(t, 4) AS on_time_rate, round(c, 4) AS cancel_rate
        FROM b_seller b LEFT JOIN sold USING (seller_id) LEFT JOIN score USING (seller_id) LEFT JOIN done USING (seller_id))
"""


@register("dm_seller_kpi", SELLER_SQL + "SELECT *, concat_ws(', ', seller_city, seller_state) AS city_state FROM kpi")
def dm_seller_kpi(s: Star) -> DataFrame:
    kpi = marts.seller_kpi(s.fact_order_item, s.fact_order, s.fact_review, s.dim_seller)
    return doubles(rounded(kpi, "avg_review_score", "on_time_rate", "cancel_rate"))


@register(
    "dm_customer_lifecycle",
    """
WITH f AS (SELECT customer_id, strftime(min(full_date), '%Y-%m') AS cohort_month FROM foi GROUP BY 1),
a AS (SELECT customer_id, strftime(full_date, '%Y-%m') AS year_month, count(DISTINCT order_id) AS orders, sum(price) AS gmv FROM foi GROUP BY 1, 2)
SELECT a.customer_id, c.customer_unique_id, year_month, cohort_month, CAST(orders AS BIGINT) AS orders, CAST(gmv AS DOUBLE) AS gmv
FROM a LEFT JOIN f ON a.customer_id = f.customer_id LEFT JOIN b_customer c ON a.customer_id = c.customer_id""",
)
def dm_customer_lifecycle(s: Star) -> DataFrame:
    return doubles(marts.customer_lifecycle(s.fact_order_item, s.dim_customer, s.dim_date))


@register(
    "dm_payment_mix",
    """SELECT year_month, payment_type, CAST(orders AS BIGINT) AS orders, CAST(unique_customers AS BIGINT) AS unique_customers,
       CAST(payment_total AS DOUBLE) AS payment_total FROM mart_pay""",
)
def dm_payment_mix(s: Star) -> DataFrame:
    return doubles(marts.payment_mix(s.fact_payment, s.fact_order, s.dim_date))


@register(
    "dm_logistics_sla",
    """SELECT strftime(full_date, '%Y-%m') AS year_month, g.state AS geolocation_state, round(avg(delivered_days), 4) AS avg_delivered_days,
       round(avg(CASE WHEN delivered_on_time THEN 1.0 ELSE 0.0 END), 4) AS on_time_rate,
       CAST(sum(CASE WHEN delivered_on_time THEN 0 ELSE 1 END) AS BIGINT) AS late_orders
       FROM fo LEFT JOIN b_customer c ON fo.customer_id = c.customer_id LEFT JOIN s_geo g ON c.customer_zip_code_prefix = g.zip GROUP BY 1, 2""",
)
def dm_logistics_sla(s: Star) -> DataFrame:
    sla = marts.logistics_sla(s.fact_order, s.dim_customer, s.dim_geolocation, s.dim_date)
    return rounded(sla, "avg_delivered_days", "on_time_rate")


BEST_SQL = """
WITH m AS (SELECT product_id, category, sum(price) AS gmv, count(*) AS units, count(DISTINCT order_id) AS orders FROM cat_items GROUP BY 1, 2),
v AS (SELECT product_id, avg(review_score) AS s FROM b_review r LEFT JOIN foi i ON r.order_id = i.order_id GROUP BY 1)
SELECT m.product_id, category AS product_category_name_english, CAST(gmv AS DOUBLE) AS gmv, CAST(units AS BIGINT) AS units,
       CAST(orders AS BIGINT) AS orders, round(s, 4) AS avg_review_score,
       CAST(row_number() OVER (PARTITION BY category ORDER BY gmv DESC, m.product_id) AS INTEGER) AS rank_in_category
FROM m LEFT JOIN v ON m.product_id = v.product_id"""


@register("dm_product_bestsellers", BEST_SQL)
def dm_product_bestsellers(s: Star) -> DataFrame:
    return doubles(rounded(marts.product_bestsellers(s.items_by_category, s.fact_review), "avg_review_score"))


@register(
    "dm_category_price_bands",
    """
WITH banded AS (SELECT *, CASE WHEN price < 10000 THEN 0 WHEN price < 25000 THEN 1 WHEN price < 50000 THEN 2 WHEN price < 75000 THEN 3 ELSE 4 END AS band_no
                FROM cat_items)
SELECT category AS product_category_name_english, band_no,
       CASE band_no WHEN 0 THEN 'Under $10000' WHEN 1 THEN '$10000-$25000' WHEN 2 THEN '$25000-$50000' WHEN 3 THEN '$50000-$75000' ELSE 'Over $75000' END AS price_band,
       CAST(count(*) AS BIGINT) AS order_items, CAST(count(DISTINCT order_id) AS BIGINT) AS orders, CAST(sum(price) AS DOUBLE) AS total_gmv,
       round(avg(CAST(price AS DOUBLE)), 2) AS avg_price
FROM banded GROUP BY 1, 2, 3""",
)
def dm_category_price_bands(s: Star) -> DataFrame:
    return doubles(rounded(marts.category_price_bands(s.items_by_category, EDGES), "avg_price", places=2))
