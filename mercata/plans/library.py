"""The library of parameterised business queries and their templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mercata.functions.predicates import between, in_months
from mercata.operators import marts
from mercata.sources.star import Star

from .layers import doubles, ratio, rounded
from .registry import register

START, END = "1996-01-01", "1998-12-31"
PERIOD = f"full_date BETWEEN DATE '{START}' AND DATE '{END}'"


def value() -> Column:
    return F.col("price") + F.col("freight_value")


def sales() -> Column:
    return F.col("sum_price") + F.col("sum_freight")


def period(df: DataFrame, start: str = START, end: str = END) -> DataFrame:
    return df.where(between("full_date", start, end))


def pct(part: Column, whole: Column) -> Column:
    """Per cent of a whole; null where the whole is zero."""
    return F.round(100.0 * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), 2)


def cents(value: Column) -> Column:
    """A computed double to two places."""
    return F.round(value, 2)


def top(df: DataFrame, n: int, *by: Column | str) -> DataFrame:
    """The first ``n`` rows of an order that ties can't leave open; ``by`` ends in a key."""
    return df.orderBy(*by).limit(n)


def trade(df: DataFrame, keys: list, amount: Column | None = None, name: str = "gmv") -> DataFrame:
    """Value, distinct orders and units by ``keys`` with the value of an average order."""
    whole = df.groupBy(*keys).agg(F.sum(value() if amount is None else amount).alias(name), F.countDistinct("order_id").alias("orders"), F.count("*").alias("units"))
    return whole.withColumn("aov", ratio(F.col(name), F.col("orders")))


def with_region(s: Star) -> DataFrame:
    sellers = s.dim_seller.select("seller_id", F.col("city_state").alias("region"))
    return period(s.fact_order_item).join(sellers, "seller_id", "left")


TRADE_SQL = "CAST({v} AS DOUBLE) AS {n}, CAST(count(DISTINCT order_id) AS BIGINT) AS orders, CAST((2 * CAST(100 * CAST({v} AS DECIMAL(28,2)) AS HUGEINT) + count(DISTINCT order_id)) // nullif(2 * count(DISTINCT order_id), 0) AS DOUBLE) / 100 AS aov"
GMV_SQL = TRADE_SQL.format(v="sum(price + freight_value)", n="gmv")
REGION_SQL = f"""WITH sold AS (SELECT f.*, concat_ws(', ', seller_city, seller_state) AS region FROM foi f LEFT JOIN b_seller b ON f.seller_id = b.seller_id WHERE {PERIOD})
"""


@register(
    "q_revenue_ts_month",
    """SELECT year_month AS dt, CAST(sum(gmv) AS DOUBLE) AS gmv, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(units) AS BIGINT) AS units,
       CAST((2 * CAST(100 * CAST(sum(gmv) AS DECIMAL(28,2)) AS HUGEINT) + sum(orders)) // nullif(2 * sum(orders), 0) AS DOUBLE) / 100 AS aov FROM mart_sales
       WHERE year_month >= '1996-01' AND year_month <= '1998-12' GROUP BY 1 ORDER BY 1 DESC LIMIT 200""",
)
def q_revenue_ts_month(s: Star) -> DataFrame:
    mart = marts.sales_monthly_category(s.items_by_category, s.dim_date).where(in_months("year_month", "1996-01", "1998-12"))
    months = mart.groupBy(F.col("year_month").alias("dt")).agg(
        F.sum("gmv").alias("gmv"), F.sum("orders").alias("orders"), F.sum("units").alias("units")
    )
    return doubles(top(months.withColumn("aov", ratio(F.col("gmv"), F.col("orders"))), 200, F.desc("dt")))


def revenue_by_grain(s: Star, grain: str) -> DataFrame:
    """Revenue series at a grain; the window is clamped to the days that have orders."""
    rows = period(s.fact_order).groupBy(F.to_date(F.date_trunc(grain, "full_date")).alias("dt")).agg(
        F.sum(sales()).alias("gmv"), F.count("order_id").alias("orders"), F.countDistinct("customer_id").alias("customers")
    )
    return doubles(top(rows.withColumn("aov", ratio(F.col("gmv"), F.col("orders"))), 200, F.desc("dt")))


def _grain_sql(grain: str) -> str:
    return f"""SELECT CAST(date_trunc('{grain}', full_date) AS DATE) AS dt, CAST(sum(sum_price + sum_freight) AS DOUBLE) AS gmv,
        CAST(count(DISTINCT order_id) AS BIGINT) AS orders, CAST(count(DISTINCT customer_id) AS BIGINT) AS customers,
        CAST((2 * CAST(100 * CAST(sum(sum_price + sum_freight) AS DECIMAL(28,2)) AS HUGEINT) + count(DISTINCT order_id)) // nullif(2 * count(DISTINCT order_id), 0) AS DOUBLE) / 100 AS aov
        FROM fo WHERE {PERIOD} GROUP BY 1 ORDER BY 1 DESC LIMIT 200"""


for _grain in ("day", "week", "quarter", "year"):
    register("q_revenue_ts_grain" if _grain == "week" else f"q_revenue_ts_{_grain}", _grain_sql(_grain))(
        lambda s, g=_grain: revenue_by_grain(s, g)
    )


def top_products(s: Star, items: DataFrame, n: int, by: str = "gmv", categories: list[str] | None = None) -> DataFrame:
    sold = items.groupBy("product_id").agg(
        F.sum(value()).alias("gmv"), F.count("*").alias("units"), F.countDistinct("order_id").alias("orders")
    )
    names = s.dim_product_category.select("product_category_name", F.col("product_category_name_english").alias("category_en"))
    whole = sold.join(s.dim_product, "product_id").join(names, "product_category_name", "left")
    if categories:
        whole = whole.where(F.col("category_en").isin(*categories))
    sizes = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
    out = whole.select(
        "product_id", F.coalesce("category_en", F.lit("unknown")).alias("category_en"), *sizes, "orders", "units",
        F.col("gmv"), ratio(F.col("gmv"), F.col("orders")).alias("aov"),
    )
    return doubles(top(out, n, F.desc(by), "product_id"))


def _products_sql(where: str, by: str, n: int) -> str:
    return f"""
WITH item AS (SELECT product_id, sum(price + freight_value) AS gmv, count(*) AS units, count(DISTINCT order_id) AS orders FROM foi WHERE {where} GROUP BY 1)
SELECT i.product_id, coalesce(english, 'unknown') AS category_en, product_weight_g, product_length_cm, product_height_cm, product_width_cm,
       CAST(orders AS BIGINT) AS orders, CAST(units AS BIGINT) AS units, CAST(gmv AS DOUBLE) AS gmv, CAST((2 * CAST(100 * CAST(gmv AS DECIMAL(28,2)) AS HUGEINT) + orders) // nullif(2 * orders, 0) AS DOUBLE) / 100 AS aov
FROM item i JOIN b_product p ON i.product_id = p.product_id LEFT JOIN b_category c ON p.product_category_name = c.product_category_name
ORDER BY i.{by} DESC, i.product_id LIMIT {n}"""


@register("q_top_products", _products_sql(f"full_date >= DATE '{START}' AND full_date < DATE '{END}'", "gmv", 20))
def q_top_products(s: Star) -> DataFrame:
    inside = (F.col("full_date") >= F.to_date(F.lit(START))) & (F.col("full_date") < F.to_date(F.lit(END)))
    return top_products(s, s.fact_order_item.where(inside), 20)


@register("t_top_products", _products_sql("full_date IS NOT NULL", "units", 10))
def t_top_products(s: Star) -> DataFrame:
    return top_products(s, s.fact_order_item.where("full_date IS NOT NULL"), 10, by="units")


@register(
    "q_top_categories",
    f"SELECT category, {GMV_SQL}, CAST(count(*) AS BIGINT) AS units FROM cat_items WHERE {PERIOD} GROUP BY 1 ORDER BY gmv DESC, category LIMIT 10",
)
def q_top_categories(s: Star) -> DataFrame:
    return doubles(top(trade(period(s.items_by_category), ["category"]), 10, F.desc("gmv"), "category"))


@register(
    "q_category_revenue",
    f"SELECT category, {TRADE_SQL.format(v='sum(price)', n='revenue')}, CAST(count(*) AS BIGINT) AS units FROM cat_items WHERE {PERIOD} GROUP BY 1 ORDER BY revenue DESC, category LIMIT 20",
)
def q_category_revenue(s: Star) -> DataFrame:
    return doubles(top(trade(period(s.items_by_category), ["category"], F.col("price"), "revenue"), 20, F.desc("revenue"), "category"))


@register(
    "q_distribution_region",
    REGION_SQL
    + """SELECT region, CAST(count(DISTINCT order_id) AS BIGINT) AS order_count, CAST(sum(price + freight_value) AS DOUBLE) AS gmv,
         CAST((2 * CAST(100 * CAST(sum(price + freight_value) AS DECIMAL(28,2)) AS HUGEINT) + count(DISTINCT order_id)) // nullif(2 * count(DISTINCT order_id), 0) AS DOUBLE) / 100 AS aov, CAST(count(DISTINCT product_id) AS BIGINT) AS unique_products
         FROM sold GROUP BY 1 ORDER BY order_count DESC, region LIMIT 50""",
)
def q_distribution_region(s: Star) -> DataFrame:
    rows = with_region(s).groupBy("region").agg(
        F.countDistinct("order_id").alias("order_count"), F.sum(value()).alias("gmv"), F.countDistinct("product_id").alias("unique_products")
    )
    return doubles(top(rows.withColumn("aov", ratio(F.col("gmv"), F.col("order_count"))), 50, F.desc("order_count"), "region"))


AOV_SQL = TRADE_SQL.format(v="sum(price + freight_value)", n="total_revenue")


@register(
    "q_aov_payment",
    f"""SELECT primary_payment_type AS payment_type, {TRADE_SQL.format(v='sum(sum_price + sum_freight)', n='total_revenue')}
        FROM fo WHERE {PERIOD} GROUP BY 1 ORDER BY orders DESC, payment_type LIMIT 20""",
)
def q_aov_payment(s: Star) -> DataFrame:
    rows = trade(period(s.fact_order), [F.col("primary_payment_type").alias("payment_type")], sales(), "total_revenue").drop("units")
    return doubles(top(rows, 20, F.desc("orders"), "payment_type"))


@register("q_aov_region", REGION_SQL + f"SELECT region, {AOV_SQL} FROM sold GROUP BY 1 ORDER BY orders DESC, region LIMIT 30")
def q_aov_region(s: Star) -> DataFrame:
    return doubles(top(trade(with_region(s), ["region"], value(), "total_revenue").drop("units"), 30, F.desc("orders"), "region"))


@register("q_aov_category", f"SELECT category, {AOV_SQL} FROM cat_items WHERE {PERIOD} GROUP BY 1 ORDER BY orders DESC, category LIMIT 30")
def q_aov_category(s: Star) -> DataFrame:
    rows = trade(period(s.items_by_category), ["category"], value(), "total_revenue").drop("units")
    return doubles(top(rows, 30, F.desc("orders"), "category"))


def shares(totals: DataFrame, key: str, value: str, n: int = 30) -> DataFrame:
    """Share and cumulative share of the grand total, largest first. ``totals`` is aggregated: a row for each member."""
    everything = W.partitionBy()
    so_far = W.orderBy(F.desc(value), key).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = totals.select(
        key, value, pct(F.col(value), F.sum(value).over(everything)).alias("share_pct"),
        pct(F.sum(value).over(so_far), F.sum(value).over(everything)).alias("cumulative_pct"),
    )
    return doubles(top(out, n, F.desc(value), key))


def _share_sql(source: str, key: str, value: str) -> str:
    with_, from_ = (source, "sold") if source.startswith("WITH") else ("", source)
    return f"""{with_ + ', base' if with_ else 'WITH base'} AS (SELECT {key}, sum({value}) AS revenue FROM {from_} WHERE {PERIOD} GROUP BY 1)
SELECT {key}, CAST(revenue AS DOUBLE) AS revenue, round(100.0 * CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE), 2) AS share_pct,
       round(100.0 * CAST(sum(revenue) OVER (ORDER BY revenue DESC, {key} ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE), 2) AS cumulative_pct
FROM base ORDER BY revenue DESC, {key} LIMIT 30"""


@register("q_share_region", _share_sql(REGION_SQL.strip(), "region", "price + freight_value"))
def q_share_region(s: Star) -> DataFrame:
    return shares(with_region(s).groupBy("region").agg(F.sum(value()).alias("revenue")), "region", "revenue")


@register("q_share_category", _share_sql("cat_items", "category", "price"))
def q_share_category(s: Star) -> DataFrame:
    return shares(period(s.items_by_category).groupBy("category").agg(F.sum("price").alias("revenue")), "category", "revenue")


@register(
    "q_mom",
    f"""
WITH m AS (SELECT CAST(date_trunc('month', full_date) AS DATE) AS month, CAST(sum(sum_price + sum_freight) AS DOUBLE) AS gmv, CAST(count(DISTINCT order_id) AS BIGINT) AS orders
           FROM fo WHERE {PERIOD} GROUP BY 1),
l AS (SELECT *, lag(gmv) OVER (ORDER BY month) AS g, lag(orders) OVER (ORDER BY month) AS o FROM m)
SELECT month, gmv, orders, round(gmv - g, 2) AS mom_gmv_abs, round(100.0 * (gmv / nullif(g, 0) - 1), 2) AS mom_gmv_pct,
       orders - o AS mom_orders_abs, round(100.0 * (CAST(orders AS DOUBLE) / nullif(o, 0) - 1), 2) AS mom_orders_pct
FROM l ORDER BY month DESC LIMIT 24""",
)
def q_mom(s: Star) -> DataFrame:
    months = period(s.fact_order).groupBy(F.to_date(F.date_trunc("month", "full_date")).alias("month")).agg(
        F.sum(sales()).cast("double").alias("gmv"), F.count("order_id").alias("orders")
    )
    before = lambda c: F.lag(c).over(W.orderBy("month"))
    growth = lambda c: F.round(100.0 * (F.col(c) / F.nullif(before(c).cast("double"), F.lit(0.0)) - 1), 2)
    out = months.select(
        "month", "gmv", "orders", F.round(F.col("gmv") - before("gmv"), 2).alias("mom_gmv_abs"), growth("gmv").alias("mom_gmv_pct"),
        (F.col("orders") - before("orders")).alias("mom_orders_abs"), growth("orders").alias("mom_orders_pct"),
    )
    return top(out, 24, F.desc("month"))


def on_time() -> Column:
    return F.col("delivered_on_time")


def canceled() -> Column:
    return F.col("is_canceled")


def percent_of_rows(condition: Column) -> Column:
    return pct(F.count_if(condition), F.count("*"))


@register(
    "q_ontime_time",
    f"""SELECT CAST(date_trunc('month', full_date) AS DATE) AS bucket, round(100.0 * sum(CASE WHEN delivered_on_time THEN 1 ELSE 0 END) / count(*), 2) AS ontime_rate_pct,
        round(100.0 * sum(CASE WHEN NOT delivered_on_time THEN 1 ELSE 0 END) / count(*), 2) AS late_rate_pct,
        round(100.0 * sum(CASE WHEN is_canceled THEN 1 ELSE 0 END) / count(*), 2) AS cancel_rate_pct, CAST(count(*) AS BIGINT) AS total_orders
        FROM fo WHERE {PERIOD} GROUP BY 1 ORDER BY 1 DESC LIMIT 200""",
)
def q_ontime_time(s: Star) -> DataFrame:
    rows = period(s.fact_order).groupBy(F.to_date(F.date_trunc("month", "full_date")).alias("bucket")).agg(
        percent_of_rows(on_time()).alias("ontime_rate_pct"), percent_of_rows(~on_time()).alias("late_rate_pct"),
        percent_of_rows(canceled()).alias("cancel_rate_pct"), F.count("*").alias("total_orders"),
    )
    return top(rows, 200, F.desc("bucket"))


@register(
    "q_ontime_region",
    f"""SELECT concat_ws(', ', seller_city, seller_state) AS region, round(100.0 * sum(CASE WHEN delivered_on_time THEN 1 ELSE 0 END) / count(*), 2) AS ontime_rate_pct,
        round(100.0 * sum(CASE WHEN NOT delivered_on_time THEN 1 ELSE 0 END) / count(*), 2) AS late_rate_pct, CAST(count(*) AS BIGINT) AS total_orders
        FROM fo JOIN foi i ON fo.order_id = i.order_id LEFT JOIN b_seller b ON i.seller_id = b.seller_id
        WHERE fo.{PERIOD} GROUP BY 1 ORDER BY ontime_rate_pct DESC, region LIMIT 50""",
)
def q_ontime_region(s: Star) -> DataFrame:
    sellers = s.dim_seller.select("seller_id", F.col("city_state").alias("region"))
    pairs = s.fact_order_item.select("order_id", "seller_id").join(sellers, "seller_id", "left")
    rows = period(s.fact_order).select("order_id", "delivered_on_time").join(pairs, "order_id").groupBy("region").agg(
        percent_of_rows(on_time()).alias("ontime_rate_pct"), percent_of_rows(~on_time()).alias("late_rate_pct"), F.count("*").alias("total_orders")
    )
    return top(rows, 50, F.desc("ontime_rate_pct"), "region")


def _pay_mart(s: Star) -> DataFrame:
    return marts.payment_mix(s.fact_payment, s.fact_order, s.dim_date).where(in_months("year_month", "1996-01", "1998-12"))


PAY_SQL = """CAST(sum(orders) AS BIGINT) AS {o}, CAST(sum(unique_customers) AS BIGINT) AS {c}, CAST(sum(payment_total) AS DOUBLE) AS total_revenue,
  CAST((2 * CAST(100 * CAST(sum(payment_total) AS DECIMAL(28,2)) AS HUGEINT) + sum(orders)) // nullif(2 * sum(orders), 0) AS DOUBLE) / 100 AS avg_order_value FROM mart_pay WHERE year_month BETWEEN '1996-01' AND '1998-12'"""


def _pay_totals(df: DataFrame, keys: list, orders: str, customers: str) -> DataFrame:
    rows = df.groupBy(*keys).agg(F.sum("orders").alias(orders), F.sum("unique_customers").alias(customers), F.sum("payment_total").alias("total_revenue"))
    return rows.withColumn("avg_order_value", ratio(F.col("total_revenue"), F.col(orders)))


@register(
    "q_payment_mix_total",
    f"SELECT payment_type, {PAY_SQL.format(o='total_orders', c='total_customers')} GROUP BY 1 ORDER BY total_orders DESC, payment_type LIMIT 20",
)
def q_payment_mix_total(s: Star) -> DataFrame:
    return doubles(top(_pay_totals(_pay_mart(s), ["payment_type"], "total_orders", "total_customers"), 20, F.desc("total_orders"), "payment_type"))


@register(
    "q_payment_mix_month",
    f"SELECT year_month AS dt, payment_type, {PAY_SQL.format(o='orders', c='customers')} GROUP BY 1, 2 ORDER BY dt DESC, orders DESC, payment_type LIMIT 200",
)
def q_payment_mix_month(s: Star) -> DataFrame:
    rows = _pay_totals(_pay_mart(s), [F.col("year_month").alias("dt"), "payment_type"], "orders", "customers")
    return doubles(top(rows, 200, F.desc("dt"), F.desc("orders"), "payment_type"))


@register(
    "q_recent_orders",
    """SELECT full_date, order_id, customer_id, primary_payment_type AS payment_type, CAST(items_count AS BIGINT) AS items_count,
       CAST(sum_price + sum_freight AS DOUBLE) AS gmv, delivered_on_time, is_canceled FROM fo ORDER BY full_date DESC, order_id LIMIT 20""",
)
def q_recent_orders(s: Star) -> DataFrame:
    rows = s.fact_order.where("full_date IS NOT NULL").select(
        "full_date", "order_id", "customer_id", F.col("primary_payment_type").alias("payment_type"), "items_count", sales().alias("gmv"),
        "delivered_on_time", "is_canceled",
    )
    return doubles(top(rows, 20, F.desc("full_date"), "order_id"))


@register(
    "q_sellers_bad_sla",
    f"""SELECT b.seller_id, concat_ws(', ', seller_city, seller_state) AS region,
        round(100.0 * sum(CASE WHEN delivered_on_time THEN 1 ELSE 0 END) / count(*), 2) AS ontime_rate_pct,
        CAST(count(DISTINCT fo.order_id) AS BIGINT) AS orders, CAST(sum(sum_price + sum_freight) AS DOUBLE) AS revenue
        FROM fo JOIN foi i ON fo.order_id = i.order_id LEFT JOIN b_seller b ON i.seller_id = b.seller_id
        WHERE fo.{PERIOD} GROUP BY 1, 2 HAVING count(DISTINCT fo.order_id) >= 20 ORDER BY ontime_rate_pct, b.seller_id LIMIT 10""",
)
def q_sellers_bad_sla(s: Star) -> DataFrame:
    sellers = s.dim_seller.select("seller_id", F.col("city_state").alias("region"))
    pairs = s.fact_order_item.select("order_id", "seller_id").join(sellers, "seller_id", "left")
    rows = period(s.fact_order).select("order_id", "delivered_on_time", sales().alias("v")).join(pairs, "order_id").groupBy("seller_id", "region").agg(
        percent_of_rows(on_time()).alias("ontime_rate_pct"), F.countDistinct("order_id").alias("orders"), F.sum("v").alias("revenue")
    )
    return doubles(top(rows.where("orders >= 20"), 10, "ontime_rate_pct", "seller_id"))


def month_number(c: str) -> Column:
    return F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")


@register(
    "q_cohort_retention",
    """
WITH live AS (SELECT *, strftime(full_date, '%Y-%m') AS year_month FROM fo WHERE NOT is_canceled),
firsts AS (SELECT customer_id, min(year_month) AS cohort_month FROM live GROUP BY 1),
inside AS (SELECT * FROM firsts WHERE cohort_month >= '1995-01' AND cohort_month < '1996-01'),
sizes AS (SELECT cohort_month, count(*) AS n FROM inside GROUP BY 1),
active AS (SELECT cohort_month, year_month, count(DISTINCT l.customer_id) AS customers, count(DISTINCT order_id) AS orders,
                  sum(coalesce(sum_price, 0) + coalesce(sum_freight, 0)) AS gmv FROM live l JOIN inside i ON l.customer_id = i.customer_id GROUP BY 1, 2),
numbered AS (SELECT *, date_diff('month', strptime(cohort_month || '-01', '%Y-%m-%d'), strptime(year_month || '-01', '%Y-%m-%d')) AS m FROM active)
SELECT a.cohort_month, year_month, CAST(m AS INTEGER) AS months_since_cohort, CAST(n AS BIGINT) AS customers_in_cohort, CAST(customers AS BIGINT) AS customers_active,
       round(100.0 * customers / n, 2) AS retention_pct, CAST(orders AS BIGINT) AS total_orders, CAST(gmv AS DOUBLE) AS total_gmv
FROM numbered a JOIN sizes s ON a.cohort_month = s.cohort_month WHERE m BETWEEN 0 AND 12 ORDER BY 1, 3 LIMIT 10000""",
)
def q_cohort_retention(s: Star, first: str = "1995-01", end: str = "1996-01", months: int = 12) -> DataFrame:
    live = marts.with_month(s.fact_order.where(~canceled()), s.dim_date)
    firsts = live.groupBy("customer_id").agg(F.min("year_month").alias("cohort_month")).where(in_months("cohort_month", first, end, exclusive=True))
    sizes = firsts.groupBy("cohort_month").agg(F.count("*").alias("customers_in_cohort"))
    spent = F.coalesce("sum_price", F.lit(0)) + F.coalesce("sum_freight", F.lit(0))
    active = live.join(firsts, "customer_id").groupBy("cohort_month", "year_month").agg(
        F.countDistinct("customer_id").alias("customers_active"), F.count("order_id").alias("total_orders"), F.sum(spent).alias("total_gmv")
    )
    since = (month_number("year_month") - month_number("cohort_month")).alias("months_since_cohort")
    out = active.join(sizes, "cohort_month").select(
        "cohort_month", "year_month", since, "customers_in_cohort", "customers_active",
        pct(F.col("customers_active"), F.col("customers_in_cohort")).alias("retention_pct"), "total_orders", "total_gmv",
    )
    return doubles(top(out.where(F.col("months_since_cohort").between(0, months)), 10_000, "cohort_month", "months_since_cohort"))


@register(
    "t_revenue_month",
    """SELECT year_month AS month, CAST(sum(gmv) AS DOUBLE) AS revenue, CAST(sum(orders) AS BIGINT) AS order_count, CAST(sum(units) AS BIGINT) AS units
       FROM mart_sales WHERE year_month >= '1997-01' AND year_month <= '1998-12' GROUP BY 1 ORDER BY 1 DESC LIMIT 200""",
)
def t_revenue_month(s: Star) -> DataFrame:
    mart = marts.sales_monthly_category(s.items_by_category, s.dim_date).where(in_months("year_month", "1997-01", "1998-12"))
    rows = mart.groupBy(F.col("year_month").alias("month")).agg(
        F.sum("gmv").alias("revenue"), F.sum("orders").alias("order_count"), F.sum("units").alias("units")
    )
    return doubles(top(rows, 200, F.desc("month")))


def paid(df: DataFrame, keys: list, average: str = "avg_order_value") -> DataFrame:
    """Orders, total and average payment by ``keys``; an order is one row of the fact."""
    return df.groupBy(*keys).agg(
        F.count("order_id").alias("order_count"), F.sum("payment_total").alias("total_revenue"), ratio(F.sum("payment_total"), F.count("payment_total")).alias(average)
    )


PAID_SQL = "CAST(count(DISTINCT order_id) AS BIGINT) AS order_count, CAST(sum(payment_total) AS DOUBLE) AS total_revenue, CAST((2 * CAST(100 * CAST(sum(payment_total) AS DECIMAL(28,2)) AS HUGEINT) + count(payment_total)) // nullif(2 * count(payment_total), 0) AS DOUBLE) / 100 AS {a}"


@register("t_customer_value", f"SELECT customer_id, {PAID_SQL.format(a='avg_order_value')} FROM fo GROUP BY 1 ORDER BY total_revenue DESC, customer_id LIMIT 30")
def t_customer_value(s: Star) -> DataFrame:
    return doubles(top(paid(s.fact_order, ["customer_id"]), 30, F.desc("total_revenue"), "customer_id"))


@register(
    "t_payment_type",
    f"SELECT primary_payment_type AS payment_type, {PAID_SQL.format(a='avg_order_value')} FROM fo WHERE primary_payment_type IS NOT NULL GROUP BY 1 ORDER BY order_count DESC, 1 LIMIT 200",
)
def t_payment_type(s: Star) -> DataFrame:
    rows = paid(s.fact_order.where("primary_payment_type IS NOT NULL"), [F.col("primary_payment_type").alias("payment_type")])
    return doubles(top(rows, 200, F.desc("order_count"), "payment_type"))


@register(
    "t_order_value",
    f"SELECT order_id, {PAID_SQL.format(a='avg_revenue_per_order')}, CAST(sum(items_count) AS BIGINT) AS total_quantity FROM fo GROUP BY 1 ORDER BY total_revenue DESC, order_id LIMIT 20",
)
def t_order_value(s: Star) -> DataFrame:
    rows = s.fact_order.select(
        "order_id", F.lit(1).cast("long").alias("order_count"), F.col("payment_total").alias("total_revenue"),
        cents(F.col("payment_total").cast("double")).alias("avg_revenue_per_order"), F.col("items_count").alias("total_quantity"),
    )
    return doubles(top(rows, 20, F.desc("total_revenue"), "order_id"))


@register(
    "t_status_breakdown",
    """
WITH g AS (SELECT CASE WHEN is_canceled THEN 'canceled' WHEN delivered_on_time THEN 'delivered_on_time' WHEN NOT delivered_on_time THEN 'delivered_late' ELSE 'other' END AS order_status,
                  count(DISTINCT order_id) AS n, count(DISTINCT customer_id) AS c FROM fo GROUP BY 1)
SELECT order_status, CAST(n AS BIGINT) AS order_count, CAST(c AS BIGINT) AS customer_count, round(n * 100.0 / sum(n) OVER (), 2) AS percentage FROM g""",
)
def t_status_breakdown(s: Star) -> DataFrame:
    status = F.when(canceled(), "canceled").when(on_time(), "delivered_on_time").when(~on_time(), "delivered_late").otherwise("other")
    rows = s.fact_order.groupBy(status.alias("order_status")).agg(
        F.count("order_id").alias("order_count"), F.countDistinct("customer_id").alias("customer_count")
    )
    return rows.withColumn("percentage", pct(F.col("order_count"), F.sum("order_count").over(W.partitionBy()))).orderBy(F.desc("order_count"))


@register(
    "t_recent_orders",
    """SELECT order_id, customer_id, full_date, CAST(payment_total AS DOUBLE) AS payment_total, primary_payment_type, CAST(items_count AS BIGINT) AS items_count,
       delivered_on_time, is_canceled FROM fo ORDER BY full_date DESC, order_id LIMIT 50""",
)
def t_recent_orders(s: Star) -> DataFrame:
    rows = s.fact_order.select("order_id", "customer_id", "full_date", "payment_total", "primary_payment_type", "items_count", "delivered_on_time", "is_canceled")
    return doubles(top(rows, 50, F.desc("full_date"), "order_id"))


STATS_SQL = """SELECT CAST(date_trunc('month', full_date) AS DATE) AS month, CAST((2 * CAST(100 * CAST(sum(payment_total) AS DECIMAL(28,2)) AS HUGEINT) + count(payment_total)) // nullif(2 * count(payment_total), 0) AS DOUBLE) / 100 AS avg_order_value,
  round(stddev_samp(CAST(payment_total AS DOUBLE)), 2) AS stddev_order_value, CAST(min(payment_total) AS DOUBLE) AS min_order_value,
  CAST(max(payment_total) AS DOUBLE) AS max_order_value, CAST(count(DISTINCT order_id) AS BIGINT) AS order_count FROM fo GROUP BY 1 ORDER BY 1 DESC LIMIT 200"""


@register("t_aov_stats", STATS_SQL)
def t_aov_stats(s: Star) -> DataFrame:
    v = F.col("payment_total").cast("double")
    rows = s.fact_order.groupBy(F.to_date(F.date_trunc("month", "full_date")).alias("month")).agg(
        ratio(F.sum("payment_total"), F.count("payment_total")).alias("avg_order_value"), F.round(F.stddev_samp(v), 2).alias("stddev_order_value"),
        F.min(v).alias("min_order_value"), F.max(v).alias("max_order_value"), F.count("order_id").alias("order_count"),
    )
    return top(rows, 200, F.desc("month"))


register("agg_stats_set", STATS_SQL)(t_aov_stats)


@register(
    "t_delivery_status",
    """SELECT CASE WHEN delivered_on_time THEN 'On Time' WHEN NOT delivered_on_time THEN 'Late' ELSE 'Unknown' END AS delivery_status,
       CAST(count(DISTINCT order_id) AS BIGINT) AS order_count, round(avg(delivered_days), 4) AS avg_delivery_days
       FROM fo WHERE delivered_days IS NOT NULL GROUP BY 1""",
)
def t_delivery_status(s: Star) -> DataFrame:
    status = F.when(on_time(), "On Time").when(~on_time(), "Late").otherwise("Unknown").alias("delivery_status")
    rows = s.fact_order.where("delivered_days IS NOT NULL").groupBy(status).agg(
        F.count("order_id").alias("order_count"), F.avg("delivered_days").alias("avg_delivery_days")
    )
    return rounded(rows, "avg_delivery_days").orderBy(F.desc("order_count"))
