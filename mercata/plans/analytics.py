"""Windows, joins, predicates and cubes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mercata.functions.predicates import capped, dual, half_open, in_list, in_months, last_months, month_bounds
from mercata.operators import marts
from mercata.operators.cube import cube_query
from mercata.operators.ordered import exact_quantiles, prefix_sums
from mercata.operators import sketches
from mercata.sources.shared import new_path, stored
from mercata.sources.star import Star

from .layers import doubles
from .library import PERIOD, pct, period, ratio, top
from .registry import alias, register

D0, D1 = date(1997, 3, 5), date(1997, 4, 18)
RANGE = "full_date >= DATE '1997-03-05' AND full_date < DATE '1997-04-19'"
COUNTED = "CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(price), 0) AS DOUBLE) AS gmv FROM foi WHERE "


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum("price"), F.lit(0)).cast("double").alias("gmv"))


@register("pred_half_open", f"SELECT {COUNTED}{RANGE}")
def pred_half_open(s: Star) -> DataFrame:
    return counted(s.fact_order_item.where(half_open("full_date", D0, D1)))


@register("pred_month_bounds", f"SELECT {COUNTED} full_date >= DATE '1997-12-01' AND full_date < DATE '1998-01-01'")
def pred_month_bounds(s: Star) -> DataFrame:
    first, after = month_bounds("1997-12")
    return counted(s.fact_order_item.where((F.col("full_date") >= first) & (F.col("full_date") < after)))


def facts_by_month(s: Star) -> DataFrame:
    """The items of orders written by month, so that a month's files are found by its folder."""
    path = new_path(s.spark)
    facts = s.fact_order_item.select("full_date", "price", marts.month().alias("year_month"))
    facts.repartition("year_month").write.partitionBy("year_month").parquet(path)
    return s.spark.read.schema(facts.schema).parquet(path)


@register("pred_dual", f"SELECT {COUNTED}{RANGE}")
def pred_dual(s: Star) -> DataFrame:
    """The month bound prunes folders, the day bound rows."""
    return counted(facts_by_month(s).where(dual("year_month", "full_date", D0, D1)))


@register("pred_dual_join", f"SELECT {COUNTED} strftime(full_date, '%Y-%m') IN ('1997-02', '1997-11')")
def pred_dual_join(s: Star) -> DataFrame:
    """Months chosen by a join: folders are pruned at run time by what the filtered calendar holds."""
    months = s.dim_date.where("(year = 1997) AND (month IN (2, 11))").select(marts.month().alias("year_month")).distinct()
    return counted(facts_by_month(s).join(months, "year_month"))


@register("pred_last_n_months", f"SELECT {COUNTED} full_date >= DATE '1998-06-30' - INTERVAL 3 MONTH")
def pred_last_n_months(s: Star) -> DataFrame:
    return counted(s.fact_order_item.where(last_months("full_date", date(1998, 6, 30), 3)))


@register("pred_in_list", f"SELECT {COUNTED} order_status IN ('delivered', 'shipped')")
def pred_in_list(s: Star) -> DataFrame:
    return counted(s.fact_order_item.where(in_list("order_status", ["delivered", "shipped"])))


@register(
    "pred_month_string",
    """SELECT CAST(sum(CASE WHEN year_month >= '1996-02' AND year_month <= '1996-05' THEN orders ELSE 0 END) AS BIGINT) AS inclusive,
       CAST(sum(CASE WHEN year_month >= '1996-02' AND year_month < '1996-05' THEN orders ELSE 0 END) AS BIGINT) AS exclusive FROM mart_sales""",
)
def pred_month_string(s: Star) -> DataFrame:
    mart = marts.sales_monthly_category(s.items_by_category, s.dim_date)
    pick = lambda x: F.sum(F.when(in_months("year_month", "1996-02", "1996-05", x), F.col("orders")).otherwise(0))
    return mart.agg(pick(False).alias("inclusive"), pick(True).alias("exclusive"))


@register("row_cap", "SELECT order_id FROM fo ORDER BY order_id LIMIT 1000")
def row_cap(s: Star) -> DataFrame:
    return capped(s.fact_order.select("order_id").orderBy("order_id"), rows=1000)


STAR_SQL = """SELECT category, strftime(i.full_date, '%Y-%m') AS year_month, CAST(count(*) AS BIGINT) AS n, CAST(sum(price) AS DOUBLE) AS gmv
  FROM cat_items i {j} GROUP BY 1, 2"""


def _by_month(df: DataFrame) -> DataFrame:
    return doubles(df.groupBy("category", "year_month").agg(F.count("*").alias("n"), F.sum("price").alias("gmv")))


@register("join_star_left", STAR_SQL.format(j=""))
def join_star_left(s: Star) -> DataFrame:
    return _by_month(marts.with_month(s.items_by_category, s.dim_date))


@register("join_star_inner_mixed", STAR_SQL.format(j="JOIN b_product p ON i.product_id = p.product_id JOIN days d ON i.full_date = d.full_date"))
def join_star_inner_mixed(s: Star) -> DataFrame:
    inner = s.items_by_category.join(s.dim_product.select("product_id"), "product_id")
    return _by_month(inner.join(s.dim_date.select("full_date", "year_month"), "full_date"))


@register("join_zip_geo", "SELECT customer_id, zip AS geolocation_zip_code_prefix, state FROM b_customer LEFT JOIN s_geo ON customer_zip_code_prefix = zip")
def join_zip_geo(s: Star) -> DataFrame:
    geo = s.dim_geolocation.select("geolocation_zip_code_prefix", F.col("geolocation_state").alias("state"))
    people = s.dim_customer.select("customer_id", "customer_zip_code_prefix")
    return people.join(geo, F.col("customer_zip_code_prefix") == F.col("geolocation_zip_code_prefix"), "left").drop("customer_zip_code_prefix")


@register(
    "join_fanout_reviews",
    "SELECT product_id, CAST(count(*) AS BIGINT) AS n, round(avg(review_score), 4) AS avg_review_score FROM b_review r LEFT JOIN foi i ON r.order_id = i.order_id GROUP BY 1",
)
def join_fanout_reviews(s: Star) -> DataFrame:
    pairs = s.fact_review.select("order_id", "review_score").join(s.fact_order_item.select("order_id", "product_id"), "order_id", "left")
    return pairs.groupBy("product_id").agg(F.count("*").alias("n"), F.round(F.avg("review_score"), 4).alias("avg_review_score"))


@register("join_self_latest", "WITH r AS (SELECT order_id, customer_id, full_date, rank() OVER (PARTITION BY customer_id ORDER BY full_date DESC) AS k FROM fo) SELECT order_id, customer_id, full_date FROM r WHERE k = 1")
def join_self_latest(s: Star) -> DataFrame:
    """Each customer's orders of its last day, ties kept."""
    newest = W.partitionBy("customer_id").orderBy(F.desc("full_date"))
    rows = s.fact_order.select("order_id", "customer_id", "full_date")
    return rows.withColumn("k", F.rank().over(newest)).where("k = 1").drop("k")


@register(
    "join_enrich_product",
    """SELECT i.product_id, english AS category, product_weight_g, CAST(n AS BIGINT) AS n FROM (SELECT product_id, count(*) AS n FROM foi GROUP BY 1) i
       LEFT JOIN b_product p ON i.product_id = p.product_id LEFT JOIN b_category c ON p.product_category_name = c.product_category_name""",
)
def join_enrich_product(s: Star) -> DataFrame:
    return enrich_product(s, s.fact_order_item.groupBy("product_id").agg(F.count("*").alias("n"))).select("product_id", "category", "product_weight_g", "n")


def enrich_product(s: Star, df: DataFrame) -> DataFrame:
    """Add category and sizes to any result with a product_id; columns it has win where they are not null; unmatched rows stay."""
    names = s.dim_product_category.select("product_category_name", F.col("product_category_name_english").alias("category"))
    sizes = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
    facts = s.dim_product.select("product_id", "product_category_name", *sizes).join(names, "product_category_name", "left").drop("product_category_name")
    own = [c for c in ("category", *sizes) if c in df.columns]
    wide = df.join(facts.withColumnsRenamed({c: f"_{c}" for c in own}), "product_id", "left")
    return wide.withColumns({c: F.coalesce(c, f"_{c}") for c in own}).drop(*[f"_{c}" for c in own])


@register("agg_having", "SELECT seller_id, CAST(count(DISTINCT order_id) AS BIGINT) AS orders FROM foi GROUP BY 1 HAVING count(DISTINCT order_id) >= 580")
def agg_having(s: Star) -> DataFrame:
    return s.fact_order_item.groupBy("seller_id").agg(F.countDistinct("order_id").alias("orders")).where("orders >= 580")


@register("agg_quantile", "SELECT round(quantile_cont(CAST(price AS DOUBLE), 0.1), 4) AS q10, round(quantile_cont(CAST(price AS DOUBLE), 0.9), 4) AS q90 FROM foi")
def agg_quantile(s: Star) -> DataFrame:
    q10, q90 = exact_quantiles(stored(s.fact_order_item.select("price")), "price", [0.1, 0.9])
    return s.spark.createDataFrame([(q10, q90)], "q10 double, q90 double").select(F.round("q10", 4).alias("q10"), F.round("q90", 4).alias("q90"))


@register(
    "agg_distinct_sketch",
    f"""
WITH c AS (SELECT DISTINCT year(full_date) * 12 + month(full_date) AS m, customer_id FROM fo WHERE full_date IS NOT NULL)
SELECT CAST(a.m AS INTEGER) AS period, CAST(count(DISTINCT c.customer_id) AS BIGINT) AS customers, true AS within_bound
FROM (SELECT DISTINCT m FROM c) a JOIN c ON c.m BETWEEN a.m - 2 AND a.m GROUP BY 1""",
)
def agg_distinct_sketch(s: Star) -> DataFrame:
    """Customers of each month and the two before it: exact, and whether the estimate from stored monthly sketches keeps its bound."""
    seen = s.fact_order.where("full_date IS NOT NULL").select((F.year("full_date") * 12 + F.month("full_date")).alias("m"), "customer_id")
    monthly = stored(sketches.period_sketches(seen, "m", "customer_id"))
    told = sketches.distinct_in_windows(monthly, 3)
    pairs = seen.distinct().select("customer_id", F.explode(F.sequence(F.col("m"), F.col("m") + 2)).alias("period")).distinct()
    exact = pairs.groupBy("period").agg(F.count("*").alias("customers"))
    within = F.abs(F.col("estimate") - F.col("customers")) <= sketches.BOUND * F.col("customers") + 1
    return told.join(exact, "period").select("period", "customers", within.alias("within_bound"))


@register("agg_filter_clause", "SELECT seller_id, CAST(count(*) FILTER (WHERE price >= 50000) AS BIGINT) AS n_large FROM foi GROUP BY 1")
def agg_filter_clause(s: Star) -> DataFrame:
    return s.fact_order_item.groupBy("seller_id").agg(F.count_if(F.col("price") >= 50000).alias("n_large"))


@register(
    "agg_cond_pivot",
    """SELECT payment_type, CAST(max(CASE WHEN payment_installments = 1 THEN payment_value END) AS DOUBLE) AS one,
       CAST(max(CASE WHEN payment_installments = 7 THEN payment_value END) AS DOUBLE) AS seven FROM b_payment GROUP BY 1""",
)
def agg_cond_pivot(s: Star) -> DataFrame:
    pick = lambda n: F.max(F.when(F.col("payment_installments") == n, F.col("payment_value"))).cast("double")
    return s.fact_payment.groupBy("payment_type").agg(pick(1).alias("one"), pick(7).alias("seven"))




def measures() -> dict[str, Column]:
    return {"orders": F.countDistinct("order_id"), "units": F.count("*"), "gmv": F.sum("price").cast("double")}


ROLL_MEASURES = "CAST(count(DISTINCT order_id) AS BIGINT) AS orders, CAST(count(*) AS BIGINT) AS units, CAST(sum(price) AS DOUBLE) AS gmv"
ROLL_SQL = f"""
WITH t AS (SELECT *, CAST(date_trunc('year', full_date) AS DATE) AS bucket FROM cat_items WHERE {PERIOD})
SELECT CASE WHEN grouping(bucket) = 1 THEN 'ALL' ELSE CAST(bucket AS VARCHAR) END AS bucket, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category,
       CASE WHEN grouping(order_status) = 1 THEN 'ALL' ELSE order_status END AS order_status, {ROLL_MEASURES}
FROM t GROUP BY """


@register("agg_rollup", ROLL_SQL + "ROLLUP (bucket, category, order_status)")
def agg_rollup(s: Star) -> DataFrame:
    return cube_query(period(s.items_by_category), "full_date", "year", ["category", "order_status"], measures(), mode="rollup")


@register("agg_grouping_sets", ROLL_SQL + "GROUPING SETS ((bucket, category, order_status), (bucket, category), (bucket), ())")
def agg_grouping_sets(s: Star) -> DataFrame:
    return cube_query(period(s.items_by_category), "full_date", "year", ["category", "order_status"], measures(), mode="sets")


@register(
    "agg_builder",
    f"""SELECT CAST(CAST(date_trunc('month', full_date) AS DATE) AS VARCHAR) AS bucket, category, {ROLL_MEASURES} FROM cat_items
        WHERE {PERIOD} AND order_status = 'delivered' GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 500""",
)
def agg_builder(s: Star) -> DataFrame:
    rows = cube_query(
        s.items_by_category, "full_date", "month", ["category"], measures(), start="1996-01-01", end="1998-12-31",
        where=F.col("order_status") == "delivered", mode="plain", limit=500,
    )
    return rows


alias("win_row_number", "dm_product_bestsellers")


SERIES_SQL = "WITH d AS (SELECT seller_id, full_date, CAST(sum(price) AS DOUBLE) AS v FROM foi WHERE full_date IS NOT NULL GROUP BY 1, 2)\n"


def daily_sellers(s: Star) -> DataFrame:
    return s.fact_order_item.where("full_date IS NOT NULL").groupBy("seller_id", "full_date").agg(F.sum("price").cast("double").alias("v"))


@register(
    "win_lag",
    SERIES_SQL + "SELECT seller_id, full_date, " + ", ".join(f"lag(v, {n}) OVER w AS lag_{n}" for n in (1, 7, 28)) + " FROM d WINDOW w AS (PARTITION BY seller_id ORDER BY full_date)",
)
def win_lag(s: Star) -> DataFrame:
    w = W.partitionBy("seller_id").orderBy("full_date")
    return daily_sellers(s).select("seller_id", "full_date", *[F.lag("v", n).over(w).alias(f"lag_{n}") for n in (1, 7, 28)])


@register(
    "win_rolling",
    SERIES_SQL + "SELECT seller_id, full_date, " + ", ".join(f"CAST((2 * CAST(100 * CAST(sum(v) OVER w{n} AS DECIMAL(28,2)) AS HUGEINT) + count(v) OVER w{n}) // (2 * count(v) OVER w{n}) AS DOUBLE) / 100 AS roll{n}" for n in (7, 28)) + " FROM d WINDOW " + ", ".join(f"w{n} AS (PARTITION BY seller_id ORDER BY full_date ROWS {n - 1} PRECEDING)" for n in (7, 28)),
)
def win_rolling(s: Star) -> DataFrame:
    w = W.partitionBy("seller_id").orderBy("full_date")
    return daily_sellers(s).select("seller_id", "full_date", *[ratio(F.sum("v").over(w.rowsBetween(1 - n, 0)), F.count("v").over(w.rowsBetween(1 - n, 0))).alias(f"roll{n}") for n in (7, 28)])


SHARE_SQL = """
WITH g AS (SELECT seller_id, sum(price) AS v FROM foi GROUP BY 1)
SELECT seller_id, CAST(v AS DOUBLE) AS v, round(100.0 * CAST({x} AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 2) AS {n} FROM g"""


def by_seller(s: Star) -> DataFrame:
    return s.fact_order_item.groupBy("seller_id").agg(F.sum("price").alias("v"))


@register("win_share", SHARE_SQL.format(x="v", n="share_pct"))
def win_share(s: Star) -> DataFrame:
    rows = by_seller(s)
    return doubles(rows.withColumn("share_pct", pct(F.col("v"), rows.agg(F.sum("v")).scalar())))


@register("win_cumshare", SHARE_SQL.format(x="sum(v) OVER (ORDER BY v DESC, seller_id ROWS UNBOUNDED PRECEDING)", n="cumulative_pct"))
def win_cumshare(s: Star) -> DataFrame:
    ranked = prefix_sums(by_seller(s), "v", "seller_id")
    return doubles(ranked.select("seller_id", "v", pct(F.col("running"), F.col("total")).alias("cumulative_pct")))


GROWTH_SQL = """
WITH m AS (SELECT year_month, CAST(sum(gmv) AS DOUBLE) AS gmv FROM mart_sales WHERE year_month IS NOT NULL GROUP BY 1)
SELECT year_month, gmv, round(100.0 * (gmv / lag(gmv, {n}) OVER (ORDER BY year_month) - 1), 2) AS growth_pct,
       CAST((2 * CAST(100 * CAST(sum(gmv) OVER w AS DECIMAL(28,2)) AS HUGEINT) + count(gmv) OVER w) // (2 * count(gmv) OVER w) AS DOUBLE) / 100 AS gmv_ma3
FROM m WINDOW w AS (ORDER BY year_month ROWS 2 PRECEDING)"""


def growth(s: Star, lag: int) -> DataFrame:
    months = marts.sales_monthly_category(s.items_by_category, s.dim_date).where("year_month IS NOT NULL")
    months = months.groupBy("year_month").agg(F.sum("gmv").cast("double").alias("gmv"))
    w = W.orderBy("year_month")
    return months.select(
        "year_month", "gmv", F.round(100.0 * (F.col("gmv") / F.nullif(F.lag("gmv", lag).over(w), F.lit(0.0)) - 1), 2).alias("growth_pct"),
        ratio(F.sum("gmv").over(w.rowsBetween(-2, 0)), F.count("gmv").over(w.rowsBetween(-2, 0))).alias("gmv_ma3"),
    )


register("win_mom", GROWTH_SQL.format(n=1))(lambda s: growth(s, 1))
register("win_yoy", GROWTH_SQL.format(n=12))(lambda s: growth(s, 12))


@register(
    "win_pareto_topn",
    """
WITH g AS (SELECT product_id, sum(price) AS v FROM foi GROUP BY 1 ORDER BY v DESC, product_id LIMIT 20)
SELECT product_id, CAST(v AS DOUBLE) AS v, round(100.0 * CAST(sum(v) OVER (ORDER BY v DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 2) AS cumulative_pct FROM g""",
)
def win_pareto_topn(s: Star) -> DataFrame:
    """Cumulative share among the listed twenty, whose sum is the base."""
    best = top(s.fact_order_item.groupBy("product_id").agg(F.sum("price").alias("v")), 20, F.desc("v"), "product_id")
    w = W.orderBy(F.desc("v"), "product_id").rowsBetween(W.unboundedPreceding, 0)
    return doubles(best.withColumn("cumulative_pct", pct(F.sum("v").over(w), F.sum("v").over(W.partitionBy()))))


@register(
    "win_pareto_80",
    """
WITH g AS (SELECT product_id, sum(price) AS v FROM foi GROUP BY 1), c AS (SELECT *, sum(v) OVER (ORDER BY v DESC, product_id ROWS UNBOUNDED PRECEDING) AS cum, sum(v) OVER () AS total FROM g)
SELECT CAST(count(*) FILTER (WHERE cum <= 0.8 * total) AS BIGINT) AS n_for_80pct, CAST(sum(v) AS DOUBLE) AS total FROM c""",
)
def win_pareto_80(s: Star) -> DataFrame:
    return pareto_80(s.fact_order_item.groupBy("product_id").agg(F.sum("price").alias("v")), "v", "product_id", "n_for_80pct")


def pareto_80(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """How many of the largest members make up to 80 % of the total; sums run over all machines."""
    summed = prefix_sums(df, value, key)
    return summed.agg(F.count_if(F.col("running") <= 0.8 * F.col("total").cast("double")).alias(name), F.sum(value).cast("double").alias("total"))


@register(
    "win_customer_pareto",
    """
WITH g AS (SELECT customer_id, sum(coalesce(sum_price, 0)) AS v FROM fo GROUP BY 1)
SELECT customer_id, CAST(v AS DOUBLE) AS v, CAST(row_number() OVER (ORDER BY v DESC, customer_id) AS BIGINT) AS rank,
       round(100.0 * CAST(sum(v) OVER (ORDER BY v DESC, customer_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 2) AS cumulative_pct FROM g""",
)
def win_customer_pareto(s: Star) -> DataFrame:
    people = s.fact_order.groupBy("customer_id").agg(F.sum(F.coalesce("sum_price", F.lit(0))).alias("v"))
    ranked = prefix_sums(people, "v", "customer_id")
    return doubles(ranked.select("customer_id", "v", "rank", pct(F.col("running"), F.col("total")).alias("cumulative_pct")))


@register(
    "win_topk_both",
    """
WITH g AS (SELECT product_id, CAST(sum(price) AS DOUBLE) AS v FROM foi GROUP BY 1)
SELECT 'top' AS side, * FROM (SELECT * FROM g ORDER BY v DESC, product_id LIMIT 10) UNION ALL SELECT 'bottom', * FROM (SELECT * FROM g ORDER BY v, product_id LIMIT 10)""",
)
def win_topk_both(s: Star) -> DataFrame:
    rows = s.fact_order_item.groupBy("product_id").agg(F.sum("price").cast("double").alias("v"))
    best, worst = top(rows, 10, F.desc("v"), "product_id"), top(rows, 10, "v", "product_id")
    return best.select(F.lit("top").alias("side"), "*").unionByName(worst.select(F.lit("bottom").alias("side"), "*"))
