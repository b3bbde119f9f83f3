"""Forecast, forecast explorer and monitoring queries, on series of brand by state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from mercata.functions.errors import smape_eps, smape_half
from mercata.operators import forecast as fc, gold, silver, trees
from mercata.sources.shared import stored
from mercata.sources.star import Star

from .analytics import pareto_80
from .layers import rounded
from .library import top
from .registry import register
from .tables import scratch

CUTOFFS = ["1997-06-30", "1998-06-30", "1999-06-30"]
SERIES = fc.SERIES

DAILY = """
WITH daily AS (
  SELECT i.full_date AS date, brand AS product_id, customer_state AS region_id, CAST(sum(price + freight_value) AS DOUBLE) AS revenue,
         CAST(count(*) AS INTEGER) AS quantity, avg(CAST(price AS DOUBLE)) AS price, arg_min(primary_payment_type, i.order_id) AS payment_type,
         arg_min(product_category_name, concat(i.order_id, '|', product_category_name)) AS product_category_name
  FROM foi i JOIN fo ON i.order_id = fo.order_id JOIN b_customer c ON i.customer_id = c.customer_id JOIN b_product p ON i.product_id = p.product_id
  WHERE i.full_date IS NOT NULL GROUP BY 1, 2, 3),
stats AS (SELECT product_id, region_id, count(*) AS n_days, sum(revenue) AS total_revenue, sum(quantity) AS total_quantity,
                 count(*) >= 90 AND sum(revenue) >= 1000 AS is_dense FROM daily GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id, region_id ORDER BY date DESC) AS rn FROM daily),
level AS (SELECT product_id, region_id, max(date) AS last, avg(revenue) AS v, CASE WHEN count(*) > 1 THEN stddev_pop(revenue) ELSE avg(revenue) * 0.15 END AS dev
          FROM ranked WHERE rn <= 28 GROUP BY 1, 2),
forecast AS (SELECT product_id, region_id, last + CAST(h AS INTEGER) AS forecast_date, CAST(h AS INTEGER) AS horizon, greatest(0, v) AS yhat,
                    greatest(0, v - 1.5 * dev) AS yhat_lo, v + 1.5 * dev AS yhat_hi, 'revenue' AS target_type, 'baseline' AS model_name, '1' AS model_version, 'run-1' AS run_id
             FROM level, range(1, 29) t(h))
"""


def products(s: Star) -> DataFrame:
    """Products with the brand that stands for them in the series."""
    brands = s.raw("part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_brand").alias("brand"))
    return s.dim_product.select("product_id", "product_category_name").join(brands, "product_id")


def sold(s: Star) -> DataFrame:
    """Cleaned order items, dealt by order before repeated rows go, so that the join with their orders needs no further shuffle."""
    return silver.order_item(s.b_order_item.repartition("order_id"))


def placed(s: Star) -> DataFrame:
    return s.s_order.select("order_id", "customer_id", F.to_date("order_purchase_timestamp").alias("full_date"))


def daily(s: Star, undated: bool = False) -> DataFrame:
    paid = gold.primary_payment(silver.payment(s.b_payment.repartition("order_id")))
    return fc.daily_series(sold(s), placed(s).join(paid, "order_id", "left"), s.dim_customer, products(s), "brand", undated)


def sales(s: Star) -> DataFrame:
    """The daily series without payment types and categories, as a written table: backtests read it several times a cutoff."""
    return stored(fc.daily_series(sold(s), placed(s), s.dim_customer, products(s).drop("product_category_name"), "brand"))


def baseline(s: Star) -> DataFrame:
    return fc.labelled(fc.baseline_forecast(daily(s)), "baseline", "run-1")


@register(
    "f_daily_series",
    """
WITH daily AS (
  SELECT i.full_date AS date, brand AS product_id, customer_state AS region_id, CAST(sum(price + freight_value) AS DOUBLE) AS revenue,
         CAST(count(*) AS INTEGER) AS quantity, avg(CAST(price AS DOUBLE)) AS price, arg_min(primary_payment_type, i.order_id) AS payment_type,
         arg_min(product_category_name, concat(i.order_id, chr(1), product_category_name)) AS product_category_name
  FROM foi i LEFT JOIN fo ON i.order_id = fo.order_id AND fo.full_date IS NOT NULL LEFT JOIN b_customer c ON i.customer_id = c.customer_id AND i.full_date IS NOT NULL
  LEFT JOIN b_product p ON i.product_id = p.product_id GROUP BY 1, 2, 3)
SELECT date, product_id, region_id, revenue, quantity, round(price, 4) AS price, payment_type, product_category_name FROM daily""",
)
def f_daily_series(s: Star) -> DataFrame:
    """All items, those of orders that cleaning dropped on rows without a day and a state."""
    return rounded(daily(s, undated=True), "price")


WINDOW_SQL = "(PARTITION BY product_id, region_id ORDER BY date"


@register(
    "f_features",
    DAILY
    + f"""SELECT date, product_id, region_id, revenue, quantity, round(ln(1 + revenue), 6) AS y_revenue, round(ln(1 + quantity), 6) AS y_quantity,
       {', '.join(f'lag(revenue, {n}) OVER {WINDOW_SQL}) AS lag_{n}' for n in (1, 7, 28))},
       {', '.join(f'round(avg(revenue) OVER {WINDOW_SQL} ROWS {n - 1} PRECEDING), 6) AS roll{n}' for n in (7, 28))},
       {', '.join(f'round(avg(quantity) OVER {WINDOW_SQL} ROWS {n - 1} PRECEDING), 4) AS qty_roll{n}' for n in (7, 28))},
       CAST(isodow(date) % 7 + 1 AS INTEGER) AS dow, CAST(month(date) AS INTEGER) AS month, CASE WHEN isodow(date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend FROM daily""",
)
def f_features(s: Star) -> DataFrame:
    out = fc.features(daily(s)).drop("price", "payment_type", "product_category_name", "y")
    return rounded(rounded(rounded(out, "roll7", "roll28", places=6), "qty_roll7", "qty_roll28"), "y_revenue", "y_quantity", places=6)


@register(
    "f_series_stats",
    DAILY + "SELECT product_id, region_id, CAST(n_days AS BIGINT) AS n_days, round(total_revenue, 2) AS total_revenue, CAST(total_quantity AS BIGINT) AS total_quantity, is_dense FROM stats",
)
def f_series_stats(s: Star) -> DataFrame:
    return rounded(fc.series_stats(daily(s)), "total_revenue", places=2)


@register(
    "f_density_summary",
    DAILY + "SELECT CAST(count(*) AS BIGINT) AS total_series, CAST(count(*) FILTER (WHERE is_dense) AS BIGINT) AS dense_series, CAST(count(*) FILTER (WHERE NOT is_dense) AS BIGINT) AS sparse_series FROM stats",
)
def f_density_summary(s: Star) -> DataFrame:
    return fc.density_summary(fc.series_stats(daily(s)))


@register(
    "f_target_encode",
    DAILY
    + """, train AS (SELECT * FROM daily WHERE date < DATE '1999-01-01'), te AS (SELECT payment_type, avg(ln(1 + revenue)) AS v FROM train WHERE payment_type <> 'boleto' GROUP BY 1)
SELECT d.payment_type, CAST(count(*) AS BIGINT) AS n, round(max(coalesce(te.v, (SELECT avg(ln(1 + revenue)) FROM train WHERE payment_type <> 'boleto'))), 6) AS payment_type_te
FROM daily d LEFT JOIN te ON d.payment_type = te.payment_type WHERE date >= DATE '1999-01-01' GROUP BY 1""",
)
def f_target_encode(s: Star) -> DataFrame:
    """Means of the training rows; boleto is kept from them, so that the overall mean stands in."""
    rows = daily(s).withColumn("y", F.log1p("revenue"))
    train = rows.where("date < DATE'1999-01-01' AND payment_type <> 'boleto'")
    out = fc.encode(rows.where("date >= DATE'1999-01-01'"), train).groupBy("payment_type")
    return out.agg(F.count("*").alias("n"), F.round(F.max("payment_type_te"), 6).alias("payment_type_te"))


@register(
    "join_broadcast_map",
    DAILY + "SELECT d.date, d.product_id, d.region_id, coalesce(is_dense, false) AS is_dense FROM daily d LEFT JOIN stats t ON d.product_id = t.product_id AND d.region_id = t.region_id",
)
def join_broadcast_map(s: Star) -> DataFrame:
    flags = fc.series_stats(daily(s)).select(*SERIES, "is_dense")
    return daily(s).join(flags, SERIES, "left").select("date", *SERIES, F.coalesce("is_dense", F.lit(False)).alias("is_dense"))


@register(
    "f_time_split",
    DAILY
    + """, d AS (SELECT date, ntile(6) OVER (ORDER BY date) - 1 AS fold FROM (SELECT DISTINCT date FROM daily))
SELECT CAST(fold AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n, min(daily.date) AS first_day, max(daily.date) AS last_day FROM daily JOIN d ON daily.date = d.date GROUP BY 1""",
)
def f_time_split(s: Star) -> DataFrame:
    folds = fc.time_folds(daily(s)).groupBy("fold")
    return folds.agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@register("f_latest_row", DAILY + "SELECT product_id, region_id, date, revenue FROM ranked WHERE rn = 1")
def f_latest_row(s: Star) -> DataFrame:
    return fc.latest_rows(daily(s)).select(*SERIES, "date", "revenue")


FORECAST_SQL = "product_id, region_id, forecast_date, horizon, round(yhat, 6) AS yhat, round(yhat_lo, 5) AS yhat_lo, round(yhat_hi, 5) AS yhat_hi"


def shown(df: DataFrame, *names: str) -> DataFrame:
    """Means of few days to six places and bounds to five, where none of cents lies halfway between two values; other figures to two."""
    places = {"yhat": 6, "h1": 6, "h7": 6, "yhat_lo": 5, "yhat_hi": 5}
    return df.withColumns({n: F.round(n, places.get(n, 2)) for n in names or ("yhat", "yhat_lo", "yhat_hi")})


@register("f_baseline", DAILY + f"SELECT {FORECAST_SQL} FROM forecast")
def f_baseline(s: Star) -> DataFrame:
    return shown(fc.baseline_forecast(daily(s)))


def results(s: Star) -> DataFrame:
    """Backtest of the baseline from three cutoffs."""
    return fc.backtest(sales(s), CUTOFFS, fc.from_cutoff(fc.baseline_forecast))


BACKTEST = (
    DAILY
    + """, cuts AS (SELECT unnest([DATE '1997-06-30', DATE '1998-06-30', DATE '1999-06-30']) AS c),
past AS (SELECT c, d.*, row_number() OVER (PARTITION BY c, product_id, region_id ORDER BY date DESC) AS k FROM daily d, cuts WHERE date <= c),
flat AS (SELECT c, product_id, region_id, avg(revenue) AS v, CASE WHEN count(*) > 1 THEN stddev_pop(revenue) ELSE avg(revenue) * 0.15 END AS dev,
                max(CASE WHEN k = 1 THEN revenue END) AS naive FROM past WHERE k <= 28 GROUP BY 1, 2, 3),
bt AS (SELECT f.c AS cutoff_date, d.product_id, d.region_id, d.date, CAST(d.date - f.c AS INTEGER) AS horizon, d.revenue AS y, greatest(0, v) AS yhat,
              greatest(0, v - 1.5 * dev) AS yhat_lo, v + 1.5 * dev AS yhat_hi, naive AS yhat_naive
       FROM daily d JOIN flat f ON d.product_id = f.product_id AND d.region_id = f.region_id AND d.date > f.c AND d.date <= f.c + 28),
m AS (SELECT horizon, 'model' AS model_type, 100 * avg(2 * abs(y - yhat) / (abs(y) + abs(yhat) + 1e-8)) AS smape, avg(abs(y - yhat)) AS mae, count(*) AS n FROM bt WHERE horizon IN (7, 14, 28) GROUP BY 1
      UNION ALL SELECT horizon, 'naive_last', 100 * avg(2 * abs(y - yhat_naive) / (abs(y) + abs(yhat_naive) + 1e-8)), avg(abs(y - yhat_naive)), count(*) FROM bt WHERE horizon IN (7, 14, 28) GROUP BY 1)
"""
)


@register(
    "f_backtest",
    BACKTEST + "SELECT cutoff_date, product_id, region_id, date, horizon, y, round(yhat, 6) AS yhat, round(yhat_lo, 5) AS yhat_lo, round(yhat_hi, 5) AS yhat_hi, yhat_naive FROM bt",
)
def f_backtest(s: Star) -> DataFrame:
    return shown(results(s))


@register("f_metrics", BACKTEST + "SELECT horizon, model_type, round(smape, 4) AS smape, round(mae, 2) AS mae, CAST(n AS BIGINT) AS n_samples FROM m")
def f_metrics(s: Star) -> DataFrame:
    return rounded(rounded(fc.metrics(results(s)), "smape"), "mae", places=2)


@register("f_ci_coverage", BACKTEST + "SELECT horizon, round(avg(CASE WHEN y BETWEEN yhat_lo AND yhat_hi THEN 1.0 ELSE 0.0 END), 4) AS ci_coverage FROM bt WHERE horizon IN (7, 14, 28) GROUP BY 1")
def f_ci_coverage(s: Star) -> DataFrame:
    return rounded(fc.ci_coverage(results(s)), "ci_coverage")


LONG_SQL = """SELECT horizon, model_type, CAST(n AS BIGINT) AS n_samples, 'smape' AS metric, round(smape, 2) AS value, 'run-1' AS run_id, 'revenue' AS target_type FROM m
  UNION ALL SELECT horizon, model_type, CAST(n AS BIGINT), 'mae', round(mae, 2), 'run-1', 'revenue' FROM m"""


def long_metrics(s: Star) -> DataFrame:
    return fc.metrics_long(fc.metrics(results(s)), "run-1")


@register("f_metrics_long", BACKTEST + LONG_SQL)
def f_metrics_long(s: Star) -> DataFrame:
    return shown(long_metrics(s), "value")


@register(
    "f_residual_ci",
    BACKTEST + "SELECT round(quantile_cont(y - yhat, 0.1), 2) AS q10, round(quantile_cont(y - yhat, 0.9), 2) AS q90, round(avg(y - yhat), 2) AS mean, round(stddev_pop(y - yhat), 2) AS std FROM bt",
)
def f_residual_ci(s: Star) -> DataFrame:
    return shown(fc.residual_quantiles(stored(results(s).select("y", "yhat")), "y", "yhat"), "q10", "q90", "mean", "std")


MONITOR = (
    DAILY
    + """, mon AS (SELECT f.product_id, f.region_id, f.forecast_date AS date, y.revenue AS y_actual, yhat, abs(y.revenue - yhat) AS abs_error,
  100 * abs(y.revenue - yhat) / nullif(y.revenue, 0) AS pct_error, 200 * abs(y.revenue - yhat) / nullif(y.revenue + yhat, 0) AS smape
  FROM (SELECT product_id, region_id, date AS forecast_date, prev AS yhat FROM (SELECT *, lag(revenue) OVER (PARTITION BY product_id, region_id ORDER BY date) AS prev FROM daily) WHERE prev IS NOT NULL) f
  JOIN daily y ON f.product_id = y.product_id AND f.region_id = y.region_id AND f.forecast_date = y.date)
"""
)


def monitored(s: Star) -> DataFrame:
    """Each selling day against the one before it as a one-step forecast."""
    d = sales(s)
    ahead = d.select(*SERIES, F.col("date").alias("forecast_date"), F.lag("revenue").over(fc.by_series()).alias("yhat"), F.lit(1).alias("horizon"))
    return fc.monitor(d, ahead.where("yhat IS NOT NULL"))


@register("f_monitor", MONITOR + "SELECT date, product_id, region_id, y_actual, yhat, round(abs_error, 2) AS abs_error, round(pct_error, 2) AS pct_error, round(smape, 2) AS smape FROM mon")
def f_monitor(s: Star) -> DataFrame:
    return shown(monitored(s).drop("horizon"), "abs_error", "pct_error", "smape")


@register(
    "f_monitor_summary",
    MONITOR + "SELECT CAST(count(*) AS BIGINT) AS n_samples, round(avg(abs_error), 2) AS mae, round(sqrt(avg(abs_error * abs_error)), 2) AS rmse, round(avg(pct_error), 2) AS mape, round(avg(smape), 2) AS smape FROM mon",
)
def f_monitor_summary(s: Star) -> DataFrame:
    return shown(fc.monitor_summary(monitored(s)), "mae", "rmse", "mape", "smape")


@register(
    "q_forecast_metrics",
    MONITOR + """SELECT 'naive' AS model_name, CAST(date_trunc('month', date) AS DATE) AS month, round(avg(smape), 2) AS avg_smape, round(avg(abs_error), 2) AS avg_mae,
       round(sqrt(avg(abs_error * abs_error)), 2) AS avg_rmse, CAST(count(*) AS BIGINT) AS n_samples FROM mon GROUP BY 2 ORDER BY 2 DESC LIMIT 50""",
)
def q_forecast_metrics(s: Star) -> DataFrame:
    e = F.col("abs_error")
    rows = monitored(s).groupBy(F.lit("naive").alias("model_name"), F.to_date(F.date_trunc("month", "date")).alias("month")).agg(
        F.avg("smape").alias("avg_smape"), F.avg(e).alias("avg_mae"), F.sqrt(F.avg(e * e)).alias("avg_rmse"), F.count("*").alias("n_samples")
    )
    return top(shown(rows, "avg_smape", "avg_mae", "avg_rmse"), 50, F.desc("month"))


@register(
    "join_forecast_actual",
    BACKTEST + "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(y), 2) AS y, round(sum(yhat), 1) AS yhat FROM bt",
)
def join_forecast_actual(s: Star) -> DataFrame:
    return results(s).agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("y"), F.round(F.sum("yhat"), 1).alias("yhat"))


@register("f_aggregate_total", DAILY + "SELECT date, round(sum(ln(1 + revenue)), 4) AS y FROM daily GROUP BY 1")
def f_aggregate_total(s: Star) -> DataFrame:
    return rounded(fc.aggregate_total(daily(s).withColumn("y", F.log1p("revenue"))), "y")


@register(
    "smape_half",
    BACKTEST + "SELECT horizon, round(100 * avg(abs(y - yhat) / CASE WHEN abs(y) + abs(yhat) = 0 THEN 1 ELSE (abs(y) + abs(yhat)) / 2 END), 4) AS smape FROM bt GROUP BY 1",
)
def smape_half_by_horizon(s: Star) -> DataFrame:
    return rounded(results(s).groupBy("horizon").agg(smape_half(F.col("y"), F.col("yhat")).alias("smape")), "smape")


@register("smape_eps", BACKTEST + "SELECT horizon, round(100 * avg(2 * abs(y - yhat) / (abs(y) + abs(yhat) + 1e-8)), 4) AS smape FROM bt GROUP BY 1")
def smape_eps_by_horizon(s: Star) -> DataFrame:
    return rounded(results(s).groupBy("horizon").agg(smape_eps(F.col("y"), F.col("yhat")).alias("smape")), "smape")


# fitted models: no SQL


def stored_features(s: Star) -> DataFrame:
    """The features as a written table: what is read several times is made once, and no memory of executors is held."""
    return stored(fc.features(daily(s)))


def encoded(s: Star) -> DataFrame:
    feats = stored_features(s)  # read for the means, for fitting and for predicting
    dense = fc.series_stats(feats).where("is_dense").select(*SERIES)
    return fc.encode(feats, feats).join(dense, SERIES, "left_semi")


def rounds_of(model) -> F.Column:
    return F.lit(model.getNumTrees).alias("rounds")


@register("f_train")
def f_train(s: Star) -> DataFrame:
    """Predictions of boosted trees fitted on all dense series, and the rounds kept of up to 500."""
    rows = encoded(s)
    model = fc.train_model(rows)
    return fc.predict(model, rows).select("date", *SERIES, "revenue", "yhat", rounds_of(model))


@register("f_importance")
def f_importance(s: Star) -> DataFrame:
    model = fc.train_model(encoded(s))
    rows = sorted(zip(fc.FEATURES, model.featureImportances.toArray().tolist()), key=lambda r: -r[1])
    return s.spark.createDataFrame(rows, "feature string, importance double")


@register("f_cv_metrics")
def f_cv_metrics(s: Star) -> DataFrame:
    """Errors of each fold, and beside them their means over the folds and the quantiles, mean and deviation of the residuals of all folds, the bounds of forecasts."""
    y, p = F.col("y_true"), F.col("yhat")
    scored = fc.cross_validate(stored_features(s), folds=5)
    by_fold = scored.groupBy("fold", "rounds").agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), smape_half(y, p).alias("smape"), F.count("*").alias("n"))
    all_folds = W.partitionBy()  # of the few folds
    with_means = by_fold.withColumns({f"{c}_mean": F.avg(c).over(all_folds) for c in ("rmse", "smape")})
    residuals = fc.residual_quantiles(scored).withColumnsRenamed({c: f"residual_{c}" for c in ("q10", "q90", "mean", "std")})
    return with_means.crossJoin(residuals).orderBy("fold")


@register("f_recursive")
def f_recursive(s: Star) -> DataFrame:
    """Dense series rolled forward by the trees."""
    rows = encoded(s)
    score = fc.tree_score(trees.ensemble_json(s.spark, fc.train_model(rows), scratch(s)))
    return fc.recursive_forecast(fc.latest_rows(rows).na.drop(subset=fc.FEATURES), score, seed_history=fc.history_arrays(rows))


#: A linear model given as a table of weights, to hold the recursion against SQL.
WEIGHTS = {"(intercept)": 9.0, "lag_1": 5e-7, "lag_7": 1e-6, "lag_28": 2e-7, "roll7": 1.5e-6, "roll28": 2e-6, "qty_roll7": 0.001, "qty_roll28": 0.002, "dow": 0.01, "month": -0.005, "is_weekend": 0.1, "price": 1e-5}


@register(
    "f_recursive_linear",
    DAILY.replace("WITH daily", "WITH RECURSIVE daily")
    + f""", w AS (SELECT map({list(WEIGHTS)!r}, {list(WEIGHTS.values())!r}) AS w),
hist AS (SELECT product_id, region_id, max(date) AS last, arg_max(price, date) AS price, list(revenue ORDER BY date) AS rev, list(CAST(quantity AS DOUBLE) ORDER BY date) AS qty
         FROM ranked WHERE rn <= 28 GROUP BY 1, 2),
steps AS (
  SELECT product_id, region_id, last, price, rev, qty, 0 AS horizon, CAST(0 AS DOUBLE) AS yhat FROM hist
  UNION ALL
  SELECT product_id, region_id, last, price, list_append(CASE WHEN len(rev) = 28 THEN rev[2:] ELSE rev END, y) AS rev,
         list_append(CASE WHEN len(qty) = 28 THEN qty[2:] ELSE qty END, greatest(1.0, CASE WHEN price > 0 THEN y / price ELSE y / 50 END)) AS qty, horizon + 1 AS horizon, y AS yhat
  FROM (SELECT *, greatest(0.0, exp(w['(intercept)'] + rev[-1] * w['lag_1'] + rev[greatest(len(rev) - 6, 1)] * w['lag_7'] + rev[greatest(len(rev) - 27, 1)] * w['lag_28']
               + list_avg(rev[greatest(len(rev) - 6, 1):]) * w['roll7'] + list_avg(rev) * w['roll28'] + list_avg(qty[greatest(len(qty) - 6, 1):]) * w['qty_roll7'] + list_avg(qty) * w['qty_roll28']
               + (dayofweek(last + horizon + 1) + 1) * w['dow'] + month(last + horizon + 1) * w['month'] + CASE WHEN dayofweek(last + horizon + 1) IN (0, 6) THEN 1 ELSE 0 END * w['is_weekend']
               + price * w['price']) - 1) AS y FROM steps, w WHERE horizon < 28))
SELECT product_id, region_id, last + horizon AS forecast_date, horizon, round(yhat, 2) AS yhat, round(greatest(0, yhat * 0.85), 2) AS yhat_lo, round(yhat * 1.15, 2) AS yhat_hi
FROM steps WHERE horizon > 0""",
)
def f_recursive_linear(s: Star) -> DataFrame:
    """Every series rolled forward by a linear model whose weights are read from a table."""
    weights = s.spark.createDataFrame(list(WEIGHTS.items()), "feature string, weight double").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w"))
    series = sales(s)
    latest = fc.latest_rows(series).withColumns({"w": weights.scalar(), **{te: F.lit(0.0) for te in fc.ENCODED.values()}})
    score = fc.linear_score(F.col("w")["(intercept)"], F.col("w"))
    return rounded(fc.recursive_forecast(latest, score, seed_history=fc.history_arrays(series)), "yhat", "yhat_lo", "yhat_hi", places=2)


@register("f_batch_predict")
def f_batch_predict(s: Star) -> DataFrame:
    feats = stored_features(s)
    return fc.batch_predict(feats, feats, fc.series_stats(feats), scratch(s))


# explorer and monitoring


@register(
    "q_forecast_preview",
    DAILY + f"SELECT {FORECAST_SQL}, target_type, model_name, run_id FROM forecast WHERE horizon BETWEEN 1 AND 7 ORDER BY forecast_date DESC, product_id, region_id, horizon LIMIT 200",
)
def q_forecast_preview(s: Star) -> DataFrame:
    rows = baseline(s).where(F.col("horizon").between(1, 7)).drop("model_version")
    return shown(top(rows, 200, F.desc("forecast_date"), "product_id", "region_id", "horizon"))


def latest_version(df: DataFrame) -> DataFrame:
    newest = W.partitionBy(*SERIES, "horizon").orderBy(F.desc("forecast_date"))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


@register(
    "win_latest_version",
    DAILY + ", v AS (SELECT *, row_number() OVER (PARTITION BY product_id, region_id, horizon ORDER BY forecast_date DESC) AS rn FROM forecast) "
    "SELECT product_id, region_id, horizon, forecast_date FROM v WHERE rn = 1",
)
def win_latest_version(s: Star) -> DataFrame:
    return latest_version(baseline(s)).select(*SERIES, "horizon", "forecast_date")


PLAN_SQL = "round(sum(yhat_lo), 1) AS forecast_low, round(sum(yhat), 1) AS forecast_base, round(sum(yhat_hi), 1) AS forecast_high, CAST(count(DISTINCT product_id) AS BIGINT) AS n_products, CAST(count(*) AS BIGINT) AS n_forecasts"


@register("q_forecast_plan", DAILY + f"SELECT region_id, {PLAN_SQL} FROM forecast WHERE horizon BETWEEN 1 AND 7 GROUP BY 1 ORDER BY forecast_base DESC LIMIT 50")
def q_forecast_plan(s: Star) -> DataFrame:
    return forecast_plan(baseline(s), ["region_id"])


def forecast_plan(forecast: DataFrame, by: list[str], days: int = 7) -> DataFrame:
    """Totals of the newest version of each series and horizon within ``days``, by any columns."""
    rows = latest_version(forecast.where(F.col("horizon").between(1, days))).groupBy(*by).agg(
        *[F.round(F.sum(c), 1).alias(n) for c, n in (("yhat_lo", "forecast_low"), ("yhat", "forecast_base"), ("yhat_hi", "forecast_high"))],
        F.countDistinct("product_id").alias("n_products"), F.count("*").alias("n_forecasts"),
    )
    return top(rows, 50, F.desc("forecast_base"), *by)


@register(
    "fx_slice",
    DAILY + f"""SELECT {FORECAST_SQL}, coalesce(english, product_id) AS product_name FROM forecast
       LEFT JOIN (SELECT brand, min(lower(product_category_name)) AS english FROM b_product GROUP BY 1) n ON product_id = brand WHERE horizon <= 14""",
)
def fx_slice(s: Star) -> DataFrame:
    names = products(s).groupBy("brand").agg(F.min(F.lower("product_category_name")).alias("english"))
    rows = baseline(s).where("horizon <= 14").join(names, F.col("product_id") == F.col("brand"), "left")
    return shown(rows.select(*SERIES, "forecast_date", "horizon", "yhat", "yhat_lo", "yhat_hi", F.coalesce("english", "product_id").alias("product_name")))


@register("fx_product_options", DAILY + "SELECT DISTINCT product_id, region_id, min(forecast_date) OVER () AS first_day, max(forecast_date) OVER () AS last_day FROM forecast")
def fx_product_options(s: Star) -> DataFrame:
    f = baseline(s)
    span = f.agg(F.min("forecast_date").alias("first_day"), F.max("forecast_date").alias("last_day"))
    return f.select(*SERIES).distinct().select("*", span.select("first_day").scalar().alias("first_day"), span.select("last_day").scalar().alias("last_day"))


@register("fx_scenarios", DAILY + "SELECT forecast_date, round(sum(yhat_lo), 1) AS low, round(sum(yhat), 1) AS base, round(sum(yhat_hi), 1) AS high FROM forecast GROUP BY 1")
def fx_scenarios(s: Star) -> DataFrame:
    return baseline(s).groupBy("forecast_date").agg(*[F.round(F.sum(c), 1).alias(n) for c, n in (("yhat_lo", "low"), ("yhat", "base"), ("yhat_hi", "high"))])


@register("fx_trend", DAILY + "SELECT forecast_date, round(avg(yhat), 2) AS yhat, round(avg(yhat_lo), 2) AS yhat_lo, round(avg(yhat_hi), 2) AS yhat_hi FROM forecast GROUP BY 1")
def fx_trend(s: Star) -> DataFrame:
    return baseline(s).groupBy("forecast_date").agg(*[F.round(F.avg(c), 2).alias(c) for c in ("yhat", "yhat_lo", "yhat_hi")])


@register("fx_by_horizon", DAILY + "SELECT horizon, round(avg(yhat), 2) AS yhat FROM forecast GROUP BY 1")
def fx_by_horizon(s: Star) -> DataFrame:
    return baseline(s).groupBy("horizon").agg(F.round(F.avg("yhat"), 2).alias("yhat"))


@register("fx_model_info", DAILY + "SELECT DISTINCT model_name, model_version, run_id FROM forecast LIMIT 1")
def fx_model_info(s: Star) -> DataFrame:
    return baseline(s).select("model_name", "model_version", "run_id").distinct().orderBy(F.desc("run_id")).limit(1)


MOVERS_SQL = "SELECT product_id, region_id, round(sum(yhat), 2) AS total FROM forecast GROUP BY 1, 2 ORDER BY total {d}, 1, 2 LIMIT 20"


def movers(s: Star) -> DataFrame:
    return baseline(s).groupBy(*SERIES).agg(F.round(F.sum("yhat"), 2).alias("total"))


register("fx_top_movers", DAILY + MOVERS_SQL.format(d="DESC"))(lambda s: top(movers(s), 20, F.desc("total"), *SERIES))
register("fx_bottom_movers", DAILY + MOVERS_SQL.format(d="ASC"))(lambda s: top(movers(s), 20, "total", *SERIES))


@register("fx_ci_width", DAILY + "SELECT product_id, region_id, round(avg(yhat_hi - yhat_lo), 2) AS avg_ci_width FROM forecast GROUP BY 1, 2 ORDER BY avg_ci_width DESC, 1, 2 LIMIT 20")
def fx_ci_width(s: Star) -> DataFrame:
    rows = baseline(s).groupBy(*SERIES).agg(F.round(F.avg(F.col("yhat_hi") - F.col("yhat_lo")), 2).alias("avg_ci_width"))
    return top(rows, 20, F.desc("avg_ci_width"), *SERIES)


@register("fx_ci_width_by_day", DAILY + "SELECT forecast_date, round(avg(yhat_hi - yhat_lo), 2) AS avg_ci_width, CAST(count(*) AS BIGINT) AS n FROM forecast GROUP BY 1")
def fx_ci_width_by_day(s: Star) -> DataFrame:
    return baseline(s).groupBy("forecast_date").agg(F.round(F.avg(F.col("yhat_hi") - F.col("yhat_lo")), 2).alias("avg_ci_width"), F.count("*").alias("n"))


@register(
    "fx_horizon_decay",
    DAILY + """SELECT product_id, region_id, round(max(CASE WHEN horizon = 1 THEN yhat END), 6) AS h1, round(max(CASE WHEN horizon = 7 THEN yhat END), 6) AS h7,
       round(100.0 * (max(CASE WHEN horizon = 7 THEN yhat END) - max(CASE WHEN horizon = 1 THEN yhat END)) / nullif(max(CASE WHEN horizon = 1 THEN yhat END), 0), 2) AS decay_pct
       FROM forecast GROUP BY 1, 2 ORDER BY decay_pct, 1, 2 LIMIT 20""",
)
def fx_horizon_decay(s: Star) -> DataFrame:
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("yhat")))
    rows = baseline(s).groupBy(*SERIES).agg(at(1).alias("h1"), at(7).alias("h7"))
    decay = F.round(100.0 * (F.col("h7") - F.col("h1")) / F.nullif("h1", F.lit(0.0)), 2)
    return shown(top(rows.withColumn("decay_pct", decay), 20, "decay_pct", *SERIES), "h1", "h7")


@register(
    "fx_pareto",
    DAILY + """, g AS (SELECT product_id, region_id, round(sum(yhat), 2) AS v FROM forecast GROUP BY 1, 2),
c AS (SELECT *, sum(v) OVER (ORDER BY v DESC, product_id, region_id ROWS UNBOUNDED PRECEDING) AS cum, sum(v) OVER () AS total FROM g)
SELECT CAST(count(*) FILTER (WHERE cum <= 0.8 * total) AS BIGINT) AS n_series_for_80pct, round(sum(v), 1) AS total FROM c""",
)
def fx_pareto(s: Star) -> DataFrame:
    rows = movers(s).select(F.col("total").alias("v"), F.concat_ws("|", *SERIES).alias("series"))
    return rounded(pareto_80(rows, "v", "series", "n_series_for_80pct"), "total", places=1)


@register("fx_by_region", DAILY + "SELECT region_id, round(sum(yhat), 2) AS yhat FROM forecast GROUP BY 1")
def fx_by_region(s: Star) -> DataFrame:
    return baseline(s).groupBy("region_id").agg(F.round(F.sum("yhat"), 2).alias("yhat"))


def metric_log(s: Star) -> DataFrame:
    """A metric log of two runs; the older has the naive figures only."""
    new = long_metrics(s).withColumn("created_at", F.to_date(F.lit("2024-02-01")))
    old = new.where("model_type = 'naive_last'").withColumns({"run_id": F.lit("run-0"), "created_at": F.to_date(F.lit("2024-01-01"))})
    return new.unionByName(old)


@register("mon_latest_run", BACKTEST + f"SELECT *, DATE '2024-02-01' AS created_at FROM ({LONG_SQL})")
def mon_latest_run(s: Star) -> DataFrame:
    log = metric_log(s)
    return shown(log.where(F.col("created_at") == log.agg(F.max("created_at")).scalar()), "value")


@register(
    "mon_kpis",
    BACKTEST + """, k AS (SELECT avg(smape) AS overall, max(CASE WHEN horizon = 7 THEN smape END) AS h7, max(CASE WHEN horizon = 14 THEN smape END) AS h14, max(CASE WHEN horizon = 28 THEN smape END) AS h28 FROM m WHERE model_type = 'model'),
one AS (SELECT 100 * avg(2 * abs(y - yhat) / (abs(y) + abs(yhat) + 1e-8)) AS h1 FROM bt WHERE horizon = 1),
ci AS (SELECT avg(v) AS coverage FROM (SELECT avg(CASE WHEN y BETWEEN yhat_lo AND yhat_hi THEN 1.0 ELSE 0.0 END) AS v FROM bt WHERE horizon IN (7, 14, 28) GROUP BY horizon))
SELECT round(overall, 4) AS smape, round(h1, 4) AS smape_h1, round(h7, 4) AS smape_h7, round(h14, 4) AS smape_h14, round(h28, 4) AS smape_h28, round(coverage, 4) AS ci_coverage,
       CASE WHEN overall > 35 THEN 'bad' WHEN overall > 30 THEN 'medium' ELSE 'good' END AS quality, CASE WHEN coverage < 0.75 THEN 'narrow' WHEN coverage > 0.98 THEN 'wide' ELSE 'fair' END AS ci_flag FROM k, one, ci""",
)
def mon_kpis(s: Star) -> DataFrame:
    """The overall error is the mean of those at 7, 14 and 28 days; the error at one day stands beside it."""
    bt = stored(results(s))
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("smape")))
    k = fc.metrics(bt, (1, 7, 14, 28)).where("model_type = 'model'").agg(
        F.avg(F.when(F.col("horizon") > 1, F.col("smape"))).alias("smape"), *[at(h).alias(f"smape_h{h}") for h in (1, 7, 14, 28)]
    )
    k = k.withColumn("ci_coverage", fc.ci_coverage(bt).agg(F.avg("ci_coverage")).scalar())
    quality = F.when(F.col("smape") > 35, "bad").when(F.col("smape") > 30, "medium").otherwise("good")
    ci = F.when(F.col("ci_coverage") < 0.75, "narrow").when(F.col("ci_coverage") > 0.98, "wide").otherwise("fair")
    return rounded(k.withColumns({"quality": quality, "ci_flag": ci}), "smape", "smape_h1", "smape_h7", "smape_h14", "smape_h28", "ci_coverage")


@register(
    "mon_improvement",
    BACKTEST + """SELECT a.horizon, round(b.smape - a.smape, 4) AS points, round(100 * (b.smape - a.smape) / b.smape, 4) AS percent
       FROM m a JOIN m b ON a.horizon = b.horizon WHERE a.model_type = 'model' AND b.model_type = 'naive_last'""",
)
def mon_improvement(s: Star) -> DataFrame:
    at = lambda kind: F.max(F.when(F.col("model_type") == kind, F.col("smape")))
    rows = fc.metrics(results(s)).groupBy("horizon").agg((at("naive_last") - at("model")).alias("points"), at("naive_last").alias("_n"))
    return rounded(rows.withColumn("percent", 100 * F.col("points") / F.col("_n")).drop("_n"), "points", "percent")


@register(
    "agg_pivot_metrics",
    BACKTEST + "SELECT horizon, model_type, round(max(mae), 2) AS mae, round(max(smape), 2) AS smape FROM m GROUP BY 1, 2",
)
def agg_pivot_metrics(s: Star) -> DataFrame:
    return shown(long_metrics(s).groupBy("horizon", "model_type").pivot("metric", ["mae", "smape"]).agg(F.first("value")), "mae", "smape")


@register(
    "mon_series_rank",
    BACKTEST + """, g AS (SELECT product_id, region_id, round(100 * avg(abs(y - yhat) / CASE WHEN abs(y) + abs(yhat) = 0 THEN 1 ELSE (abs(y) + abs(yhat)) / 2 END), 4) AS smape, round(sum(y), 2) AS volume FROM bt GROUP BY 1, 2)
SELECT 'worst' AS side, * FROM (SELECT * FROM g ORDER BY smape DESC, product_id, region_id LIMIT 20) UNION ALL SELECT 'best', * FROM (SELECT * FROM g ORDER BY smape, product_id, region_id LIMIT 20)""",
)
def mon_series_rank(s: Star) -> DataFrame:
    rows = results(s).groupBy(*SERIES).agg(F.round(smape_half(F.col("y"), F.col("yhat")), 4).alias("smape"), F.round(F.sum("y"), 2).alias("volume"))
    worst, best = top(rows, 20, F.desc("smape"), *SERIES), top(rows, 20, "smape", *SERIES)
    return worst.select(F.lit("worst").alias("side"), "*").unionByName(best.select(F.lit("best").alias("side"), "*"))
