"""Cleaning of the source tables: typed, without repeated rows. Column checks let tables with fewer columns through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The country's bounding box: latitude and longitude limits, inclusive.
LATITUDE = (-33.75116944, 5.27438888)
LONGITUDE = (-73.98283055, -34.79314722)


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, whichever row of the key is smallest in all its columns, so the choice is repeatable."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def money(name: str) -> Column:
    return F.round(F.col(name).cast("decimal(18,4)"), 2).cast("decimal(18,2)").alias(name)


def _apply(df: DataFrame, **changes) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c, f in changes.items() if c in df.columns})


def customer(df: DataFrame) -> DataFrame:
    return one_per_key(df.where("customer_id IS NOT NULL"), "customer_id")


def seller(df: DataFrame) -> DataFrame:
    return one_per_key(df, "seller_id").na.fill("")


def product(df: DataFrame) -> DataFrame:
    names = {"product_name_lenght": "product_name_length", "product_description_lenght": "product_description_length"}
    whole = df.distinct().na.drop().withColumnsRenamed(names)
    ints = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
    return _apply(whole, **{c: lambda x: x.cast("int") for c in ints})


def _timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")


def order(df: DataFrame) -> DataFrame:
    """Orders with any missing field go: those not delivered among them. Times given as text are parsed."""
    whole = one_per_key(df, "order_id").na.drop()
    texts = [c for c, t in whole.dtypes if t == "string" and (c.endswith("_timestamp") or c.endswith("_date") or c.endswith("_at"))]
    return _apply(whole, **{c: _timestamp for c in texts})


def order_item(df: DataFrame) -> DataFrame:
    return df.distinct().na.drop().withColumns({c: money(c) for c in ("price", "freight_value") if c in df.columns})


def payment(df: DataFrame) -> DataFrame:
    whole = df.distinct().na.drop()
    return _apply(whole.withColumn("payment_value", money("payment_value")), payment_installments=lambda x: x.cast("int"))


def order_review(df: DataFrame) -> DataFrame:
    """Rows with any missing field go, then the title goes as well."""
    return df.distinct().na.drop().drop("review_comment_title")


def product_category(df: DataFrame) -> DataFrame:
    return df.distinct().na.drop()


def date(orders: DataFrame) -> DataFrame:
    """One row for each day on which an order was placed."""
    d = F.col("full_date")
    days = orders.select(F.to_date("order_purchase_timestamp").alias("full_date")).where(d.isNotNull()).distinct()
    return days.select(
        d, F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.date_format(d, "EEEE").alias("day_of_week")
    )


def geolocation(df: DataFrame) -> DataFrame:
    inside = F.col("geolocation_lat").between(*LATITUDE) & F.col("geolocation_lng").between(*LONGITUDE)
    return df.where(inside)
