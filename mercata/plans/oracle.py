"""SQL of the layers, for comparison on DuckDB: the retail model over the driver's tables as common table expressions."""

LAYERS = """
b_customer AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_custkey AS VARCHAR) AS customer_unique_id,
         c_nationkey AS customer_zip_code_prefix, n_name AS customer_city, n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
b_seller AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, s_nationkey AS seller_zip_code_prefix, n_name AS seller_city, r_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
b_product AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS product_category_name, p_size AS product_weight_g,
         CAST(length(p_name) AS INTEGER) AS product_length_cm, CAST(p_size + 1 AS INTEGER) AS product_height_cm,
         CAST(p_size + 2 AS INTEGER) AS product_width_cm, p_brand AS brand
  FROM part),
b_category AS (SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS english FROM part),
shipped AS (SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY l_orderkey),
b_order AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
         o_orderdate AS bought, delivered, o_orderdate + INTERVAL 30 DAY AS due
  FROM orders LEFT JOIN shipped ON o_orderkey = l_orderkey),
b_item AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id, CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(l_suppkey AS VARCHAR) AS seller_id, l_shipdate AS shipping_limit_date,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS price,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS freight_value
  FROM lineitem),
b_payment AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 1 AS payment_sequential,
         CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'credit_card' WHEN o_orderpriority = '2-HIGH' THEN 'boleto'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'voucher' ELSE 'debit_card' END AS payment_type,
         CAST(o_orderkey % 10 + 1 AS INTEGER) AS payment_installments, CAST(o_totalprice AS DECIMAL(18,2)) AS payment_value
  FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), 2, 'voucher', 1, CAST(10 AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 4 = 0),
b_review AS (
  SELECT concat('r', o_orderkey) AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderkey % 5 + 1 AS INTEGER) AS review_score,
         o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS created
  FROM orders WHERE o_orderkey % 3 <> 0),
b_geo AS (
  SELECT n_nationkey AS zip, n_nationkey * 2.0 - 40 AS lat, n_nationkey - 70.0 AS lng, n_name AS city, n_name AS state FROM nation),
s_order AS (SELECT * FROM b_order WHERE delivered IS NOT NULL),
s_item AS (SELECT DISTINCT * FROM b_item),
s_geo AS (SELECT * FROM b_geo WHERE lat BETWEEN -33.75116944 AND 5.27438888 AND lng BETWEEN -73.98283055 AND -34.79314722),
days AS (SELECT DISTINCT CAST(bought AS DATE) AS full_date FROM b_order WHERE bought IS NOT NULL),
foi AS (
  SELECT i.*, customer_id, CAST(bought AS DATE) AS full_date, order_status FROM s_item i LEFT JOIN s_order o ON i.order_id = o.order_id),
item_sums AS (SELECT order_id, count(*) AS items_count, sum(price) AS sum_price, sum(freight_value) AS sum_freight FROM s_item GROUP BY order_id),
pay_sums AS (
  SELECT order_id, sum(payment_value) AS payment_total, max(payment_installments) AS payment_installments_max,
         arg_min(payment_type, payment_sequential) AS primary_payment_type
  FROM b_payment GROUP BY order_id),
fo AS (
  SELECT o.order_id, o.customer_id, CAST(bought AS DATE) AS full_date, items_count, sum_price, sum_freight, payment_total,
         payment_installments_max, primary_payment_type, CAST(delivered AS DATE) - CAST(bought AS DATE) AS delivered_days,
         coalesce(delivered <= due, false) AS delivered_on_time, order_status = 'canceled' AS is_canceled
  FROM s_order o LEFT JOIN item_sums i ON o.order_id = i.order_id LEFT JOIN pay_sums p ON o.order_id = p.order_id),
cat_items AS (
  SELECT f.*, english AS category, brand FROM foi f LEFT JOIN b_product p ON f.product_id = p.product_id
  LEFT JOIN b_category c ON p.product_category_name = c.product_category_name),
mart_sales AS (
  SELECT strftime(full_date, '%Y-%m') AS year_month, category, sum(price) AS gmv, count(DISTINCT order_id) AS orders, count(*) AS units
  FROM cat_items GROUP BY ALL),
mart_pay AS (
  SELECT strftime(full_date, '%Y-%m') AS year_month, payment_type, count(DISTINCT p.order_id) AS orders,
         count(DISTINCT customer_id) AS unique_customers, sum(payment_value) AS payment_total
  FROM b_payment p LEFT JOIN fo ON p.order_id = fo.order_id GROUP BY ALL)
"""
