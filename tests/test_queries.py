"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from mercata.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
#: A part of each family; ``TEST_ALL=1`` compares every key.
CHOSEN = (
    "silver_product silver_order dim_date dim_geolocation fact_order_item fact_order dm_sales_monthly_category dm_seller_kpi dm_customer_lifecycle "
    "dm_logistics_sla dm_product_bestsellers dm_category_price_bands q_revenue_ts_grain q_top_products q_share_region q_mom q_sellers_bad_sla q_cohort_retention "
    "t_status_breakdown t_aov_stats d_category_heatmap d_customer_kpis d_dq_checks m_order_details m_order_details_once kpi_delivery agg_rollup agg_grouping_sets "
    "win_customer_pareto win_topk_both pred_dual join_self_latest f_features f_baseline f_metrics fx_horizon_decay mon_kpis rag_chunk rag_topk vec_nearest tag_entities "
    "log_over_quota log_sessions src_csv sink_append_merge compact_partition small_files"
).split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("key", list(registry.oracle_sql()) if os.environ.get("TEST_ALL") else CHOSEN)
def test_same_as_sql(spark, duck, key):
    df = registry.queries()[key](spark, SF)
    theirs = duck.execute(registry.oracle_sql()[key])
    names = [d[0] for d in theirs.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, theirs.fetchall())


def test_names_without_a_session():
    assert len(registry.queries()) > 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("key", ["f_backtest", "f_monitor", "f_recursive_linear"])
def test_series_are_made_once(spark, key):
    """What reads the daily series several times reads it written, and builds it from the raw items no second time."""
    files = registry.queries()[key](spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_daily_series_leaves_no_item_out(spark, tmp_path):
    """Orders that are missing or have no date: every item stands in the result, as in the SQL, and with its category."""
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "part", "lineitem", "orders"):
        rows = "SELECT * REPLACE (CASE WHEN o_orderkey % 11 = 3 THEN NULL ELSE o_orderdate END AS o_orderdate) FROM {} WHERE o_orderkey % 7 <> 2" if t == "orders" else "SELECT * FROM {}"
        con.execute(f"COPY ({rows.format(f"read_parquet('{SF}/{t}.parquet')")}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    df = registry.queries()["f_daily_series"](spark, str(tmp_path))
    rows, theirs = df.collect(), con.execute(registry.oracle_sql()["f_daily_series"])
    names = [d[0] for d in theirs.description]
    assert rows_of(df.columns, [tuple(r) for r in rows]) == rows_of(names, theirs.fetchall())
    items = con.execute("SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax FROM lineitem)").fetchone()[0]
    assert sum(r.quantity for r in rows) == items and sum(r.quantity for r in rows if r.date is None) > 100
    assert all(r.product_category_name for r in rows)
