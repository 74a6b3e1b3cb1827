"""Queries on the transformations that recommendations propose."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import sqltext as S
from suite.views import table, with_views
from tablegauge.operators import remediate as X

QUERIES, ORACLES = {}, {}
DIRTY, SHIP, FEAT, CUST = "orders_dirty", "shipments_dirty", "lineitem_feat", "customer_dirty"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _sql(view: str, body: str) -> str:
    return with_views(view) + body.format(v=view)


@query("fix_fill_constant", _sql(DIRTY, "select o_orderkey, coalesce(comment, 'Not Provided') as comment from {v}"))
def fix_fill_constant(spark, sf):
    return X.fix_fill_constant(table(spark, sf, DIRTY), "comment").select("o_orderkey", "comment")


@query("fix_drop_missing_keys", _sql(DIRTY, "select o_orderkey, o_custkey from {v} where o_custkey is not null"))
def fix_drop_missing_keys(spark, sf):
    return X.fix_drop_missing_keys(table(spark, sf, DIRTY), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("fix_flag_present", _sql(DIRTY, "select o_orderkey, case when o_custkey is null then 0 else 1 end as has_o_custkey from {v}"))
def fix_flag_present(spark, sf):
    return X.fix_flag_present(table(spark, sf, DIRTY), "o_custkey").select("o_orderkey", "has_o_custkey")


@query("fix_fill_median", _sql(DIRTY, "select o_orderkey, coalesce(o_totalprice, (select median(o_totalprice) from {v})) as o_totalprice, "
       "coalesce(o_custkey::double, (select median(o_custkey::double) from {v})) as o_custkey from {v}"))
def fix_fill_median(spark, sf):
    return X.fix_fill_median(table(spark, sf, DIRTY), ["o_totalprice", "o_custkey"]).select("o_orderkey", "o_totalprice", "o_custkey")


@query("fix_fill_mode", _sql(DIRTY, "select o_orderkey, coalesce(ship_priority, (select ship_priority from {v} where ship_priority "
       "is not null group by 1 order by count(*) desc, 1 limit 1)) as ship_priority from {v}"))
def fix_fill_mode(spark, sf):
    return X.fix_fill_mode(table(spark, sf, DIRTY), "ship_priority").select("o_orderkey", "ship_priority")


@query("fix_drop_sparse_columns", _sql(DIRTY, "select o_orderkey, coalesce(o_custkey::double, (select median(o_custkey::double) from {v})) "
       "as o_custkey, o_orderstatus, coalesce(o_totalprice, (select median(o_totalprice) from {v})) as o_totalprice, "
       "ship_priority, order_date, net_total, schema_tag from {v}"))
def fix_drop_sparse_columns(spark, sf):
    """``comment`` goes; ``loaded`` is left out of the comparison as a timestamp."""
    return X.fix_drop_sparse_columns(table(spark, sf, DIRTY)).drop("loaded")


@query("fix_drop_duplicates", _sql(DIRTY, "select distinct * exclude (loaded) from {v}"))
def fix_drop_duplicates(spark, sf):
    return X.fix_drop_duplicates(table(spark, sf, DIRTY)).drop("loaded")


@query("fix_clip_iqr", with_views(SHIP).rstrip() + """, s as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from
    (select quantile_cont(load_index, 0.25) as q1, quantile_cont(load_index, 0.75) as q3 from shipments_dirty))
    select row_id, round(case when load_index < lo then lo when load_index > hi then hi else load_index end, 9) as load_index
    from shipments_dirty, s""")
def fix_clip_iqr(spark, sf):
    rows = X.fix_clip_iqr(table(spark, sf, SHIP), ["load_index"])
    return rows.select("row_id", F.round("load_index", 9).alias("load_index"))


@query("fix_parse_datetime", _sql(DIRTY, "select o_orderkey, strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y/%m/%d') as day from {v}"))
def fix_parse_datetime(spark, sf):
    rows = X.fix_parse_datetime(table(spark, sf, DIRTY), ["order_date"])
    return rows.select("o_orderkey", F.date_format("order_date", "yyyy/MM/dd").alias("day"))


@query("fix_parse_numeric", _sql(DIRTY, "select o_orderkey, try_cast(net_total as double) as net_total, "
       "try_cast(ship_priority as double) as ship_priority from {v}"))
def fix_parse_numeric(spark, sf):
    rows = X.fix_parse_numeric(table(spark, sf, DIRTY), ["net_total", "ship_priority"])
    return rows.select("o_orderkey", "net_total", "ship_priority")


@query("fix_log1p", _sql(SHIP, "select row_id, round(case when unit_price > -1 then ln(1 + unit_price) end, 6) as unit_price from {v}"))
def fix_log1p(spark, sf):
    rows = X.fix_log1p(table(spark, sf, SHIP), ["unit_price"])
    return rows.select("row_id", F.round("unit_price", 6).alias("unit_price"))


@query("fix_drop_correlated", _sql(FEAT, "select l_quantity, l_extendedprice, l_discount, l_tax, const_num, tiny_var, gappy, l_returnflag from {v}"))
def fix_drop_correlated(spark, sf):
    """``price_copy`` repeats ``l_extendedprice`` and goes."""
    return X.fix_drop_correlated(table(spark, sf, FEAT))


@query("fix_clip_negative", _sql(CUST, "select c_custkey, case when balance_amount < 0 then 0 else balance_amount end as balance_amount from {v}"))
def fix_clip_negative(spark, sf):
    return X.fix_clip_negative(table(spark, sf, CUST), ["balance_amount"]).select("c_custkey", "balance_amount")


@query("fix_drop_negative", _sql(CUST, "select c_custkey, balance_amount from {v} where balance_amount >= 0"))
def fix_drop_negative(spark, sf):
    return X.fix_drop_negative(table(spark, sf, CUST), "balance_amount").select("c_custkey", "balance_amount")


@query("fix_class_weights", "select doc_id, toxic, round((select count(*) from labels)::double / ((select count(distinct toxic) from labels) "
       "* (select count(*) from labels b where b.toxic = a.toxic)), 6) as class_weight from labels a")
def fix_class_weights(spark, sf):
    rows = X.fix_class_weights(table(spark, sf, "labels"), "toxic")
    return rows.select("doc_id", "toxic", F.round("class_weight", 6).alias("class_weight"))


@query("fix_drop_leakage", _sql(FEAT, "select * exclude (l_extendedprice) from {v}"))
def fix_drop_leakage(spark, sf):
    from tablegauge.operators.readiness import leakage_columns

    df = table(spark, sf, FEAT)
    return X.fix_drop_leakage(df, [r["col"] for r in leakage_columns(df, "price_copy").collect()])


@query("fix_standardize", "with s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as d from orders) "
       "select o_orderkey, round((o_totalprice - m) / d, 6) as o_totalprice from orders, s")
def fix_standardize(spark, sf):
    rows = X.fix_standardize(table(spark, sf, "orders"), ["o_totalprice"])[0]
    return rows.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))
