"""Derived views with injected defects, as SQL text that Spark and DuckDB both run.

The given tables hold no nulls and no duplicates, so the checks would have nothing to find.
``{orders}`` and the like stand for the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "orders_dirty": """
        with b as (
          select o_orderkey,
                 case when o_orderkey % 10 = 0 then null else o_custkey end as o_custkey,
                 o_orderstatus,
                 case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice,
                 case when o_orderkey % 3 = 0 then null else o_orderpriority end as ship_priority,
                 case when o_orderkey % 8 = 0 then 'ok' else null end as comment,
                 cast(cast(o_orderdate as date) as string) as order_date,
                 cast(cast(o_totalprice as decimal(12,2)) as string) as net_total,
                 'v1' as schema_tag,
                 o_orderdate as loaded
          from {orders})
        select * from b union all select * from b where o_orderkey % 20 = 1""",
    "customer_dirty": """
        select c_custkey, c_acctbal as balance_amount, cast(c_custkey % 90 as int) as age,
               c_mktsegment as segment
        from {customer}""",
    "lineitem_feat": """
        select l_quantity, l_extendedprice, l_discount, l_tax,
               l_extendedprice * 1.1e0 + l_tax as price_copy,
               1.0e0 as const_num,
               0.01e0 * (l_linenumber % 2) as tiny_var,
               case when l_linenumber = 7 then null else l_quantity * l_discount end as gappy,
               l_returnflag
        from {lineitem}""",
    "shipments_dirty": """
        with b as (
          select l_orderkey * 10 + l_linenumber as row_id,
                 case when l_orderkey % 9 = 0 then null else l_partkey end as part_id,
                 case when l_linenumber = 7 then -l_extendedprice else l_extendedprice end as unit_price,
                 l_extendedprice as gross_value,
                 l_extendedprice * 1.1e0 + l_tax as price_copy,
                 case when l_quantity = 1 then 0.0e0 else l_quantity end as weight,
                 l_quantity / 50.0e0 * (l_quantity / 50.0e0) * (l_quantity / 50.0e0) * (l_quantity / 50.0e0)
                   * (l_quantity / 50.0e0) * (l_quantity / 50.0e0) * (l_quantity / 50.0e0) * (l_quantity / 50.0e0)
                   * (l_quantity / 50.0e0) * (l_quantity / 50.0e0)
                   as load_index,
                 case when l_orderkey % 5 = 0 then 'left at door' else null end as notes,
                 cast(cast(l_shipdate as date) as string) as ship_day,
                 cast(cast(l_tax as decimal(4,2)) as string) as tax_text,
                 case when l_orderkey % 3 = 0 then null else l_returnflag end as flag,
                 case when l_orderkey % 11 = 0 then 'rare' else 'usual' end as outcome
          from {lineitem})
        select * from b union all select * from b where row_id % 13 = 1""",
    "orders_orphan": """
        select o_orderkey,
               case when o_orderkey % 25 = 0 then o_custkey + 1000000 else o_custkey end as custkey
        from {orders}""",
    "customer_ref": "select c_custkey as custkey, c_mktsegment from {customer}",
    "responses": """
        with b as (
          select c_custkey,
                 case when c_custkey % 12 = 0 then 1000 + c_custkey % 900
                      when c_custkey % 70 = 1 then 21800000 + (c_custkey + 1) * 70
                      else 21800000 + c_custkey * 70 end as response_id,
                 concat('Cust ', cast(c_custkey % 1400 as string)) as nm
          from {customer}),
        n as (
          select c_custkey, response_id,
                 case when c_custkey % 9 = 0 then concat(nm, ' ')
                      when c_custkey % 11 = 0 then upper(nm) else nm end as customer_name
          from b)
        select customer_name, response_id from n
        union all
        select customer_name, response_id from n where c_custkey % 30 = 0""",
    "slices": """
        select cast(floor(l_orderkey / 125) as bigint) as slice,
               l_quantity, l_extendedprice, l_discount,
               case when l_linenumber = 5 then null else l_tax end as l_tax,
               case when floor(l_orderkey / 125) % 3 = 0 then 1 else 0 end as by_size,
               case when floor(l_orderkey / 125) % 3 = 1 then 1 else 0 end as by_line,
               case when floor(l_orderkey / 125) % 3 = 0 then case when l_quantity > 25 then 'large' else 'small' end
                    when floor(l_orderkey / 125) % 3 = 1 then case when l_linenumber = 7 then 'last' else 'inner' end
                    else l_returnflag end as target
        from {lineitem}""",
    "scores": """
        select c_name as table_name, cast(floor(abs(c_acctbal) / 100) as bigint) as score, c_custkey as analyzed_at
        from {customer}""",
    "events_gaps": """
        select event_id, user_id, event_type,
               case when event_id % 10 = 0 then cast('NaN' as double)
                    when event_id % 15 = 1 then cast('Infinity' as double)
                    when event_id % 15 = 2 then cast('-Infinity' as double)
                    when event_id % 15 = 3 then null
                    else value end as value
        from {events}""",
}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view."""
    if name in TABLES:
        return base_table(spark, sf_dir, name)
    text = VIEWS[name]
    used = {t: base_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql(name: str) -> str:
    """The view as SQL text over the tables' plain names."""
    return VIEWS[name].format(**{t: t for t in TABLES})


def with_views(*names: str) -> str:
    """``with orders_dirty as (...), ...`` to put in front of an oracle query."""
    return "with " + ",\n".join(f"{n} as ({sql(n)})" for n in names) + "\n"
