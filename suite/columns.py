"""Queries on columns: classifiers, projections, overview and profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import sqltext as S
from suite.views import table, with_views
from tablegauge.functions import names as N
from tablegauge.functions import probes
from tablegauge.functions.classes import columns_of, dtype_class, select_by_class
from tablegauge.functions.nulls import json_safe_values, normalize_nulls
from tablegauge.operators import audit as A
from tablegauge.operators import distinct as D
from tablegauge.operators import duplicates as U
from tablegauge.operators import profile as P
from tablegauge.operators.quantiles import SKETCH_SIZE, rank_error
from tablegauge.plans.analyze import importance_groups

QUERIES, ORACLES = {}, {}
DIRTY = "orders_dirty"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _per_column_sql(view: str, body: str) -> str:
    """A select per column, ``{c}`` its name, over a derived view."""
    return with_views(view) + " union all ".join(
        body.format(c=c, i=i) for i, (c, _, _) in enumerate(S.COLUMNS[view]))


# Names and classes, each with a count that the data gives.

_MISSING = "select '{c}' as name, count(*) - count({c}) as missing, count(*) as n_rows, count(distinct {c}) as n from " + DIRTY


def _named(body: str) -> str:
    return with_views(DIRTY) + f"select {body} from (" + " union all ".join(
        _MISSING.format(c=c) for c in S.names(DIRTY)) + ")"


@query("resolve_target", with_views(DIRTY) + "select 'o_orderstatus' as target, count(o_orderstatus) as present from " + DIRTY)
def resolve_target(spark, sf):
    df = table(spark, sf, DIRTY)
    found = N.resolve_target(df, " O_OrderStatus ")
    return df.agg(F.count(found).alias("present")).select(F.lit(found).alias("target"), "present")


@query("name_tokens", _named(f"name, array_to_string(list_sort(list_distinct({S.tokens('name')})), '|') as tokens, missing"))
def name_tokens(spark, sf):
    rows = P.missing_by_column(table(spark, sf, DIRTY))
    return rows.select("name", F.array_join(F.array_sort(N.name_tokens(F.col("name"))), "|").alias("tokens"), "missing")


@query("is_id_like", _named(f"name, {S.id_like('name', 'n', 'n_rows')} as is_id_like, n as \"unique\""))
def is_id_like(spark, sf):
    df = table(spark, sf, DIRTY)
    rows = P.distinct_by_column(df).crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"))))
    return rows.select("name", N.is_id_like(F.col("name"), F.col("unique"), F.col("n_rows")).alias("is_id_like"), "unique")


@query("column_importance", _named(f"name, {S.importance('name', 'net_total')} as importance, missing"))
def column_importance(spark, sf):
    rows = P.missing_by_column(table(spark, sf, DIRTY))
    return rows.select("name", N.column_importance(F.col("name"), "net_total").alias("importance"), "missing")


@query("name_suggests_datetime", _named(f"name, {S.datetime_name('name')} as suggests_datetime, missing"))
def name_suggests_datetime(spark, sf):
    rows = P.missing_by_column(table(spark, sf, DIRTY))
    return rows.select("name", N.name_suggests_datetime(F.col("name")).alias("suggests_datetime"), "missing")


@query("classify_type", with_views(DIRTY) + " union all ".join(
    f"select '{c}' as name, '{k}' as dtype_class, count({c}) as present from {DIRTY}" for c, _, k in S.COLUMNS[DIRTY]))
def classify_type(spark, sf):
    df = table(spark, sf, DIRTY)
    cls = F.element_at(F.create_map(*[F.lit(v) for f in df.schema for v in (f.name, dtype_class(f.dataType))]), F.col("name"))
    rows = P.per_column(df, df.columns, present=F.count)
    return rows.select("name", cls.alias("dtype_class"), "present")


_TEXT = S.names(DIRTY, "categorical")


@query("probe_datetime", with_views(DIRTY) + " union all ".join(
    f"select '{c}' as name, count({c}) as present, count(*) filter (where regexp_full_match({c}, "
    f"'\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_strptime({c}, '%Y-%m-%d') is not null) as iso, "
    f"count(*) filter (where regexp_full_match({c}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') "
    f"and try_strptime({c}, '%m/%d/%Y') is not null) as us from {DIRTY}" for c in _TEXT))
def probe_datetime(spark, sf):
    formats = dict(probes.DATETIME_FORMATS)
    df = table(spark, sf, DIRTY)
    rows = P.per_column(
        df, columns_of(df, "categorical"), present=F.count,
        iso=lambda x: F.count(probes.parse_datetime(x, "yyyy-MM-dd", formats["yyyy-MM-dd"])),
        us=lambda x: F.count(probes.parse_datetime(x, "MM/dd/yyyy", formats["MM/dd/yyyy"])))
    return rows.select("name", "present", "iso", "us")


@query("probe_numeric", with_views(DIRTY) + " union all ".join(
    f"select '{c}' as name, count({c}) as present, count(*) filter (where regexp_full_match({c}, '{S.NUMBER}')) as numbers, "
    f"round(sum(case when regexp_full_match({c}, '{S.NUMBER}') then try_cast({c} as double) end), 2) as total from {DIRTY}"
    for c in _TEXT))
def probe_numeric(spark, sf):
    df = table(spark, sf, DIRTY)
    rows = P.per_column(
        df, columns_of(df, "categorical"), present=F.count, numbers=lambda x: F.count(probes.parse_number(x)),
        total=lambda x: F.sum(probes.parse_number(x)))
    return rows.select("name", "present", "numbers", F.round("total", 2).alias("total"))


@query("select_by_class", with_views(DIRTY) + f"select {', '.join(S.names(DIRTY, 'numeric'))} from {DIRTY}")
def select_numeric(spark, sf):
    return select_by_class(table(spark, sf, DIRTY), "numeric")


@query("drop_columns", "select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders")
def drop_columns(spark, sf):
    return table(spark, sf, "orders").drop("o_orderstatus", "o_orderdate")


@query("drop_null_rows", with_views(DIRTY) + f"select o_orderkey, o_custkey, o_totalprice from {DIRTY} "
       "where o_custkey is not null and o_totalprice is not null")
def drop_null_rows(spark, sf):
    rows = table(spark, sf, DIRTY).dropna(subset=["o_custkey", "o_totalprice"])
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("split_by_threshold", with_views("responses") +
       "select 'short' as part, customer_name, response_id from responses where response_id < 10000 "
       "union all select 'long', customer_name, response_id from responses where response_id >= 10000")
def split_by_threshold(spark, sf):
    short, long = A.split_by_threshold(table(spark, sf, "responses"), "response_id")
    parts = [p.select(F.lit(k).alias("part"), "customer_name", "response_id") for k, p in (("short", short), ("long", long))]
    return parts[0].unionByName(parts[1])


@query("outlier_rows", with_views("responses") + """, s as (select quantile_cont(response_id::double, 0.25) as q1,
    quantile_cont(response_id::double, 0.75) as q3 from responses)
    select customer_name, response_id from responses, s
    where response_id < q1 - 1.5 * (q3 - q1) or response_id > q3 + 1.5 * (q3 - q1)
    order by response_id, customer_name limit 10""")
def outlier_rows(spark, sf):
    return A.outlier_rows(table(spark, sf, "responses"), "response_id", ["customer_name", "response_id"])


@query("id_format_case", with_views("responses") +
       "select customer_name, response_id, case when response_id < 10000 then 'short' else 'long' end as id_format from responses")
def id_format_case(spark, sf):
    return table(spark, sf, "responses").withColumn("id_format", A.id_format_case(F.col("response_id")))


@query("importance_groups", with_views(DIRTY) + "select importance, string_agg(name, ', ' order by ordinal) as columns, "
       f"count(*) as n_columns from (select name, ordinal, {S.importance('name')} as importance from (" + " union all ".join(
           f"select '{c}' as name, {i} as ordinal, count({c}) as n from {DIRTY}" for i, c in enumerate(S.names(DIRTY))) +
       ")) group by importance")
def importance_groups_(spark, sf):
    profile = P.profile_table(table(spark, sf, DIRTY), distinct="skip", quartiles=False, duplicates=False)
    return importance_groups(profile).filter("n_columns > 0").select(
        "importance", F.array_join("columns", ", ").alias("columns"), "n_columns")


# Overview and profile.

@query("table_shape", with_views(DIRTY) + f"select count(*) as rows, 10::bigint as columns, 3::bigint as numeric_cols, "
       f"6::bigint as categorical_cols, 1::bigint as datetime_cols from {DIRTY}")
def table_shape(spark, sf):
    return P.table_shape(table(spark, sf, DIRTY))


def _overview_part(*cols: str) -> str:
    return with_views(DIRTY) + f"select {', '.join(cols)} from ({S.overview(DIRTY)})"


@query("memory_estimate", _overview_part("data_mb"))
def memory_estimate(spark, sf):
    return P.memory_estimate(table(spark, sf, DIRTY))


@query("duplicate_rows", _overview_part("rows", "duplicate_rows", "duplicate_pct"))
def duplicate_rows(spark, sf):
    return U.duplicate_rows(table(spark, sf, DIRTY))


@query("duplicate_groups", with_views(DIRTY) + f"select *, count(*) as copies from (select * exclude (loaded) from {DIRTY}) "
       "group by all having count(*) > 1")
def duplicate_groups(spark, sf):
    return U.duplicate_groups(table(spark, sf, DIRTY).drop("loaded"))


@query("clean_rows", _overview_part("rows", "duplicate_rows", "rows - duplicate_rows as clean_rows"))
def clean_rows(spark, sf):
    return U.clean_rows(table(spark, sf, DIRTY))


@query("missing_cells", _overview_part("missing_cells", "rows * columns as total_cells", "missing_pct"))
def missing_cells(spark, sf):
    return P.missing_cells(table(spark, sf, DIRTY))


@query("complete_rows", _overview_part("rows", "complete_rows", "complete_rows_pct"))
def complete_rows(spark, sf):
    return P.complete_rows(table(spark, sf, DIRTY))


@query("table_overview", _overview_part("*"))
def table_overview(spark, sf):
    return P.table_overview(table(spark, sf, DIRTY))


@query("missing_by_column", _per_column_sql(
    DIRTY, "select '{c}' as name, count(*) - count({c}) as missing, "
    "round((count(*) - count({c}))::double / count(*) * 100, 2) as missing_pct from " + DIRTY))
def missing_by_column(spark, sf):
    return P.missing_by_column(table(spark, sf, DIRTY))


@query("distinct_by_column", _per_column_sql(
    DIRTY, "select '{c}' as name, count(distinct {c}) as \"unique\", "
    "round(count(distinct {c})::double / count(*) * 100, 2) as unique_pct from " + DIRTY))
def distinct_by_column(spark, sf):
    return P.distinct_by_column(table(spark, sf, DIRTY))


@query("constant_columns", with_views(DIRTY) + "select * from (" + " union all ".join(
    f"select '{c}' as name, count(distinct {c}) as \"unique\" from {DIRTY}" for c in S.names(DIRTY)) + ") where \"unique\" <= 1")
def constant_columns(spark, sf):
    return P.constant_columns(table(spark, sf, DIRTY))


@query("frequency_table", with_views(DIRTY) + " union all ".join(
    f"select '{c}' as column_name, {c}::varchar as value, count(*) as freq from {DIRTY} where {c} is not null group by 2"
    for c in ("o_custkey", "o_orderstatus", "ship_priority", "order_date")))
def frequency_table(spark, sf):
    return D.frequency_table(table(spark, sf, DIRTY), ["o_custkey", "o_orderstatus", "ship_priority", "order_date"])


def _facts_of(view: str, *cols: str, derived: bool = False, where: str = "true") -> str:
    return S.with_facts(view, derived) + f"select {', '.join(cols)} from ({S.profile()}) where {where}"


def _profile(spark, sf, view, target=None, **passes):
    return P.profile_table(table(spark, sf, view), target, duplicates=False, **passes)


@query("target_candidates", S.with_facts(DIRTY) + f'select name, "unique" from ({S.profile("o_orderstatus")}) where is_target_candidate')
def target_candidates(spark, sf):
    found = _profile(spark, sf, DIRTY, "o_orderstatus", quartiles=False).columns
    return found.filter("is_target_candidate").select("name", "unique")


def _lineitem(*cols: str) -> str:
    return _facts_of("lineitem", "name", *cols, where="dtype_class = 'numeric'")


def _numeric(spark, sf, *cols, **passes):
    return _profile(spark, sf, "lineitem", **passes).columns.filter("dtype_class = 'numeric'").select("name", *cols)


@query("numeric_moments", _lineitem("mean", "median", "std", "min", "max"))
def numeric_moments(spark, sf):
    return _numeric(spark, sf, "mean", "median", "std", "min", "max", distinct="skip")


@query("numeric_quartiles", _lineitem("q25", "q75"))
def numeric_quartiles(spark, sf):
    return _numeric(spark, sf, "q25", "q75", distinct="skip")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
_SHARES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


@query("numeric_quartiles_approx", " union all ".join(
    f"select '{c}' as name, '{q}' as quartile, count({c}) as n, true as near from lineitem" for c in _MEASURES for q in _SHARES))
def numeric_quartiles_approx(spark, sf):
    """Quartiles from sketches: whether the share of rows below each, and at or below it, enclose its own within the stated error."""
    rows = table(spark, sf, "lineitem")
    found = {r["name"]: r for r in _numeric(spark, sf, *_SHARES, distinct="skip", quartiles="approx").where(F.col("name").isin(*_MEASURES)).collect()}  # a row per column
    error, aggs = rank_error(SKETCH_SIZE), []
    for c in _MEASURES:
        x, n = F.col(c).cast("double"), F.count(c)
        for q, share in _SHARES.items():
            value = F.lit(found[c][q])
            near = (F.count_if(x < value) / n <= share + error) & (F.count_if(x <= value) / n >= share - error)
            aggs.append(F.struct(F.lit(c).alias("name"), F.lit(q).alias("quartile"), n.alias("n"), near.alias("near")))
    return rows.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("ordinal_flag", _lineitem("is_ordinal"))
def ordinal_flag(spark, sf):
    return _numeric(spark, sf, "is_ordinal", quartiles=False)


@query("outliers_iqr", _facts_of("events", "name", "outliers_iqr", where="dtype_class = 'numeric'"))
def outliers_iqr(spark, sf):
    return _profile(spark, sf, "events").columns.filter("dtype_class = 'numeric'").select("name", "outliers_iqr")


@query("outliers_zscore", _facts_of("events", "name", "outliers_zscore", where="dtype_class = 'numeric'"))
def outliers_zscore(spark, sf):
    return _profile(spark, sf, "events").columns.filter("dtype_class = 'numeric'").select("name", "outliers_zscore")


@query("skewness", _lineitem("skewness"))
def skewness(spark, sf):
    return _numeric(spark, sf, "skewness", quartiles=False, distinct="skip")


@query("kurtosis", _lineitem("kurtosis"))
def kurtosis(spark, sf):
    return _numeric(spark, sf, "kurtosis", quartiles=False, distinct="skip")


@query("coef_variation", _lineitem("cv"))
def coef_variation(spark, sf):
    return _numeric(spark, sf, "cv", quartiles=False, distinct="skip")


def _top(view: str, derived: bool) -> str:
    return _facts_of(view, "name", "top_value", "top_freq", "top_freq_pct", derived=derived, where="dtype_class = 'categorical'")


@query("top_value", _top(DIRTY, True))
def top_value(spark, sf):
    found = _profile(spark, sf, DIRTY, quartiles=False).columns
    return found.filter("dtype_class = 'categorical'").select("name", "top_value", "top_freq", "top_freq_pct")


@query("top_value_documents", _top("documents", False))
def top_value_documents(spark, sf):
    """Whole texts of up to 20,000 words, grouped by digest."""
    found = _profile(spark, sf, "documents", quartiles=False).columns
    return found.filter("dtype_class = 'categorical'").select("name", "top_value", "top_freq", "top_freq_pct")


@query("column_profile", S.with_facts(DIRTY) + S.profile())
def column_profile(spark, sf):
    return P.column_profile(table(spark, sf, DIRTY))


@query("column_profile_lineitem", S.with_facts("lineitem", False) + S.profile("l_returnflag"))
def column_profile_lineitem(spark, sf):
    return P.column_profile(table(spark, sf, "lineitem"), "l_returnflag")


@query("normalize_nulls", with_views("events_gaps") +
       "select event_id, case when not isnan(value) then value end as value from events_gaps")
def nan_to_null(spark, sf):
    return normalize_nulls(table(spark, sf, "events_gaps")).select("event_id", "value")


@query("json_safe_values", with_views("events_gaps") +
       "select event_id, user_id, event_type, case when not isnan(value) and not isinf(value) then value end as value from events_gaps")
def safe_values(spark, sf):
    return json_safe_values(table(spark, sf, "events_gaps"))
