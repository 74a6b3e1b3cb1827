"""Pieces of oracle SQL: keyword rules, and the facts of every column of a view."""

from __future__ import annotations

from suite.views import with_views

# The keyword lists once more, written for SQL so that the check stays independent.
CRITICAL = ("id|customer|order|product|transaction|invoice|payment|price|amount|revenue|cost|salary|"
            "target|label|class|outcome|fraud|churn")
OPTIONAL = ("comment|description|note|review|text|message|feedback|remark|body|content|summary|detail|"
            "title|subject|narrative")
TARGET = "target|label|class|outcome|result|price|rating|churn|fraud|survived|diagnosis|default"
NEGATIVE = "price|age|qty|quantity|amount|salary|weight|height|distance|count|payment|value"
ZERO = "bmi|salary|price|age|weight|height"
FINANCIAL = "price|amount|payment|revenue|cost|value|salary"
ID = "['id','no','number','code','key','uuid','ref','serial','index']"
DATETIME = ("['date','time','timestamp','datetime','created','updated','modified','at','dt','ts',"
            "'_at','_date','_time','_ts']")
NUMBER = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"

# The columns of the views, with their Spark type and class.
COLUMNS = {
    "orders_dirty": [
        ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
        ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
        ("ship_priority", "string", "categorical"), ("comment", "string", "categorical"),
        ("order_date", "string", "categorical"), ("net_total", "string", "categorical"),
        ("schema_tag", "string", "categorical"), ("loaded", "timestamp_ntz", "datetime"),
    ],
    "customer_dirty": [
        ("c_custkey", "bigint", "numeric"), ("balance_amount", "double", "numeric"),
        ("age", "int", "numeric"), ("segment", "string", "categorical"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"),
        ("l_suppkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"),
        ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
        ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"),
        ("l_returnflag", "string", "categorical"), ("l_linestatus", "string", "categorical"),
        ("l_shipdate", "timestamp_ntz", "datetime"),
    ],
    "events": [
        ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "numeric"),
        ("event_type", "string", "categorical"), ("value", "double", "numeric"), ("props", "string", "categorical"),
    ],
    "documents": [
        ("doc_id", "bigint", "numeric"), ("text", "string", "categorical"), ("lang", "string", "categorical"),
        ("source", "string", "categorical"), ("n_chars", "bigint", "numeric"),
    ],
    "shipments_dirty": [
        ("row_id", "bigint", "numeric"), ("part_id", "bigint", "numeric"), ("unit_price", "double", "numeric"),
        ("gross_value", "double", "numeric"), ("price_copy", "double", "numeric"), ("weight", "double", "numeric"),
        ("load_index", "double", "numeric"), ("notes", "string", "categorical"),
        ("ship_day", "string", "categorical"), ("tax_text", "string", "categorical"),
        ("flag", "string", "categorical"), ("outcome", "string", "categorical"),
    ],
    "lineitem_feat": [
        ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
        ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"), ("price_copy", "double", "numeric"),
        ("const_num", "double", "numeric"), ("tiny_var", "double", "numeric"), ("gappy", "double", "numeric"),
        ("l_returnflag", "string", "categorical"),
    ],
}


def names(view: str, cls: str | None = None) -> list[str]:
    return [c for c, _, k in COLUMNS[view] if cls in (None, k)]


def tokens(name: str) -> str:
    return f"list_append(string_split_regex(lower({name}), '[_\\-\\s]+'), lower({name}))"


def importance(name: str, target: str | None = None) -> str:
    first = f"when {name} = '{target}' then 'CRITICAL' " if target else ""
    return (f"case {first}when regexp_matches(lower({name}), '{CRITICAL}') then 'CRITICAL' "
            f"when regexp_matches(lower({name}), '{OPTIONAL}') then 'OPTIONAL' else 'IMPORTANT' end")


def datetime_name(name: str) -> str:
    return (f"(list_has_any({tokens(name)}, {DATETIME}) or "
            f"regexp_matches(lower({name}), '(_at|_date|_time|_ts|_datetime)$'))")


def id_like(name: str, distinct: str, rows: str) -> str:
    return f"(list_has_any({tokens(name)}, {ID}) or coalesce({distinct}::double / nullif({rows}, 0), 0) > 0.85)"


def few(distinct: str, rows: str) -> str:
    return f"({distinct} < 20 or coalesce({distinct}::double / nullif({rows}, 0) < 0.05, false))"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"coalesce(round({part}::double / nullif({whole}, 0) * 100, {digits}), 0.0)"


def _numeric_facts(view: str, c: str, i: int, kind: str) -> str:
    low, high = "q25 - 1.5 * (q75 - q25)", "q75 + 1.5 * (q75 - q25)"
    return f"""select '{c}' as name, {i} as ordinal, '{kind}' as dtype_raw, 'numeric' as dtype_class,
        '' as suggested_dtype, (select count(*) from {view}) as n_rows, count(x) as present,
        count(distinct x) as n_distinct, avg(x) as mean, median(x) as med, stddev_samp(x) as std,
        var_samp(x) as variance, min(x) as lo, max(x) as hi, min(q25) as q25, min(q75) as q75,
        case when count(x) < 3 then 0.0 when min(x) = max(x) then null
             else avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) end as skew,
        case when count(x) < 4 then 0.0 when min(x) = max(x) then null
             else avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3 end as kurt,
        case when min(q75) > min(q25) and count(distinct x) > 10
             then count(*) filter (where x < {low} or x > {high}) else 0 end as iqr_n,
        case when min(sp) > 0 and count(distinct x) > 10
             then count(*) filter (where abs(x - m) / nullif(sp, 0) > 3) else 0 end as z_n,
        count(*) filter (where x < 0) as negatives, count(*) filter (where x = 0) as zeros,
        null::varchar as top_value, null::bigint as top_freq
      from (select {c}::double as x from {view} where {c} is not null) a,
           (select avg({c}::double) as m, quantile_cont({c}::double, 0.25) as q25,
                   quantile_cont({c}::double, 0.75) as q75, stddev_pop({c}::double) as sp from {view}) s"""


def _other_facts(view: str, c: str, i: int, kind: str, cls: str) -> str:
    nulls = ", ".join(f"null::double as {n}" for n in
                      ("mean", "med", "std", "variance", "lo", "hi", "q25", "q75", "skew", "kurt"))
    counts = "null::bigint as iqr_n, null::bigint as z_n, 0::bigint as negatives, 0::bigint as zeros"
    if cls == "categorical":
        best = f"(select {c} as v, count(*) as n from {view} where {c} is not null group by 1 order by 2 desc, 1 limit 1)"
        suggested = (
            f"case when count({c}) > 0 and count(*) filter (where regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') "
            f"and try_strptime({c}, '%Y-%m-%d') is not null) = count({c}) then 'datetime' "
            f"when count({c}) > 0 and count(*) filter (where regexp_full_match({c}, '{NUMBER}')) = count({c}) "
            f"and not {datetime_name(chr(39) + c + chr(39))} then 'numeric' else '' end")
        tops = f"(select v from {best}) as top_value, (select n from {best}) as top_freq"
    else:
        suggested, tops = "''", "null::varchar as top_value, null::bigint as top_freq"
    return f"""select '{c}' as name, {i} as ordinal, '{kind}' as dtype_raw, '{cls}' as dtype_class,
        {suggested} as suggested_dtype, count(*) as n_rows, count({c}) as present,
        count(distinct {c}) as n_distinct, {nulls}, {counts}, {tops} from {view}"""


def facts(view: str, only: list[str] | None = None) -> str:
    """``facts as (...)``: one row per column of a view."""
    parts = [
        _numeric_facts(view, c, i, t) if k == "numeric" else _other_facts(view, c, i, t, k)
        for i, (c, t, k) in enumerate(COLUMNS[view]) if only is None or c in only
    ]
    return "facts as (" + "\n      union all ".join(parts) + ")"


def with_facts(view: str, derived: bool = True, only: list[str] | None = None) -> str:
    return (with_views(view) + ", " if derived else "with ") + facts(view, only) + "\n"


def profile(target: str | None = None) -> str:
    """The column profile over ``facts``."""
    other = f"name <> '{target}'" if target else "true"
    stat = "case when dtype_class = 'numeric' and present >= 2 then {} end"
    shown = [(a, b) for a, b in (("mean", "mean"), ("med", "median"), ("std", "std"), ("lo", "min"), ("hi", "max"),
                                 ("q25", "q25"), ("q75", "q75"), ("skew", "skewness"), ("kurt", "kurtosis"))]
    stats = ", ".join(stat.format(f"round({a}, 4)") + f" as {b}" for a, b in shown)
    return f"""select name, ordinal, dtype_raw, dtype_class, suggested_dtype, n_rows - present as missing,
        {pct('(n_rows - present)', 'n_rows')} as missing_pct, n_distinct as "unique",
        {pct('n_distinct', 'n_rows')} as unique_pct, {id_like('name', 'n_distinct', 'n_rows')} as is_id_like,
        n_distinct <= 1 as is_constant,
        (not {id_like('name', 'n_distinct', 'n_rows')} and {other} and {few('n_distinct', 'n_rows')}) as is_target_candidate,
        {importance('name', target)} as importance, {stats},
        {stat.format('iqr_n')} as outliers_iqr, {stat.format('z_n')} as outliers_zscore,
        {stat.format('round(abs(std / nullif(mean, 0)), 4)')} as cv,
        {stat.format('n_distinct <= 10')} as is_ordinal,
        case when dtype_class = 'categorical' and present > 0 then top_value end as top_value,
        case when dtype_class = 'categorical' and present > 0 then top_freq end as top_freq,
        case when dtype_class = 'categorical' and present > 0 then {pct('top_freq', 'present')} end as top_freq_pct
      from facts"""


def overview(view: str) -> str:
    """The table overview of a view; one statement to select from."""
    cols = COLUMNS[view]
    gaps = " + ".join(f"(count(*) - count({c}))" for c, _, _ in cols)
    whole = " and ".join(f"{c} is not null" for c, _, _ in cols)
    width = {"bigint": 8, "double": 8, "int": 4, "timestamp_ntz": 8}
    size = " + ".join(f"coalesce(sum(strlen({c})), 0)" if k == "categorical" else f"count(*) * {width[t]}"
                      for c, t, k in cols)
    kinds = [k for _, _, k in cols]
    return f"""select a.rows, {len(cols)}::bigint as columns, round(bytes / 1e6, 3) as data_mb,
        {kinds.count('numeric')}::bigint as numeric_cols, {kinds.count('categorical')}::bigint as categorical_cols,
        {kinds.count('datetime')}::bigint as datetime_cols, a.rows - d.n as duplicate_rows,
        {pct('(a.rows - d.n)', 'a.rows')} as duplicate_pct, missing_cells,
        {pct('missing_cells', f'(a.rows * {len(cols)})')} as missing_pct, complete_rows,
        {pct('complete_rows', 'a.rows')} as complete_rows_pct
      from (select count(*) as rows, {gaps} as missing_cells, count(*) filter (where {whole}) as complete_rows,
                   {size} as bytes from {view}) a,
           (select count(*) as n from (select distinct * from {view})) d"""


def corr(a: str, b: str) -> str:
    """r, or null where either side does not vary over the common rows."""
    return (f"case when isnan(corr({a}, {b})) or var_pop(case when {b} is not null then {a} end) = 0 "
            f"or var_pop(case when {a} is not null then {b} end) = 0 then null else corr({a}, {b}) end")


def missing_risk(p: str, imp: str) -> str:
    return (f"case when {imp} = 'CRITICAL' and {p} > 5 then 'CRITICAL' when {imp} = 'CRITICAL' and {p} > 0 then 'HIGH' "
            f"when {imp} = 'OPTIONAL' and {p} > 80 then 'MEDIUM' when {imp} = 'OPTIONAL' then 'LOW' "
            f"when {p} > 50 then 'HIGH' when {p} > 20 then 'MEDIUM' else 'LOW' end")


def outlier_risk(n: str, rows: str) -> str:
    return (f"case when {n} * 100.0 / nullif({rows}, 0) > 15 then 'HIGH' "
            f"when {n} * 100.0 / nullif({rows}, 0) > 5 then 'MEDIUM' else 'LOW' end")


def pairs(view: str, cols: list[str]) -> str:
    """``pairs as (...)``: every unordered pair in table order, with its unrounded r."""
    from itertools import combinations

    return "pairs as (" + " union all ".join(
        f"select {k} as position, '{a}' as col1, '{b}' as col2, {corr(a, b)} as r from {view}"
        for k, (a, b) in enumerate(combinations(cols, 2))) + ")"


def checks(view: str, target: str | None = None, derived: bool = True) -> str:
    """``with ...``: profile, overview and every check of a view as common table expressions."""
    continuous = [c for c in names(view, "numeric")]
    return with_facts(view, derived).rstrip() + f""",
    prof as ({profile(target)}),
    over as ({overview(view)}),
    missing as (select name as col, ordinal, missing, missing_pct as pct,
        {missing_risk('missing_pct', 'importance')} as risk, importance from prof where missing > 0),
    dups as (select duplicate_rows, duplicate_pct, case when duplicate_pct > 20 then 'HIGH'
        when duplicate_pct > 5 then 'MEDIUM' else 'LOW' end as risk from over),
    outl as (select name as col, ordinal, outliers_iqr as iqr_count, outliers_zscore as zscore_count,
        {outlier_risk('greatest(outliers_iqr, outliers_zscore)', '(select rows from over)')} as risk, is_ordinal
        from prof where outliers_iqr > 0 or outliers_zscore > 0),
    wrong as (select name as col, ordinal, dtype_raw as current_type, suggested_dtype as suggested_type
        from prof where suggested_dtype <> ''),
    neg as (select name as col, ordinal, negatives as count from facts
        where dtype_class = 'numeric' and negatives > 0 and regexp_matches(lower(name), '{NEGATIVE}')),
    zero as (select name as col, ordinal, zeros as count from facts
        where dtype_class = 'numeric' and zeros > 0 and regexp_matches(lower(name), '{ZERO}')),
    skews as (select name as col, ordinal, skewness, case when abs(skewness) > 2 then 'HIGH' else 'MEDIUM' end as level
        from prof where dtype_class = 'numeric' and not coalesce(is_ordinal, false) and abs(skewness) > 1),
    {pairs(view, continuous)},
    bands as (select position, col1, col2, case when abs(r) > 0.9 then 'high' when abs(r) > 0.7 then 'medium' end as band,
        round(r, 3) as correlation from pairs
        where abs(r) > 0.7 and col1 not in (select name from prof where is_ordinal)
          and col2 not in (select name from prof where is_ordinal)),
    issues as (
      select 0 as block, ordinal as position, 'missing' as type, col,
             'Missing values: ' || pct::varchar || '% in ' || col || ' [' || importance || ']' as "desc",
             risk as severity, importance from missing
      union all select 1, 0, 'duplicate', '—', duplicate_pct::varchar || '% duplicate rows',
             case when duplicate_pct > 10 then 'HIGH' when duplicate_pct > 2 then 'MEDIUM' else 'LOW' end, 'IMPORTANT'
             from dups where duplicate_pct > 0
      union all select 2, ordinal, 'outlier', col, 'Outliers: ' || iqr_count || ' in ' || col, risk, 'IMPORTANT' from outl
      union all select 3, ordinal, 'wrong_type', col,
             'Type mismatch: ' || col || ' (' || current_type || ' → ' || suggested_type || ')', 'MEDIUM', 'IMPORTANT' from wrong
      union all select 4, ordinal, 'skewness', col, 'Skewed: ' || col || ' (skew=' || skewness::varchar || ')', level,
             'IMPORTANT' from skews
      union all select 5, position, 'correlation', col1 || ' ↔ ' || col2, 'High correlation ' || correlation::varchar ||
             ' between ' || col1 || ' and ' || col2, 'MEDIUM', 'IMPORTANT' from bands where band = 'high'
      union all select 6, ordinal, 'invalid_value', col, 'Negative values in ' || col || ' (' || count || ' rows)',
             'HIGH', 'CRITICAL' from neg),
    parts as (select
        30.0 - least(coalesce((select sum(missing_pct * case importance when 'CRITICAL' then 2.5 when 'OPTIONAL' then 0.3
            else 1.5 end) from prof), 0) / (select columns from over) * 3, 30.0) as completeness,
        20.0 - least(duplicate_pct * 2.0, 20.0) as consistency,
        20.0 - least(coalesce((select sum(iqr_count) from outl where not is_ordinal), 0)::double / rows * 100 * 1.5, 15.0) as validity,
        30.0 - least((select count(*) from wrong) * 2, 10) - least((select count(*) from skews where level = 'HIGH') * 2, 10)
          - least(((select count(*) from neg) + (select count(*) from zero)) * 2, 10) as usability,
        case when missing_pct = 0 then 5 else 0 end + case when duplicate_pct = 0 then 5 else 0 end as bonus
      from over),
    totals as (select floor(least(100.0, greatest(0.0, completeness + consistency + validity + usability + bonus)))::bigint
        as total, * from parts)
"""


GRADE = ("case when total >= 90 then 'Excellent' when total >= 70 then 'Good' "
         "when total >= 50 then 'Needs Cleaning' else 'High Risk' end")
TIER = "case when total >= 75 then 'Good' when total >= 50 then 'Fair' else 'Poor' end"
