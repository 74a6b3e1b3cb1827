"""Queries on relationships between tables and on the name/identifier audit."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from suite import sqltext as S
from suite.views import table, with_views
from tablegauge.functions.session import local_rows
from tablegauge.operators import audit as A
from tablegauge.operators import checks as C
from tablegauge.operators import profile as P
from tablegauge.operators import relate as L
from tablegauge.operators import score as Z
from tablegauge.plans.compare import compare

QUERIES, ORACLES = {}, {}
NAME, IDENT = "customer_name", "response_id"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


# Tables that share column names once the prefixes are gone.
_RENAMED = {
    "orders": "select o_orderkey as orderkey, o_custkey as custkey, o_orderstatus as status, o_totalprice as amount from {orders}",
    "customer": "select c_custkey as custkey, c_nationkey as nationkey, c_acctbal as balance from {customer}",
    "lineitem": "select l_orderkey as orderkey, l_suppkey as suppkey, l_linestatus as status, l_quantity as quantity from {lineitem}",
    "supplier": "select s_suppkey as suppkey, s_nationkey as nationkey, s_acctbal as balance from {supplier}",
}
_COLS = {
    "orders": ["orderkey", "custkey", "status", "amount"], "customer": ["custkey", "nationkey", "balance"],
    "lineitem": ["orderkey", "suppkey", "status", "quantity"], "supplier": ["suppkey", "nationkey", "balance"],
}


def _tables(spark, sf) -> dict:
    from suite.views import base_table

    return {n: spark.sql(text, **{n: base_table(spark, sf, n)}) for n, text in _RENAMED.items()}


def _renamed() -> str:
    return "with " + ", ".join(f"t_{n} as ({text.format(**{n: n})})" for n, text in _RENAMED.items())


def _shared() -> list[tuple[str, str, str]]:
    return [(a, b, c) for a, b in combinations(_COLS, 2) for c in sorted(set(_COLS[a]) & set(_COLS[b]))]


_KIND = "case when regexp_matches('{c}', 'id|key|code|no') then 'FK' else 'shared_column' end"


@query("shared_columns", _renamed() + " union all ".join(
    f"select '{a}' as table1, '{b}' as table2, '{c}' as col, {_KIND.format(c=c)} as relationship_type, "
    f"(select count({c}) from t_{a}) as present1, (select count({c}) from t_{b}) as present2" for a, b, c in _shared()))
def shared_columns(spark, sf):
    """Shared columns with the number of values on either side."""
    tables = _tables(spark, sf)
    pairs = L.shared_columns(L.column_catalog(spark, tables))
    present = None
    for n, df in tables.items():
        rows = P.per_column(df, df.columns, present=F.count).select(F.lit(n).alias("t"), F.col("name").alias("c"), "present")
        present = rows if present is None else present.unionByName(rows)
    for i in (1, 2):
        side = present.select(F.col("t").alias(f"table{i}"), F.col("c").alias("col"), F.col("present").alias(f"present{i}"))
        pairs = pairs.join(F.broadcast(side), [f"table{i}", "col"])  # a row per column of the catalog
    return pairs.select("table1", "table2", "col", "relationship_type", "present1", "present2")


def _integrity(a: str, ca: str, b: str, cb: str) -> str:
    return f"""select total_in_source, matched, total_in_source - matched as missing_references,
        total_in_source = matched as integrity_ok,
        (select coalesce(string_agg(v::varchar, ', ' order by v), '') from (select distinct {ca} as v from {a}
          where {ca} is not null and {ca} not in (select {cb} from {b} where {cb} is not null) order by 1 limit 5)) as sample_missing
      from (select count(*) as total_in_source, count(*) filter (where v in (select {cb} from {b})) as matched
            from (select distinct {ca} as v from {a} where {ca} is not null))"""


@query("referential_integrity", with_views("orders_orphan", "customer_ref") + _integrity("orders_orphan", "custkey", "customer_ref", "custkey"))
def referential_integrity(spark, sf):
    return L.referential_integrity(table(spark, sf, "orders_orphan"), "custkey", table(spark, sf, "customer_ref"), "custkey")


@query("referential_integrity_labels", _integrity("labels", "doc_id", "documents", "doc_id"))
def referential_integrity_labels(spark, sf):
    return L.referential_integrity(table(spark, sf, "labels"), "doc_id", table(spark, sf, "documents"), "doc_id")


@query("referential_integrity_mixed", "select count(distinct value) as total_in_source, "
       "count(distinct value) filter (where value in (select user_id::double from events)) as matched from events")
def referential_integrity_mixed(spark, sf):
    """A fractional column against an integral one: 1.0 meets 1, 1.5 meets nothing."""
    events = table(spark, sf, "events")
    return L.referential_integrity(events, "value", events, "user_id").select("total_in_source", "matched")


@query("orphan_rows", "select distinct doc_id as value from documents where doc_id not in (select doc_id from labels)")
def orphan_rows(spark, sf):
    return L.orphan_values(table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels"), "doc_id")


def _key(t: str, c: str) -> str:
    return (f"select '{c}' as col, count({c}) as total_values, count(distinct {c}) as unique_values, "
            f"count({c}) - count(distinct {c}) as duplicate_count, count({c}) = count(distinct {c}) as is_unique_key from {t}")


@query("key_uniqueness", with_views("orders_dirty") + _key("orders_dirty", "o_custkey") + " union all " + _key("documents", "doc_id"))
def key_uniqueness(spark, sf):
    a = L.key_uniqueness(table(spark, sf, "orders_dirty"), "o_custkey")
    return a.unionByName(L.key_uniqueness(table(spark, sf, "documents"), "doc_id"))


def _report() -> str:
    parts = []
    for a, b, c in _shared():
        if "key" in c or "id" in c:
            parts.append(
                f"select '{a}' as table1, '{b}' as table2, '{c}' as col, 'FK/PK' as relationship_type, i.*, "
                f"(select count({c}) = count(distinct {c}) from t_{a}) as unique1, "
                f"(select count({c}) - count(distinct {c}) from t_{a}) as duplicates1, "
                f"(select count({c}) = count(distinct {c}) from t_{b}) as unique2, "
                f"(select count({c}) - count(distinct {c}) from t_{b}) as duplicates2 "
                f"from ({_integrity('t_' + a, c, 't_' + b, c)}) i")
        else:
            parts.append(f"select '{a}', '{b}', '{c}', {_KIND.format(c=c)}, null::bigint, null::bigint, null::bigint, "
                         "null::boolean, null::varchar, null::boolean, null::bigint, null::boolean, null::bigint")
    parts.sort(key=lambda p: "i.*" not in p)  # the first part names the columns
    return _renamed() + " union all ".join(parts)


@query("relationship_report", _report())
def relationship_report(spark, sf):
    return L.relationship_report(spark, _tables(spark, sf))


@query("column_intersection", _renamed() + " union all ".join(
    f"select '{c}' as col, count({c}) as present from t_orders" for c in ("orderkey", "status")))
def column_intersection(spark, sf):
    """Values in the columns two tables have in common."""
    tables = _tables(spark, sf)
    common = L.column_intersection(tables["orders"], tables["lineitem"])
    return P.per_column(tables["orders"], common, present=F.count).select(F.col("name").alias("col"), "present")


# Comparison of tables. The dirty views give scores that differ.

_COMPARED = ("orders_dirty", "customer_dirty", "shipments_dirty")


def _ranked(view: str) -> str:
    return S.checks(view) + (
        f"select '{view}' as table_name, total as score, {S.GRADE} as grade, (select rows from over) as rows, "
        "(select missing_pct from over) as missing_pct, (select count(*) from issues where severity = 'CRITICAL') as critical_issues, "
        "(select count(*) from issues where severity = 'HIGH') as high_issues from totals")


def _ranking_sql() -> str:
    return " union all ".join(f"select * from ({_ranked(v)})" for v in _COMPARED)


def _ranking(spark, sf):
    reports = []
    for v in _COMPARED:
        checks = C.check_table(table(spark, sf, v))
        over, best = checks.profile.overview.first(), Z.score(checks).first()
        counts = {r["severity"]: r["issues"] for r in Z.severity_counts(Z.issues(checks)).collect()}
        reports.append({"table_name": v, "score": best["total"], "grade": best["grade"], "rows": over["rows"],
                        "missing_pct": over["missing_pct"], "critical_issues": counts["CRITICAL"],
                        "high_issues": counts["HIGH"]})
    return L.table_ranking(spark, [*reports, {"table_name": "unread", "error": "not a table"}])


@query("table_ranking", _ranking_sql())
def table_ranking(spark, sf):
    return _ranking(spark, sf)


@query("compare_ranking", _ranking_sql())
def compare_ranking(spark, sf):
    """The ranking as the comparison of several tables gives it."""
    return compare(spark, {v: table(spark, sf, v) for v in _COMPARED}).ranking


@query("best_worst_table", f"""with r as ({_ranking_sql()})
    select (select table_name from r order by score desc, table_name limit 1) as best_table,
           (select table_name from r order by score, table_name desc limit 1) as worst_table""")
def best_worst_table(spark, sf):
    return L.best_worst_table(_ranking(spark, sf))


def _gaps(view: str) -> str:
    return with_views(view) + " union all ".join(
        f"select '{view}' as table_name, '{c}' as col, round((count(*) - count({c}))::double / count(*) * 100, 2) as pct from {view}"
        for c in S.names(view))


@query("problem_columns_topk", "select table_name, col, pct, " + S.missing_risk("pct", "(" + S.importance("col") + ")") +
       " as risk from (" + " union all ".join(f"select * from ({_gaps(v)})" for v in _COMPARED) +
       ") where pct > 5 order by pct desc, table_name, col limit 10")
def problem_columns_topk(spark, sf):
    found = None
    for v in _COMPARED:
        profile = P.profile_table(table(spark, sf, v), distinct="skip", quartiles=False, duplicates=False)
        rows = C.check_missing(profile).select(F.lit(v).alias("table_name"), "col", "pct", "risk")
        found = rows if found is None else found.unionByName(rows)
    return L.problem_columns_topk(found)


_LARGE = 9007199254740992  # from here on neighbouring integers are one double


@query("referential_integrity_decimal", f"""with a as (select distinct {_LARGE}::hugeint + o_orderkey as k from orders),
    b as (select distinct {_LARGE}::hugeint + o_orderkey + 1 as k from orders)
    select count(*) as total_in_source, count(b.k) as matched, count(*) - count(b.k) as missing_references,
           count(*) = count(b.k) as integrity_ok from a left join b on a.k = b.k""")
def referential_integrity_decimal(spark, sf):
    """Decimal keys against integer keys beyond what a double can tell apart."""
    key = F.col("o_orderkey") + F.lit(_LARGE)
    orders = table(spark, sf, "orders")
    return L.referential_integrity(orders.select(key.cast("decimal(22,2)").alias("k")), "k", orders.select((key + 1).alias("k")), "k").drop("sample_missing")


# Audit of names against identifiers.

def _audit(body: str) -> str:
    return with_views("responses") + body


_NORM = f"lower(trim({NAME}))"


def _responses(spark, sf):
    return table(spark, sf, "responses")


@query("basic_distinct_stats", _audit(f"select count(*) as rows, count(distinct {NAME}) as distinct_names, "
                                      f"count(distinct {IDENT}) as distinct_ids from responses"))
def basic_distinct_stats(spark, sf):
    return A.basic_distinct_stats(_responses(spark, sf), NAME, IDENT)


@query("format_split_ranges", _audit(f"select case when {IDENT} < 10000 then 'short' else 'long' end as id_format, "
                                     f"count(*) as rows, min({IDENT}) as min_id, max({IDENT}) as max_id from responses group by 1"))
def format_split_ranges(spark, sf):
    return A.format_split_ranges(_responses(spark, sf), IDENT)


_FENCE = f"""s as (select q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence
    from (select quantile_cont({IDENT}::double, 0.25) as q1, quantile_cont({IDENT}::double, 0.75) as q3 from responses))"""


@query("iqr_fences", with_views("responses").rstrip() + f", {_FENCE} select s.*, count(*) filter (where {IDENT} < lower_fence "
       f"or {IDENT} > upper_fence) as flagged, count(*) filter (where ({IDENT} < lower_fence or {IDENT} > upper_fence) "
       f"and {IDENT} < 10000) as flagged_short from responses, s group by all")
def iqr_fences(spark, sf):
    return A.iqr_fences(_responses(spark, sf), IDENT)


@query("normalize_text", _audit(f"select {NAME}, {_NORM} as name_norm, {IDENT} from responses"))
def normalize_text(spark, sf):
    return _responses(spark, sf).withColumn("name_norm", A.normalize_text(F.col(NAME)))


@query("normalization_gain", _audit(f"select count(distinct {NAME}) as raw_distinct, count(distinct {_NORM}) as normalized_distinct, "
                                    f"count(distinct {NAME}) - count(distinct {_NORM}) as fixed_by_normalization from responses"))
def normalization_gain(spark, sf):
    return A.normalization_gain(_responses(spark, sf), NAME)


@query("text_variants", _audit(f"""select name_norm, spelling, variants from
    (select distinct {_NORM} as name_norm, {NAME} as spelling from responses) a join
    (select {_NORM} as k, count(distinct {NAME}) as variants from responses group by 1 having count(distinct {NAME}) > 1) b
    on k = name_norm"""))
def text_variants(spark, sf):
    return A.text_variants(_responses(spark, sf), NAME)


@query("fd_violation_id_to_name", _audit(f"""select {IDENT} as id, {NAME} as name, count(*) as rows, max(n_names) as n_names
    from responses join (select {IDENT} as k, count(distinct {_NORM}) as n_names from responses group by 1
      having count(distinct {_NORM}) > 1) b on k = {IDENT} group by 1, 2"""))
def fd_violation_id_to_name(spark, sf):
    return A.fd_violation_id_to_name(_responses(spark, sf), NAME, IDENT)


@query("fd_violation_name_to_id", _audit(f"""select {_NORM} as name_norm, {IDENT} as id, count(*) as rows, max(n_ids) as n_ids
    from responses join (select {_NORM} as k, count(distinct {IDENT}) as n_ids from responses group by 1
      having count(distinct {IDENT}) > 1) b on k = {_NORM} group by 1, 2"""))
def fd_violation_name_to_id(spark, sf):
    return A.fd_violation_name_to_id(_responses(spark, sf), NAME, IDENT)


@query("trim_clean", _audit(f"select trim({NAME}) as {NAME}, {IDENT} from responses"))
def trim_clean(spark, sf):
    return A.trim_clean(_responses(spark, sf), NAME)


@query("dedupe_subset", _audit(f"select distinct {NAME}, {IDENT} from responses"))
def dedupe_subset(spark, sf):
    return A.dedupe_subset(_responses(spark, sf), [NAME, IDENT])


_CLEAN = f"""clean as (select distinct trim({NAME}) as {NAME}, {IDENT},
    case when {IDENT} < 10000 then 'short' else 'long' end as id_format from responses)"""
_GROUPED = f"""grouped as (select g.id_format, rows, q1, q3, case when rows >= 4 and q3 > q1 then
      (select count(*) from clean c where c.id_format = g.id_format and
        (c.{IDENT} < q1 - 1.5 * (q3 - q1) or c.{IDENT} > q3 + 1.5 * (q3 - q1))) else 0 end as outliers
    from (select id_format, count(*) as rows, quantile_cont({IDENT}::double, 0.25) as q1,
          quantile_cont({IDENT}::double, 0.75) as q3 from clean group by 1) g)"""


@query("grouped_iqr_outliers", with_views("responses").rstrip() + f", {_CLEAN}, {_GROUPED} select * from grouped")
def grouped_iqr_outliers(spark, sf):
    return A.grouped_iqr_outliers(A.clean_table(_responses(spark, sf), NAME, IDENT), IDENT)


@query("audit_summary", with_views("responses").rstrip() + f""", {_FENCE}, {_CLEAN}, {_GROUPED}
    select *, outliers_before - outliers_after as reduction from (select
      (select count(*) from responses, s where {IDENT} < lower_fence or {IDENT} > upper_fence) as outliers_before,
      (select sum(outliers)::bigint from grouped) as outliers_after,
      (select count(*) from responses where {IDENT} < 10000) as short_ids,
      (select count(distinct {NAME}) - count(distinct {_NORM}) from responses) as fixed_by_normalization,
      (select count(*) from (select 1 from responses group by {IDENT} having count(distinct {_NORM}) > 1)) as ids_with_several_names,
      (select count(*) from (select 1 from responses group by {_NORM} having count(distinct {IDENT}) > 1)) as names_with_several_ids)""")
def audit_summary(spark, sf):
    return A.audit_summary(_responses(spark, sf), NAME, IDENT)
