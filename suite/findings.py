"""Queries on quality checks, readiness, distributions, score and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import sqltext as S
from suite.views import table, with_views
from tablegauge.functions import rules as R
from tablegauge.functions.classes import select_by_class
from tablegauge.functions.nulls import normalize_nulls
from tablegauge.operators import checks as C
from tablegauge.operators import distributions as X
from tablegauge.operators import profile as P
from tablegauge.operators import readiness as Y
from tablegauge.operators import recommend as M
from tablegauge.operators import score as Z
from tablegauge.plans.analyze import analyze

QUERIES, ORACLES = {}, {}
SHIP = "shipments_dirty"


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _check(body: str, view: str = SHIP, target: str | None = None) -> str:
    return S.checks(view, target) + body


def _light(spark, sf, view=SHIP, target=None, distinct="skip", quartiles=False, duplicates=False):
    return P.profile_table(table(spark, sf, view), target, distinct=distinct, quartiles=quartiles, duplicates=duplicates)


# Checks.

@query("risk_missing", S.with_facts(SHIP) + f"select name, missing_pct, importance, "
       f"{S.missing_risk('missing_pct', 'importance')} as risk from ({S.profile()})")
def risk_missing(spark, sf):
    rows = _light(spark, sf).columns
    return rows.select("name", "missing_pct", "importance",
                       R.missing_risk(F.col("missing_pct"), F.col("importance")).alias("risk"))


@query("check_missing", _check("select col, missing, pct, risk, importance from missing"))
def check_missing(spark, sf):
    return C.check_missing(_light(spark, sf)).drop("ordinal")


@query("check_duplicates", _check("select * from dups"))
def check_duplicates(spark, sf):
    return C.check_duplicates(_light(spark, sf, duplicates=True))


@query("risk_outlier", _check("select name, greatest(outliers_iqr, outliers_zscore) as outliers, "
       + S.outlier_risk("greatest(outliers_iqr, outliers_zscore)", "(select rows from over)")
       + " as risk from prof where dtype_class = 'numeric'"))
def risk_outlier(spark, sf):
    profile = _light(spark, sf, quartiles=True, distinct="exact")
    most = F.greatest("outliers_iqr", "outliers_zscore")
    return profile.columns.filter("dtype_class = 'numeric'").select(
        "name", most.alias("outliers"), R.outlier_risk(most, F.lit(profile.facts.rows)).alias("risk"))


@query("check_outliers", _check("select col, iqr_count, zscore_count, risk, is_ordinal from outl"))
def check_outliers(spark, sf):
    return C.check_outliers(_light(spark, sf, quartiles=True, distinct="exact")).drop("ordinal")


@query("check_wrong_types", _check("select col, current_type, suggested_type from wrong"))
def check_wrong_types(spark, sf):
    return C.check_wrong_types(_light(spark, sf)).drop("ordinal")


@query("check_negative_invalid", _check("select col, count from neg"))
def check_negative_invalid(spark, sf):
    return C.check_negative_invalid(_light(spark, sf)).drop("ordinal")


@query("check_zero_invalid", _check("select col, count from zero", "customer_dirty"))
def check_zero_invalid(spark, sf):
    return C.check_zero_invalid(_light(spark, sf, "customer_dirty")).drop("ordinal")


@query("check_skewness", _check("select col, skewness, level from skews"))
def check_skewness(spark, sf):
    return C.check_skewness(_light(spark, sf, distinct="exact")).drop("ordinal")


@query("correlation_pairs", S.with_facts("lineitem_feat") + ", " + S.pairs("lineitem_feat", S.names("lineitem_feat", "numeric")) +
       " select col1, col2, round(r, 3) as correlation from pairs where r is not null and col1 not in "
       "(select name from facts where n_distinct <= 10) and col2 not in (select name from facts where n_distinct <= 10)")
def correlation_pairs(spark, sf):
    df = normalize_nulls(table(spark, sf, "lineitem_feat"))
    found = C.correlation_pairs(df, P.profile_table(df, quartiles=False, duplicates=False))
    return found.select("col1", "col2", F.round("r", 3).alias("correlation"))


@query("correlation_bands", _check("select col1, col2, band, correlation from bands"))
def correlation_bands(spark, sf):
    df = normalize_nulls(table(spark, sf, SHIP))
    found = C.correlation_pairs(df, P.profile_table(df, quartiles=False, duplicates=False))
    return C.correlation_bands(found).drop("position")


@query("flag_high_cv", _check("select name as col, cv from prof where cv > 2"))
def flag_high_cv(spark, sf):
    return C.flag_high_cv(_light(spark, sf)).drop("ordinal")


@query("flag_high_cardinality", S.with_facts("documents", False) +
       "select name as col, n_distinct as \"unique\", round(n_distinct::double / n_rows * 100, 2) as unique_pct from facts "
       "where dtype_class = 'categorical' and n_distinct::double / n_rows > 0.85")
def flag_high_cardinality(spark, sf):
    return C.flag_high_cardinality(_light(spark, sf, "documents", distinct="exact")).drop("ordinal")


_HIGH = "(dtype_class = 'categorical' and \"unique\"::double / (select rows from over) > 0.85)"


@query("column_flags", _check(f"""select name as col, dtype_class as dtype, missing, missing_pct,
    coalesce(greatest(outliers_iqr, outliers_zscore), 0) as outliers, skewness, is_constant as constant,
    {_HIGH} as high_cardinality, suggested_dtype <> '' as type_mismatch,
    case when is_constant or {_HIGH} or suggested_dtype <> '' or missing > 0
           or coalesce(greatest(outliers_iqr, outliers_zscore), 0) > 0 then 'review' else 'ok' end as status from prof"""))
def column_flags(spark, sf):
    return C.column_flags(_light(spark, sf, quartiles=True, distinct="exact")).drop("ordinal")


@query("target_correlation", S.with_facts("lineitem_feat") + " select * from (" + " union all ".join(
    f"select '{c}' as col, round(abs({S.corr(c, 'price_copy')}), 3) as abs_correlation from lineitem_feat"
    for c in S.names("lineitem_feat", "numeric") if c != "price_copy") +
    ") where abs_correlation is not null and col not in (select name from facts where "
    + S.id_like("name", "n_distinct", "n_rows") + ")")
def target_correlation(spark, sf):
    return C.target_correlation(table(spark, sf, "lineitem_feat"), "price_copy")


@query("empty_table", "select count(*) as rows, 0::bigint as profiled_columns, 0::bigint as issues from lineitem where l_quantity < 0")
def empty_table(spark, sf):
    """A filter over the whole table that leaves nothing: no division by zero, empty results."""
    df = table(spark, sf, "lineitem").filter("l_quantity < 0")
    checks = C.check_table(df)
    counts = [df.agg(F.count("*").alias("rows")), checks.profile.columns.agg(F.count("*").alias("profiled_columns")),
              Z.issues(checks).agg(F.count("*").alias("issues"))]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))


# Readiness.

def _suggest(view: str, derived: bool) -> str:
    points = (f"case when regexp_matches(lower(name), '{S.TARGET}') then 0.5 else 0.0 end + "
              f"case when {S.few('n_distinct', 'n_rows')} then 0.3 else 0.0 end + "
              "case when dtype_class in ('numeric', 'boolean') then 0.0 else 0.2 end")
    return S.with_facts(view, derived) + (
        f'select name as "column", confidence, n_distinct as unique_values, dtype_raw as dtype from (select *, '
        f"round(least({points}, 1.0), 2)::double as confidence from facts where not {S.id_like('name', 'n_distinct', 'n_rows')}) "
        "where confidence > 0 order by confidence desc, ordinal limit 5")


@query("suggest_targets", _suggest(SHIP, True))
def suggest_targets(spark, sf):
    return Y.suggest_targets(_light(spark, sf, distinct="exact")).drop("ordinal")


@query("task_type", with_views("lineitem_feat") +
       "select 'l_returnflag' as target, count(distinct l_returnflag) as classes, 'classification' as task_type from lineitem_feat "
       "union all select 'gappy', count(distinct gappy), case when count(distinct gappy) <= 20 then 'classification' else 'regression' end from lineitem_feat "
       "union all select 'tiny_var', count(distinct tiny_var), case when count(distinct tiny_var) <= 20 then 'classification' else 'regression' end from lineitem_feat")
def task_type(spark, sf):
    profile = _light(spark, sf, "lineitem_feat", distinct="exact")
    kinds = {t: Y.task_type(profile, t) for t in ("l_returnflag", "gappy", "tiny_var")}
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv]), F.col("name"))
    return profile.columns.filter(F.col("name").isin(*kinds)).select(
        F.col("name").alias("target"), F.col("unique").alias("classes"), kind.alias("task_type"))


@query("class_counts", "select toxic::varchar as class, count(*) as count from labels group by 1")
def class_counts(spark, sf):
    return Y.class_counts(table(spark, sf, "labels"), "toxic")


@query("class_imbalance", """with cc as (select toxic::varchar as c, count(*) as n from labels group by 1)
    select dominant_class, dominant_pct, minority_pct, case when dominant_pct > 90 then 'CRITICAL' when dominant_pct > 80 then 'HIGH'
      when dominant_pct > 70 then 'MEDIUM' else 'LOW' end as risk
    from (select (select c from cc order by n desc, c limit 1) as dominant_class, round(max(n)::double / sum(n) * 100, 2) as dominant_pct,
      round(min(n)::double / sum(n) * 100, 2) as minority_pct from cc)""")
def class_imbalance(spark, sf):
    return Y.class_imbalance(table(spark, sf, "labels"), "toxic")


@query("target_skewness", "select round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 4) as target_skewness "
       "from events, (select avg(value) as m from events)")
def target_skewness(spark, sf):
    return Y.target_skewness(table(spark, sf, "events"), "value")


@query("leakage_columns", with_views("lineitem_feat") + "select col, round(r, 3) as correlation from (" + " union all ".join(
    f"select '{c}' as col, {S.corr(c, 'price_copy')} as r from lineitem_feat"
    for c in S.names("lineitem_feat", "numeric") if c != "price_copy") + ") where abs(r) > 0.95")
def leakage_columns(spark, sf):
    return Y.leakage_columns(table(spark, sf, "lineitem_feat"), "price_copy").drop("position")


@query("low_variance", with_views("lineitem_feat") + "select col, round(v, 6) as variance from (" + " union all ".join(
    f"select '{c}' as col, var_samp({c}) as v from lineitem_feat" for c in S.names("lineitem_feat", "numeric")) + ") where v < 0.01")
def low_variance(spark, sf):
    return Y.low_variance(table(spark, sf, "lineitem_feat"), "l_returnflag")


def _histogram(view: str, cols: list[str]) -> str:
    """Right-closed bins by their edges, as the axis cuts them."""
    parts = []
    for c in cols:
        edge = "(lo + {i} * ((hi - lo) / 8))"
        bins = "case " + " ".join(f"when x <= {edge.format(i=i)} then {i}" for i in range(1, 8)) + " else 8 end"
        low = "case when b = 1 then lo - (hi - lo) * 0.001 else lo + (b - 1) * ((hi - lo) / 8) end"
        high = "case when b = 8 then hi else lo + b * ((hi - lo) / 8) end"
        parts.append(f"""select '{c}' as col, b as bin,
            format('{{:.2g}}', {low}) || '–' || format('{{:.2g}}', {high}) as label, coalesce(n, 0) as count
            from (select unnest(range(1, 9)) as b) g
            left join (select {bins} as bin, count(*) as n from
              (select {c}::double as x, min({c}::double) over () as lo, max({c}::double) over () as hi from {view} where {c} is not null)
              group by 1) h on h.bin = g.b,
            (select min({c})::double as lo, max({c})::double as hi from {view}) e""")
    return " union all ".join(parts)


@query("histogram", with_views("lineitem_feat") + _histogram("lineitem_feat", ["l_quantity", "l_discount", "l_tax", "tiny_var"]))
def histogram(spark, sf):
    return _histograms(spark, sf, 4)


def _histograms(spark, sf, limit):
    df = select_by_class(table(spark, sf, "lineitem_feat").drop("const_num"), "numeric")
    facts = P.profile_table(df, quartiles=False, duplicates=False).facts
    return X.histogram(df, facts, X.histogram_columns(facts, limit=limit))


@query("histogram_all", with_views("lineitem_feat") + _histogram("lineitem_feat", ["l_quantity", "l_discount", "l_tax", "tiny_var", "gappy"]))
def histogram_all(spark, sf):
    """All numeric columns that are no identifiers."""
    return _histograms(spark, sf, None)


@query("histogram_events", _histogram("events", ["value"]))
def histogram_events(spark, sf):
    df = table(spark, sf, "events").select("value")
    facts = P.profile_table(df, quartiles=False, duplicates=False, distinct="skip").facts
    return X.histogram(df, facts, ["value"])


def _bars(view: str, cols: list[str]) -> str:
    return " union all ".join(
        f"select * from (select '{c}' as col, row_number() over (order by count(*) desc, {c}) as rank, {c} as value, "
        f"count(*) as count from {view} where {c} is not null group by {c}) where rank <= 10" for c in cols)


@query("category_bars", with_views(SHIP) + _bars(SHIP, ["notes", "ship_day", "tax_text"]))
def category_bars(spark, sf):
    return _bars_of(spark, sf, 3)


def _bars_of(spark, sf, limit):
    df = table(spark, sf, SHIP)
    return X.category_bars(df, X.bar_columns(df, P.profile_table(df, quartiles=False, duplicates=False).facts, limit=limit))


@query("category_bars_all", with_views(SHIP) + _bars(SHIP, ["notes", "ship_day", "tax_text", "flag", "outcome"]))
def category_bars_all(spark, sf):
    """All text columns that are no identifiers."""
    return _bars_of(spark, sf, None)


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_copy", "const_num"]


def _matrix(names: list[str]) -> str:
    out = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            r = f"case when var_pop({a}) > 0 then 1.0::double end" if i == j else f"round({S.corr(*sorted((a, b), key=names.index))}, 3)"
            out.append(f"select {i} as row_no, {j} as col_no, '{a}' as col1, '{b}' as col2, {r} as r from lineitem_feat")
    return with_views("lineitem_feat") + " union all ".join(out)


def _matrix_of(spark, sf, limit):
    df = normalize_nulls(table(spark, sf, "lineitem_feat"))
    profile = P.profile_table(df, "l_quantity", quartiles=False, duplicates=False, distinct="skip")
    return X.correlation_matrix(df, profile, "l_quantity", limit)


@query("correlation_matrix", _matrix(_MATRIX))
def correlation_matrix(spark, sf):
    return _matrix_of(spark, sf, 6)


@query("correlation_matrix_all", _matrix([*_MATRIX, "tiny_var", "gappy"]))
def correlation_matrix_all(spark, sf):
    """All numeric columns."""
    return _matrix_of(spark, sf, None)


# Severity and score.

def _checked(spark, sf, target=None):
    return C.check_table(table(spark, sf, SHIP), target)


def _parts(spark, sf, **passes):
    """Parts of the score, with the passes that the wanted part looks at."""
    return Z.score_parts(C.TableChecks(table(spark, sf, SHIP), _light(spark, sf, **passes)))


def _score(spark, sf, view):
    """The score needs no correlations."""
    df = table(spark, sf, view)
    return Z.score(C.TableChecks(df, P.profile_table(df)))


@query("issues", _check("select * from issues"))
def issues(spark, sf):
    return Z.issues(_checked(spark, sf))


@query("severity_counts", _check("""select severity, rank, coalesce(n, 0) as issues, (select count(*) from issues) as total
    from (values ('CRITICAL', 0), ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3)) l(severity, rank)
    left join (select severity as s, count(*) as n from issues group by 1) on s = severity"""))
def severity_counts(spark, sf):
    return Z.severity_counts(Z.issues(_checked(spark, sf)))


@query("score_completeness", _check("select round(completeness, 4) as completeness from parts"))
def score_completeness(spark, sf):
    return _parts(spark, sf).select(F.round("completeness", 4).alias("completeness"))


@query("score_consistency", _check("select round(consistency, 4) as consistency from parts"))
def score_consistency(spark, sf):
    return _parts(spark, sf, duplicates=True).select(F.round("consistency", 4).alias("consistency"))


@query("score_validity", _check("select round(validity, 4) as validity from parts"))
def score_validity(spark, sf):
    return _parts(spark, sf, distinct="exact", quartiles=True).select(F.round("validity", 4).alias("validity"))


@query("score_usability", _check("select usability::double as usability from parts"))
def score_usability(spark, sf):
    return _parts(spark, sf, distinct="exact").select(F.col("usability").cast("double").alias("usability"))


@query("score_total", _check("select total, round(completeness)::bigint as completeness, round(consistency)::bigint as consistency, "
       "round(validity)::bigint as validity, round(usability)::bigint as usability from totals"))
def score_total(spark, sf):
    return _score(spark, sf, SHIP).drop("grade", "tier")


@query("score_customer", _check("select total, round(completeness)::bigint as completeness, round(consistency)::bigint as consistency, "
       "round(validity)::bigint as validity, round(usability)::bigint as usability from totals", "customer_dirty"))
def score_customer(spark, sf):
    return _score(spark, sf, "customer_dirty").drop("grade", "tier")


@query("grade", _check(f"select total, {S.GRADE} as grade from totals"))
def grade(spark, sf):
    return _score(spark, sf, SHIP).select("total", "grade")


@query("quality_tier", _check(f"select total, {S.TIER} as tier from totals", "customer_dirty"))
def quality_tier(spark, sf):
    return _score(spark, sf, "customer_dirty").select("total", "tier")


# Recommendations: what each rule says about the data.

_SHOWN = ["priority", "title", "problem", "fix"]
_KEY = "regexp_matches(lower(col), '_id|id_|customerid|orderid|productid')"
_KIND = (f"case when importance = 'OPTIONAL' then 'optional' when importance = 'CRITICAL' and {_KEY} then 'key' "
         f"when regexp_matches(lower(col), '{S.FINANCIAL}') then 'financial' else 'generic' end")
_RANK = "case risk when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end"
_ONE = "printf('%.1f', round({}, 1))"

_REC = {
    "recommend_missing": f"""select case kind when 'optional' then 'LOW' when 'key' then 'HIGH'
          when 'financial' then case when pct > 10 then 'HIGH' else 'MEDIUM' end
          else case when pct > 30 then 'HIGH' when pct > 5 then 'MEDIUM' else 'LOW' end end as priority,
        case kind when 'optional' then 'Optional field missing: ' when 'key' then 'Critical key missing: '
          when 'financial' then 'Financial column missing: ' else 'Handle missing values: ' end || col as title,
        col || ' has ' || {_ONE.format('pct')} || '% missing values' ||
          case when kind = 'key' then ' in a primary/foreign key column.' else '.' end as problem,
        case when kind = 'optional' then 'fix_fill_constant(df, ''' || col || ''', ''Not Provided'')'
          when kind = 'key' then 'fix_drop_missing_keys(df, [''' || col || '''])  # or fix_flag_present(df, ''' || col || ''')'
          when kind = 'generic' and pct > 30 then 'fix_drop_sparse_columns(df, [''' || col || '''])'
          when kind = 'generic' and pct > 5 then 'fix_fill_median(df, [''' || col || '''])  # text: fix_fill_mode(df, ''' || col || ''')'
          else 'fix_fill_median(df, [''' || col || '''])' end as fix
      from (select *, {_KIND} as kind from missing order by {_RANK}, pct desc, ordinal limit 7)""",
    "recommend_duplicates": f"""select case when duplicate_pct > 5 then 'HIGH' else 'MEDIUM' end as priority,
        'Remove Duplicate Rows' as title, format('{{:,}}', duplicate_rows) || ' duplicate rows (' ||
        {_ONE.format('duplicate_pct')} || '%).' as problem, 'fix_drop_duplicates(df)' as fix from dups where duplicate_rows > 0""",
    "recommend_correlation": """select 'MEDIUM' as priority, 'Remove Redundant Correlated Features' as title,
        (select count(*) from bands where band = 'high')::varchar || ' feature pair(s) with |r|>0.9 (e.g. ' || col1 || ' ↔ ' ||
        col2 || ', r=' || correlation::varchar || ').' as problem, 'fix_drop_correlated(df)' as fix
        from bands where band = 'high' order by position limit 1""",
    "recommend_scaling": """select 'LOW' as priority, 'Scale Numeric Features Before Training' as title,
        'Numeric features likely have different scales.' as problem,
        'fix_standardize(train, columns, also=[test])' as fix from over""",
}


def _listing(src: str, k: int, priority: str, title: str, problem: str, call: str) -> str:
    return f"""select '{priority}' as priority, '{title}' as title,
        replace('{problem}', '%s', string_agg(col, ', ' order by ordinal)) as problem,
        '{call}(df, [' || string_agg('''' || col || '''', ', ' order by ordinal) || '])' as fix
        from (select * from ({src}) order by ordinal limit {k}) having count(*) > 0"""


_REC["recommend_outliers"] = _listing(
    "select * from outl where risk in ('HIGH', 'MEDIUM') and not is_ordinal", 3, "HIGH",
    "Handle Outliers in Continuous Columns", "Statistical outliers found in: %s.", "fix_clip_iqr")
_REC["recommend_datetime"] = _listing(
    "select * from wrong where suggested_type = 'datetime'", 4, "MEDIUM", "Convert Date Columns to datetime",
    "Columns stored as strings but contain dates: %s.", "fix_parse_datetime")
_REC["recommend_numeric"] = _listing(
    "select * from wrong where suggested_type = 'numeric'", 4, "MEDIUM",
    "Convert Numeric Columns Stored as Strings", "Numeric data stored as text: %s.", "fix_parse_numeric")
_REC["recommend_skew"] = _listing(
    "select * from skews where level = 'HIGH'", 3, "MEDIUM", "Fix Highly Skewed Features",
    "Columns with |skewness|>2: %s.", "fix_log1p")
_REC["recommend_negative"] = _listing(
    "select * from neg", 3, "HIGH", "Fix Invalid Negative Values", "Negative values where impossible: %s.", "fix_clip_negative")


def _recommend(name: str, needs: dict):
    @query(name, _check(_REC[name]))
    def run(spark, sf):
        if needs is None:
            checks = _checked(spark, sf)
        else:
            checks = C.TableChecks(table(spark, sf, SHIP), _light(spark, sf, **needs))
        return getattr(M, name)(checks).select(*_SHOWN)


_recommend("recommend_missing", {})
_recommend("recommend_duplicates", {"duplicates": True})
_recommend("recommend_outliers", {"quartiles": True, "distinct": "exact"})
_recommend("recommend_datetime", {})
_recommend("recommend_numeric", {})
_recommend("recommend_skew", {"distinct": "exact"})
_recommend("recommend_correlation", None)
_recommend("recommend_negative", {})


_CC = "cc as (select outcome as c, count(*) as n from shipments_dirty group by 1)"
_IMBALANCE = f"""select 'HIGH' as priority, 'Address Class Imbalance' as title, 'Target dominant class: ' || {_ONE.format('d')} ||
    '%, minority: ' || {_ONE.format('m')} || '%.' as problem, 'fix_class_weights(df, ''outcome'')' as fix
    from (select round(max(n)::double / sum(n) * 100, 2) as d, round(min(n)::double / sum(n) * 100, 2) as m from cc) where d > 80"""


@query("recommend_imbalance", with_views(SHIP) + ", " + _CC + _IMBALANCE)
def recommend_imbalance(spark, sf):
    df = table(spark, sf, SHIP)
    ready = Y.Readiness(df, _light(spark, sf, target="outcome", distinct="exact"), "outcome")
    return M.recommend_imbalance(spark, ready).select(*_SHOWN)


_LEAK = _listing(
    "select * from (" + " union all ".join(
        f"select '{c}' as col, {i} as ordinal, {S.corr(c, 'price_copy')} as r from {SHIP}"
        for i, c in enumerate(x for x in S.names(SHIP, "numeric") if x != "price_copy")) + ") where abs(r) > 0.95",
    3, "HIGH", "Potential Data Leakage Detected", "Near-perfect correlation to target in: %s.", "fix_drop_leakage")


@query("recommend_leakage", with_views(SHIP) + _LEAK)
def recommend_leakage(spark, sf):
    df = normalize_nulls(table(spark, sf, SHIP))
    ready = Y.Readiness(df, _light(spark, sf, target="price_copy", distinct="exact"), "price_copy")
    return M.recommend_leakage(spark, ready).select(*_SHOWN)


@query("recommend_scaling", _check(_REC["recommend_scaling"]))
def recommend_scaling(spark, sf):
    """Given for every table that has rows."""
    any_row = table(spark, sf, SHIP).agg(F.count("*").alias("n")).filter("n > 0")
    return M.recommend_scaling(spark).crossJoin(F.broadcast(any_row)).select(*_SHOWN)


_ORDER = ["recommend_missing", "recommend_duplicates", "recommend_outliers", "recommend_datetime", "recommend_numeric",
          "recommend_skew", "recommend_correlation", "recommend_negative"]


@query("recommendations", S.checks(SHIP, "outcome").rstrip() + ", " + _CC + " " + " union all ".join(
    f"select {i} as block, * from ({_REC[n]})" for i, n in enumerate(_ORDER)) +
    f" union all select 8 as block, * from ({_IMBALANCE}) union all select 10 as block, * from ({_REC['recommend_scaling']})")
def recommendations(spark, sf):
    report = analyze(table(spark, sf, SHIP), "outcome", SHIP)
    return report.recommendations.select("block", *_SHOWN)
