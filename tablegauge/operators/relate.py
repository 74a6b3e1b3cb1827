"""Relationships between tables: shared columns, key uniqueness, referential integrity, ranking."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions import keywords as K
from tablegauge.functions.classes import INTEGRALS, dtype_class, text_form
from tablegauge.functions.names import contains_any
from tablegauge.functions.nulls import normalize_nulls, quoted
from tablegauge.functions.session import local_rows
from tablegauge.operators.distinct import text_key


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table_no, table_name, column_name`` of every table, from the schemas."""
    rows = [(i, t, c) for i, (t, df) in enumerate(tables.items()) for c in df.columns]
    return local_rows(spark, rows, "table_no int, table_name string, column_name string")


def shared_columns(catalog: DataFrame) -> DataFrame:
    """Same-named columns of each unordered pair of tables, key-like names marked ``FK``."""
    a, b = catalog.alias("a"), catalog.alias("b")
    met = a.join(b, (F.col("a.column_name") == F.col("b.column_name")) & (F.col("a.table_no") < F.col("b.table_no")))
    kind = F.when(contains_any(F.col("a.column_name"), K.FOREIGN_KEY_WORDS), "FK").otherwise("shared_column")
    return met.select(
        F.col("a.table_name").alias("table1"), F.col("b.table_name").alias("table2"),
        F.col("a.column_name").alias("col"), kind.alias("relationship_type"),
    )


def column_intersection(first: DataFrame, second: DataFrame) -> list[str]:
    """Column names both tables have, in sorted order."""
    return sorted(set(first.columns) & set(second.columns))


def _family(dtype: T.DataType) -> str:
    cls = dtype_class(dtype)
    if cls == "numeric" and not isinstance(dtype, INTEGRALS):
        return "fraction"
    return cls if cls != "datetime" else f"datetime:{dtype.typeName()}"


def _number_key(c: Column, dtype: T.DataType, other: T.DataType) -> Column:
    """Numbers of different types as one text: 1 and 1.0 agree.

    Integers and decimals keep all digits. Only where a side is float or double are both compared
    as doubles.
    """
    if not any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (dtype, other)):
        text = c.cast("string")
        return F.when(text.contains("."), F.regexp_replace(text, "\\.?0+$", "")).otherwise(text)
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9.2e18)
    return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))


def _keys(first: DataFrame, col1: str, second: DataFrame, col2: str) -> tuple[DataFrame, DataFrame, bool]:
    """Distinct non-null values of both sides in one type, and whether they can be compared."""
    a = normalize_nulls(text_form(first.select(quoted(col1).alias("value"))))
    b = normalize_nulls(text_form(second.select(quoted(col2).alias("value"))))
    ta, tb = (x.schema["value"].dataType for x in (a, b))
    fa, fb = _family(ta), _family(tb)
    numbers = {"numeric", "fraction"}
    comparable = fa == fb or {fa, fb} <= numbers
    if comparable and fa in numbers and ta != tb and not (fa == fb == "numeric"):
        a = a.select(_number_key(F.col("value"), ta, tb).alias("value"))
        b = b.select(_number_key(F.col("value"), tb, ta).alias("value"))
    elif not comparable:
        a = a.select(F.col("value").cast("string").alias("value"))
    return a.dropna().distinct(), b.dropna().distinct(), comparable


def orphan_values(first: DataFrame, col1: str, second: DataFrame, col2: str) -> DataFrame:
    """``value``: distinct non-null values of the first column that the second does not hold.

    Both sides are made distinct before they meet, so a hot key is one row on each side.
    Values of different kinds (a number and a text) never match.
    """
    a, b, comparable = _keys(first, col1, second, col2)
    return a.join(b, "value", "left_anti") if comparable else a


def referential_integrity(
    first: DataFrame, col1: str, second: DataFrame, col2: str, sample: int = 5
) -> DataFrame:
    """One row: distinct source values, matched, missing, ok flag, and the smallest missing values."""
    a, b, comparable = _keys(first, col1, second, col2)
    if comparable:
        seen = a.join(b.withColumn("hit", F.lit(True)), "value", "left")
    else:
        seen = a.withColumn("hit", F.lit(None).cast("boolean"))
    counts = seen.agg(F.count("*").alias("total_in_source"), F.count("hit").alias("matched"))
    # The examples are a handful of rows whatever the size of either table.
    lost = seen.filter("hit is null").select("value").orderBy("value").limit(sample)
    examples = lost.agg(F.array_join(
        F.transform(F.sort_array(F.collect_list("value")), lambda v: v.cast("string")), ", ").alias("sample_missing"))
    gone = F.col("total_in_source") - F.col("matched")
    return counts.crossJoin(F.broadcast(examples)).select(
        "total_in_source", "matched", gone.alias("missing_references"), (gone == 0).alias("integrity_ok"),
        "sample_missing",
    )


def key_uniqueness(df: DataFrame, col: str) -> DataFrame:
    """One row: non-null values, distinct values, duplicates, and whether the column is a key."""
    flat = normalize_nulls(text_form(df.select(quoted(col).alias("value"))))
    if isinstance(flat.schema["value"].dataType, T.StringType):
        flat = flat.select(text_key(F.col("value")).alias("value"))  # long texts travel as digests
    # A grouped count first: a hot value is one row before it is shuffled.
    counted = flat.dropna().groupBy("value").agg(F.count("*").alias("n"))
    total, unique = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return counted.agg(total.alias("total_values"), unique.alias("unique_values")).select(
        F.lit(col).alias("col"), "total_values", "unique_values",
        (F.col("total_values") - F.col("unique_values")).alias("duplicate_count"),
        (F.col("total_values") == F.col("unique_values")).alias("is_unique_key"),
    )


_REPORT = (
    "table1 string, table2 string, col string, relationship_type string, total_in_source long, "
    "matched long, missing_references long, integrity_ok boolean, sample_missing string, "
    "unique1 boolean, duplicates1 long, unique2 boolean, duplicates2 long"
)


def _space(ta: T.DataType, tb: T.DataType) -> tuple[str, str] | None:
    """How values of two types are compared, as a name and the form they take; None if they are not."""
    fa, fb = _family(ta), _family(tb)
    if fa == fb == "numeric":
        return "integral", "integral"
    if {fa, fb} <= {"numeric", "fraction"} and ta != tb:
        floats = any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (ta, tb))
        return ("as doubles", "double") if floats else ("as digits", "digits")
    if fa != fb:
        return None
    return (ta.simpleString(), "own") if fa == "fraction" else (fa, "own")


def _in_form(c: Column, dtype: T.DataType, form: str) -> list[Column]:
    """A value as text, and the numbers that order it where it is compared in its own type."""
    whole, part = F.lit(None).cast("decimal(38,0)"), F.lit(None).cast("double")
    if form in ("double", "digits"):
        shown = _number_key(c, dtype, T.DoubleType() if form == "double" else dtype)
    else:
        shown = c.cast("string")
        if form == "integral":
            whole = c.cast("decimal(38,0)")
        elif form == "own" and isinstance(dtype, T.DecimalType):
            whole = F.floor(c).cast("decimal(38,0)")
            part = (c - F.floor(c)).cast("double")
        elif form == "own" and isinstance(dtype, (T.FloatType, T.DoubleType)):
            part = c.cast("double")
    return [shown.alias("shown"), whole.alias("whole"), part.alias("part")]


def _key_values(df: DataFrame, table_no: int, wanted: list[tuple[int, str, str]]) -> DataFrame:
    """``table_no, space, shown, whole, part``: the non-null values of key columns, read at once.

    ``wanted`` lists (number of the space, column, form).
    """
    names = sorted({c for _, c, _ in wanted})
    flat = normalize_nulls(text_form(df.select(*[quoted(c) for c in names])))
    each = [F.struct(F.lit(n).alias("space"), *_in_form(quoted(c), flat.schema[c].dataType, form)) for n, c, form in wanted]
    rows = flat.select(F.explode(F.array(*each)).alias("v")).select("v.*").filter("shown is not null")
    return rows.select(F.lit(table_no).alias("table_no"), "*")


def relationship_report(spark: SparkSession, tables: dict[str, DataFrame], sample: int = 5) -> DataFrame:
    """Every pair of tables: integrity (first to second) and key checks of shared key columns,
    plus the other shared columns as plain rows.

    One index answers for all pairs: each table's key columns are read together, equal values of a table are
    counted before they are shuffled, and every distinct value then knows the tables that hold it. Pairs are added up
    from the sets of tables that occur. Each table is read three times (counts, sets, examples) however many pairs it is
    in, and nothing runs before the result is asked for. Values of different
    kinds never match; columns of a name are compared as ``referential_integrity`` does for each two types.
    """
    names, spaces, pairs = list(tables), {}, []
    types = {(t, f.name): f.dataType for t, df in tables.items() for f in text_form(df).schema}
    wanted: dict[str, dict[tuple[int, str, str], None]] = {t: {} for t in tables}

    def numbered(t: str, col: str, name: str, form: str) -> int:
        n = spaces.setdefault((col, name), len(spaces))
        wanted[t][n, col, form] = None
        return n

    for t1, t2 in combinations(tables, 2):
        for col in column_intersection(tables[t1], tables[t2]):
            if not K.has_word(col, K.JOIN_KEY_WORDS):
                continue
            own = [numbered(t, col, *_space(types[t, col], types[t, col])) for t in (t1, t2)]
            met = _space(types[t1, col], types[t2, col])
            if met:
                n = numbered(t1, col, *met)
                numbered(t2, col, *met)
            else:  # a space of its own, where all values of the first table are alone
                n = numbered(t1, col, f"alone:{t1}", "text")
            pairs.append((names.index(t1), names.index(t2), t1, t2, col, n, *own))
    plain = shared_columns(column_catalog(spark, tables)).filter(~contains_any(F.col("col"), K.JOIN_KEY_WORDS))
    empty = local_rows(spark, [], _REPORT)
    if not pairs:
        return empty.unionByName(plain, allowMissingColumns=True)

    values = reduce(DataFrame.unionByName, [_key_values(tables[t], names.index(t), list(w)) for t, w in wanted.items() if w])
    counted = values.groupBy("space", "table_no", text_key(F.col("shown")).alias("key")).agg(
        F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("shown", "whole", "part")])
    unique = counted.groupBy("space", "table_no").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    held = counted.groupBy("space", "key").agg(
        F.sort_array(F.collect_list("table_no")).alias("held"), *[F.min(c).alias(c) for c in ("shown", "whole", "part")])
    order = ["whole", "part", "shown"]
    sets = held.groupBy("space", "held").agg(F.count("*").alias("n"))
    least = held.withColumn("place", F.row_number().over(Window.partitionBy("space", "held").orderBy(*order))).filter(F.col("place") <= sample)

    asked = F.broadcast(local_rows(  # from the schemas: a row for each pair of tables and key column
        spark, [(i, *p) for i, p in enumerate(pairs)],
        "pair int, no1 int, no2 int, table1 string, table2 string, col string, space int, own1 int, own2 int"))
    here, there = F.array_contains("held", F.col("no1")), F.array_contains("held", F.col("no2"))
    sums = asked.join(sets, "space").filter(here).groupBy("pair").agg(
        F.sum("n").alias("total"), F.sum(F.when(there, F.col("n"))).alias("hit"))
    lost = asked.join(least, "space").filter(here & ~there)
    first = lost.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy(*order))).filter(F.col("place") <= sample)
    examples = first.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("place", "shown"))).alias("few"))
    out = asked.join(sums, "pair", "left").join(examples, "pair", "left")
    for i in (1, 2):
        side = unique.select(F.col("space").alias(f"own{i}"), F.col("table_no").alias(f"no{i}"),
                             (F.col("total") - F.col("distinct")).alias(f"more{i}"))
        out = out.join(side, [f"own{i}", f"no{i}"], "left").withColumn(f"more{i}", F.coalesce(f"more{i}", F.lit(0)))
    total, hit = (F.coalesce(c, F.lit(0)) for c in ("total", "hit"))
    keys = out.select(
        "table1", "table2", "col", F.lit("FK/PK").alias("relationship_type"), total.alias("total_in_source"), hit.alias("matched"),
        (total - hit).alias("missing_references"), (total == hit).alias("integrity_ok"),
        F.coalesce(F.array_join("few.shown", ", "), F.lit("")).alias("sample_missing"),
        *[c for i in (1, 2) for c in ((F.col(f"more{i}") == 0).alias(f"unique{i}"), F.col(f"more{i}").alias(f"duplicates{i}"))])
    return empty.unionByName(keys).unionByName(plain, allowMissingColumns=True)


def table_ranking(spark: SparkSession, reports: list[dict]) -> DataFrame:
    """Tables by score, best first; tables that could not be read are left out."""
    rows = [
        (r["table_name"], r["score"], r["grade"], r["rows"], r["missing_pct"], r["critical_issues"], r["high_issues"])
        for r in reports if not r.get("error")
    ]
    schema = ("table_name string, score long, grade string, rows long, missing_pct double, "
              "critical_issues long, high_issues long")
    return local_rows(spark, rows, schema).orderBy(F.desc("score"), "table_name")


def best_worst_table(ranking: DataFrame) -> DataFrame:
    """One row: first and last of the ranking."""
    place = F.struct(-F.col("score"), F.col("table_name"))
    return ranking.agg(F.min_by("table_name", place).alias("best_table"), F.max_by("table_name", place).alias("worst_table"))


def problem_columns_topk(missing: DataFrame, k: int = 10) -> DataFrame:
    """The columns of all tables with the largest share of gaps above 5 %."""
    return missing.filter("pct > 5").orderBy(F.desc("pct"), "table_name", "col").limit(k)
