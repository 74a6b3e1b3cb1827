"""Relationships, audit, comparison and remediations on small literals."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tablegauge.operators import audit as A
from tablegauge.operators import relate as L
from tablegauge.operators import remediate as X
from tablegauge.plans.compare import compare


def test_integrity_counts_add_up(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id long")
    b = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    got = L.referential_integrity(a, "id", b, "id").first()
    assert got["matched"] + got["missing_references"] == got["total_in_source"] == 3
    assert got["sample_missing"] == "3" and not got["integrity_ok"]
    assert L.referential_integrity(b, "id", a, "id").first()["integrity_ok"]


def test_integrity_between_types(spark):
    whole = spark.createDataFrame([(1,), (2**60,)], "k long")
    real = spark.createDataFrame([(1.0,), (1.5,), (float("nan"),)], "k double")
    text = spark.createDataFrame([("1",)], "k string")
    assert L.referential_integrity(whole, "k", real, "k").first()["matched"] == 1
    assert L.referential_integrity(real, "k", whole, "k").first()["total_in_source"] == 2
    got = L.referential_integrity(whole, "k", text, "k").first()
    assert got["matched"] == 0 and got["missing_references"] == 2


def test_key_uniqueness(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    assert L.key_uniqueness(df, "k").first().asDict() == {
        "col": "k", "total_values": 3, "unique_values": 2, "duplicate_count": 1, "is_unique_key": False}


def test_relationship_report_has_key_checks_and_plain_columns(spark):
    tables = {
        "a": spark.createDataFrame([(1, "x"), (2, "y")], "cust_id long, city string"),
        "b": spark.createDataFrame([(1, "x"), (1, "z")], "cust_id long, city string"),
        "c": spark.createDataFrame([(1,)], "amount long"),
    }
    got = {(r["table1"], r["table2"], r["col"]): r for r in L.relationship_report(spark, tables).collect()}
    assert set(got) == {("a", "b", "cust_id"), ("a", "b", "city")}
    key = got[("a", "b", "cust_id")]
    assert key["relationship_type"] == "FK/PK" and key["missing_references"] == 1 and key["unique1"] and not key["unique2"]
    assert got[("a", "b", "city")]["relationship_type"] == "shared_column"


KEYED = {
    "longs": ("id long, other_key string", [(1, "a"), (2, "b"), (2, None), (-30, "a"), (None, "c" * 100), (400, "d")]),
    "ints": ("id int, other_key string", [(2, "b"), (400, "b"), (5, "c" * 100)]),
    "doubles": ("id double, other_key double", [(1.0, 1.0), (2.5, -0.0), (float("nan"), 0.0), (-30.0, 3.0), (1e300, 0.5)]),
    "decimals": ("id decimal(10,2), other_key decimal(10,2)", [("1.00", "0.50"), ("-2.50", "-1.25"), ("-2.75", None), ("7.10", "3.00")]),
    "texts": ("id string, other_key string", [("1", "a"), ("2.5", ""), (None, "zz")]),
    "days": ("id date, other_key string", [("2020-01-02", "a"), ("1999-12-31", "x")]),
    "none": ("id long, other_key string", []),
}


def keyed(spark):
    out = {}
    for name, (schema, rows) in KEYED.items():
        plain = ", ".join(f"{c.split()[0]} {'double' if 'double' in c else 'string'}" for c in schema.replace("(10,2)", "").split(", "))
        df = spark.createDataFrame([tuple(v if isinstance(v, float) or v is None else str(v) for v in r) for r in rows], plain)
        columns = [c.split(" ") for c in schema.replace("(10,2)", "(10;2)").split(", ")]
        out[name] = df.select([F.col(c).cast(t.replace(";", ",")).alias(c) for c, t in columns])
    return out


def test_relationship_report_agrees_with_the_checks_of_each_pair(spark):
    tables = keyed(spark)
    got = {(r["table1"], r["table2"], r["col"]): r for r in L.relationship_report(spark, tables).collect()}
    pairs = list(combinations(tables, 2))
    assert set(got) == {(a, b, c) for a, b in pairs for c in ("id", "other_key")}
    unique = {(t, c): L.key_uniqueness(df, c).first() for t, df in tables.items() for c in ("id", "other_key")}
    for a, b in pairs:
        for c in ("id", "other_key"):
            r = got[a, b, c].asDict()
            wanted = L.referential_integrity(tables[a], c, tables[b], c).first().asDict()
            assert {k: r[k] for k in wanted} == wanted, (a, b, c)
            for i, t in ((1, a), (2, b)):
                assert (r[f"unique{i}"], r[f"duplicates{i}"]) == (unique[t, c]["is_unique_key"], unique[t, c]["duplicate_count"])


def test_relationship_report_starts_no_job_and_its_reads_do_not_grow_with_the_pairs(spark, tmp_path):
    tables = {}
    for i in range(5):
        spark.range(10 * i, 10 * i + 30).withColumn("region_key", F.col("id") % 3).write.parquet(str(tmp_path / f"t{i}"))
        tables[f"t{i}"] = spark.read.parquet(str(tmp_path / f"t{i}"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    report = L.relationship_report(spark, tables)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert len(report.collect()) == 20
    plan = report._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= 3 * len(tables)  # counts, sets of tables, examples


def test_comparison_goes_on_after_an_empty_table(spark):
    tables = {
        "good": spark.range(50).select((F.col("id") % 9).alias("m")),
        "gappy": spark.range(50).select(F.when(F.col("id") > 40, 1).alias("order_no"), (F.col("id") % 9).alias("m")),
        "empty": spark.range(0).toDF("m"),
    }
    got = compare(spark, tables)
    assert [r["table_name"] for r in got.errors.collect()] == ["empty"]
    ranked = got.ranking.collect()
    assert len(ranked) == 2 and ranked[0]["score"] >= ranked[1]["score"]
    assert got.best_worst.first().asDict() == {"best_table": ranked[0]["table_name"], "worst_table": ranked[1]["table_name"]}
    assert [(r["table_name"], r["col"]) for r in got.problem_columns.collect()] == [("gappy", "order_no")]


@pytest.fixture(scope="module")
def responses(spark):
    """1,000 rows: 84 short identifiers, 916 long ones of which 23 lie far below the others."""
    rows = [(f"Name {i}", 1135 + i * 10) for i in range(84)]
    rows += [(f"Name {84 + i}", 21_600_000 + i) for i in range(23)]
    rows += [(f"Name {107 + i}", 21_800_000 + i * 80) for i in range(893)]
    rows[200] = ("name 108 ", rows[200][1])
    rows[300] = ("Somebody", rows[301][1])
    return spark.createDataFrame(rows, "customer_name string, response_id long")


def test_audit_of_mixed_formats(responses):
    got = A.audit_summary(responses, "customer_name", "response_id").first()
    assert got["short_ids"] == 84 and got["outliers_before"] == 107
    assert got["outliers_after"] == 23 and got["reduction"] == 84
    assert got["ids_with_several_names"] == 1 and got["names_with_several_ids"] == 1
    assert got["fixed_by_normalization"] == 1
    fences = A.iqr_fences(responses, "response_id").first()
    assert fences["flagged_short"] == 84


def test_small_groups_and_flat_groups_give_no_outliers(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)] + [("x", 20_000)] * 9 + [("y", 90_000)], "n string, i long")
    got = {r["id_format"]: r["outliers"] for r in A.grouped_iqr_outliers(df, "i").collect()}
    assert got == {"short": 0, "long": 0}


def test_variants_and_missing_identifiers(spark):
    df = spark.createDataFrame([("Ann", 1), ("ann ", 1), ("Bob", None), ("Cy", 2), ("Di", 2)], "n string, i long")
    assert {r["spelling"] for r in A.text_variants(df, "n").collect()} == {"Ann", "ann "}
    assert {(r["id"], r["name"]) for r in A.fd_violation_id_to_name(df, "n", "i").collect()} == {(2, "Cy"), (2, "Di")}
    assert A.fd_violation_name_to_id(df, "n", "i").count() == 0
    formats = {r["n"]: r["f"] for r in df.select("n", A.id_format_case(F.col("i")).alias("f")).collect()}
    assert formats["Bob"] == "long" and formats["Ann"] == "short"


def test_fill_median_is_exact_and_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,), (float("nan"),)], "x double")
    assert sorted(r["x"] for r in X.fix_fill_median(df, ["x"]).collect()) == [1.0, 2.0, 6.0, 6.0, 10.0, 20.0]


def test_fill_mode_of_ties_and_of_an_empty_column(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    assert sorted(r["x"] for r in X.fix_fill_mode(df, "x").collect()) == ["a", "a", "b"]
    none = spark.createDataFrame([(None,), (None,)], "x string")
    assert [r["x"] for r in X.fix_fill_mode(none, "x").collect()] == [None, None]


def test_sparse_columns_go_and_others_are_filled(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, "x")], "a double, b string")
    got = X.fix_drop_sparse_columns(df)
    assert got.columns == ["a"] and sorted(r["a"] for r in got.collect()) == [1.0, 2.0, 3.0]


def test_clips_keep_gaps(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    got = [r["x"] for r in X.fix_clip_iqr(df, ["x"]).collect()]
    assert got.count(None) == 1 and max(v for v in got if v is not None) == 7.0
    signs = spark.createDataFrame([(-1,), (2,), (None,)], "x long")
    assert sorted((r["x"] for r in X.fix_clip_negative(signs, ["x"]).collect()), key=str) == [0, 2, None]
    assert X.fix_drop_negative(signs, "x").count() == 1


def test_class_weights_balance_the_classes(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), (None,)], "y string")
    got = {r["y"]: r["class_weight"] for r in X.fix_class_weights(df, "y").collect()}
    assert got["a"] == pytest.approx(4 / 6) and got["b"] == pytest.approx(2.0) and got[None] is None


def test_standardize_uses_the_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    test = spark.createDataFrame([(5.0, 6.0)], "x double, c double")
    a, b = X.fix_standardize(train, ["x", "c"], also=[test])
    assert sorted(r["x"] for r in a.collect()) == [-1.0, 1.0]
    assert b.first().asDict() == {"x": 3.0, "c": 1.0}


def test_later_column_of_a_correlated_pair_goes(spark):
    df = spark.range(30).select((F.col("id") * 1.0).alias("a"), (F.col("id") * 2.0).alias("b"), ((F.col("id") * 7) % 11).alias("c"))
    assert X.fix_drop_correlated(df).columns == ["a", "c"]


def test_log1p_and_flags(spark):
    df = spark.createDataFrame([(0.0,), (-2.0,), (None,)], "X double")
    assert [r["X"] for r in X.fix_log1p(df, ["X"]).collect()] == [0.0, None, None]
    assert [r["has_x"] for r in X.fix_flag_present(df, "X").collect()] == [1, 1, 0]
