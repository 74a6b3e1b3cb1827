"""Readers and sinks on small files."""

import json
import zipfile

import pytest

from tablegauge.operators.history import history_recent, history_summary
from tablegauge.plans.analyze import analyze
from tablegauge.plans.compare import analyze_path
from tablegauge.sources import readers as R
from tablegauge.sources import sinks as K


def test_csv_tokens_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('n,r,s,d,b,e,f\n1,1.5,x,2020-01-01,True,,True\nNA,null,"a,b",2020-01-02,False,NaN,\n3,2e3,None,n/a,True,,False\n')
    df = R.scan_csv(spark, str(path))
    assert dict(df.dtypes) == {"n": "bigint", "r": "double", "s": "string", "d": "string", "b": "boolean", "e": "double", "f": "string"}
    rows = [tuple(r) for r in df.collect()]
    assert rows[1] == (None, None, "a,b", "2020-01-02", False, None, None)
    assert rows[2][:4] == (3, 2000.0, None, None)


def test_csv_numbers_that_python_reads_and_letters_that_it_does_not(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1d,1e5,12345678901234567890\n2f, 7 ,1\n")
    assert dict(R.scan_csv(spark, str(path)).dtypes) == {"a": "string", "b": "double", "c": "double"}


def test_json_records_lines_and_columns(spark, tmp_path):
    records, lines, columns, broken = (tmp_path / n for n in ("r.json", "l.json", "c.json", "x.json"))
    records.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}], indent=1))
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    columns.write_text('{"a":{"0":1,"1":2},"b":{"0":"x","1":"y"}}')
    broken.write_text('[{"a": 1}, {"a"')
    assert R.scan_json(spark, str(records)).count() == 2
    assert [r["a"] for r in R.scan_json(spark, str(lines)).collect()] == [1, 2]
    for bad in (columns, broken):
        with pytest.raises(ValueError):
            R.scan_json(spark, str(bad))


def test_csv_keeps_quoted_breaks_and_returns_long_records(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,a\n1,"x\ny ""z"", w",3\n4,5\n6,7,8,9\n"1,2",,\n')
    table, bad = R.scan_csv_rows(spark, str(path))
    assert table.columns == ["a", "b", "a.1"]
    assert {tuple(r) for r in table.collect()} == {("1", 'x\ny "z", w', 3), ("4", "5", None), ("1,2", None, None)}
    assert [tuple(r) for r in bad.collect()] == [("6,7,8,9", 4)]
    with pytest.raises(ValueError, match="4 cells"):
        R.scan_csv(spark, str(path))


def test_names_of_a_header():
    assert R.column_names(["a", None, "a", "A", "a.1", "b"]) == ["a", "Unnamed: 1", "a.1", "A.2", "a.1.1", "b"]


def test_json_folder_of_several_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n\n" + json.dumps([{"a": i, "b": "x"} for i in range(500)]))
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2, "c": true}\n{"a": 3}\n')
    (tmp_path / "c.json").write_text(json.dumps({"a": 7, "b": "y"}, indent=2))
    (tmp_path / "d.json").write_text("\n")
    got = R.scan_json(spark, str(tmp_path))
    assert got.count() == 504 and set(got.columns) == {"a", "b", "c"}


def test_catalog_records_long_records(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3,4,99\n")
    tables, errors = R.scan_catalog(spark, str(tmp_path))
    assert tables["t.csv"].count() == 1
    assert [tuple(r) for r in errors.collect()] == [("t.csv", "record with 3 cells: 3,4,99")]


def test_extension_decides_and_others_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert R.scan_by_extension(spark, str(tmp_path / "a.csv")).count() == 1
    with pytest.raises(ValueError, match="unsupported"):
        R.scan_by_extension(spark, str(tmp_path / "a.txt"))


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = tmp_path_factory.mktemp("zips") / "data.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one/t.csv", "id,v\n" + "".join(f"{i},{i % 5}\n" for i in range(12_000)))
        z.writestr("two/t.csv", "id,w\n1,a\n2,\"b\nc\"\n")
        z.writestr("lines.json", '{"id": 1, "u": 2.5}\n{"id": 2, "u": null}\n')
        z.writestr("records.json", '[{"id": 1}, {"id": 3}]')
        z.writestr("columns.json", '{"a": {"0": 1}}')
        z.writestr("broken.json", "[{")
        z.writestr("empty.csv", "a,b\n")
        z.writestr(".hidden.csv", "a\n1\n")
        z.writestr("__MACOSX/one/t.csv", "a\n1\n")
        z.writestr("notes.txt", "nothing")
    return str(path)


def test_archive_members_by_path(spark, archive):
    tables, errors = R.scan_archive(spark, archive)
    assert sorted(tables) == ["lines.json", "one/t.csv", "records.json", "two/t.csv"]
    assert tables["one/t.csv"].count() == 12_000 and dict(tables["one/t.csv"].dtypes) == {"id": "bigint", "v": "bigint"}
    assert [r["w"] for r in tables["two/t.csv"].orderBy("id").collect()] == ["a", "b\nc"]
    assert {r["table_name"] for r in errors.collect()} == {"columns.json", "broken.json", "empty.csv"}


def test_two_archives_and_one_that_is_none(spark, tmp_path):
    for n in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("t.csv", f"x\n{n}\n")
    (tmp_path / "c.zip").write_bytes(b"not a zip")
    tables, errors = R.scan_archive(spark, str(tmp_path))
    assert sorted(tables) == ["a.zip/t.csv", "b.zip/t.csv"]
    assert [r["table_name"] for r in errors.collect()] == ["c.zip"]


def test_members_of_many_archives_as_one_table(spark, tmp_path):
    """By column name, typed by the cells of all, with one scan for each header however many archives there are."""
    for n in range(8):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("d/t.csv", f"k,x\n{n},{n}.5\n" if n % 2 else f"x,k\n{n},{n}\n")
            z.writestr("d/r.json", f'[{{"k": {n}, "y": {n if n % 2 else n + 0.5}}}]' if n < 7 else '{"0": {"0": 1}}')
    tables, errors = R.scan_archive(spark, str(tmp_path))
    assert len(tables) == 15 and [r["table_name"] for r in errors.collect()] == ["7.zip/d/r.json"]
    cells, records = tables.together("d/t.csv"), tables.together("d/r.json")
    assert dict(cells.dtypes) == {"k": "bigint", "x": "double"} and dict(records.dtypes) == {"k": "bigint", "y": "double"}
    assert sorted((r["k"], r["x"]) for r in cells.collect()) == [(n, n + 0.5 if n % 2 else float(n)) for n in range(8)]
    assert sorted((r["k"], r["y"]) for r in records.collect()) == [(n, float(n) if n % 2 else n + 0.5) for n in range(7)]
    for df, scans in ((cells, 2), (records, 1)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == scans
    with pytest.raises(KeyError):
        tables.together("t.csv")


def test_archive_analysis_compares_its_tables(spark, archive):
    got = analyze_path(spark, archive)
    assert set(got.reports) == {"lines.json", "one/t.csv", "records.json", "two/t.csv"}
    assert got.ranking.count() == 4 and got.relationships.filter("col = 'id'").count() == 6


def test_catalog_skips_hidden_and_reports_empty(spark, tmp_path):
    (tmp_path / "sub" / "__MACOSX").mkdir(parents=True)
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "sub" / "b.json").write_text('[{"x": 1}]')
    (tmp_path / "sub" / "none.csv").write_text("x\n")
    (tmp_path / "sub" / ".h.csv").write_text("x\n1\n")
    (tmp_path / "sub" / "__MACOSX" / "c.csv").write_text("x\n1\n")
    tables, errors = R.scan_catalog(spark, str(tmp_path))
    assert sorted(tables) == ["a.csv", "sub/b.json"]
    assert [tuple(r) for r in errors.collect()] == [("sub/none.csv", "empty table")]


def test_report_document_and_history(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "a" if i % 3 else None) for i in range(40)], "x double, y string")
    report = analyze(df, "Y", "numbers")
    path = str(tmp_path / "report")
    K.sink_report_json(report.document(), path)
    got = spark.read.json(path).first()
    assert got["table_name"] == "numbers" and got["target_used"] == "y" and len(got["columns"]) == 2
    assert got["overview"]["rows"] == 40 and got["task_type"] == "classification"
    history = str(tmp_path / "history")
    for score, at in ((80, 1), (60, 2), (40, 3), (None, 4)):
        row = spark.createDataFrame([(f"t{at}", score, at)], "table_name string, score long, analyzed_at long")
        K.sink_history(row, history)
    stored = K.read_history(spark, history)
    assert history_summary(stored).first().asDict() == {
        "datasets": 4, "good": 1, "needs_attention": 1, "poor": 2, "recent_avg_score": 45}
    assert [r["table_name"] for r in history_recent(stored).collect()] == ["t4", "t3", "t2"]


def test_texts_without_braces_are_no_objects_and_not_parsed(spark, monkeypatch):
    texts = ['{"a":1}', ' {"a":2}\t', '{"a":3} x', '{"a":4},{"a":5}', "{", "}", '"a":6}', '{"a":7', "[{}]", "8", '{"a" 9}', '﻿{"a":10}']
    tried, parse = [], R.F.try_parse_json
    monkeypatch.setattr(R.F, "try_parse_json", lambda x: tried.append(1) or R.F.when(R.F.length(x) < 6, R.F.raise_error(x)).otherwise(parse(x)))
    parsed = R._parsed(spark.createDataFrame([("f", t) for t in texts], "file string, value string"))
    rows = parsed.selectExpr("record", "to_json(v) as v").collect()
    assert tried and sorted(r["v"] for r in rows if r["v"]) == ['{"a":1}', '{"a":2}']
    assert sorted(r["record"] for r in rows if r["record"]) == sorted(texts[2:])


def test_arrays_are_written_as_more_files_where_there_are_more_rows(spark, tmp_path):
    from suite.files import _arrays

    rows = spark.range(40).selectExpr("id", "to_json(struct(id)) as value")
    _arrays(rows, "id", f"{tmp_path}/many", most=5)
    found = [f for f in (tmp_path / "many").rglob("*.txt")]
    assert 4 < len(found) <= 8
    good, bad = R.scan_json_rows(spark, f"{tmp_path}/many")
    assert sorted(r["id"] for r in good.collect()) == list(range(40)) and bad.count() == 0


def test_parts_of_archives_are_joined_without_a_broadcast(spark, tmp_path):
    """Each part has a record for every order, however small its compressed records look."""
    from suite import files as Q

    spark.range(60).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'F' as o_orderstatus", "id * 1.5 as o_totalprice",
                               "timestamp_ntz'2020-01-02 00:00:00' as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    for query, joins in ((Q.scan_archive, 2), (Q.scan_archive_rows, 1)):
        got = query(spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin [o_orderkey") == joins and "BroadcastHashJoin [o_orderkey" not in plan
        assert got.count() == 60
