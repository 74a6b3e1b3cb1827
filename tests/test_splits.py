"""Records over the splits of a file: the same as from one task, whatever the size of a split."""

import csv
import json
import random
import zipfile

import pytest

from tablegauge.sources import readers as R
from tablegauge.sources import splits as S


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_breaks_in_many_splits(small_splits, tmp_path, end):
    own, path = random.Random(1), tmp_path / "t.csv"
    cells = ["plain", 'a "q" b', "line\nbreak", '"', "\n\n,", '5" pipe', "", "é,ü", "x" * 4_000 + "\n" + "y" * 4_000, '""', "a\n\"b\"\nc"]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["id", "note\nin two lines", "x"])
        out.writerows([i, own.choice(cells), own.choice([1.5, 2, ""])] for i in range(600))
    table, bad = R.scan_csv_rows(small_splits, str(path))
    with open(path, newline="", encoding="utf-8") as f:
        _, *expected = csv.reader(f)
    assert table.columns == ["id", "note\nin two lines", "x"] and bad.count() == 0
    assert rows_of(table, "id") == [(int(i), note or None, float(x) if x else None) for i, note, x in expected]
    if end == "\n":
        whole, _ = R.scan_csv_rows(small_splits, str(path), multi_line=True)
        assert table.dtypes == whole.dtypes and rows_of(table, "id") == rows_of(whole, "id")
    assert len({r.file for r in S.moves(S.pieces(small_splits, str(path), "\n"), S.Delimited()).collect()}) == 1
    assert S.moves(S.pieces(small_splits, str(path), "\n"), S.Delimited()).count() > 20


def test_separators_of_several_characters_and_quotes_inside_cells(small_splits, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id||b\n" + "".join(f'{i}||{("x y", chr(34) + "a||b" + chr(10) + "c" + chr(34), "5" + chr(34) + " pipe", "")[i % 4]}\n' for i in range(400)))
    table, bad = R.scan_csv_rows(small_splits, str(path), sep="||")
    assert [r["b"] for r in table.orderBy("id").collect()] == [("x y", "a||b\nc", '5" pipe', None)[i % 4] for i in range(400)] and bad.count() == 0


def test_long_records_next_to_quoted_breaks(small_splits, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join('1,"x\ny",9\n' if i % 5 == 0 else f'{i},"p\nq"\n' for i in range(500)))
    table, bad = R.scan_csv_rows(small_splits, str(path))
    assert table.count() == 400 and {tuple(r) for r in bad.collect()} == {('1,"x\ny",9', 3)} and bad.count() == 100


def test_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,10\n")
    (tmp_path / "2 %20x.csv").write_text("b,a\n30,3\n")
    (tmp_path / "3.csv").write_text('\n\nc,a\n"l\nm",5\n')
    (tmp_path / "4.csv").write_text("a,b\n")
    got = R.scan_csv(spark, str(tmp_path))
    assert {tuple(sorted(r.asDict().items(), key=str)) for r in got.collect()} == {
        (("a", 1), ("b", 10), ("c", None)), (("a", 3), ("b", 30), ("c", None)), (("a", 5), ("b", None), ("c", "l\nm"))}


def values(own, depth=0):
    kind = own.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return {own.choice(["k", "m}", "[", '"', "z\\"]) + str(i): values(own, depth + 1) for i in range(own.randrange(4))}
    if kind == 6:
        return [values(own, depth + 1) for _ in range(own.randrange(4))]
    return [1, 2.5, None, True, own.choice(["}", '{"a":1}', '\\"}', "x,y", "[", "]", "\\", '"', "\n", "é" * own.randrange(2_000)])][kind]


@pytest.mark.parametrize("form", ["array", "pretty array", "lines", "objects"])
def test_json_records_in_many_splits(small_splits, tmp_path, form):
    own = random.Random(3)
    rows = [{"id": i, "v": values(own)} for i in range(120)]
    text = {"array": lambda: json.dumps(rows), "pretty array": lambda: json.dumps(rows, indent=2) + "\n", "lines": lambda: "\n".join(map(json.dumps, rows)),
            "objects": lambda: "\n".join(json.dumps(r, indent=1, ensure_ascii=False) for r in rows)}[form]()
    (tmp_path / "t.json").write_text(text, encoding="utf-8")
    parsed = R.json_records(small_splits, str(tmp_path / "t.json"))
    got = sorted((json.loads(r["v"]) for r in parsed.selectExpr("cast(v as string) as v").collect()), key=lambda r: r["id"])
    assert got == rows and parsed.where("record is not null").count() == 0


@pytest.mark.parametrize("text,good,bad", [
    ('{"a":1}\n{"a":2\n{"a":3}\n{"a":4}\n', [1, 3, 4], ['{"a":2']), ('[{"a":1},{"a":2 x},{"a":3},{"a":4}]', [1, 3, 4], ['{"a":2 x}']), ('[{"a":1},{"a":2', [1], ['{"a":2']),
    ('[{"a":1},\n{"a" "},\n{"a":3}]', [1], ['{"a" "},\n{"a":3}]']), ('{\n"a":1\n}', [1], []), ('{\n"a":1\n}\n{\n"a":2', [1], ['{\n"a":2']), ("[]", [], []), ('﻿[{"a":1}]', [1], []),
    ('[{"a":1}] x', [1], ["] x"]), ('{"a":1,"a":2}\n{"a":3}', [3], ['{"a":1,"a":2}']), ('5\n{"a":3}\n"x"', [3], ["5", '"x"']), ('[{"a":1},3,{"a":2}]', [1], ['3,{"a":2}']),
])
def test_bad_records_are_records(spark, tmp_path, text, good, bad):
    (tmp_path / "t.json").write_text(text, encoding="utf-8")
    table, lost = R.scan_json_rows(spark, str(tmp_path / "t.json"))
    assert sorted(r["a"] for r in table.collect()) == good if good else table.columns == []
    assert sorted(r["record"] for r in lost.collect()) == sorted(bad)
    if bad:
        with pytest.raises(ValueError, match="no JSON object"):
            R.scan_json(spark, str(tmp_path / "t.json"))


def test_bad_records_of_catalogs_and_archives(spark, tmp_path):
    forms = {"lines.json": '{"a":1}\n{"a":2\n{"a":3}\n{"a":4}\n', "array.json": '[{"a":1},{"a":2 x},{"a":3},{"a":4}]', "whole.json": '{\n"a":1}\n{"a":\n2 x}\n{"a":3}{"a":\n4}'}
    (tmp_path / "folder").mkdir()
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        for name, text in forms.items():
            (tmp_path / "folder" / name).write_text(text)
            z.writestr(name, text)
    for tables, errors in (R.scan_catalog(spark, str(tmp_path / "folder")), R.scan_archive(spark, str(tmp_path / "t.zip"))):
        assert {n: sorted(r["a"] for r in t.collect()) for n, t in tables.items()} == dict.fromkeys(forms, [1, 3, 4])
        found = [tuple(r) for r in errors.collect()]
        assert sorted(n for n, _ in found) == sorted(forms) and all(e.startswith("record that is no JSON object: {") for _, e in found)


def test_members_are_partitions_and_jobs_do_not_depend_on_them(spark, tmp_path):
    def jobs(members):
        path = tmp_path / f"{members}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(members):
                z.writestr(f"{i}.csv", "a,b\n" + f"{i},x\n" * 50)
                z.writestr(f"{i}.json", '{"a": 1}\n' * 20)
        spark.dataSource.register(R.ZipMembers)
        assert spark.read.format("zip_members").load(str(path)).rdd.getNumPartitions() == 2 * members
        group = f"archive-{members}"
        spark.sparkContext.setJobGroup(group, group)
        tables, errors = R.scan_archive(spark, str(path))
        assert len(tables) == 2 * members and errors.count() == 0
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(9)


def test_states_of_both_beginnings():
    rules = S.Delimited()
    for piece, outside, inside in (("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('a,5" x,"y', True, True), ('"a"', False, False), ('x","y"', False, False), ('"a",b,"c\r', True, True)):
        assert (rules.moved(piece, False)[0], rules.moved(piece, True)[0]) == (outside, inside), piece
    assert S.Braces().moved('{"a": "}', False) == (True, 1) and S.Braces().moved('x", "b": [{"c": 1', True) == (False, 1)
    assert rules.cells('a,"b ""c"", d",,"e') == ["a", 'b "c", d', "", '"e']
