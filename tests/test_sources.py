"""Workbooks and delimited text as sources, and writes in stages."""

import json
import os
import zipfile

import pytest

from docframe.sources import delimited, packages, stores, structured, workbooks

SHEET = [["id", "name", "score", "on", "mixed"], [1, "a", 1.5, True, 1], [2, None, 2, False, "x"], [3, "c|\nd", None, None, None]]


@pytest.fixture(scope="module")
def source(spark):
    workbooks.register(spark)
    return spark


def put(folder, name, data):
    (folder / name).write_bytes(data)
    return str(folder / name)


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_types_and_partitions(source, tmp_path, kind):
    write = packages.write_xlsx if kind == "xlsx" else packages.write_ods
    path = put(tmp_path, f"b.{kind}", write({"A": SHEET, "B": [["id"], ["only"]]}))
    df = source.read.format("workbook").load(path)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double", "on": "boolean", "mixed": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a", 1.5, True, "1"), (2, None, 2.0, False, "x"), (3, "c|\nd", None, None, None)]
    cut = source.read.format("workbook").option("rowsPerPartition", 1).load(path)
    assert cut.rdd.getNumPartitions() >= 4 and sorted(cut.collect(), key=str) == sorted(df.collect(), key=str)
    other = source.read.format("workbook").option("sheet", "B").option("metadata", "true").load(path)
    assert [tuple(r) for r in other.collect()] == [("only", path, "B", 2)]
    every = source.read.format("workbook").option("sheet", "*").schema("id string, _sheet string").load(path)
    assert sorted(map(tuple, every.collect())) == [("1", "A"), ("2", "A"), ("3", "A"), ("only", "B")]


def test_filters_are_pushed(source, tmp_path):
    for k in range(3):
        put(tmp_path, f"f{k}.xlsx", packages.write_xlsx({"A": [["id", "name"], *[[10 * k + j, f"n{j}" if j != 5 else None] for j in range(10)]]}))

    def read(*conditions):
        return source.read.format("workbook").option("metadata", "true").option("filters", json.dumps(conditions)).load(f"{tmp_path}/*.xlsx")

    some = read(("_file", "=", f"{tmp_path}/f1.xlsx"), ("id", ">=", 14), ("name", "in", ["n4", "n9", "n0"]), ("name", "is not null"))
    assert some.rdd.getNumPartitions() == 1 and sorted(r["id"] for r in some.collect()) == [14, 19]
    assert sorted(r["id"] for r in read(("name", "is null")).collect()) == [5, 15, 25]
    assert read(("name", "<>", "n1")).count() == 24 and read(("_file", "=", "none")).collect() == [] and read().count() == 30
    with pytest.raises(Exception, match="no column other"):
        read(("other", "=", 1)).collect()


def test_broken_records(source, tmp_path):
    path = put(tmp_path, "r.xlsx", packages.write_xlsx({"A": [["id", "n"], [1, 2], [3, "x"], [4, 5, 6], [None, None], [7]]}))
    read = lambda mode: source.read.format("workbook").option("mode", mode).schema("id long, n long, _corrupt_record string").load(path)
    with pytest.raises(Exception, match="row 3: n: 'x' is no bigint"):
        read("FAILFAST").collect()
    assert [tuple(r) for r in read("DROPMALFORMED").collect()] == [(1, 2, None), (7, None, None)]
    assert [tuple(r) for r in read("PERMISSIVE").collect()] == [(1, 2, None), (3, None, '[3, "x"]'), (4, 5, "[4, 5, 6]"), (7, None, None)]
    with pytest.raises(Exception, match="no column other"):
        source.read.format("workbook").schema("other long").load(path).collect()
    with pytest.raises(Exception, match="no sheet C"):
        source.read.format("workbook").option("sheet", "C").load(path)


def test_names_and_no_header(source, tmp_path):
    path = put(tmp_path, "n.xlsx", packages.write_xlsx({"A": [["a", "a", None, 3], [1, 2, 3, 4]]}))
    assert source.read.format("workbook").load(path).columns == ["a", "a_2", "_c2", "3"]
    bare = source.read.format("workbook").option("header", "false").load(path)
    assert bare.columns == ["_c0", "_c1", "_c2", "_c3"] and sorted(map(tuple, bare.collect())) == [("1", "2", 3, 4), ("a", "a", None, 3)]


def test_blank_runs_of_sheets(source, tmp_path):
    cells = '<table:table-cell office:value-type="float" office:value="{}"/>'
    blank = '<table:table-row table:number-rows-repeated="1048576"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    body = f'<table:table-row><table:table-cell office:value-type="string"><text:p>v</text:p></table:table-cell></table:table-row><table:table-row table:number-rows-repeated="3">{cells.format(5)}</table:table-row>{blank}<table:table-row>{cells.format(6)}</table:table-row>{blank}'
    path = put(tmp_path, "o.ods", packages.odf_package("ods", f'<office:spreadsheet><table:table table:name="A">{body}</table:table></office:spreadsheet>'))
    df = source.read.format("workbook").option("metadata", "true").load(path)
    assert [(r["v"], r["_row"]) for r in df.collect()] == [(5, 2), (5, 3), (5, 4), (6, 1048576 + 5)]


def test_written_and_read(source, tmp_path):
    df = source.range(2500).selectExpr("id", "concat('n', id) AS name", "id / 4 AS q", "id % 2 = 0 AS even", "cast(null AS string) AS none")
    for kind in ("xlsx", "ods"):
        to = f"{tmp_path}/{kind}"
        df.repartition(3).write.format("workbook").option("kind", kind).option("rowsPerFile", 600).mode("append").save(to)
        assert sorted(source.read.format("workbook").schema(df.schema).load(to).collect()) == sorted(df.collect())
        assert len([f for f in os.listdir(to) if f.endswith(kind)]) == 6 and not os.path.exists(f"{to}/_temporary")
        with pytest.raises(Exception, match="holds files"):
            df.write.format("workbook").option("kind", kind).mode("append").save(to)
        assert source.read.format("workbook").schema("id long").load(to).count() == 2500
    to = f"{tmp_path}/xlsx"
    df.limit(5).write.format("workbook").option("exists", "append").mode("append").save(to)
    assert source.read.format("workbook").load(to).count() == 2505
    df.limit(7).write.format("workbook").mode("overwrite").save(to)
    assert source.read.format("workbook").load(to).count() == 7 and len(os.listdir(to)) == 2
    with pytest.raises(Exception, match="cast date"):
        source.sql("SELECT current_date() AS d").write.format("workbook").mode("append").save(f"{tmp_path}/d")


def test_failed_task_leaves_nothing(source, tmp_path):
    df = source.range(100, numPartitions=4).selectExpr("concat('d', id, '.txt') AS name", "if(id = 77, raise_error('no'), cast(id AS string)) AS content")
    with pytest.raises(Exception, match="no"):
        df.write.format("document_files").mode("append").save(f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out") or {f for f in os.listdir(f"{tmp_path}/out")} <= {"_temporary"}
    assert not os.path.exists(f"{tmp_path}/out") or stores.find(f"{tmp_path}/out")[1] == []


def test_files_all_or_none(source, tmp_path):
    to, rows = f"{tmp_path}/out", lambda *r: source.createDataFrame(list(r), "name string, content binary, error string")
    rows(("a/x.txt", b"1", None), ("y.txt", b"2", None), ("z.txt", None, "broken")).write.format("document_files").mode("append").save(to)
    with pytest.raises(Exception, match="y.txt exists"):
        rows(("new.txt", b"3", None), ("y.txt", b"4", None)).write.format("document_files").mode("append").save(to)
    assert open(f"{to}/y.txt").read() == "2" and not os.path.exists(f"{to}/new.txt")
    with pytest.raises(Exception, match="several rows"):
        rows(("w.txt", b"3", None), ("./w.txt", b"4", None)).write.format("document_files").mode("append").save(to)
    with pytest.raises(Exception, match="no name for an output"):
        rows(("../w.txt", b"3", None)).write.format("document_files").mode("append").save(to)
    rows(("y.txt", b"5", None)).write.format("document_files").mode("overwrite").save(to)
    assert open(f"{to}/y.txt").read() == "5" and open(f"{to}/a/x.txt").read() == "1"
    store, found = stores.find(to)
    assert sorted(p[len(to) :] for p, _ in found) == ["/a/x.txt", "/y.txt"]


def test_commit_that_breaks_off_shows_nothing(tmp_path, monkeypatch):
    staged = stores.Staged(str(tmp_path / "o"))
    staged.put("t", "a.txt", b"1")
    real = stores.json.dumps
    monkeypatch.setattr(stores.json, "dumps", lambda *a, **k: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError, match="disk"):
        staged.commit([("t", {"name": "a.txt", "bytes": 1})], overwrite=False, append=True)
    monkeypatch.setattr(stores.json, "dumps", real)
    assert stores.manifest(stores.opened("/")[0], str(tmp_path / "o")) is None


def test_delimited(source, tmp_path):
    text = 'id;name;tags\n1;"a;b";"line\nbreak"\n2;;"say ""x"""\n'
    path = put(tmp_path, "a.csv", text.encode())
    df = delimited.read(source, path, ";")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "a;b", "line\nbreak"), ("2", "", 'say "x"')]
    assert [list(r) for r in df.collect()] == structured.read_csv(text, ";")["Sheet1"][1:]
    ragged = put(tmp_path, "b.csv", b"id,name\n1,a\n2\n3,c,d\nx,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.read(source, ragged).select("id").collect()
    kept = delimited.read(source, ragged, mode="PERMISSIVE").collect()
    assert [(r["id"], r["_corrupt_record"]) for r in kept] == [("1", None), ("2", "2"), ("3", "3,c,d"), ("x", None)]
    assert [tuple(r) for r in delimited.read(source, ragged, schema="id long, name string", mode="DROPMALFORMED").collect()] == [(1, "a")]


def test_no_workbook(source, tmp_path):
    with pytest.raises(Exception, match="is no workbook"):
        source.read.format("workbook").load(put(tmp_path, "a.txt", b"x"))
    path = str(tmp_path / "bad.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x", "y")
    with pytest.raises(Exception, match="workbook part is missing"):
        source.read.format("workbook").load(path)
