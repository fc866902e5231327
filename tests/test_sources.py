"""Files, workbooks, manifests, schema reports and database options."""

import datetime
import hashlib
import zipfile

import pytest

from tablewright.errors import SourceError
from tablewright.sources import jdbc
from tablewright.sources.files import file_manifest, read_csv, require_supported
from tablewright.sources.registry import CATALOG, import_tables, read_dataset
from tablewright.sources.schema import schema_report
from tablewright.sources.workbook import list_sheets, read_workbook

TOOLS = "code,tool,weight,steel\n40,Chisel,1.25,true\n41,Mallet,0.75,false\n44,Rasp,3.5,true\n"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types(spark, tmp_path):
    df = read_csv(spark, put(tmp_path / "tools.csv", TOOLS))
    assert dict(df.dtypes) == {"code": "bigint", "tool": "string", "weight": "double", "steel": "boolean"}
    report = schema_report(df).orderBy("position").collect()
    assert report[1]["sample_values"] == ["Chisel", "Mallet", "Rasp"] and not report[1]["nullable"]


def test_csv_dates_stay_text_and_quotes_are_kept(spark, tmp_path):
    text = 'd,t,m\n2024-01-05,"a, ""b""",1\n2024-01-06,"two\nlines",x\n,,\n'
    df = read_csv(spark, put(tmp_path / "q.csv", text))
    assert dict(df.dtypes) == {"d": "string", "t": "string", "m": "string"}
    assert [r["t"] for r in df.collect()] == ['a, "b"', "two\nlines", None]
    report = {r["name"]: r for r in schema_report(df).collect()}
    assert report["d"]["nullable"] and report["d"]["sample_values"] == ["2024-01-05", "2024-01-06", ""]


def test_csv_folder_is_typed_by_all_files(spark, tmp_path):
    put(tmp_path / "0.csv", "x\n")
    put(tmp_path / "a.csv", "x\n1\n2\n")
    put(tmp_path / "b.csv", "x\n3\n")
    df = read_csv(spark, str(tmp_path))
    assert sorted(r["x"] for r in df.collect()) == [1, 2, 3]
    put(tmp_path / "c.csv", "x\n4.5\n")
    assert dict(read_csv(spark, str(tmp_path)).dtypes) == {"x": "double"}


def test_csv_headers_in_another_order_and_paths_with_blanks(spark, tmp_path):
    folder = tmp_path / "my files"
    folder.mkdir()
    put(folder / "sales 2024.csv", "a,b\n1,x\n2,y\n")
    put(folder / "sales%20 2025.csv", "b,a\nz,3\n")
    got = read_csv(spark, str(folder))
    assert sorted(map(tuple, got.select("a", "b").collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert read_csv(spark, str(folder / "sales 2024.csv")).count() == 2
    put(folder / "other.csv", "a,c\n1,x\n")
    with pytest.raises(SourceError, match="columns"):
        read_csv(spark, str(folder))


def test_csv_cell_beyond_the_window_fails_loudly(spark, tmp_path):
    path = put(tmp_path / "late.csv", "x\n" + "1\n" * 30 + "oops\n")
    with pytest.raises(Exception, match="MALFORMED|oops"):
        read_csv(spark, path, infer_rows=10).collect()
    assert dict(read_csv(spark, path, infer_rows=None).dtypes) == {"x": "string"}


def test_manifest(spark, tmp_path):
    put(tmp_path / "my data+1.csv", TOOLS)
    put(tmp_path / "notes.txt", "hello")
    put(tmp_path / "BIG.PARQUET", "x" * 500)
    put(tmp_path / "a  (b).csv", "x")
    got = {r["original_name"]: r for r in file_manifest(spark, str(tmp_path), size_cap=100).collect()}
    csv = got["my data+1.csv"]
    assert (csv["safe_name"], csv["kind"], csv["dataset_name"]) == ("my_data_1.csv", "csv", "my data+1")
    assert csv["sha256"] == hashlib.sha256(TOOLS.encode()).hexdigest() and csv["size_bytes"] == len(TOOLS)
    assert got["notes.txt"]["error"] == "unsupported file extension" and got["notes.txt"]["kind"] is None
    assert got["BIG.PARQUET"]["error"] == "file too large" and got["BIG.PARQUET"]["sha256"] is None
    assert got["a  (b).csv"]["safe_name"] == "a_b_.csv"
    assert file_manifest(spark, str(tmp_path)).where("sha256 is null").count() == 0
    with pytest.raises(SourceError):
        require_supported(file_manifest(spark, str(tmp_path)))


def sheet_xml(rows):
    body = ""
    for r, cells in enumerate(rows, 1):
        body += f'<row r="{r}">'
        for c, cell in enumerate(cells):
            ref = f"{chr(65 + c)}{r}"
            if cell is None:
                continue
            if isinstance(cell, bool):
                body += f'<c r="{ref}" t="b"><v>{int(cell)}</v></c>'
            elif isinstance(cell, datetime.datetime):
                days = (cell - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)
                body += f'<c r="{ref}" s="1"><v>{days!r}</v></c>'
            elif isinstance(cell, (int, float)):
                body += f'<c r="{ref}"><v>{cell}</v></c>'
            elif cell.startswith("#"):
                body += f'<c r="{ref}" t="s"><v>{cell[1:]}</v></c>'
            else:
                body += f'<c r="{ref}" t="inlineStr"><is><t>{cell}</t></is></c>'
        body += "</row>"
    return f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>'


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(path, sheets, strings=()):
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        )
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
            '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        )
        items = "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", sheet_xml(rows))


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    day = datetime.datetime(2024, 1, 5, 12)
    head = ["id", "#0", "price", "ok", "day", "mix"]
    write_workbook(
        folder / "a.xlsx",
        {"Data": [head, [1, "#1", 1, True, day, 1], [2, None, 2.5, False, None, "x"]], "Other": [["z"], [9]]},
        ["name", "Ana"],
    )
    write_workbook(folder / "b.xlsx", {"Data": [head, [3, "Beto", 4, True, day, None]], "Empty": []}, ["name"])
    return str(folder)


def test_workbook_folder(spark, books):
    df = read_workbook(spark, books)
    assert dict(df.dtypes) == {
        "id": "bigint",
        "name": "string",
        "price": "double",
        "ok": "boolean",
        "day": "timestamp_ntz",
        "mix": "string",
    }
    day = datetime.datetime(2024, 1, 5, 12)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "Ana", 1.0, True, day, "1"),
        (2, None, 2.5, False, None, "x"),
        (3, "Beto", 4.0, True, day, None),
    ]


def test_workbook_sheets(spark, books):
    got = [(r["path"][-6:], r["sheet_no"], r["sheet"], r["row_count"]) for r in list_sheets(spark, books).collect()]
    assert sorted(got) == [("a.xlsx", 0, "Data", 2), ("a.xlsx", 1, "Other", 1), ("b.xlsx", 0, "Data", 1), ("b.xlsx", 1, "Empty", 0)]
    assert [tuple(r) for r in read_workbook(spark, books, "Other").collect()] == [(9,)]
    with pytest.raises(SourceError):
        read_workbook(spark, books, "Nope")


def test_read_dataset(spark, books, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert read_dataset(spark, "parquet", {"path": str(tmp_path / "p")}).count() == 3
    assert read_dataset(spark, "xlsx", {"path": books, "sheet": "Other"}).count() == 1
    spark.range(4).createOrReplaceTempView("four")
    assert read_dataset(spark, "query", {"sql": "SELECT * FROM four WHERE id > 1"}).count() == 2
    with pytest.raises(SourceError):
        read_dataset(spark, "json", {"path": "x"})


def test_import_tables(spark):
    catalog = spark.createDataFrame([("0", "public.taken", "table", {}, "")], CATALOG)
    opened = []

    def open_table(schema, table):
        opened.append((schema, table))
        return spark.range(1)

    got = import_tables(spark, catalog, [("public", "a", None), ("public", "b", "B!")], open_table).collect()
    assert [r["name"] for r in got] == ["public.a", "B!"] and got[0]["locator"] == {"schema": "public", "table": "a"}
    assert opened == [("public", "a"), ("public", "b")]
    for requests in ([("public", "a", "x"), ("public", "b", "x")], [("public", "taken", None)], []):
        with pytest.raises(SourceError):
            import_tables(spark, catalog, requests, open_table)
    many = [("s", "t", str(i)) for i in range(60)]
    assert import_tables(spark, catalog, many, open_table).count() == 60
    with pytest.raises(SourceError):
        import_tables(spark, catalog, many, open_table, max_tables=50)


CONFIG = {"host": "h", "database": "d", "user": "u", "password": "p"}


def test_jdbc_options():
    pg = jdbc.jdbc_options("postgres", CONFIG, "public", 'we"ird', "id", (0, 100), 8)
    assert pg["url"].startswith("jdbc:postgresql://h:5432/d?") and pg["dbtable"] == '"public"."we""ird"'
    assert (pg["partitionColumn"], pg["numPartitions"]) == ("id", "8")
    ms = jdbc.jdbc_options("mssql", {**CONFIG, "port": 99}, "dbo", "t]x")
    assert ms["dbtable"] == "[dbo].[t]]x]" and "h:99" in ms["url"] and "encrypt=false" in ms["url"]
    azure = jdbc.jdbc_url("mssql_azure", {**CONFIG, "sslmode": "disable"})
    assert "encrypt=true;trustServerCertificate=false" in azure
    assert "trustServerCertificate=true" in jdbc.jdbc_url("mssql_azure", CONFIG)
    assert "trustServerCertificate=false" in jdbc.jdbc_url("mssql", {**CONFIG, "sslmode": "verify-full"})
    with pytest.raises(SourceError):
        jdbc.jdbc_options("postgres", CONFIG, "s", "t", "id")
    with pytest.raises(SourceError):
        jdbc.jdbc_url("oracle", CONFIG)


def test_schema_report_with_known_nullability(spark):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    got = {r["name"]: r for r in schema_report(df, nullable={"a": False, "b": True}).collect()}
    declared = {r["name"]: r["nullable"] for r in jdbc.table_report(spark.range(2)).collect()}
    assert declared == {"id": False}
    assert got["b"]["nullable"] and got["b"]["sample_values"] == ["[1,2]"] and not got["a"]["nullable"]
