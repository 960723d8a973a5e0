"""File ingest (A1-A4, A8-A12) on inputs the tests write (FIXTURES.md part 2)."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tally.operators import ingest as ig
from tally.operators import store
from tally.sources.files import UnsupportedInput, load_sections, sniff_delimiter
from tally.streaming.landing import ingest_landing, landing_status

from .xlsx_writer import write_xlsx


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="tally-test-")


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_sniff_delimiter():
    assert sniff_delimiter(["a;b;c", "1;2;3"]) == ";"
    assert sniff_delimiter(["a|b", "1|2"]) == "|"
    assert sniff_delimiter(["a\tb", "1\t2"]) == "\t"
    assert sniff_delimiter(['a,b', '"1,5",2']) == ","


def test_semicolon_csv_tokens_repeats_and_empty_rows(spark, tmp):
    p = _write(os.path.join(tmp, "semicolon.csv"), "a;b;a\n1;NA;x\n;;\nNone;2;\n3;;y\n")
    kind, sections = load_sections(spark, p)
    assert kind == "csv"
    s = sections[0]
    assert s.name == "semicolon"
    assert s.columns == ["a", "b", "a"] or s.columns[0] == "a"
    df = s.df
    assert [c for c in df.columns if c != "_rid"] == ["a", "b", "a_2"]
    rows = df.orderBy("_rid").collect()
    # the all-empty row is gone; NA / None / blank are null
    assert [r["_rid"] for r in rows] == [1, 3, 4]
    assert rows[0]["b"] is None and rows[1]["a"] is None
    assert s.verdicts["a"] == "bigint" and s.verdicts["b"] == "bigint" and s.verdicts["a_2"] == "string"


def test_numbers_all_or_nothing(spark, tmp):
    text = 'good,mixed,grouped,suffix,blank\n1, x,"1,000",1d,\n" 2 ",2,2,2,\n1e3,3,3,3,\n'
    p = _write(os.path.join(tmp, "numbers.csv"), text)
    s = load_sections(spark, p)[1][0]
    v = s.verdicts
    assert v["good"] == "double"  # 1e3 is a number, not an integer
    assert v["mixed"] == "string" and v["grouped"] == "string" and v["suffix"] == "string"
    assert v["blank"] == "string"
    vals = [r["good"] for r in s.df.orderBy("_rid").collect()]
    assert vals == [1.0, 2.0, 1000.0]


def test_pipe_dates_and_booleans(spark, tmp):
    p = _write(os.path.join(tmp, "pipe_dates.csv"), "fecha|activo\n2024-01-05|True\n2024-02-10|False\n")
    s = load_sections(spark, p)[1][0]
    assert s.verdicts == {"fecha": "string", "activo": "boolean"}
    assert [r["activo"] for r in s.df.orderBy("_rid").collect()] == [True, False]


def test_unsupported_suffix(spark, tmp):
    p = _write(os.path.join(tmp, "notes.txt"), "x")
    with pytest.raises(UnsupportedInput):
        load_sections(spark, p)


def test_workbook_sheets(spark, tmp):
    p = os.path.join(tmp, "book.xlsx")
    write_xlsx(p, [
        ("Ventas", "visible", [["Fecha", "Monto Total", None, "Año"], [("date", 45292), 10.5, "a", 2024],
                               [("date", 45293), 20, "b", 2024], [None, None, None, None]]),
        ("Oculta", "hidden", [["x"], [1], [2]]),
        ("Vacía", "visible", []),
        ("Flags", "visible", [["ok"], [True], [False]]),
    ])
    kind, sections = load_sections(spark, p)
    assert kind == "excel"
    by = {s.name: s for s in sections}
    v = by["Ventas"]
    assert v.columns == ["Fecha", "Monto Total", "col_3", "Año"]
    assert [c for c in v.df.columns if c != "_rid"] == ["fecha", "monto_total", "col_3", "a_o"]
    rows = v.df.orderBy("_rid").collect()
    assert len(rows) == 2
    assert str(rows[0]["fecha"]) == "2024-01-01 00:00:00"
    assert rows[1]["monto_total"] == 20.0 and rows[0]["a_o"] == 2024
    assert by["Oculta"].hidden and not v.hidden
    assert by["Vacía"].df.count() == 0
    assert [r["ok"] for r in by["Flags"].df.orderBy("_rid").collect()] == [True, False]


def test_row_ids_follow_file_order(spark, tmp):
    lines = "k\n" + "\n".join(str(i) for i in range(5000)) + "\n"
    p = _write(os.path.join(tmp, "many.csv"), lines)
    s = load_sections(spark, p)[1][0]
    got = s.df.select("_rid", "k").collect()
    assert all(r["_rid"] == r["k"] + 1 for r in got)
    assert len(got) == 5000


def test_refresh_replaces_only_its_dataset(spark, tmp):
    out = os.path.join(tmp, "catalog")
    a = spark.createDataFrame([("ds1", 1), ("ds2", 2)], "dataset_id string, v int")
    ig.refresh_dataset_rows(a, out)
    ig.refresh_dataset_rows(spark.createDataFrame([("ds1", 9)], "dataset_id string, v int"), out)
    got = sorted((r["dataset_id"], r["v"]) for r in spark.read.parquet(out).collect())
    assert got == [("ds1", 9), ("ds2", 2)]


def test_landing_folder_each_file_once_and_quarantine(spark, tmp):
    landing = os.path.join(tmp, "landing")
    out = os.path.join(tmp, "out")
    ckpt = os.path.join(tmp, "ckpt")
    os.makedirs(landing)
    _write(os.path.join(landing, "ventas.csv"), "fecha,monto\n2024-01-01,10\n2024-01-02,20\n")
    _write(os.path.join(landing, "clientes.csv"), "id;nombre\n1;Ana\n2;Luis\n")
    ingest_landing(spark, landing, out, checkpoint=ckpt)
    first = {os.path.basename(r["path"]): r["status"] for r in landing_status(spark, out).collect()}
    assert first == {"ventas.csv": "ready", "clientes.csv": "ready"}
    _write(os.path.join(landing, "roto.csv"), "a,b\n1,2,3,4\n")
    _write(os.path.join(landing, "extra file.csv"), "a\n1\n")
    ingest_landing(spark, landing, out, checkpoint=ckpt)
    st = spark.read.parquet(os.path.join(out, "_status"))
    per_file = {os.path.basename(r["path"]): r["n"] for r in st.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert per_file == {"ventas.csv": 1, "clientes.csv": 1, "roto.csv": 1, "extra file.csv": 1}
    last = {os.path.basename(r["path"]): r["status"] for r in landing_status(spark, out).collect()}
    assert last["roto.csv"] == "error" and last["extra file.csv"] == "ready"
    q = spark.read.parquet(os.path.join(out, "_quarantine")).collect()
    assert [os.path.basename(r["path"]) for r in q] == ["roto.csv"]
    cat = spark.read.parquet(store.root_of(spark, out, "ventas") + "/catalog")
    assert cat.where("dataset_id = 'ventas'").count() == 2
    # A file that fails publishes nothing.
    assert {r["dataset_id"]: r["parts"] for r in store.current(spark, out).collect()} == {
        "ventas": ["tables/sheet_ventas", "catalog"], "clientes": ["tables/sheet_clientes", "catalog"], "extra_file_" + hashlib.md5(b"extra file.csv").hexdigest()[:8]: ["tables/sheet_extra_file", "catalog"]}


def test_quoted_line_breaks(spark, tmp):
    p = _write(os.path.join(tmp, "notas.csv"), 'id,nota\n1,"linea uno\nlinea dos"\n2,simple\n')
    s = load_sections(spark, p)[1][0]
    rows = s.df.orderBy("_rid").collect()
    assert [r["nota"] for r in rows] == ["linea uno\nlinea dos", "simple"]
    assert s.verdicts["id"] == "bigint"


def test_bom_header(spark, tmp):
    p = os.path.join(tmp, "bom.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("Año;Monto\n2024;10,5\n")
    s = load_sections(spark, p)[1][0]
    assert s.columns == ["Año", "Monto"]
    assert [c for c in s.df.columns if c != "_rid"] == ["a_o", "monto"]


def test_workbook_decoder_shared_strings_formulas_styles(tmp):
    import io
    import zipfile

    from tally.sources.workbook import decode_workbook

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   '<sheets><sheet name="Datos" sheetId="1" state="veryHidden" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId7" Target="/xl/worksheets/hoja.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Nombre</t></si>'
                   '<si><r><t>Ana </t></r><r><t>María</t></r></si><si><t>Fecha</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy;@"/>'
                   '<numFmt numFmtId="171" formatCode="&quot;d&quot;0.00"/></numFmts>'
                   '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/hoja.xml", f'<worksheet xmlns="{main}"><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>2</v></c><c r="C1"><v>7</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45292</v></c>'
                   '<c r="C2" s="2"><f>1+1</f><v>2</v></c><c r="D2" t="e"><v>#DIV/0!</v></c></row>'
                   '</sheetData></worksheet>')
    cells = decode_workbook("book.xlsx", buf.getvalue())
    sheet = [c for c in cells if c["kind"] == "sheet"][0]
    assert sheet["sheet"] == "Datos" and sheet["state"] == "veryHidden"
    got = {(c["row"], c["col"]): (c["value"], c["kind"]) for c in cells if c["kind"] != "sheet"}
    assert got[(1, 1)] == ("Nombre", "string") and got[(2, 1)] == ("Ana María", "string")
    assert got[(2, 2)] == ("2024-01-01 00:00:00", "date")
    assert got[(2, 3)] == ("2", "number")  # quoted "d" in the format is literal text, not a date
    assert got[(2, 4)] == ("#DIV/0!", "error") and got[(1, 3)] == ("7", "number")
