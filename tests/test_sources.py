"""Sources and sinks on files made here."""

from __future__ import annotations

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quernstone.operators import corpus
from quernstone.sources import files, sinks


def workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>#REF!</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" s="1"><v>45292</v></c></row>'
                   '<row r="3"><c r="B3" t="b"><v>1</v></c><c r="AA3" t="inlineStr"><is><t>in</t></is></c><c r="D3" t="s"><v>1</v></c></row></sheetData></worksheet>')  # fmt: skip


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    cells = files.read_workbooks(spark, str(tmp_path)).cache()
    assert {(r.row_no, r.col_no, r.cell) for r in cells.filter("sheet is not null").collect()} == {(0, 0, "name"), (0, 2, "2024-01-01"), (2, 1, "TRUE"), (2, 26, "in"), (2, 3, "#REF!")}
    assert cells.filter("sheet is null").count() == 1
    p = files.sheet_profile(cells.filter("sheet is not null")).first()
    assert (p.rows, p.columns, p.filled_cells) == (3, 27, 5)
    assert [r.issue for r in files.formula_errors(cells, ["in"]).orderBy("issue").collect()] == ["forbidden_term", "formula_error"]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" id ;name\n1;x\n2;\n")
    df = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"] and df.count() == 2 and dict(df.dtypes)["id"] == "string"
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(files.SourceError):
        files.read_delimited(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("a,b\n")
    with pytest.raises(files.SourceError):
        files.read_delimited(spark, str(tmp_path / "c.csv"))


def test_header_mapping_fails_closed(spark):
    df = spark.createDataFrame([(1, 2)], "`Paid_Amount` int, orders int")
    assert files.map_headers(df, {"paid": ["paid amount"], "orders": ["Orders"]}).columns == ["paid", "orders"]
    with pytest.raises(files.SourceError):
        files.map_headers(df, {"x": ["missing"]})
    with pytest.raises(files.SourceError):
        files.map_headers(df, {"x": ["orders"], "y": ["orders"]})


def test_html_and_office(spark, tmp_path):
    assert files.visible_text("<p>a&amp;b</p><script>x</script><div>c  d<br>e</div>") == "a&b\nc d\ne"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "p.html").write_text("<p>hi</p>")
    (tmp_path / "q.bin").write_bytes(b"\0\0\1")
    out = files.binary_files(spark, str(tmp_path)).select("path", files.extract_text("path", "content").alias("e")).select("path", "e.*").collect()
    assert {r.path.rsplit("/", 1)[1]: (r.text, r.status) for r in out} == {"d.docx": ("one two", "extracted"), "p.html": ("hi", "extracted"), "q.bin": (None, "unsupported")}
    assert [(r.member, r.suffix) for r in (lambda d: (d / "z.zip").write_bytes((d / "d.docx").read_bytes()) and files.zip_members(spark, str(d)).collect())(tmp_path)] == [("word/document.xml", "xml")]


def test_inventory_and_manifest(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.txt").write_text("hello")
    (tmp_path / "c.md").write_text("hello")
    inv = files.inventory(spark, str(tmp_path)).cache()
    assert {r.path.rsplit("/", 1)[1]: r.signature for r in inv.collect()} == {"a.png": "png", "b.txt": "text", "c.md": "text"}
    size = files.binary_files(spark, str(tmp_path), "*.png").select(*files.image_size(F.col("content"))).first()
    assert tuple(size) == (30, 20)
    marked = {r.path.rsplit("/", 1)[1]: r for r in corpus.mark_canonical(inv).collect()}
    assert marked["c.md"].duplicate_of.endswith("b.txt")
    m = sinks.run_manifest(inv, "inputs")
    later = inv.filter("path not like '%a.png'").withColumn("sha256", F.when(F.col("path").endswith("c.md"), "x").otherwise(F.col("sha256")))
    assert {r.problem for r in sinks.verify_manifest(m, later).collect()} == {"missing", "changed"}


def test_sinks_protect_sources(spark, tmp_path):
    with pytest.raises(files.SourceError):
        sinks.guard("/data/in/out", ["/data/in"])
    out = str(tmp_path / "o.json")
    sinks.write_document(spark, {"a": 1}, out)
    with pytest.raises(files.SourceError):
        sinks.write_document(spark, {"a": 2}, out)
    assert spark.read.json(out, multiLine=True).first().a == 1
    df = spark.createDataFrame([(1, None)], "a int, b string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).filter("value = '1,'").count() == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n[1]\nnope\n')
    good, bad = files.read_json_lines(spark, str(tmp_path / "x.jsonl"))
    assert good.count() == 1 and bad.count() == 2
