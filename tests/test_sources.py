"""Files as tables: sheets, documents, texts of several encodings, and files that can't be read."""

import io
import zipfile

from sieveloom.sources.files import docx_bytes, errors, files, read_docx, read_text, read_xlsx, xlsx_rows
from sieveloom.streaming.jobs import admitted, job_ends, latest

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sheet() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>question</t></si><si><r><t>ri</t></r><r><t>ght</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1"/></row><row r="3"><c r="B3"><v>7</v></c><c r="C3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_xlsx_rows():
    assert xlsx_rows(sheet()) == [{"sheet": "One", "row_no": 1, "cells": ["question", None, "right"]}, {"sheet": "One", "row_no": 3, "cells": [None, "7", "in"]}]


def test_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheet())
    (tmp_path / "b.docx").write_bytes(docx_bytes(["? one", "+ two"]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes("ёлка".encode("cp1251"))
    root = str(tmp_path)
    assert [r.cells for r in read_xlsx(files(spark, root, ".xlsx")).orderBy("row_no").collect()][1] == [None, "7", "in"]
    assert [r.text for r in read_docx(files(spark, root, ".docx")).orderBy("para").collect()] == ["? one", "+ two"]
    assert errors(files(spark, root, ".docx")).count() == 1
    assert [(r.text, r.encoding) for r in read_text(spark, root).collect()] == [("ёлка", "cp1251")]


def test_jobs(spark):
    events = spark.createDataFrame([(1, 1, "running"), (1, 2, "completed"), (2, 3, "failed")], "batch_id long, ts long, status string")
    assert {(r.batch_id, r.ok) for r in job_ends(events).collect()} == {(1, True), (2, False)}
    users = spark.createDataFrame([(1,), (1,)], "batch_id long")
    assert admitted(events, users, "batch_id").count() == 2
    assert {(r.batch_id, r.status) for r in latest(events, "batch_id").collect()} == {(1, "completed"), (2, "failed")}
