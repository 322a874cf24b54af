"""Files as tables: texts of unknown encoding, word-processor documents and sheets.

Containers are read on executors from Spark's binaryFile rows, so that any store that Spark reads will do.
A file that can't be read gives no rows of its own kind, and a row in errors().
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "latin-1")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def files(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """(path, ext, length, content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = df.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), "length", "content")
    return df.where(F.col("ext") == suffix) if suffix else df


def route(ext: str | Column) -> Column:
    """The reader of a file by its suffix; what is unknown goes to the page reader."""
    ext = F.col(ext) if isinstance(ext, str) else ext
    return F.when(ext == ".docx", "docx").when(ext == ".doc", "doc").when(ext == ".xlsx", "xlsx").when(ext == ".txt", "txt").otherwise("pdf")


def decode(data: bytes) -> tuple[str, str]:
    """The text, and the first encoding of the ladder that reads it."""
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads all bytes")


@pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(bytes(x)) for x in content], columns=["text", "encoding"])


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding)."""
    return files(spark, path, ".txt").select("path", decoded("content").alias("d")).select("path", "d.*")


def formula(node: ET.Element) -> str:
    """An Office formula as text: fractions, powers, indices, roots and brackets."""
    tag = node.tag.removeprefix(M)
    part = lambda name: "".join(formula(x) for x in node.findall(M + name))
    if tag == "f":
        return f"{part('num')}/{part('den')}"
    if tag == "sSup":
        return f"{part('e')}^{part('sup')}"
    if tag == "sSub":
        return f"{part('e')}_{part('sub')}"
    if tag == "rad":
        degree = part("deg")
        return (f"[{degree}]" if degree else "") + f"√{part('e')}"
    if tag == "d":
        return "(" + ", ".join(formula(x) for x in node.findall(M + "e")) + ")"
    if tag.endswith("Pr"):
        return ""
    return (node.text or "") if tag == "t" else "".join(map(formula, node))


def _runs(p: ET.Element) -> Iterator[dict]:
    for node in p.iter():
        if node.tag == M + "oMath":
            yield {"text": formula(node), "bold": False, "color": None, "highlight": None}
        elif node.tag == W + "r":
            props = node.find(W + "rPr")
            get = lambda name: None if props is None or props.find(W + name) is None else props.find(W + name).get(W + "val", "1")  # noqa: B023, E731
            text = "".join("\n" if x.tag == W + "br" else x.text or "" for x in node if x.tag in (W + "t", W + "br"))
            yield {"text": text, "bold": get("b") not in (None, "0", "false"), "color": get("color"), "highlight": get("highlight")}


def docx_runs(data: bytes) -> list[dict]:
    """Styled runs in the body's order; paragraphs of tables carry table, row and cell."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(W + "body")
    out, para, tables = [], 0, 0

    def add(p: ET.Element, **where) -> None:
        nonlocal para
        numbered = p.find(f"{W}pPr/{W}numPr") is not None
        for k, run in enumerate([*_runs(p)] or [{"text": "", "bold": False, "color": None, "highlight": None}]):
            out.append({"para": para, "run": k, "numbered": numbered, "table": None, "row": None, "cell": None} | where | run)
        para += 1

    for node in body:
        if node.tag == W + "p":
            add(node)
        elif node.tag == W + "tbl":
            for i, row in enumerate(node.findall(W + "tr")):
                for j, cell in enumerate(row.findall(W + "tc")):
                    for p in cell.findall(W + "p"):
                        add(p, table=tables, row=i, cell=j)
            tables += 1
    return out


RUNS = "path string, para int, run int, numbered boolean, `table` int, `row` int, cell int, text string, bold boolean, color string, highlight string"
CELLS = "path string, sheet string, row_no int, cells array<string>"


def _place(ref: str) -> int:
    out = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def xlsx_rows(data: bytes) -> list[dict]:
    """Rows of each sheet, as texts; cells that are empty are null, and those at the end are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
        target = targets[sheet.get(R + "id")].lstrip("/")
        tree = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for row in tree.iter(S + "row"):
            cells: list[str | None] = []
            for c in row.findall(S + "c"):
                at = _place(c.get("r")) if c.get("r") else len(cells)
                value = c.find(S + "v")
                text = "".join(t.text or "" for t in c.iter(S + "t")) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                cells += [None] * (at + 1 - len(cells))
                cells[at] = text or None
            while cells and cells[-1] is None:
                cells.pop()
            out.append({"sheet": sheet.get("name"), "row_no": int(row.get("r", len(out) + 1)), "cells": cells})
    return out


def _read(read, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = read(bytes(content))
                except UNREADABLE:
                    continue
                yield pd.DataFrame([{"path": path} | r for r in rows], columns=columns)

    return run


def read_docx(source: DataFrame) -> DataFrame:
    """Runs of the documents in (path, content)."""
    return source.select("path", "content").mapInPandas(_read(docx_runs, [x.split()[0].strip("`") for x in RUNS.split(", ")]), RUNS)


def read_xlsx(source: DataFrame) -> DataFrame:
    """Rows of the sheets in (path, content)."""
    return source.select("path", "content").mapInPandas(_read(xlsx_rows, ["path", "sheet", "row_no", "cells"]), CELLS)


#: What a reader raises at a file that isn't what its name says, or is damaged.
UNREADABLE = (KeyError, ValueError, AttributeError, IndexError, TypeError, zipfile.BadZipFile, ET.ParseError, EOFError, NotImplementedError)


def errors(source: DataFrame, read=None) -> DataFrame:
    """(path, error) of files in (path, content) that the reader can't read, by default that of word-processor documents."""
    read = read or docx_runs

    @pandas_udf("string")
    def error(content: pd.Series) -> pd.Series:
        def test(data):
            try:
                read(bytes(data))
            except UNREADABLE as e:
                return f"{type(e).__name__}: {e}"

        return content.map(test)

    return source.select("path", error("content").alias("error")).where("error is not null")


#: Suffixes of files that are taken, and their most bytes.
TAKEN, MOST_BYTES = (".pdf", ".docx", ".doc", ".xlsx", ".txt"), 20 * 1024 * 1024


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """A stream of files (path, ext, length, content) as they come into a folder; those of other kinds or too large are left out."""
    df = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = df.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), "length", "content")
    return df.where(F.col("ext").isin(*TAKEN) & (F.coalesce("length", F.lit(0)) <= MOST_BYTES))


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def docx_bytes(lines: list[str]) -> bytes:
    """A document of plain paragraphs; right options (+) are bold."""
    from xml.sax.saxutils import escape

    body = "".join(f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if x.startswith("+") else ""}<w:t xml:space="preserve">{escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", x))}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8"?>{text}')
        z.writestr(zipfile.ZipInfo("word/document.xml"), f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def write_docx(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(path, content): a document of each key's lines (line_no, text)."""
    grouped = lines.groupBy(key).agg(F.expr("array_sort(collect_list(struct(line_no, text)))").alias("ls"))

    @pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: docx_bytes(list(x)))

    return grouped.select(F.concat(F.col(key).cast("string"), F.lit(".docx")).alias("path"), packed(F.expr("ls.text")).alias("content"))
