"""Questions as word-processor documents, JSON and marked text.

A document is built on the executor that holds its questions; files go out through Spark's own writers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .files import R, W

A = "http://schemas.openxmlformats.org/drawingml/2006/main"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
PIC = "http://schemas.openxmlformats.org/drawingml/2006/picture"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
#: Colours of right and other options, and an image's widest side, in English metric units (three inches).
RIGHT, OTHER, WIDEST = "16A34A", "475569", 3 * 914_400


def run(text: str, bold: bool = False, color: str | None = None, size: float | None = None, highlight: str | None = None) -> str:
    """A run of text; characters that XML can't hold are left out, line feeds are breaks."""
    props = ("<w:b/>" if bold else "") + (f'<w:color w:val="{color}"/>' if color else "") + (f'<w:sz w:val="{round(2 * size)}"/>' if size else "") + (f'<w:highlight w:val="{highlight}"/>' if highlight else "")
    clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)
    return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}" + "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in clean.split("\n")) + "</w:r>"


def paragraph(*runs: str, numbered: bool = False) -> str:
    return f"<w:p>{'<w:pPr><w:numPr/></w:pPr>' if numbered else ''}{''.join(runs)}</w:p>"


def table(rows: Iterable[Iterable[str]]) -> str:
    """Rows of cells, each of one paragraph or more."""
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{c}</w:tc>' for c in row)}</w:tr>" for row in rows) + "</w:tbl>"


def picture(relation: str) -> str:
    """A run with the image of a relation, as wide as images get."""
    size = f'cx="{WIDEST}" cy="{WIDEST}"'
    return (
        f'<w:r><w:drawing><wp:inline xmlns:wp="{DRAW}"><wp:extent {size}/><wp:docPr id="1" name="{relation}"/><a:graphic xmlns:a="{A}"><a:graphicData uri="{PIC}"><pic:pic xmlns:pic="{PIC}"><pic:nvPicPr><pic:cNvPr id="0" name="{relation}"/><pic:cNvPicPr/></pic:nvPicPr>'
        f'<pic:blipFill><a:blip r:embed="{relation}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'
    )


def document(blocks: Iterable[str], images: Iterable[bytes] = ()) -> bytes:
    """The container; image k has the relation rId{k}. The same blocks give the same bytes."""
    images = [*images]
    kinds = [".jpeg" if x[:2] == b"\xff\xd8" else ".gif" if x[:4] == b"GIF8" else ".png" for x in images]
    relations = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/image" Target="media/image{k}{kind}"/>' for k, kind in enumerate(kinds))
    defaults = "".join(f'<Default Extension="{x}" ContentType="image/{x}"/>' for x in ("png", "jpeg", "gif"))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{defaults}<Override PartName="/word/document.xml" ContentType="{MAIN}"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{relations}</Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"><w:body>{"".join(blocks)}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8"?>{text}')
        for k, (kind, data) in enumerate(zip(kinds, images, strict=True)):
            z.writestr(zipfile.ZipInfo(f"word/media/image{k}{kind}"), data)
    return out.getvalue()


def marked(question: str, options: Iterable[str], right: int) -> list[str]:
    return [f"? {question}", *(f"{'+' if k == right else '='} {x}" for k, x in enumerate(options))]


def classic_document(questions: Iterable[tuple]) -> bytes:
    """Marked paragraphs of questions (q, o, c, image or None), a question's image after its first line."""
    blocks, images = [], []
    for q, o, c, image in questions:
        head, *rest = marked(q, o, c)
        blocks.append(paragraph(run(head)))
        if image:
            blocks.append(paragraph(picture(f"rId{len(images)}")))
            images.append(bytes(image))
        blocks += [*(paragraph(run(x)) for x in rest), paragraph()]
    return document(blocks, images)


def resolved_document(questions: Iterable[tuple], title: str = "Quiz — AI Resolved") -> bytes:
    """A title, questions in bold, the right option in green and the others in grey."""
    blocks = [paragraph(run(title, bold=True, size=26)), paragraph()]
    for q, o, c, *_ in questions:
        head, *rest = marked(q, o, c)
        blocks.append(paragraph(run(head, bold=True, size=11)))
        blocks += [*(paragraph(run(x, color=RIGHT if x[0] == "+" else OTHER, size=10.5)) for x in rest), paragraph()]
    return document(blocks)


def documents(questions: DataFrame, key: str = "doc_id", resolved: bool = False) -> DataFrame:
    """(path, content): a document of each key's questions (q_no, q, o, c, image), plain or as resolved ones are shown."""
    has = "image" in questions.columns
    fields = F.struct("q_no", "q", "o", "c", (F.col("image") if has else F.lit(None).cast("binary")).alias("image"))
    # the order is by q_no, which is told apart, so that images are never compared
    grouped = questions.select(key, fields.alias("x")).groupBy(key).agg(F.expr("array_sort(collect_list(x), (a, b) -> cast(sign(a.q_no - b.q_no) as int))").alias("xs"))

    @pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        build = resolved_document if resolved else classic_document
        return rows.map(lambda xs: build([(x["q"], list(x["o"]), x["c"], x["image"]) for x in xs]))

    return grouped.select(F.concat(F.col(key).cast("string"), F.lit(".docx")).alias("path"), packed("xs").alias("content"))


def save_files(files: DataFrame, folder: str) -> int:
    """Writes (path, content) one by one through the Hadoop file system of the folder, from the executors; the number written.

    A task that is run again overwrites what it wrote before.
    """
    import pyarrow.fs as fs

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                at = f"{root}/{path}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(frame)]})

    return files.select("path", "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def save_json(questions: DataFrame, path: str, full: bool = False) -> None:
    """Questions as JSON objects, one a line, over whatever was there: all fields, or q, o, c and what else a short one has."""
    short = [c for c in ("q", "o", "c", "cf", "img") if c in questions.columns]
    (questions if full else questions.select(*short)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_text(questions: DataFrame, path: str, key: str = "doc_id") -> None:
    """Marked lines of each key's questions, an empty line after each, in a folder for each key."""
    lines = F.expr("concat('? ', q, '\\n', array_join(transform(o, (x, i) -> concat(if(i = c, '+ ', '= '), x)), '\\n'), '\\n')")
    questions.select(key, "q_no", lines.alias("value")).repartition(key).sortWithinPartitions(key, "q_no").drop("q_no").write.mode("overwrite").partitionBy(key).text(path)


#: Layouts of example documents, and how each shows a question with four options of which the first is right.
EXAMPLES = ("inline", "table_blocks", "table_bold", "table_columns", "numbered_bold", "plain")


def example(layout: str, questions: Iterable[tuple[str, list[str]]]) -> bytes:
    """A document that shows its questions in one of the layouts."""
    blocks = []
    for n, (q, o) in enumerate(questions, 1):
        if layout == "inline":
            blocks.append(paragraph(run("\n".join([f"{n}. {q}", *(f"{c}. {x}" for c, x in zip("abcd", o, strict=True))]))))
        elif layout == "table_blocks":
            rows = [q, *(y for k, x in enumerate(o) for y in ("====", ("" if k else "#") + x))]
            blocks += [table([[paragraph(run(x))] for x in rows]), paragraph(run("++++"))]
        elif layout == "table_bold":
            blocks += [[paragraph(run(q, bold=True))], *([paragraph(run(x))] for x in o)]
        elif layout == "table_columns":
            blocks.append([paragraph(run(x)) for x in (q, f"*{o[0]}", *o[1:])])
        elif layout == "numbered_bold":
            blocks += [paragraph(run(f"{n}. {q}")), *(paragraph(run(f"{c}. "), run(x, bold=not k)) for k, (c, x) in enumerate(zip("ABCD", o, strict=True)))]
        else:
            blocks += [paragraph(run(f"? {q}")), *(paragraph(run(f"= {x}", highlight=None if k else "yellow")) for k, x in enumerate(o))]
    return document([table(blocks)] if layout in ("table_bold", "table_columns") else blocks)


def examples(questions: DataFrame) -> DataFrame:
    """(path, content) of documents (doc_id, layout, questions array<struct<q, o>>)."""

    @pandas_udf("binary")
    def packed(layout: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([example(a, [(x["q"], list(x["o"])) for x in xs]) for a, xs in zip(layout, rows, strict=True)])

    return questions.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), packed("layout", "questions").alias("content"))


def workbook(sheets: Iterable[tuple[str, list[list[str | None]]]]) -> bytes:
    """A workbook of sheets of text cells."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheets, out = [*sheets], io.BytesIO()
    column = lambda k: (column(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("xl/workbook.xml"), f'<workbook xmlns="{main}" xmlns:r="{R[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr(zipfile.ZipInfo("xl/_rels/workbook.xml.rels"), f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (_, rows) in enumerate(sheets, 1):
            cells = lambda n, row: "".join(f'<c r="{column(j)}{n}" t="inlineStr"><is><t>{escape(x)}</t></is></c>' for j, x in enumerate(row) if x is not None)
            z.writestr(zipfile.ZipInfo(f"xl/worksheets/sheet{k}.xml"), f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{n}">{cells(n, row)}</row>' for n, row in enumerate(rows, 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def workbooks(rows: DataFrame) -> DataFrame:
    """(path, content): a workbook of one sheet for each doc_id of rows (doc_id, row_no, cells)."""
    grouped = rows.groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(row_no, cells))), x -> x.cells)").alias("xs"))

    @pandas_udf("binary")
    def packed(sheets: pd.Series) -> pd.Series:
        return sheets.map(lambda xs: workbook([("Sheet1", [list(x) for x in xs])]))

    return grouped.select(F.concat(F.col("doc_id").cast("string"), F.lit(".xlsx")).alias("path"), packed("xs").alias("content"))
