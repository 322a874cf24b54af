"""Old binary documents: pieces of two widths, a broken table, newer documents under the old name, and no document at all."""

import struct

import pytest

from sieveloom.sources import olddoc
from sieveloom.sources.files import docx_bytes


@pytest.mark.parametrize("wide,text", [(True, "? Oʻzbek ёлка\n+ yes\n= no"), (False, "? plain\n+ “yes”\n= no"), (True, "long " * 9000 + "\nend")])
def test_pieces(wide, text):
    assert olddoc.doc_text(olddoc.doc_bytes(text, wide)) == text


def test_broken_table():
    data = bytearray(olddoc.doc_bytes("? readable text here", False))
    struct.pack_into("<H", data, 512 + olddoc.COUNT_AT, 5)
    assert "? readable text here" in olddoc.doc_text(bytes(data))


def test_other_files(spark):
    assert olddoc.doc_text(docx_bytes(["? a", "+ b"])) == "? a\n+ b" and olddoc.doc_text(b"nothing") is None and olddoc.doc_text(olddoc.SIGNATURE + bytes(2000)) is None
    rows = spark.createDataFrame([("a.doc", bytearray(olddoc.doc_bytes("? q\n+ a"))), ("b.doc", bytearray(b"no"))], "path string, content binary")
    got = olddoc.read_doc_lines(rows).orderBy("path", "line_no").collect()
    assert [(r.path, r.layout, r.line_no, r.text) for r in got] == [("a.doc", "doc", 1, "? q"), ("a.doc", "doc", 2, "+ a"), ("b.doc", "unreadable", None, None)]
