"""Text of old binary word-processor documents: streams of the compound file, and the piece table of the main one."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the compound file format: signature, ends of chains, sizes; and of the document: the table's place in the header.
SIGNATURE, END, FREE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFE, 0xFFFFFFFF
SMALL = 4096
FLAGS_AT, COUNT_AT, PLACES_AT, CLX = 10, 152, 154, 33


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise ValueError("not a compound file")
        self.data = data
        self.sector = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        _, first, _, _, mini_first, _, more, n_more = struct.unpack_from("<8I", data, 44)
        places = [x for x in struct.unpack_from("<109I", data, 76) if x < END]
        while more < END and n_more:
            *own, more = struct.unpack(f"<{self.sector // 4}I", self._at(more))
            places += [x for x in own if x < END]
            n_more -= 1
        self.next = [x for p in places for x in struct.unpack(f"<{self.sector // 4}I", self._at(p))]
        entries = self._chain(first)
        self.entries = {}
        for k in range(0, len(entries) - 127, 128):
            size = struct.unpack_from("<H", entries, k + 64)[0]
            name = entries[k : k + max(0, size - 2)].decode("utf-16-le", "replace")
            kind, start, length = entries[k + 66], *struct.unpack_from("<IQ", entries, k + 116)
            if kind:
                self.entries.setdefault(name, (kind, start, length & 0xFFFFFFFF))
        root = next((x for x in self.entries.values() if x[0] == 5), (5, END, 0))
        self.small = self._chain(root[1])[: root[2]]
        self.small_next = [x for x in struct.unpack(f"<{len(self._chain(mini_first)) // 4}I", self._chain(mini_first))]

    def _at(self, k: int) -> bytes:
        return self.data[(k + 1) * self.sector : (k + 2) * self.sector].ljust(self.sector, b"\0")

    def _chain(self, k: int) -> bytes:
        out, seen = [], set()
        while k < END and k not in seen and k < len(self.next):
            seen.add(k)
            out.append(self._at(k))
            k = self.next[k]
        return b"".join(out)

    def __contains__(self, name: str) -> bool:
        return self.entries.get(name, (0,))[0] == 2

    def read(self, name: str) -> bytes:
        _, k, size = self.entries[name]
        if size >= SMALL:
            return self._chain(k)[:size]
        out, seen = [], set()
        while k < END and k not in seen and k < len(self.small_next):
            seen.add(k)
            out.append(self.small[k * self.mini : (k + 1) * self.mini])
            k = self.small_next[k]
        return b"".join(out)[:size]


def pieces(document: bytes, table: bytes) -> str:
    """The pieces of the text in order: of one byte a character, or of two."""
    if struct.unpack_from("<H", document, COUNT_AT)[0] <= CLX:
        raise ValueError("no piece table")
    start, length = struct.unpack_from("<II", document, PLACES_AT + 8 * CLX)
    clx, at = table[start : start + length], 0
    while clx[at] == 1:  # properties
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if clx[at] != 2:
        raise ValueError("no piece table")
    size = struct.unpack_from("<I", clx, at + 1)[0]
    plc = clx[at + 5 : at + 5 + size]
    n = (len(plc) - 4) // 12
    ends, out = struct.unpack_from(f"<{n + 1}I", plc), []
    for k in range(n):
        place, chars = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0], ends[k + 1] - ends[k]
        first = place & 0x3FFFFFFF
        if place & 0x40000000:
            out.append(document[first // 2 : first // 2 + chars].decode("cp1252", "replace"))
        else:
            out.append(document[first : first + 2 * chars].decode("utf-16-le", "replace"))
    return re.sub("[\x07\x0b\x0c\r]", "\n", "".join(out)).replace("\0", "")


def main_text(data: bytes) -> str | None:
    """The body's text; where the piece table can't be read, runs of four or more printable characters; None without the main stream."""
    file = Compound(data)
    if "WordDocument" not in file:
        return None
    document = file.read("WordDocument")
    try:
        return pieces(document, file.read("1Table" if struct.unpack_from("<H", document, FLAGS_AT)[0] >> 9 & 1 else "0Table"))
    except (struct.error, ValueError, KeyError, IndexError):
        return "\n".join(x.decode("latin-1") for x in re.findall(rb"[\x20-\x7e\t\r\n]{4,}", document))


def doc_text(data: bytes) -> str | None:
    """What the first way that works gives: a newer document under the old name, or the compound file; None if neither."""
    from .layouts import Document

    try:
        return "\n".join(p.text for p in Document(data).paragraphs())
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        pass
    try:
        text = main_text(data)
    except (ValueError, struct.error):
        return None
    return text if text and text.strip() else None


def read_doc_lines(source: DataFrame) -> DataFrame:
    """(path, layout, line_no, text) of (path, content); one row of layout "unreadable" where there is no text."""
    from .layouts import LINES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                text = doc_text(bytes(content))
                lines = [None] if text is None else text.split("\n")
                rows = {"path": path, "layout": "unreadable" if text is None else "doc", "line_no": [None] if text is None else range(1, len(lines) + 1), "text": lines}
                yield pd.DataFrame(rows).astype({"line_no": "Int64"})

    return source.select("path", "content").mapInPandas(run, LINES)


def doc_bytes(text: str, wide: bool = True) -> bytes:
    """A compound file with a document of one piece, for tests and examples: the main stream and its table, in sectors of 512 bytes."""
    raw = text.replace("\n", "\r").encode("utf-16-le" if wide else "cp1252", "replace")
    header = bytearray(1024)
    struct.pack_into("<H", header, FLAGS_AT, 1 << 9)
    struct.pack_into("<H", header, COUNT_AT, 0x5D)
    plc = struct.pack("<II", 0, len(raw) // (2 if wide else 1)) + struct.pack("<HIH", 0, 1024 if wide else 2048 | 0x40000000, 0)
    table = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", header, PLACES_AT + 8 * CLX, 0, len(table))
    streams = [(n, x.ljust(SMALL, b"\0")) for n, x in (("WordDocument", bytes(header) + raw), ("1Table", table))]
    sectors, entries, chains = [], [("Root Entry", 5, END, 0)], []
    for name, x in streams:
        x += b"\0" * (-len(x) % 512)
        entries.append((name, 2, len(sectors), len(x)))
        chains += [*range(len(sectors) + 1, len(sectors) + len(x) // 512), END]
        sectors += [x[k : k + 512] for k in range(0, len(x), 512)]
    folder = b""
    for name, kind, start, size in entries:
        e = bytearray(128)
        coded = name.encode("utf-16-le") + b"\0\0"
        e[: len(coded)] = coded
        struct.pack_into("<HBB", e, 64, len(coded), kind, 1)
        struct.pack_into("<IQ", e, 116, start, size)
        folder += bytes(e)
    at = len(sectors)
    sectors.append(folder.ljust(512, b"\0"))
    chains.append(END)
    tables = 1
    while tables * 128 < len(sectors) + tables:
        tables += 1
    fats = [*range(len(sectors), len(sectors) + tables)]
    chains += [0xFFFFFFFD] * tables
    chains += [FREE] * (tables * 128 - len(chains))
    head = bytearray(512)
    head[:8] = SIGNATURE
    struct.pack_into("<HHHHH", head, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<8I", head, 44, tables, at, 0, SMALL, END, 0, END, 0)
    struct.pack_into("<109I", head, 76, *fats, *[FREE] * (109 - tables))
    return bytes(head) + b"".join(sectors) + struct.pack(f"<{tables * 128}I", *chains)
