"""Word-processor documents and sheets as marked lines (? question, + right, = wrong).

A document is one row with its bytes; its layout is found out of six, and its lines come out in order. All of
this looks at one document only, so documents are independent of each other and spread over the executors.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from pathlib import PurePosixPath
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from .files import M, R, W, formula, xlsx_rows

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
#: A colour dominates if it exceeds both others by more than this.
DOMINANT = 40

# Signs that open marked lines and options, and patterns of questions, options, headers and sections.
MARKED = "?+="
LETTER = "А-ЯЁа-яёA-Za-z"
OPTION = re.compile(rf"\s*[{LETTER}][.)]\s*\S")
OPTION_MARK = re.compile(rf"[{LETTER}][.)]\s*")
BARE_MARK = re.compile(rf"[{LETTER}][.)]?\s*")
LOOSE_OPTION = re.compile(r"[А-ЯЁа-яё]\s+(\S.*)")
QUESTION = re.compile(rf"\s*\d+[.)]\s*(.*)|\s*\d{{1,3}}\s+([{LETTER}].*)")
NUMBERED = re.compile(r"\d+[.)]\s+(.+)$|\d{2,3}\s+[.)]+\s*(.+)$|\d{2,3}\s+\d+[.)]\s*(.+)$|\d{2,3}([А-ЯЁA-Z].{4,})$|\d{2,3}\s+([А-ЯЁA-Z].{4,})$")
ASKS = re.compile(r"\?|\d+[.)]\s|\d{2,3}[.)'\"“”«»]\S")
RULE = re.compile(r"[+=]{3,}$")
SECTION = re.compile(r"част[а-яё]{0,2}\s*\d", re.IGNORECASE)
INLINE_OPTION = re.compile(r"\n\s*[a-d]\.\s", re.IGNORECASE)
HEAD_CELL = re.compile(r"\b(?:savol|javob|to[\W_]*g[\W_]*ri|muqobil|question|answer|correct|wrong|option|variant)\b|вопрос|ответ|правильн|альтернатив|^[№n]$|^t/r$|^no\.?$", re.IGNORECASE)
SHEET_HEAD_WORDS = {"savol", "question", "to'g'ri", "noto'g'ri", "correct", "incorrect", "t/r", "№", "id", "javob", "fan"}
SHEET_HEAD_PHRASES = ("savol matni", "to'g'ri javob", "noto'g'ri javob", "savol_matni", "savol matn", "fan nomi", "fan_nomi")
#: Places where a line is split before an option, a question number or a mark, in this order.
INLINE = [
    (re.compile(r"^\s*([a-fA-F]) \)", re.MULTILINE), r"\1)"),
    (re.compile(r";\s*([=+])\s"), r"\n\1 "),
    (re.compile(r"(?<=[^\s#*+=\-–\nA-Z\d(])\s*([#*+=]?[A-D]\))"), r"\n\1"),
    (re.compile(r"(?<=[^\s#*+=\-–\na-zA-Z\d(])\s*([#*+=]?[a-d]\))"), r"\n\1"),
    (re.compile(r"(?<=[^\n\d])\s+(\d{2,3}[.)](?=\s))"), r"\n\1"),
]


@dataclass
class Run:
    text: str
    bold: bool = False
    color: str | None = None
    highlight: str | None = None

    def strong(self) -> bool:
        """Highlighted, or of a colour in which green or red dominates."""
        if self.highlight not in (None, "none"):
            return True
        if not self.color or not re.fullmatch(r"[0-9A-Fa-f]{6}", self.color):
            return False
        r, g, b = (int(self.color[k : k + 2], 16) for k in (0, 2, 4))
        return g - max(r, b) > DOMINANT or r - max(g, b) > DOMINANT


@dataclass
class Paragraph:
    text: str
    runs: list[Run]
    numbered: bool = False
    images: list[str] = field(default_factory=list)

    def fully_bold(self) -> bool:
        told = [r.bold for r in self.runs if r.text.strip()]
        return bool(told) and all(told)

    def some_bold(self) -> bool:
        return any(r.bold and r.text.strip() for r in self.runs)

    def bold_chunks(self) -> list[str]:
        """Neighbouring bold runs joined."""
        joined = ("".join(r.text for r in rs).strip() for bold, rs in groupby(self.runs, lambda r: r.bold) if bold)
        return [x for x in joined if x]


@dataclass
class Table:
    """Rows of cells; a cell is (identity, paragraphs), and a merged cell is in several places under one identity."""

    rows: list[list[tuple[int, list[Paragraph]]]]

    def width(self) -> int:
        return max(map(len, self.rows), default=0)

    def unique(self, row: int) -> list[list[Paragraph]]:
        return list(dict(self.rows[row]).values())

    def columns(self) -> int:
        """Cells of the first row that has more than one, merged ones once."""
        return next((n for n in (len({k for k, _ in row}) for row in self.rows) if n > 1), 0)


class Document:
    """Blocks of the body in order, and images by relation."""

    def __init__(self, data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
            self.images: dict[str, tuple[str, bytes]] = {}
            names = set(z.namelist())
            if "word/_rels/document.xml.rels" in names:
                for x in ET.fromstring(z.read("word/_rels/document.xml.rels")):
                    target = str(PurePosixPath("word") / x.get("Target", "").lstrip("/"))
                    if target in names and "/media/" in target:
                        self.images[x.get("Id")] = PurePosixPath(target).suffix.lower(), z.read(target)
        self.blocks = [self._paragraph(x) if x.tag == W + "p" else self._table(x) for x in (body if body is not None else ()) if x.tag in (W + "p", W + "tbl")]
        self.tables = [x for x in self.blocks if isinstance(x, Table)]
        self.top = [x for x in self.blocks if isinstance(x, Paragraph)]

    @staticmethod
    def _run(r: ET.Element) -> Run:
        props = r.find(W + "rPr")

        def get(name):
            x = None if props is None else props.find(W + name)
            return None if x is None else x.get(W + "val", "1")

        return Run("".join("\n" if x.tag == W + "br" else x.text or "" for x in r if x.tag in (W + "t", W + "br")), get("b") not in (None, "0", "false"), get("color"), get("highlight"))

    def _paragraph(self, p: ET.Element) -> Paragraph:
        """Runs are those of the paragraph itself; its text also has those of links, and formulas."""
        text, runs = [], []
        for x in p:
            if x.tag == W + "r":
                runs.append(self._run(x))
                text.append(runs[-1].text)
            elif x.tag == W + "hyperlink":
                text += [self._run(r).text for r in x.iter(W + "r")]
            elif x.tag in (M + "oMath", M + "oMathPara"):
                text.append(formula(x))
        ids = [x.get(R + "embed") for x in p.iter(A + "blip")]
        return Paragraph("".join(text), runs, p.find(f"{W}pPr/{W}numPr") is not None, [i for i in ids if i in self.images])

    def _table(self, t: ET.Element) -> Table:
        rows: list[list[tuple[int, list[Paragraph]]]] = []
        for tr in t.findall(W + "tr"):
            row: list[tuple[int, list[Paragraph]]] = []
            for tc in tr.findall(W + "tc"):
                span, below = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
                cell = id(tc), [self._paragraph(p) for p in tc.findall(W + "p")]
                if below is not None and below.get(W + "val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                    cell = rows[-1][len(row)]
                row += [cell] * (int(span.get(W + "val", "1")) if span is not None else 1)
            rows.append(row)
        return Table(rows)

    def paragraphs(self) -> list[Paragraph]:
        """All of them in order, those of tables by rows and cells; of a merged cell in each of its places."""
        return [p for x in self.blocks for p in ([x] if isinstance(x, Paragraph) else [p for row in x.rows for _, ps in row for p in ps])]


def marked(texts: list[str]) -> bool:
    return any(x.strip()[:1] in MARKED for x in texts if x.strip())


# One paragraph for a question and its options.


def is_inline(doc: Document) -> bool:
    texts = [p.text for p in doc.paragraphs()]
    return not marked(texts) and sum(bool(INLINE_OPTION.search(x)) for x in texts) >= 5


def inline_lines(doc: Document) -> list[str]:
    """Nothing tells the right option, so all are wrong ones. Three spaces part options of one line."""
    out: list[str] = []
    for text in (p.text for p in doc.paragraphs()):
        if not INLINE_OPTION.search(text):
            out += [text.strip()] if text.strip() else []
            continue
        head, *rest = (x.strip() for x in re.sub(r"(?i)\s{3,}([a-d])\.\s*", r"\n\1. ", text).split("\n") if x.strip())
        number = re.match(r"(?s)\d+[.)]\s*(.*)", head)
        head = number[1].strip() if number else head
        out += [f"? {head}"] if head else []
        for x in rest:
            option = re.match(r"(?is)[a-d]\.\s*(.*)", x)
            if option:
                out += [f"= {option[1].strip()}"] if option[1].strip() else []
            elif out:
                out[-1] += f" {x}"
    return out


# A table for each question, ruled.


def is_table_blocks(doc: Document) -> bool:
    some = doc.tables[:10]
    if len(doc.tables) < 5 or any(t.width() > 2 for t in some):
        return False
    heads = ["".join(p.text + "\n" for p in row[0][1]).strip() for t in some for row in t.rows if row]
    rules = sum(len(x) >= 3 and not x.strip("=") for x in heads)
    return rules >= 3 * len(some) and sum(x.startswith("#") for x in heads) >= max(1, len(some) // 2)


def table_block_lines(doc: Document) -> list[str]:
    out = []
    for x in doc.blocks:
        out += [x.text.strip()] if isinstance(x, Paragraph) else [" ".join(p.text.strip() for p in row[0][1] if p.text.strip()) for row in x.rows if row]
    return [x for x in out if x]


# One table: bold questions, the first option right.


def is_table_bold(doc: Document) -> bool:
    if not doc.tables or doc.tables[0].width() > 2:
        return False
    some = [p for row in doc.tables[0].rows[:60] for _, ps in row for p in ps if "".join(r.text for r in p.runs).strip()]
    return len(some) >= 10 and not marked([p.text for p in some]) and 0.10 <= sum(p.some_bold() for p in some) / len(some) <= 0.55


def table_bold_lines(doc: Document) -> list[str]:
    out, nth = [], 0
    for p in (p for row in doc.tables[0].rows for _, ps in row for p in ps if p.text.strip()):
        nth = 0 if p.some_bold() else nth + 1
        out.append(("? ", "+ ", "= ")[min(nth, 2)] + p.text.strip())
    return out


# Tables with a question in each row.


def cell_text(paragraphs: list[Paragraph]) -> str:
    return " ".join(p.text.replace("\n", " ") for p in paragraphs).strip()


def is_header(cells: list[str]) -> bool:
    some = [c for c in cells if c]
    return bool(some) and all(len(c) < 40 for c in some) and sum(bool(HEAD_CELL.search(c)) for c in some) >= min(2, len(some))


def second_column_asks(rows: list[list[str]]) -> bool:
    """Whether the first column only counts: numbers that follow each other, or mostly nothing beside a filled second column."""
    data = [r for r in rows[:60] if sum(map(bool, r)) > 1 and not is_header(r)]
    if not data:
        return False
    numbers = [int(m[1]) for r in data if (m := re.match(r"(\d+)\.?\s*$", r[0]))]
    if len(numbers) >= 3 and sum(b == a + 1 for a, b in zip(numbers, numbers[1:])) >= len(numbers) - 1:
        return True
    return sum(bool(r[0]) for r in data) / len(data) < 0.5 < sum(len(r) > 1 and bool(r[1]) for r in data) / len(data)


def table_lines(rows: list[list[str]]) -> list[str]:
    """Starred answers are right and come first; in a row without any the first answer is right."""
    at, starred = int(second_column_asks(rows)), any(c.startswith("*") for r in rows[:30] for c in r[1:])
    out, titled = [], False
    for row in rows:
        some = [c for c in row if c]
        if len(some) <= 1 or is_header(row):
            continue
        if not titled and len(set(some)) == 1:
            titled = True
            continue
        if len(row) <= at or not row[at]:
            continue
        answers = [c for c in row[at + 1 :] if c]
        right = [c[1:].strip() for c in answers if starred and c.startswith("*")]
        wrong = [c for c in answers if not (starred and c.startswith("*"))]
        if not right:
            right, wrong = wrong[:1], wrong[1:]
        out += [f"? {row[at]}", *(f"+ {c}" for c in right), *(f"= {c}" for c in wrong)]
    return out


def is_table_columns(doc: Document) -> bool:
    if marked(["".join(r.text for r in p.runs) for p in doc.top[:30]]):
        return False
    return any(t.columns() >= 3 and sum(sum(bool(cell_text(c)) for c in t.unique(k)) >= 2 for k in range(min(30, len(t.rows)))) >= 3 for t in doc.tables)


def stem_of(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "doc"


def cell_images(doc: Document, stem: str) -> Iterator[tuple[int, int, int, str, bytes]]:
    """(table, row, cell, path, content) of images in cells of tables with two columns or more, numbered through."""
    n = 0
    for t, table in enumerate(doc.tables):
        if table.columns() < 2:
            continue
        for row in range(len(table.rows)):
            for k, cell in enumerate(table.unique(row)):
                for i in (i for p in cell for i in p.images):
                    n += 1
                    suffix, content = doc.images[i]
                    yield t, row, k, f"images/{stem}/t{t}_row{row}_img{n}{suffix or '.png'}", content


def table_column_lines(doc: Document, stem: str = "doc") -> list[str]:
    """A cell's images follow its text as tokens."""
    tokens: dict[tuple[int, int, int], list[str]] = {}
    for t, row, k, path, _ in cell_images(doc, stem):
        tokens.setdefault((t, row, k), []).append(f"[[img:{path}]]")
    out = []
    for t, table in enumerate(doc.tables):
        if table.columns() >= 2:
            out += table_lines([[" ".join([*filter(None, [cell_text(c)]), *tokens.get((t, row, k), [])]) for k, c in enumerate(table.unique(row))] for row in range(len(table.rows))])
    return out


# Numbered questions with lettered options, the right one in bold.


def is_bold_text(option: str, chunks: list[str]) -> bool:
    """A bold chunk is the option, or the option after a bare mark; part of it isn't enough."""
    return bool(option) and any(c == option or c.endswith(option) and BARE_MARK.fullmatch(c[: -len(option)]) for c in chunks)


def segments(text: str) -> list[str]:
    return [x.strip() for x in text.strip().split("\n") if x.strip()]


def is_numbered_bold(doc: Document) -> bool:
    paragraphs = doc.paragraphs()
    if marked([p.text for p in paragraphs]):
        return False
    questions = options = bold = 0
    for p in paragraphs:
        parts = segments(p.text)
        lettered = [bool(OPTION.match(x)) for x in parts]
        if len(parts) > 1:
            questions += sum(lettered) >= 2 and not lettered[0]
            options += sum(lettered)
        elif parts:
            options += lettered[0]
            questions += not lettered[0] and bool(QUESTION.match(parts[0]))
        chunks = p.bold_chunks()
        bold += any(is_bold_text(OPTION_MARK.sub("", x, count=1).strip(), chunks) for x, is_option in zip(parts, lettered, strict=True) if is_option)
    return questions >= 5 and options >= 5 and bold >= 3


def numbered_bold_lines(doc: Document) -> list[str]:
    """In paragraphs of several lines an option may lack the point after a Cyrillic letter, and the first line asks if two options follow."""
    out: list[str] = []
    begun = False
    for p in doc.paragraphs():
        parts, chunks = segments(p.text), p.bold_chunks()
        lettered = [bool(OPTION.match(x)) for x in parts]
        several = len(parts) > 1
        if several and not any(lettered) and not any(QUESTION.match(x) for x in parts):
            continue
        for k, (x, is_option) in enumerate(zip(parts, lettered, strict=True)):
            loose = LOOSE_OPTION.match(x) if several and not is_option else None
            asks = QUESTION.match(x)
            opens = several and k == 0 and not is_option and not loose and sum(lettered) >= 2
            if not is_option and not loose and (asks or opens):
                begun = True
                body = (asks[1] or asks[2] or "").strip() if asks else x
                out += [f"? {body}"] if body else []
            elif begun and (is_option or loose):
                body = OPTION_MARK.sub("", x, count=1).strip() if is_option else loose[1].strip()
                out += [f"{'+' if is_bold_text(body, chunks) else '='} {body}"] if body else []
            elif begun and out:
                out[-1] += f" {x}"
    return out


# Any other document: marks in the text, or else colour, list numbers and bold type.


def explicit(lines: list[str]) -> bool:
    return any(x.startswith("+") and not RULE.match(x) or re.match(r"[*#]\s*[a-fA-F][.)]", x) for x in (x.strip() for x in lines))


def mark_right(text: str) -> str:
    lead, body = re.match(r"(\s*)(.*)", text, re.DOTALL).groups()
    if not body or body[0] in "?#+" or re.match(r"\d+[.)]", body):
        return text
    return f"{lead}+{body[1:]}" if body[0] in "=-–" else f"{lead}#{body}"


def block_lines(paragraphs: list[Paragraph]) -> list[str]:
    """A question sign or a list number opens a block; in it the first strong option is right, or else the only bold one."""
    blocks: list[list[Paragraph]] = []
    for p in paragraphs:
        if not p.text.strip():
            continue
        if not blocks or p.text.strip().startswith("?") or p.numbered:
            blocks.append([])
        blocks[-1].append(p)
    out = []
    for head, *options in blocks:
        asks = head.text.strip()
        out.append(f"? {asks}" if head.numbered and asks[0] not in "?=+#-–" else head.text)
        strong = [k for k, p in enumerate(options) if any(r.strong() for r in p.runs)]
        bold = [k for k, p in enumerate(options) if p.fully_bold()]
        right = strong[0] if strong else bold[0] if len(bold) == 1 else None
        out += [mark_right(p.text) if k == right else p.text for k, p in enumerate(options)]
    return out


def mark_numbered(line: str) -> str:
    x = line.strip()
    found = None if x[:1] in ("?", "=", "+", "#") else NUMBERED.match(x)
    return f"? {next(g for g in found.groups() if g).strip()}" if found else line


def mark_before_dashes(lines: list[str]) -> list[str]:
    """An unmarked line before one that opens with a dash or plus asks."""
    out = list(lines)
    following = ""
    for k in range(len(out) - 1, -1, -1):
        x = out[k].strip()
        if not x:
            continue
        if following[:1] in ("-", "–", "+") and x[0] not in "?=+#*-–":
            out[k] = f"? {x}"
        following = x
    return out


def unmark_all_right(lines: list[str]) -> list[str]:
    """Where all options of a question, two or more, are marked right, the marks are ornament."""
    out, scope = list(lines), None

    def close(options: list[int] | None) -> None:
        if options and len(options) > 1 and all(out[k].lstrip()[0] in "+#" for k in options):
            for k in options:
                lead = len(out[k]) - len(out[k].lstrip())
                out[k] = out[k][:lead] + ("=" if out[k][lead] == "+" else "") + out[k][lead + 1 :]

    for k, line in enumerate(lines):
        x = line.strip()
        if ASKS.match(x):
            close(scope)
            scope = []
        elif RULE.match(x) or SECTION.match(x):
            close(scope)
            scope = None
        elif scope is not None and x[:1] in ("=", "+", "#"):
            scope.append(k)
    close(scope)
    return out


def number_unnumbered(lines: list[str]) -> list[str]:
    """Where lines that open with a) outnumber numbered ones, the line before each of them gets a number."""
    opens = re.compile(r"[#*+=]?\s*[aAаА]\)")
    first = sum(bool(opens.match(x.strip())) for x in lines)
    if first < 5 or first <= sum(bool(re.match(r"\d+[.)]", x.strip())) for x in lines):
        return lines
    out, following, asked = list(lines), "", []
    for k in range(len(out) - 1, -1, -1):
        x = out[k].strip()
        if not x:
            continue
        if opens.match(following) and not re.match(r"[?=+#*\-–]|\d+[.)]|[a-fA-FА-Еа-е][.)]", x):
            asked.append(k)
        following = x
    for n, k in enumerate(reversed(asked), 1):
        out[k] = f"{n}. {out[k].strip()}"
    return out


def split_inline(text: str) -> str:
    for pattern, to in INLINE:
        text = pattern.sub(to, text)
    return text


def plain_lines(doc: Document) -> list[str]:
    paragraphs = doc.paragraphs()
    lines = [p.text for p in paragraphs]
    if not explicit([x for t in lines for x in t.split("\n")]):
        lines = mark_before_dashes([mark_numbered(x) for x in block_lines(paragraphs)])
    return number_unnumbered(split_inline("\n".join(unmark_all_right(lines))).split("\n"))


#: Layouts in the order in which they are tried.
LAYOUTS: list[tuple[str, Callable[[Document], bool], Callable[[Document], list[str]]]] = [
    ("inline", is_inline, inline_lines),
    ("table_blocks", is_table_blocks, table_block_lines),
    ("table_bold", is_table_bold, table_bold_lines),
    ("table_columns", is_table_columns, table_column_lines),
    ("numbered_bold", is_numbered_bold, numbered_bold_lines),
]


def docx_lines(data: bytes, stem: str = "doc") -> tuple[str, list[str]]:
    """The layout's name and the document's lines."""
    doc = Document(data)
    for name, fits, lines in LAYOUTS:
        if fits(doc):
            return name, lines(doc, stem) if lines is table_column_lines else lines(doc)
    return "plain", plain_lines(doc)


def quiz_questions(data: bytes) -> list[dict]:
    """Questions (?) with options (+, =) of the body's own paragraphs, tables left out; a paragraph of only an image gives the question its first one."""
    doc, out = Document(data), []
    for n, p in enumerate(doc.top, 1):
        x = p.text.strip()
        if not x:
            if p.images and out and out[-1]["image"] is None:
                out[-1]["image"] = doc.images[p.images[0]][1]
        elif x[0] == "?":
            out.append({"question": x[1:].strip(), "options": [], "right": [], "line_start": n, "image": None})
        elif x[0] in "+=" and out:
            out[-1]["options"].append(x[1:].strip())
            out[-1]["right"].append(x[0] == "+")
        elif out and out[-1]["options"]:
            out[-1]["options"][-1] += f" {x}"
        elif out:
            out[-1]["question"] += f" {x}"
    return out


# Sheets.


def counts_only(column: list[str]) -> bool:
    """Whether the first column holds a subject, numbers or codes and no questions."""
    if not column:
        return False
    if len(set(column)) == 1 or len(set(column)) / len(column) < 0.30:
        return True
    number = lambda x: re.sub(r"[.-]", "", x).strip().isdigit() or any(w in x.lower() for w in ("savol", "quest", "t/r", "№"))
    return all(len(x) <= 10 or number(x) for x in column)


def sheet_lines(rows: list[list[str | None]]) -> list[str]:
    """Rows of three filled cells or more, the header left out: question, right answer, wrong answers, from the first or second column on."""
    wide = [[(c or "").strip() for c in r] for r in rows if sum(bool(c and c.strip()) for c in r) >= 3]
    if wide:
        heads = [c.lower() for c in wide[0] if c][:3]
        if any(SHEET_HEAD_WORDS & set(re.sub(r"[/.-]", " ", h).split()) or any(x in h for x in SHEET_HEAD_PHRASES) for h in heads):
            wide = wide[1:]
    at = int(counts_only([r[0] for r in wide if r[0]]))
    out = []
    for r in wide:
        asks, right, *wrong = [*r[at:], "", ""][: max(2, len(r) - at)]
        wrong = [x for x in wrong if x]
        if asks and right and wrong:
            out += [f"? {asks}", f"+ {right}", *(f"= {x}" for x in wrong), ""]
    return out


def xlsx_lines(data: bytes) -> list[str]:
    """Lines of all sheets in their order."""
    sheets = groupby(xlsx_rows(data), lambda r: r["sheet"])
    return [x for _, rows in sheets for x in sheet_lines([r["cells"] for r in rows])]


LINES = "path string, layout string, line_no long, text string"


def _lines(read: Callable[[bytes, str], tuple[str, list[str]]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    layout, lines = read(bytes(content), stem_of(PurePosixPath(path).stem))
                except (KeyError, ValueError, AttributeError, IndexError, zipfile.BadZipFile, ET.ParseError):
                    yield pd.DataFrame([(path, "unreadable", None, None)], columns=["path", "layout", "line_no", "text"]).astype({"line_no": "Int64"})
                    continue
                texts = "\n".join(lines).split("\n") if lines else []
                yield pd.DataFrame({"path": path, "layout": layout, "line_no": range(1, len(texts) + 1), "text": texts}).astype({"line_no": "Int64"})

    return run


def read_docx_lines(source: DataFrame) -> DataFrame:
    """(path, layout, line_no, text) of the documents in (path, content); one row of layout "unreadable" where a file can't be read."""
    return source.select("path", "content").mapInPandas(_lines(docx_lines), LINES)


def read_xlsx_lines(source: DataFrame) -> DataFrame:
    """The same for sheets."""
    return source.select("path", "content").mapInPandas(_lines(lambda data, _: ("sheet", xlsx_lines(data))), LINES)


def read_docx_images(source: DataFrame) -> DataFrame:
    """(path, image, content) of images in table cells, under the names that the lines' tokens have."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, name, data) for _, _, _, name, data in cell_images(Document(bytes(content)), stem_of(PurePosixPath(path).stem))]
                except (KeyError, ValueError, zipfile.BadZipFile, ET.ParseError):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "image", "content"])

    return source.select("path", "content").mapInPandas(run, "path string, image string, content binary")
