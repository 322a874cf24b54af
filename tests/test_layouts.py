"""Word-processor documents of every layout, sheets, images, and what can't be read; a resolver made up for the purpose."""

import io
import json
import zipfile

import pytest

from sieveloom.config import AllowedUsers, load_settings, logger, model_of
from sieveloom.sources import layouts, writers
from sieveloom.sources.files import M, R, W, errors, files, incoming
from sieveloom.streaming import resolver

A = layouts.A


def run(text, bold=False, color=None, highlight=None):
    props = ("<w:b/>" if bold else "") + (f'<w:color w:val="{color}"/>' if color else "") + (f'<w:highlight w:val="{highlight}"/>' if highlight else "")
    return f"<w:r><w:rPr>{props}</w:rPr>" + "<w:br/>".join(f'<w:t xml:space="preserve">{x}</w:t>' for x in text.split("\n")) + "</w:r>"


def p(*runs, numbered=False, image=None):
    runs = [run(x) if isinstance(x, str) and not x.startswith("<") else x for x in runs]
    return f"<w:p>{'<w:pPr><w:numPr/></w:pPr>' if numbered else ''}{''.join(runs)}" + (f'<w:r><w:drawing><a:blip r:embed="{image}"/></w:drawing></w:r>' if image else "") + "</w:p>"


def table(*rows):
    cell = lambda c: f"<w:tc>{c if c.startswith('<') else p(c)}</w:tc>"
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"


def docx(*blocks, media=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W[1:-1]}" xmlns:m="{M[1:-1]}" xmlns:r="{R[1:-1]}" xmlns:a="{A[1:-1]}"><w:body>{"".join(x if x.startswith("<") else p(x) for x in blocks)}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", "<x>" + "".join(f'<r Id="{i}" Target="media/{name}"/>' for i, name, _ in media) + '<r Id="gone" Target="media/none.png"/></x>')
        for _, name, data in media:
            z.writestr(f"word/media/{name}", data)
    return out.getvalue()


def test_inline():
    body = [f"{k}. Which one{k}\na. x\nb. y   c. z\nof it" for k in range(5)]
    layout, lines = layouts.docx_lines(docx("Title", *body))
    assert layout == "inline" and lines[:5] == ["Title", "? Which one0", "= x", "= y", "= z of it"]
    assert layouts.docx_lines(docx("? marked", *body))[0] != "inline"


def test_table_blocks():
    one = table(("Which",), ("====",), ("#right",), ("====",), ("wrong",), ("====",), ("other",))
    layout, lines = layouts.docx_lines(docx(*[one, "++++"] * 5))
    assert layout == "table_blocks" and lines[:8] == ["Which", "====", "#right", "====", "wrong", "====", "other", "++++"]


def test_table_bold():
    rows = [(x,) for k in range(4) for x in (p(run(f"Q{k}", bold=True)), "first", "second", "third")]
    layout, lines = layouts.docx_lines(docx(table(*rows)))
    assert layout == "table_bold" and lines[:5] == ["? Q0", "+ first", "= second", "= third", "? Q1"]


def test_table_columns_with_images():
    rows = [("№", "Savol", "Javob", "x"), ("1", "q1", "*a", "b"), ("2", "q2", p("", image="i1"), "*d"), ("3", "q3", "e", "f")]
    data = docx(table(*rows), media=[("i1", "p.jpeg", b"JPG")])
    layout, lines = layouts.docx_lines(data, "my_doc")
    assert layout == "table_columns" and lines == ["? q1", "+ a", "= b", "? q2", "+ d", "= [[img:images/my_doc/t0_row2_img1.jpeg]]", "? q3", "+ e", "= f"]
    assert [x[3:] for x in layouts.cell_images(layouts.Document(data), "my_doc")] == [("images/my_doc/t0_row2_img1.jpeg", b"JPG")]


def test_merged_cells():
    wide = "<w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc>"
    t = layouts.Document(docx(f"<w:tbl><w:tr>{wide}</w:tr><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>")).tables[0]
    assert t.width() == 2 and t.columns() == 2 and len(t.unique(0)) == 1 and [layouts.cell_text(c) for c in t.unique(1)] == ["a", "b"]
    assert layouts.table_lines([["same", "same"], ["q", "a"], ["r", "b"]]) == ["? q", "+ a", "? r", "+ b"]


def test_numbered_bold():
    simple = [x for k in range(5) for x in (f"{k + 1}.Question {k}", "А. one", p(run("Б. "), run("two", bold=True)))]
    layout, lines = layouts.docx_lines(docx(*simple))
    assert layout == "numbered_bold" and lines[:3] == ["? Question 0", "= one", "+ two"]
    compound = [p(run(f"Which {k}\nа) would\nб) "), run("would have", bold=True), run("\nД loose\nmore")) for k in range(5)]
    layout, lines = layouts.docx_lines(docx(*compound))
    assert layout == "numbered_bold" and lines[:4] == ["? Which 0", "= would", "+ would have", "= loose more"]


@pytest.mark.parametrize("blocks,lines", [
    (["? q", "= a", p(run("= b", highlight="yellow"))], ["? q", "= a", "+ b"]),
    (["? q", "a", p(run("b", color="00B050")), p(run("c", color="FF0000"))], ["? q", "a", "#b", "c"]),
    (["? q", p(run("A) a", bold=True)), "B) b"], ["? q", "#A) a", "B) b"]),
    (["? q", p(run("a", bold=True)), p(run("b", bold=True))], ["? q", "a", "b"]),
    (["? q", "+ a", p(run("= b", highlight="yellow"))], ["? q", "+ a", "= b"]),
    ([p("listed", numbered=True), "- a", "- b"], ["? listed", "- a", "- b"]),
    (["1. Numbered", "x", "plain asks", "- a"], ["? Numbered", "x", "? plain asks", "- a"]),
    (["? q", "+ a", "+ b"], ["? q", "= a", "= b"]),
    (["1. q?", "A) one;= two;*B) three"], ["? q?", "A) one", "= two;", "*B) three"]),
    ([x for k in range(5) for x in (f"Ask {k}", "a) x", "b) y")], [x for k in range(5) for x in (f"{k + 1}. Ask {k}", "a) x", "b) y")]),
])
def test_plain(blocks, lines):
    layout, got = layouts.docx_lines(docx(*blocks))
    assert layout == "plain" and got == lines


def test_formulas_and_links():
    m = f'<m:oMath><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath>'
    d = layouts.Document(docx(f"<w:p><w:r><w:t>x = </w:t></w:r>{m}<w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink></w:p>"))
    assert d.top[0].text == "x = a/b link"


def test_quiz_reader():
    data = docx("? one", p("", image="i1"), "+ yes", "= no", "and more", "? two", "- not a mark", media=[("i1", "p.png", b"PNG")])
    one, two = layouts.quiz_questions(data)
    assert one == {"question": "one", "options": ["yes", "no and more"], "right": [True, False], "line_start": 1, "image": b"PNG"} and two["question"] == "two - not a mark"


def test_sheets():
    rows = [["Title"], ["Fan", "Savol matni", "To'g'ri javob", "x"], ["Bio", "q1", "a", "b", None, "c"], ["Bio", "q2", "a"], ["Bio", "q3", "", "b"], ["Bio", "q4", "d", "e"]]
    assert layouts.sheet_lines(rows) == ["? q1", "+ a", "= b", "= c", "", "? q4", "+ d", "= e", ""]
    assert layouts.sheet_lines([["what is thing " + str(k), "yes", "no"] for k in range(4)])[:3] == ["? what is thing 0", "+ yes", "= no"]
    assert layouts.sheet_lines([[str(k), f"q{k}", "yes", "no"] for k in range(4)])[0] == "? q0" and layouts.sheet_lines([]) == []


def test_read(spark, tmp_path):
    (tmp_path / "a b.docx").write_bytes(docx("? q", "+ a", "= b\nc"))
    (tmp_path / "broken.docx").write_bytes(b"no")
    got = layouts.read_docx_lines(files(spark, str(tmp_path), ".docx")).orderBy("path", "line_no").collect()
    assert [(r.layout, r.line_no, r.text) for r in got] == [("plain", 1, "? q"), ("plain", 2, "+ a"), ("plain", 3, "= b"), ("plain", 4, "c"), ("unreadable", None, None)]
    assert layouts.read_docx_images(files(spark, str(tmp_path), ".docx")).count() == 0


def test_sinks(spark, tmp_path):
    questions = spark.createDataFrame([(1, 2, "second", ["x", "y"], -1, b"\xff\xd8J"), (1, 1, "first & <b>", ["a", "b", "c"], 1, None), (2, 1, "other", ["p", "q"], 0, None)], "doc_id long, q_no int, q string, o array<string>, c int, image binary")
    assert writers.save_files(writers.documents(questions), f"{tmp_path}/docs") == 2 and writers.save_files(writers.documents(questions, resolved=True), f"file://{tmp_path}/shown") == 2
    first, second = layouts.quiz_questions((tmp_path / "docs/1.docx").read_bytes())
    assert (first["question"], first["right"], second["image"]) == ("first & <b>", [False, True, False], b"\xff\xd8J")
    shown = layouts.Document((tmp_path / "shown/2.docx").read_bytes())
    assert [(p.text, p.runs[0].color, p.runs[0].bold) for p in shown.top if p.text][1:] == [("? other", None, True), ("+ p", writers.RIGHT, False), ("= q", writers.OTHER, False)]
    for full in (False, True):
        writers.save_json(questions.drop("image"), f"{tmp_path}/json", full)
        rows = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
        assert len(rows) == 3 and all(("q_no" in r) == full and {"q", "o", "c"} <= set(r) for r in rows)
    writers.save_text(questions, f"{tmp_path}/text")
    text = "".join(f.read_text() for f in sorted((tmp_path / "text/doc_id=1").glob("*.txt")))
    assert text == "? first & <b>\n= a\n+ b\n= c\n\n? second\n= x\n= y\n\n"


def test_incoming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.docx", docx("? q")), ("b.exe", b"x"), ("c.TXT", b"? q"), ("d.pdf", b"%PDF")):
        (tmp_path / "in" / name).write_bytes(data)
    q = incoming(spark, f"{tmp_path}/in").select("ext", "length").writeStream.format("memory").queryName("incoming").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.ext for r in spark.table("incoming").collect()) == [".docx", ".pdf", ".txt"]


def test_errors(spark):
    source = spark.createDataFrame([("a.docx", bytearray(docx("? q"))), ("b.docx", bytearray(b"no")), ("c.docx", bytearray(b"PK\x05\x06" + bytes(18)))], "path string, content binary")
    assert {r.path: r.error.split(":")[0] for r in errors(source).collect()} == {"b.docx": "BadZipFile", "c.docx": "KeyError"}


class Made:
    """A resolver that loses connections, and whose job ends at the third look."""

    def __init__(self, end="ended"):
        self.looks, self.lost, self.end = 0, 2, end

    def create(self, requests):
        self.lost -= 1
        if self.lost >= 0:
            raise ConnectionError
        return {"id": "b1", "processing_status": "in_progress", "request_counts": {"processing": len(requests)}}

    def status(self, batch_id):
        self.looks += 1
        done = self.looks >= 3
        return {"id": batch_id, "processing_status": self.end if done else "in_progress", "request_counts": {"processing": 0 if done else 1, "succeeded": 1}}

    def cancel(self, batch_id):
        return {"id": batch_id, "processing_status": "canceling"}

    def results(self, batch_id):
        yield {"custom_id": "chunk-1"}


def test_jobs_of_a_resolver():
    waits, told, made = [], [], Made()
    assert resolver.create_job([{}, {}], made, waits.append)["total_requests"] == 2 and waits == [5.0, 10.0]
    assert resolver.await_job("b1", made, 10, told.append, waits.append) == [{"custom_id": "chunk-1"}] and told == [0.5, 0.5, 1.0] and waits[2:] == [10, 10]
    with pytest.raises(RuntimeError):
        resolver.await_job("b1", Made("expired"), sleep=waits.append)
    with pytest.raises(ConnectionError):
        resolver.create_job([], type("Down", (Made,), {"create": lambda self, r: (_ for _ in ()).throw(ConnectionError())})(), waits.append)
    assert resolver.cancel_job("b1", made)["status"] == "canceling"


def test_chunks_and_results(spark, tmp_path):
    chunks = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "chunk_id long, request string")
    ask = lambda r: "no JSON" if r == "r3" else f'```json\n{{"answers": [{{"id": {r[1:]}, "c": 1}}]}}\n```'
    got = resolver.resolve_chunks(chunks, ask, sleep=lambda s: None)
    assert sorted((r.chunk_id, r.text is None) for r in got.collect()) == [(k, k == 3) for k in range(5)]
    assert sorted((r.id, r.c, r.cf, r.s) for r in resolver.answers(got).collect()) == [(k, 1, 0.0, False) for k in (0, 1, 2, 4)]
    rows = [
        {"custom_id": "chunk-1", "result": {"type": "succeeded", "message": {"stop_reason": "end_turn", "usage": {"input_tokens": 10, "output_tokens": 4}, "content": [{"type": "thinking"}, {"type": "server_tool_use", "name": "web_search"}, {"type": "text", "text": 'so {"answers": [{"id": 1, "c": 0, "cf": 7, "s": true}]}'}]}}},
        {"custom_id": "chunk-2", "result": {"type": "succeeded", "message": {"stop_reason": "refusal", "usage": {"input_tokens": 5, "output_tokens": 1}, "content": []}}},
        {"custom_id": "chunk-3", "result": {"type": "errored"}},
        {"custom_id": "chunk-4", "result": {"type": "succeeded", "message": {"stop_reason": "end_turn", "usage": {"input_tokens": 1, "output_tokens": 1}, "content": [{"type": "text", "text": "sorry"}]}}},
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    results = resolver.read_results(spark, str(tmp_path))
    assert resolver.totals(results).first().asDict() == {"in_tokens": 16, "out_tokens": 6, "searches": 1, "refused": 1, "failed": 1}
    assert [(r.id, r.c, r.cf, r.s) for r in resolver.job_answers(results).collect()] == [(1, 0, 1.0, True)]


def test_settings(tmp_path):
    s = load_settings({"BOT_TOKEN": "t", "BOT_ADMIN_ID": "7", "BOT_ALLOWED_USERS": "1, x,2"})
    assert s.is_allowed(7) and s.is_allowed(2) and not s.is_allowed(3)
    for bad in ({}, {"BOT_TOKEN": "t", "BOT_ADMIN_ID": "me"}):
        with pytest.raises(RuntimeError):
            load_settings(bad)
    users = AllowedUsers(7, tmp_path / "x/users.json", [5, 3])
    assert users.add(9) and not users.add(9) and users.remove(5) and not users.remove(5) and json.loads((tmp_path / "x/users.json").read_text()) == [3, 9]
    assert AllowedUsers(7, tmp_path / "x/users.json", [1]).ids == {3, 9}
    (tmp_path / "x/users.json").write_text("broken")
    assert AllowedUsers(7, tmp_path / "x/users.json", [1]).ids == {1}
    assert model_of("✅ Claude Opus 5") == "claude-opus-5" and model_of("?") is None
    logger("sieveloom_test", tmp_path / "logs").info("said")
    assert "said" in (tmp_path / "logs/sieveloom_test.log").read_text()
