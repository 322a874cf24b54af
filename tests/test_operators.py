"""Single operators on small made-up input."""

import json

import pytest

from sieveloom.functions.text import join_lines
from sieveloom.operators import clean, layout, parse, spans, validate
from sieveloom.plans import views
from sieveloom.plans.dialect import apply
from sieveloom.sources.files import decode, docx_bytes, docx_runs


def lines(spark, text):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(text.split("\n"), 1)], "doc_id long, line_no long, text string")


def parsed(spark, op, text):
    rows = apply(op, spark, lines=lines(spark, text)).orderBy("q", "opt").collect()
    return [(r.q, r.opt, r.text, r.ok) for r in rows]


def test_classic(spark):
    assert parsed(spark, parse.g02_classic, "head\n? What is it\nof two\n+ red\n= blue\ndeep\n! remark\n2. Second one\nA) x\n*B) y") == [
        (1, 0, "What is it of two", False), (1, 1, "red", True), (1, 2, "blue deep", False), (2, 0, "Second one", False), (2, 1, "x", False), (2, 2, "B) y", True)]


def test_abc_answer_line(spark):
    assert [x[3] for x in parsed(spark, parse.g07_abc, "1. First\nA) a\n*B) b\nC) c\nAnswer: C") if x[1]] == [False, False, True]
    assert [x[3] for x in parsed(spark, parse.g07_abc, "1. First\nA) a\n*B) b\nAnswer: F") if x[1]] == [False, True]


def test_blocks(spark):
    assert parsed(spark, parse.g08_blocks, "Which\n====\n#one\n====\ntwo\n++++\nNext\n====\nthree") == [(0, 0, "Which", False), (0, 1, "one", True), (0, 2, "two", False), (1, 0, "Next", False), (1, 1, "three", False)]


def test_gift(spark):
    assert parsed(spark, parse.g09_gift, "Which\n{\n=one\n~two\n}\nNext\n{\n~a\n=b\n}") == [(1, 0, "Which", False), (1, 1, "one", True), (1, 2, "two", False), (2, 0, "Next", False), (2, 1, "a", False), (2, 2, "b", True)]


@pytest.mark.parametrize("text,joined", [("Is it so\n?", "Is it so ?"), ("π\n6", "π/6"), ("12\n7", "12/7"), ("a wrapped line\nthat goes on", "a wrapped line that goes on"), ("? one\n+ two", "? one\n+ two"), ("= √2\n2", "= √2/2"), ("====\nnext", "====\nnext"), ("x +\ny", "x + y"), ("a\n\n\nb", "a b"), ("", "")])
def test_join_lines(text, joined):
    assert join_lines(text) == joined


def test_dashes_keep_distinct_options(spark):
    """A dash that isn't the plain one stays where the plain one stands in an option before."""
    out = apply(clean.c04_dashes, spark, lines=lines(spark, "? q\n= a-b\n= a–b\n= c—d")).orderBy("line_no").collect()
    assert [r.text for r in out] == ["? q", "= a-b", "= a–b", "= c-d"]


@pytest.mark.parametrize("text,joined", [
    ("sinusi\n2\n5 ga teng\nend", ["sinusi 2/5 ga teng", "end"]), ("a =\n1\n\n3\nx", ["a = 1/3", "x"]), ("a\n\n1\n2 b\n3\n4 c", ["a 1/2 b 3/4 c", ""]), ("a\n1\n2\n3 x", ["a 1/2", "3 x"]), ("A\n1\n2", ["A", "1", "2"]), ("a\n1", ["a", "1"]), ("a\n1\n2024 yil", ["a 1/202 4 yil"]),
])
def test_orphan_numerators(spark, text, joined):
    out = apply(clean.c08_orphan_numerators, spark, lines=lines(spark, text)).orderBy("line_no").collect()
    assert [r.text for r in out] == joined


def test_options_dedup_with_or(spark):
    opt = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (1, 3, "a", True), (1, 4, " ", True)], "q_no long, pos long, txt string, ok boolean")
    assert [(r.txt, r.ok) for r in apply(validate.v05_option_dedup, spark, opt=opt).orderBy("place").collect()] == [("a", True), ("b", False)]
    assert apply(validate.v06_correct_index, spark, opt=opt).first().c == 0


def test_all_marked_means_none(spark):
    out = apply(layout.x15_all_correct, spark, lines=lines(spark, "? q\n+ a\n+ b\n? r\n+ c\n= d")).orderBy("line_no").collect()
    assert [r.text for r in out] == ["? q", "= a", "= b", "? r", "+ c", "= d"]


def test_decode_ladder():
    assert decode("привет".encode("cp1251")) == ("привет", "cp1251")
    assert decode(b"\xef\xbb\xbfhi") == ("hi", "utf-8-sig")
    assert decode(b"\x98\xff")[1] == "latin-1"


def test_docx_round_trip():
    assert [(r["text"], r["bold"]) for r in docx_runs(docx_bytes(["? a & b", "+ right", ""]))] == [("? a & b", False), ("+ right", True), ("", False)]


def test_throttle_stream_equals_batch(spark, tmp_path):
    from sieveloom.streaming.jobs import throttled, throttled_batch

    events = spark.sql("select id % 5 as user_id, timestamp_seconds(1000000000 + id * 7) as ts from range(100)")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = throttled(stream, 60.0).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.ts) for r in spark.sql("select * from throttled").collect()}
    assert got == {(r.user_id, r.ts) for r in throttled_batch(events, 60.0).collect()}


def test_paragraphs_are_whole(spark):
    text = " ".join(f"w{k}" for k in range(1, 41))
    runs = apply(views.runs, spark, conversations=spark.createDataFrame([(1, 0, text), (1, 1, "short one")], "conv_id long, turn long, text string"))
    first = apply(spans.j08_zip, spark, runs=runs).orderBy("n").first().text
    assert first.endswith(text[2:]) and len(first) <= len(text) + 4
    assert [r.text for r in apply(layout.x11_bold_chunks, spark, runs=runs).where("para = 1000").orderBy("chunk").collect()] == [f"w{k}" for k in range(3, 41, 3)]


def runs_of(spark, paragraphs):
    """Paragraphs of one run each: (text, bold, highlight, listed)."""
    return spark.createDataFrame([(1, k, 1, t, b, 0, 0, 0, h, n) for k, (t, b, h, n) in enumerate(paragraphs)], "doc_id long, para long, run long, text string, bold boolean, r long, g long, b long, highlight boolean, listed boolean")


def test_pages_by_their_own_counts(spark):
    pages = spark.createDataFrame([(1, 1, 2), (1, 2, 0), (1, 3, 5), (1, 4, 1)], "doc_id long, page long, n_lines long")
    out = apply(spans.s05_pages, spark, lines=lines(spark, "\n".join("x" * 10)), pages=pages).orderBy("line_no").collect()
    assert [r.page for r in out] == [1, 1, 3, 3, 3, 3, 3, 4, 4, 4]


def test_blocks_start_at_signs_and_numbers(spark):
    plain = (False, False, False)
    runs = runs_of(spark, [("lead", *plain), ("a", True, False, False), ("? one", *plain), ("", False, True, False), ("b", *plain), ("c", False, True, False), ("d", False, True, False), ("e", *plain), ("two", False, True, True), ("f", True, False, False), ("g", True, False, False)])
    assert [(r.para, r.block) for r in apply(layout.x04_blocks, spark, runs=runs).orderBy("para").collect()] == [(0, 0), (1, 0), (2, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 2), (9, 2), (10, 2)]
    assert [r.para for r in apply(layout.x05_block_answer, spark, runs=runs).where("right_").orderBy("para").collect()] == [1, 5]


@pytest.mark.parametrize("n,more,found", [(5, [], True), (4, [], False), (5, [" + marked"], False)])
def test_inline_paragraphs(spark, n, more, found):
    runs = runs_of(spark, [(t, False, False, False) for t in ["Which\n a. one\n B. two"] * n + ["a b c"] * 3 + more])
    assert apply(spans.s11_inline_paragraphs, spark, runs=runs).first().inline_ == found


@pytest.mark.parametrize("bold,plain,found", [(2, 8, True), (2, 7, False), (6, 4, False), (1, 9, True), (0, 12, False)])
def test_table_bold(spark, bold, plain, found):
    runs = runs_of(spark, [(f"p{k}", k < bold, True, False) for k in range(bold + plain)])
    assert apply(layout.s15_table_bold, spark, runs=runs).first().is_bold_table == found


def test_bold_heads(spark):
    runs = runs_of(spark, [("one", True, False, False), ("a", False, True, False), (" ", True, False, False), ("b", False, False, False), ("two", True, False, False), ("c", False, True, False)])
    assert [r.text for r in apply(layout.s16_bold_to_marks, spark, runs=runs).orderBy("para").collect()] == ["? one", "+ a", "= b", "? two", "+ c"]


def test_all_images_are_kept(spark):
    docs = spark.createDataFrame([(1, "see [[img:a/1.png]] and\n[[img:b.png]][[img:a/1.png]]"), (2, "[[img:x.png]] [[img:y.png]]"), (3, "none [[img:]]")], "doc_id long, text string")
    out = apply(parse.g06_images, spark, docs=docs).orderBy("doc_id").collect()
    assert [(r.text, json.loads(r.paths), r.images) for r in out] == [("see and", ["a/1.png", "b.png", "a/1.png"], 3), ("[rasm]", ["x.png", "y.png"], 2), ("none [[img:]]", [], 0)]


def test_images_of_questions_beyond_500(spark):
    opt = spark.sql("select id * 7 as q_no, 1L as pos, repeat('x', cast(5 + id % 3 as int)) as txt, true as ok from range(1500)")
    out = apply(spans.j10_images_of_questions, spark, opt=opt)
    assert out.count() == 1500 and {r.q_no // 7 for r in out.where("has_image").collect()} == set(range(2, 1500, 3))
