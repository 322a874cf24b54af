"""Question-bank tables derived from the driver's tables: marker lines, options, sheets, glyphs, answers."""

from __future__ import annotations

from .dialect import Dialect, Plan


def quiz_opt(d: Dialect) -> str:
    return "select l_orderkey as q_no, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice, p_partkey) as bigint) as pos, p_name as txt, l_returnflag = 'R' as ok from @lineitem join @part on p_partkey = l_partkey"


def _quiz(d: Dialect, question: str, option: str, extra: str = "") -> str:
    """Lines of the questions of each document in order: question line, options, and lines of `extra` (pos, text, condition)."""
    extra = extra and f" union all select o_custkey, o_orderkey, {extra}"
    return f"""select doc_id, cast(row_number() over (partition by doc_id order by q_no, pos, text) as bigint) as line_no, text from (
        select o_custkey as doc_id, o_orderkey as q_no, cast(0 as bigint) as pos, {question} as text from @orders
        union all select o_custkey, q_no, pos, {option} from @opt join @orders on o_orderkey = q_no{extra}) x"""


def classic_lines(d: Dialect) -> str:
    n = "cast(o_orderkey as varchar(20))"
    return _quiz(
        d,
        f"case when o_orderkey % 7 = 3 then concat({n}, '. Which part of ', o_orderpriority) when o_orderkey % 11 = 4 then concat('? #A) ', o_orderpriority) else concat('? Which part of order ', {n}, case when o_orderkey % 3 = 0 then '?' else '' end) end",
        "case when q_no % 5 = 2 then concat(case pos when 1 then 'A' when 2 then 'b' when 3 then 'C' when 4 then 'd' else 'e' end, ') ', txt) when q_no % 13 = 6 and pos = 1 then concat('= 1.', txt) when ok then concat(case when q_no % 4 = 1 then '#' else '+ ' end, txt) else concat(case when q_no % 6 = 5 then '- ' else '= ' end, txt) end",
        "cast(2 as bigint), case when o_orderkey % 9 = 1 then concat('wrapped ', o_orderstatus) when o_orderkey % 9 = 2 then '! a remark' when o_orderkey % 9 = 3 then '2. another part' when o_orderkey % 9 = 4 then '' else '?' end from @orders where o_orderkey % 9 between 1 and 5",
    )


def abc_lines(d: Dialect) -> str:
    n = "cast(o_orderkey as varchar(20))"
    letter = "substring('ABCDEFGHIJKLMNOP', cast(pos as int), 1)"
    return _quiz(
        d,
        f"concat({n}, case when o_orderkey % 2 = 0 then '. ' else ') ' end, 'Which part of ', o_orderpriority)",
        f"case when pos > 6 then concat('more ', txt) when ok and q_no % 3 = 0 then concat('*', {letter}, ') ', txt) when ok and q_no % 3 = 1 then concat({letter}, ') #', txt) when ok then concat('+ ', txt) else concat({letter}, ') ', txt) end",
        "cast(99 as bigint), case when o_orderkey % 5 = 0 then 'Answer: B' else 'Javob: Z' end from @orders where o_orderkey % 5 < 2",
    )


def block_lines(d: Dialect) -> str:
    return _quiz(
        d,
        "case when o_orderkey % 6 = 1 then concat('+++++ ', o_orderpriority) else concat('Which part of ', o_orderpriority) end",
        "case when pos % 2 = 1 then '====' when ok then concat('#', txt) else txt end",
        "cast(999 as bigint), '++++' from @orders where o_orderkey % 6 <> 0",
    )


def gift_lines(d: Dialect) -> str:
    return _quiz(
        d,
        "concat('Which part of ', o_orderpriority, case when o_orderkey % 4 = 0 then '?' else '' end)",
        "case when pos = 1 then '{' when ok then concat('=', txt) when q_no % 3 = 0 then concat('~%-50%', txt) else concat('~', txt) end",
        "cast(999 as bigint), '}' from @orders where o_orderkey % 8 <> 5",
    )


def ruled_lines(d: Dialect) -> str:
    """Questions between spaced rules."""
    return _quiz(d, "concat('Which part of ', o_orderpriority)", "case when ok then concat('#', txt) when pos = 4 then '= = =' else txt end", "cast(-1 as bigint), '+ + + +' from @orders")


def lettered_lines(d: Dialect) -> str:
    """Questions without numbers before lettered options."""
    return _quiz(d, "concat('Which part of ', o_orderpriority)", "concat(substring('abcdefghijklmnop', cast(pos as int), 1), ') ', txt)")


def bare_lines(d: Dialect) -> str:
    """Questions whose options carry no markers."""
    return _quiz(d, "concat('?Which part of ', o_orderpriority, case when o_orderkey % 2 = 0 then '?' else '' end)", "case when ok and q_no % 2 = 0 then concat('B) #', txt) else txt end")


def dash_lines(d: Dialect) -> str:
    """Options with dashes of several kinds, signs of page headers, and numbers on their own lines."""
    dash = f"case cast(q_no % 4 as int) when 0 then {d.ch(8211)} when 1 then {d.ch(8212)} when 2 then {d.ch(8722)} else '-' end"
    return _quiz(
        d,
        f"case when o_orderkey % 3 = 0 then concat('? term of ', o_orderpriority, {d.ch(8217)}, 's') else concat('term ', {d.ch(8212)}, ' ', o_orderpriority, ' is =') end",
        f"case when q_no % 3 = 0 then concat(case when ok then '+ ' else '= ' end, substring(txt, 1, 5), {dash}, substring(txt, 1, 3)) else concat(cast(pos as varchar(20)), case when pos % 2 = 0 then ' rows ' else '' end) end",
        "cast(3 as bigint), case when o_orderkey % 4 = 0 then '- 12 -' when o_orderkey % 4 = 1 then '' when o_orderkey % 4 = 2 then '77' else concat('  ', chr(9), 'lower end  ') end from @orders",
    )


def dirty_docs(d: Dialect) -> str:
    return f"select doc_id, concat(case when doc_id % 5 = 0 then {d.ch(65279)} else '' end, replace(replace(replace(text, '. ', concat(' ', {d.ch(8212)}, '  ')), 'th', concat({d.ch(8216)}, 'th')), ' of ', case when doc_id % 3 = 0 then concat(' ', {d.ch(960)}, ' 6 ') else concat('  ', chr(9), 'of ') end), case when doc_id % 4 = 0 then concat(chr(10), {d.ch(1611)}, ' = tail [[img:images/', cast(doc_id as varchar(20)), '.png]]', case when doc_id % 8 = 0 then concat(' and [[img:images/', cast(doc_id as varchar(20)), 'b.png]][[img:images/c.png]]') else '' end) else '' end) as text from @documents"


def answers(d: Dialect) -> str:
    """Answers of a resolver: chunked question ids, some repeated, some out of range, some missing."""
    return "select l_orderkey as id, l_orderkey * 8 + l_linenumber as arrival, cast(case when l_linestatus = 'F' and l_quantity > 40 then -1 else l_linenumber - 1 end as bigint) as c, cast(l_discount * 10 as double) as cf, l_tax > 0.05 as s from @lineitem where l_orderkey % 3 <> 0"


def glyphs(d: Dialect) -> str:
    x = d.each("@embeddings", "vec_id", "embedding", "seq", "v")
    return f"select vec_id as page, seq, case when v > 0.2 then {d.ch(8407)} when v > 0.1 then '(' when v < -0.15 then ')' when seq % 3 = 0 then '7' else 'a' end as ch, cast(seq % 16 * 5 + floor(v * 20) as double) as x0, cast(seq % 16 * 5 + 4 + floor(v * 10) as double) as x1, cast({d.div('seq', '16')} * 10 + floor(v * 5) as double) as y0, cast(10 + floor(v * 2) as double) as size from ({x}) g"


def runs(d: Dialect) -> str:
    """Styled runs of paragraphs, twenty conversations to a document: numbered questions, lettered options of which some are bold after or with
    their mark, options on lines of their own within a paragraph, marked lines in some documents; `listed` where the paragraph is numbered by its list."""
    x = d.each("@conversations", "conv_id, turn", d.words("text"), "run", "w")
    doc, letter = d.div("conv_id", "20"), "substring('ABCD', cast(1 + turn % 4 as int), 1)"
    head = f"case when turn % 5 = 0 then case when conv_id % 60 = 7 then '? ' else concat(cast(1 + turn as varchar(20)), '. ') end when turn % 5 = 4 then '' else concat({letter}, case when conv_id % 2 = 0 then '. ' else ') ' end) end"
    text = f"case when run = 1 then concat({head}, w) when turn % 5 = 4 and run between 3 and 4 then concat(chr(10), case when run = 3 then 'a. ' else 'b. ' end, w) else w end"
    bold = "case when turn % 5 between 1 and 3 then turn % 3 = 1 and (conv_id % 4 < 2 or run > 1) else (turn + run) % 3 = 0 end"
    return f"select {doc} as doc_id, cast(conv_id % 20 * 1000 + turn as bigint) as para, run, {text} as text, {bold} as bold, cast((conv_id * 37 + run * 61) % 256 as bigint) as r, cast((conv_id * 11 + run * 91) % 256 as bigint) as g, cast(run * 29 % 256 as bigint) as b, run % 17 = 5 as highlight, turn % 4 = 0 as listed from ({x}) x"


def glued_lines(d: Dialect) -> str:
    """Lines of documents in which sentences stand together without a space; every third one asks."""
    return f"select doc_id, line_no, concat(case when line_no % 7 = 2 then '? ' else '' end, {d.rep('text', '([a-z])[.] ([A-Z])', '$1$2')}, case when line_no % 3 = 0 then '?' else '' end) as text from ({d.lines('@documents', 'doc_id', 'text')}) l"


def page_counts(d: Dialect) -> str:
    """Lines on each page of the documents as they were before cleaning, by page lengths of 3 to 7 lines."""
    return f"select doc_id, page, count(*) as n_lines from (select doc_id, {d.div('(line_no - 1)', '(3 + doc_id % 5)')} + 1 as page from ({d.lines('@documents', 'doc_id', 'text')}) x) y group by doc_id, page"


def cells(d: Dialect) -> str:
    """Rows of sheets: a running number or code, a question, and answers, some starred."""
    return "select q_no % 12 as sheet, cast(row_number() over (partition by q_no % 12 order by q_no) as bigint) as row_no, case when q_no % 12 < 4 then cast(row_number() over (partition by q_no % 12 order by q_no) as varchar(20)) when q_no % 12 < 8 then '' else max(txt) end as c0, case when q_no % 50 = 7 then min(txt) else concat('Which part ', cast(q_no as varchar(20))) end as c1, case when q_no % 2 = 0 then concat('*', min(txt)) else min(txt) end as c2, max(case when pos = 2 then txt else '' end) as c3, max(case when pos = 3 then txt else '' end) as c4 from @opt group by q_no"


def batch_log(d: Dialect) -> str:
    return "select user_id % 40 as batch_id, ts, case event_type when 'error' then 'errored' when 'signup' then 'refusal' else 'succeeded' end as kind, cast(floor(abs(value)) as bigint) as in_tok, cast(floor(abs(value) / 2) as bigint) as out_tok, user_id from @events"


OPT = Plan(quiz_opt, lineitem="lineitem", part="part")
CLASSIC, ABC, BLOCKS, GIFT, BARE, DASH, RULED, LETTERED = (Plan(f, orders="orders", opt=OPT) for f in (classic_lines, abc_lines, block_lines, gift_lines, bare_lines, dash_lines, ruled_lines, lettered_lines))
DIRTY = Plan(dirty_docs, documents="documents")
ANSWERS = Plan(answers, lineitem="lineitem")
GLYPHS = Plan(glyphs, embeddings="embeddings")
RUNS = Plan(runs, conversations="conversations")
GLUED = Plan(glued_lines, documents="documents")
PAGES = Plan(page_counts, documents="documents")
CELLS = Plan(cells, opt=OPT)
LOG = Plan(batch_log, events="events")


def mixed_lines(d: Dialect) -> str:
    """Documents of all formats."""
    return "select doc_id * 4 as doc_id, line_no, text from @a union all select doc_id * 4 + 1, line_no, text from @b union all select doc_id * 4 + 2, line_no, text from @c union all select doc_id * 4 + 3, line_no, text from @d"


MIXED = Plan(mixed_lines, kept=True, a=CLASSIC, b=ABC, c=BLOCKS, d=GIFT)
