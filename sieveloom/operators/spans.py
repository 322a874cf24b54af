"""Spans and paragraphs: script marks, glue, marks of style, paragraph layouts, and single window and set operators."""

from __future__ import annotations

from ..plans.dialect import Dialect
from .geometry import _rows
from .layout import _paras
from .parse import SEP
from .validate import _options

#: Offsets of small spans from the base line, and their share of its size.
HIGH, RAISED, LOWERED, LOW, SMALL = 5.5, 1.5, -1.5, -6.0, 0.85
# Fixed value: a small letter right before a capital one that opens three words or more.
GLUED = "^(.*?[a-zа-яёʻʼ_])([A-ZА-ЯЁ]\\S*(?:\\s+\\S+){2,})\\s*$"


def p01_script_marks(d: Dialect) -> str:
    """Rows as text, with raised small glyphs as powers and lowered ones as indices."""
    return f"""with {_rows(d)}, b as (select *, max(size) over (partition by page, row_no) as base from r),
        z as (select *, avg(case when size >= {SMALL} * base then y0 end) over (partition by page, row_no) as base_y from b),
        m as (select page, row_no, x0, seq, case when size >= {SMALL} * base then ch when base_y - y0 > {HIGH} then ch when base_y - y0 > {RAISED} then case when ch = '0' then '°' else concat('^{{', ch, '}}') end when base_y - y0 >= {LOW} and base_y - y0 < {LOWERED} then concat('_{{', ch, '}}') else ch end as t from z)
        select page, cast(row_no as bigint) as row_no, {d.joined('t', "''", 'x0, seq')} as txt from m group by page, row_no"""


def p03_highlight_rects(d: Dialect) -> str:
    """Rectangles of annotations, and light, wide fills."""
    return "select page, seq, x0, y0 from @glyphs where seq % 8 = 0 union all select page, seq, x0, y0 from @glyphs where seq % 8 <> 0 and (seq % 10) * 0.2e0 > 1.4e0 and (x1 - x0) / size > 0.3e0"


def p04_split_glued(d: Dialect) -> str:
    """A glued question becomes a line of its own."""
    hit = f"({d.match('text', GLUED)} and {d.match('text', '[?]\\s*$')} and not {d.match('text', '^\\s*[?]')})"
    return f"select doc_id, line_no, cast(0 as bigint) as part, case when {hit} then {d.ext('text', GLUED, 1)} else text end as text from @lines union all select doc_id, line_no, cast(1 as bigint), concat('? ', {d.ext('text', GLUED, 2)}) from @lines where {hit}"


def p05_drop_glued(d: Dialect) -> str:
    """A glued fragment that asks nothing goes."""
    return f"select doc_id, line_no, case when {d.match('text', GLUED)} and not {d.match('text', '[?]\\s*$')} and not {d.match('text', '^\\s*[?]')} then {d.ext('text', GLUED, 1)} else text end as text from @lines"


def p06_bold_options(d: Dialect) -> str:
    return f"with {_paras(d)} select doc_id, para, case when full_bold and {d.match('text', '^[A-Za-z][.)]')} then concat('#', text) else text end as text from paras"


def p07_highlight_marks(d: Dialect) -> str:
    plain = f"not {d.match('text', '^([?#+]|[0-9]+[.)])')}"
    return f"with {_paras(d)} select doc_id, para, case when not strong then text when {d.match('text', '^=')} then concat('+', substring(text, 2)) when {plain} then concat('#', text) else text end as text from paras"


def s05_pages(d: Dialect) -> str:
    """Lines dealt to pages by the pages' running counts of lines (doc_id, page, n_lines); what is over goes to the last."""
    return """with p as (select doc_id, page, sum(n_lines) over (partition by doc_id order by page) - n_lines as lo, sum(n_lines) over (partition by doc_id order by page) as hi, max(page) over (partition by doc_id) as last_page from @pages)
        select l.doc_id, l.line_no, cast(p.page as bigint) as page from @lines l join p on p.doc_id = l.doc_id and l.line_no > p.lo and (l.line_no <= p.hi or p.page = p.last_page)"""


def s11_inline_paragraphs(d: Dialect) -> str:
    """Five paragraphs or more with lettered options on lines of their own, and none marked."""
    return f"with {_paras(d)} select doc_id, count_if({d.match(d.strip('text'), '^[?+=]')}) = 0 and count_if({d.match('text', '(?i)\\n\\s*[a-d]\\.\\s')}) >= 5 as inline_ from paras group by doc_id"


def s13_table_blocks(d: Dialect) -> str:
    """Five tables or more; in the first ten at most two columns, three rules a table and a marked row in every other one."""
    doc = d.div("q_no", "64")
    return f"""with t as (select doc_id, q_no, width, row_number() over (partition by doc_id order by q_no) as nth from (select distinct {doc} as doc_id, q_no, case when q_no % 97 = 3 then 3 else 1 end as width from @opt) x),
        r as (select q_no, '====' as text from @opt union all select q_no, case when ok then concat('#', txt) else txt end from @opt),
        c as (select t.doc_id, count_if({d.match('r.text', '^={3,}$')}) as rules, count_if({d.match('r.text', '^#')}) as rights from t join r on r.q_no = t.q_no where t.nth <= 10 group by t.doc_id),
        n as (select doc_id, count(*) as tables, least(count(*), 10) as sample, max(case when nth <= 10 then width else 1 end) as widest from t group by doc_id)
        select n.doc_id, tables, widest, rules, rights, tables >= 5 and widest <= 2 and rules >= 3 * sample and rights >= greatest(1, {d.div('sample', '2')}) as blocks from n join c on c.doc_id = n.doc_id"""


def s17_numbered_bold(d: Dialect) -> str:
    """No marks, five numbered questions, five lettered options and three of them in bold."""
    from .layout import ANY_LETTER, x12_bold_option

    asks = d.match("s", f"^([0-9]+[.)]|[0-9]{{1,3}}\\s+[{ANY_LETTER}])")
    return f"""with {_paras(d)}, h as ({x12_bold_option(d)}), s as (select paras.doc_id, {d.strip('text')} as s, h.para is not null as bold from paras left join h on h.doc_id = paras.doc_id and h.para = paras.para),
        k as (select doc_id, {d.match('s', '^[?+=]')} as marked, {d.match('s', f'^[{ANY_LETTER}][.)]\\s*\\S')} as option, {asks} as asks, bold from s)
        select doc_id, count_if(marked) as marks, count_if(asks and not option) as questions, count_if(option) as options, count_if(bold) as bolds, count_if(marked) = 0 and count_if(asks and not option) >= 5 and count_if(option) >= 5 and count_if(bold) >= 3 as numbered_bold from k group by doc_id"""


def s19_columns_qa(d: Dialect) -> str:
    filled = " + ".join(f"case when {c} <> '' then 1 else 0 end" for c in ("c0", "c1", "c2", "c3", "c4"))
    return f"select sheet, count_if(row_no <= 30 and {filled} >= 2) >= 3 as columns_qa from @cells group by sheet"


def s21_unique_columns(d: Dialect) -> str:
    width = "case when c0 = c1 and c1 = c2 then 1 when c0 = c1 or c1 = c2 or c0 = c2 then 2 else 3 end"
    return f"with w as (select sheet, row_no, {width} as width from @cells), f as (select sheet, min(case when width > 1 then row_no end) as first_ from w group by sheet) select f.sheet, cast(coalesce(w.width, 0) as bigint) as columns_ from f left join w on w.sheet = f.sheet and w.row_no = f.first_"


def s26_stem(d: Dialect) -> str:
    """File names as names of image folders."""
    name = "concat(case when doc_id % 9 = 0 then '__№!' else concat(' Doc ', cast(doc_id as varchar(20)), '/(a-b) №', lang, '.') end)"
    stem = d.rep(d.rep(name, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return f"select doc_id, case when {stem} = '' then 'doc' else {stem} end as stem from (select doc_id, coalesce(lang, '') as lang from @docs) x"


def s35_raw_questions(d: Dialect) -> str:
    """Options of parsed questions with the right one flagged by its index."""
    return f"with {_options(d)}, c as (select q_no, min(case when ok then place end) as c from placed group by q_no) select placed.q_no, place, txt, coalesce(place = c, false) as is_correct from placed join c on c.q_no = placed.q_no"


def x10_split_inline(d: Dialect) -> str:
    """Options, marks after semicolons and question numbers inside a line start lines of their own."""
    cut = chr(1)
    x = d.rep(d.rep("text", "^\\s*([a-fA-F]) \\)", "$1)"), ";\\s*([=+])\\s", f"{cut}$1 ")
    # a line's start stands before nothing, which the classes of the characters before leave out
    upper, lower = f"([^\\s#*+=\\x{{2013}}{cut}A-Z0-9(-])\\s*([#*+=]?[A-D]\\))", f"([^\\s#*+=\\x{{2013}}{cut}a-zA-Z0-9(-])\\s*([#*+=]?[a-d]\\))"
    for pattern in (upper, upper, lower, lower):  # twice, as neighbours share a character
        x = d.rep(x, pattern, f"$1{cut}$2")
    x = d.rep(x, f"([^{cut}0-9])\\s+([0-9]{{2,3}}[.)])(\\s)", f"$1{cut}$2$3")
    return f"select doc_id, line_no, {d.count('x', cut)} as breaks, replace(x, '{cut}', chr(10)) as text from (select doc_id, line_no, {x} as x from @lines) y"


def x13_bold_paragraph(d: Dialect) -> str:
    from .layout import x12_bold_option

    return f"with {_paras(d)}, h as ({x12_bold_option(d)}) select paras.doc_id, paras.para, h.para is not null as bold from paras left join h on h.doc_id = paras.doc_id and h.para = paras.para"


def g02a_letter_key(d: Dialect) -> str:
    """The first option that opens with the key's letter and a point or parenthesis."""
    mark = "concat(case when place % 2 = 0 then substring('abCDef', cast(place + 1 as int), 1) else substring('ABcdEF', cast(place + 1 as int), 1) end, case q_no % 3 when 0 then ') ' when 1 then '.' else ' ' end, txt)"
    letter = d.ext("txt", "^([A-Fa-f])[.)]\\s*")
    return f"""with {_options(d)}, k as (select q_no, place, {mark} as txt, substring('abcdef', cast(q_no % 6 + 1 as int), 1) as letter from placed),
        h as (select q_no, letter, place, lower({letter}) = letter as hit from k)
        select q_no, letter, coalesce(min(case when hit then place end), -1) as place from h group by q_no, letter"""


def g06b_image_token(d: Dialect) -> str:
    return "select doc_id, concat('[[img:', 'images/', cast(doc_id as varchar(20)), '.png', ']]') as token from @docs"


def g11_states(d: Dialect) -> str:
    """Reading starts at the first question sign and never ends."""
    return f"select doc_id, line_no, case when max(case when {d.match('text', '^\\s*\\?')} then 1 else 0 end) over (partition by doc_id order by line_no) = 1 then 'READING' else 'WAITING' end as state from @lines"


def w02_next_line(d: Dialect) -> str:
    return f"with n as (select doc_id, line_no, lead(line_no) over (partition by doc_id order by line_no) as next_no from @lines where {d.strip('text')} <> '') select doc_id, line_no, coalesce(next_no, -1) as next_no from n"


def w03_previous_line(d: Dialect) -> str:
    return f"select doc_id, line_no, coalesce({d.last(f'case when {d.strip("text")} <> {chr(39) * 2} then line_no end', 'partition by doc_id order by line_no rows between unbounded preceding and 1 preceding')}, -1) as before_no from @lines"


def w04_beside(d: Dialect) -> str:
    return "select doc_id, line_no, coalesce(length(lag(text) over (partition by doc_id order by line_no)), -1) as before_length, coalesce(length(lead(text) over (partition by doc_id order by line_no)), -1) as after_length from @lines"


def w05_consecutive(d: Dialect) -> str:
    """Numbers of the first column that follow the number before them."""
    number = "^([0-9]{1,9})\\.?\\s*$"
    return f"with n as (select sheet, row_no, cast({d.ext('c0', number)} as bigint) as n from @cells where {d.match('c0', number)}), l as (select *, lag(n) over (partition by sheet order by row_no) as before from n) select sheet, count(*) as numbers, count_if(n = before + 1) as steps from l group by sheet"


def w06_last_four(d: Dialect) -> str:
    return "select q_no, pos, txt from (select *, row_number() over (partition by q_no order by pos desc) as back from @opt) x where back <= 4"


def w07_first_match(d: Dialect) -> str:
    return "select q_no, coalesce(min(case when ok then pos end), -1) as first_right from @opt group by q_no"


def w10_all_of_group(d: Dialect) -> str:
    return "select q_no, count(*) >= 2 and count_if(ok) = count(*) as all_right from @opt group by q_no"


def w11_sessions(d: Dialect) -> str:
    return "with g as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from @log), s as (select user_id, ts, sum(case when before is null or ts > before + interval '1' hour then 1 else 0 end) over (partition by user_id order by ts) as session from g) select user_id, cast(session as bigint) as session, count(*) as n from s group by user_id, session"


def w12_sorted(d: Dialect) -> str:
    return "select page, seq, cast(row_number() over (partition by page order by y0, x0, seq) as bigint) as nth from @glyphs"


def w14_truncate(d: Dialect) -> str:
    return "select doc_id, substring(text, 1, 80) as a, substring(text, 1, 60) as b, substring(text, 1, 500) as c from @docs"


def w18_union(d: Dialect) -> str:
    cells = " union all ".join(f"select sheet, row_no, {k} as col, {c} as txt from @cells" for k, c in enumerate(("c0", "c1", "c2")))
    return f"select sheet, row_no, cast(col as bigint) as col, txt from ({cells}) x where txt <> ''"


def w19_common_words(d: Dialect) -> str:
    return f"with n as (select doc_id, line_no, {d.words('text')} as a, {d.words('next_')} as b from (select doc_id, line_no, text, lead(text) over (partition by doc_id order by line_no) as next_ from @lines) x where next_ is not null) select doc_id, line_no, {d.size(d.common('a', 'b'))} as common_ from n"


def a11_features(d: Dialect) -> str:
    return f"select doc_id, count_if({d.match('text', '^[0-9]+[.)]\\s*\\S')}) as numbered, count_if({d.match('text', f'^[0-9]+{SEP}')}) as separated, count_if({d.match('text', '^[#*+=]?\\s*[A-Fa-f][.)]')}) as lettered from @lines group by doc_id"


def a12_markers(d: Dialect) -> str:
    return f"select doc_id, count_if({d.match('text', '^\\s*[?]')}) as questions, count_if({d.match('text', '^\\s*[+*#]')}) as rights, count_if({d.match('text', '^\\s*[=-]')}) as wrongs from @lines group by doc_id"


def a17_size_range(d: Dialect) -> str:
    return f"with {_rows(d)} select page, cast(row_no as bigint) as row_no, max(size) - min(size) <= 0.5 as even from r group by page, row_no"


def a20_distinct(d: Dialect) -> str:
    return "select sheet, c2, count(*) as n from @cells group by sheet, c2"


def k07_lines(d: Dialect) -> str:
    """Each question as lines in order."""
    return f"with {_options(d)} select q_no, cast(0 as bigint) as pos, concat('? Which part ', cast(q_no as varchar(20))) as text from (select distinct q_no from placed) x union all select q_no, place + 1, concat(case when ok then '+ ' else '= ' end, txt) from placed"


def t09_header_drop(d: Dialect) -> str:
    return f"select sheet, row_no, c1, c2 from @cells where not (row_no = 1 and {d.match('lower(concat(c0, c1, c2))', 'savol|javob|question|answer')})"


def t11_numeric_column(d: Dialect) -> str:
    return f"select sheet, count_if({d.match('c0', '^[0-9]+$')}) = count(*) as numbers, count_if(length(c0) <= 10) = count(*) as short from @cells where c0 <> '' group by sheet"


def j07_bracket_pairs(d: Dialect) -> str:
    return f"select page, seq as open_, close_ from (select page, seq, ch, min(case when ch = ')' then seq end) over (partition by page order by seq rows between 1 following and 400 following) as close_ from @glyphs) x where ch = '(' and close_ is not null"


def j08_zip(d: Dialect) -> str:
    return f"with {_paras(d)}, a as (select doc_id, text, row_number() over (partition by doc_id order by para) as n from paras), b as (select doc_id, strong, row_number() over (partition by doc_id order by para) as n from paras) select a.doc_id, cast(a.n as bigint) as n, text, strong from a join b on b.doc_id = a.doc_id and b.n = a.n"


def j10_images_of_questions(d: Dialect) -> str:
    """Questions by their ordinals from 0 against the ordinals that have images, here those whose first text is a multiple of 7 long."""
    from .resolve import numbered

    return f"with {numbered(d, 'select distinct q_no from @opt')}, q as (select q_no, id - 1 as place from numbered), i as (select place from (select q_no, min(txt) as first_ from @opt group by q_no) t join q on q.q_no = t.q_no where length(first_) % 7 = 0) select q.q_no, i.place is not null as has_image from q left join i on i.place = q.place"
