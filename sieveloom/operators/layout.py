"""Layout detectors and converters for styled paragraphs and tables."""

from __future__ import annotations

from ..plans.dialect import Dialect
from .parse import _either

#: A colour dominates if it exceeds both others by more than this.
DOMINANT = 40
# Words of administrative headers, by prefix, and phrases.
KEYWORDS = "tasdiqlayman tasdiqlash tasdiqladi kafedra mudiri dekan tuzuvchi imzo sana professor dotsent dosent assistent semestr universitet institut akademik rahbari boshlig’i boshligi mudir fakulteti prorektori rektori vazirlik respublika".split()
PHRASES = ["test savollari", "test topshiriqlari", "fanidan test", "o’quv yili", "oquv yili", "tasdiq qilaman", "nazorat testlari", "oraliq nazorat", "yakuniy nazorat"]
FOOTER = "(?i)\\bo.qituvchi(si)?\\b|kafedra|\\bmudiri\\s*:|\\btuzuvchi\\b|\\bdekan[ia]?\\b|\\bimzo\\b|\\bsana\\b|\\bprof[.]\\s|\\bdo[ts]sent\\b"


def _paras(d: Dialect) -> str:
    strong = f"highlight or greatest(g - greatest(r, b), r - greatest(g, b)) > {DOMINANT}"
    return f"paras as (select doc_id, para, {d.joined('text', chr(39) + ' ' + chr(39), 'run')} as text, count_if({strong}) > 0 as strong, count_if(text <> '') > 0 and count_if(text <> '' and not bold) = 0 as full_bold, count_if(bold and {d.strip('text')} <> '') > 0 as some_bold, count_if(listed) > 0 as listed from @runs group by doc_id, para)"


def x01_strong(d: Dialect) -> str:
    return f"with {_paras(d)} select doc_id, para, strong from paras"


def x02_fully_bold(d: Dialect) -> str:
    return f"with {_paras(d)} select doc_id, para, full_bold from paras"


def _blocks(d: Dialect) -> str:
    """A question sign or a list number starts a block; its first paragraph is the question. Blank paragraphs are dropped."""
    start = f"({d.match(d.strip('text'), '^[?]')} or listed)"
    return f"""{_paras(d)}, starts as (select *, sum(case when {start} then 1 else 0 end) over (partition by doc_id order by para) as block from paras where {d.strip('text')} <> ''),
        blocks as (select *, row_number() over (partition by doc_id, block order by para) > 1 as option from starts)"""


def x04_blocks(d: Dialect) -> str:
    return f"with {_blocks(d)} select doc_id, para, cast(block as bigint) as block from blocks"


def x05_block_answer(d: Dialect) -> str:
    """The first strong option of a block is right; without one, the only fully bold option."""
    return f"""with {_blocks(d)}, w as (select *, min(case when strong and option then para end) over (partition by doc_id, block) as first_strong, count(case when full_bold and option then 1 end) over (partition by doc_id, block) as bolds from blocks)
        select doc_id, para, option and case when first_strong is not null then para = first_strong else bolds = 1 and full_bold end as right_ from w"""


def x11_bold_chunks(d: Dialect) -> str:
    """Neighbouring bold runs joined."""
    return f"""with f as (select *, lag(bold) over (partition by doc_id, para order by run) as before from @runs),
        i as (select *, sum(case when bold and not coalesce(before, false) then 1 else 0 end) over (partition by doc_id, para order by run) as chunk from f)
        select doc_id, para, cast(chunk as bigint) as chunk, {d.strip(d.joined('text', "' '", 'run'))} as text from i where bold group by doc_id, para, chunk"""


#: Letters that open options of any kind.
ANY_LETTER = "\\x{410}-\\x{42F}\\x{401}\\x{430}-\\x{44F}\\x{451}A-Za-z"


def x12_bold_option(d: Dialect) -> str:
    """Lettered paragraphs whose content is a bold chunk, or ends one after a bare letter's mark."""
    content = d.strip(d.rep(d.strip("p.text"), f"^[{ANY_LETTER}][.)]\\s*", ""))
    bare = d.match("substring(chunk, 1, length(chunk) - length(content))", f"^[{ANY_LETTER}][.)]?\\s*$")
    ends = "length(chunk) >= length(content) and substring(chunk, length(chunk) - length(content) + 1, length(content)) = content"
    return f"""with {_paras(d)}, c as ({x11_bold_chunks(d)}), o as (select p.doc_id, p.para, {content} as content, c.text as chunk from paras p join c on c.doc_id = p.doc_id and c.para = p.para where {d.match('p.text', f'^\\s*[{ANY_LETTER}][.)]\\s*\\S')})
        select distinct doc_id, para from o where content <> '' and (chunk = content or ({ends} and {bare}))"""


def s15_table_bold(d: Dialect) -> str:
    """Ten paragraphs or more in the first 60 rows, none marked, and 10 to 55 % with bold text."""
    return f"with {_paras(d)}, first_ as (select *, row_number() over (partition by doc_id order by para) as n from paras), t as (select doc_id, {d.strip('text')} as s, some_bold from first_ where n <= 60) select doc_id, count_if(s <> '') >= 10 and count_if({d.match('s', '^[?+=]')}) = 0 and 100 * count_if(s <> '' and some_bold) between 10 * count_if(s <> '') and 55 * count_if(s <> '') as is_bold_table from t group by doc_id"


def s16_bold_to_marks(d: Dialect) -> str:
    """Paragraphs with bold text are questions; the first other one after is right, later ones are wrong."""
    return f"""with {_paras(d)}, h as (select doc_id, para, {d.strip('text')} as s, some_bold as head from paras),
        q as (select *, sum(case when head then 1 else 0 end) over (partition by doc_id order by para) as block from h where s <> ''),
        n as (select *, sum(case when head then 0 else 1 end) over (partition by doc_id, block order by para) as nth from q)
        select doc_id, para, concat(case when head then '? ' when nth = 1 then '+ ' else '= ' end, s) as text from n"""


def x06_mark_highlighted(d: Dialect) -> str:
    equal, letter = d.match("s", "^[=\\x{2013}-]"), d.match("s", "^[A-Za-z][.)]")
    return f"with s as (select doc_id, line_no, {d.strip('text')} as s from @lines) select doc_id, line_no, case when s = '' then s when {equal} then concat('+', substring(s, 2)) when {letter} then concat('#', s) when {d.match('s', '^[?+#]')} then s else concat('#', s) end as text from s"


def x07_mark_numbered(d: Dialect) -> str:
    from .parse import NUMBERED, _first

    return f"with s as (select doc_id, line_no, {d.strip('text')} as s from @lines), n as (select *, {_first(d, 's', NUMBERED)} as body from s) select doc_id, line_no, case when body is not null and not {d.match('s', '^[?=+#]')} then concat('? ', body) else s end as text from n"


def x08_mark_before_dash(d: Dialect) -> str:
    """An unmarked line before an option is a question."""
    return f"""with s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        n as (select doc_id, line_no, lead(s) over (partition by doc_id order by line_no) as next_ from s where s <> '')
        select s.doc_id, s.line_no, case when n.line_no is not null and not {d.match('s', '^[?=+#*-]')} and {d.match("coalesce(next_, '')", '^[+\\x{2013}-]')} then concat('? ', s) else s end as text from s left join n on n.doc_id = s.doc_id and n.line_no = s.line_no"""


def x09_number_unnumbered(d: Dialect) -> str:
    """Unmarked lines before an option A get numbers, where such options outnumber numbered lines."""
    opens = d.match("s", "^[aA\\x{410}\\x{430}]\\)")
    return f"""with s as (select doc_id, line_no, {d.strip('text')} as s from @lines where text is not null),
        f as (select *, lead(s) over (partition by doc_id order by line_no) as next_ from s where s <> ''),
        gate as (select doc_id from f group by doc_id having count_if({opens}) >= 5 and count_if({opens}) > count_if({d.match('s', '^[0-9]+[.)]')})),
        h as (select f.*, coalesce({d.match('next_', '^[aA\\x{410}\\x{430}]\\)')}, false) and not {d.match('s', '^([?=+#*]|[0-9]+[.)])')} and gate.doc_id is not null as hit from f left join gate on gate.doc_id = f.doc_id)
        select doc_id, line_no, case when hit then concat(cast(sum(case when hit then 1 else 0 end) over (partition by doc_id order by line_no) as varchar(20)), '. ', s) else s end as text from h"""


def x14_explicit_correct(d: Dialect) -> str:
    return f"select doc_id, count_if({d.match('text', '^[+]([^+]|$|[+]$|[+][^+])')} or {d.match('text', '^[*#]\\s*[a-fA-F][.)]')}) > 0 as explicit from @lines group by doc_id"


def x15_all_correct(d: Dialect) -> str:
    """Where every option of a question is marked right, none is. A question's options end at the next question, a rule or a section header."""
    from .parse import SECTION, SEP

    rule = d.match("s", "^[+=]{3,}$")
    question = f"({d.match('s', '^\\?')} or {d.match('s', '^[0-9]+[.)]\\s')} or {d.match('s', f'^[0-9]{{2,3}}{SEP}\\S')})"
    ends = f"({question} or {rule} or {d.match('s', SECTION)})"
    return f"""with s as (select doc_id, line_no, text, {d.strip('text')} as s from @lines),
        k as (select *, {question} as asks, {ends} as edge, {d.match('s', '^[+#]')} as good, {d.match('s', '^[+#=]')} as option from s),
        b as (select *, sum(case when edge then 1 else 0 end) over (partition by doc_id order by line_no) as scope from k),
        w as (select *, max(case when asks then 1 else 0 end) over (partition by doc_id, scope) as asked, count(case when option and not edge then 1 end) over (partition by doc_id, scope) as options, count(case when good and not edge then 1 end) over (partition by doc_id, scope) as goods from b)
        select doc_id, line_no, case when good and not edge and asked = 1 and goods >= 2 and goods = options then case when {d.match('s', '^[+]')} then {d.rep('text', '^(\\s*)[+]', '$1=')} else {d.rep('text', '^(\\s*)#', '$1')} end else text end as text from w"""


def _header(d: Dialect, x: str) -> tuple[str, str]:
    words = "|".join(KEYWORDS)
    phrases = "|".join(PHRASES)
    letters = d.rep(x, "[^a-zA-Z\\x{410}-\\x{44F}\\x{401}\\x{451}]", "")
    asks = d.match(x, "\\?$")
    always = f"{d.match(x, '___')} or (length({x}) < 30 and {d.match(f'lower({x})', '[0-9]{4}\\s*-?\\s*(yil|y\\b)')})"
    rest = f"(length({letters}) >= 6 and {letters} = upper({letters}) and not {asks}) or (length({x}) > 6 and {d.match(x, '^[\\x22\\x{AB}].*[\\x22\\x{BB}]$')} and not {d.match(x, '\\?\\s*.$')}) or (not {asks} and {d.match(f'lower({x})', f'(^|[^a-z’ʻа-яё])({words})|{phrases}')})"
    return always, rest


def x16_header_lines(d: Dialect) -> str:
    always, rest = _header(d, "s")
    return f"with s as (select doc_id, line_no, {d.strip('text')} as s from @lines) select doc_id, line_no, s <> '' and ({always} or {rest}) as header from s"


def x17_leading_headers(d: Dialect) -> str:
    """Headers before the first rule go; the last line before it is protected from all but the surest."""
    always, rest = _header(d, "s")
    rule = d.match("s", "^={3,}$")
    return f"""with s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        r as (select *, min(case when {rule} then line_no end) over (partition by doc_id) as first_rule from s),
        l as (select *, max(case when s <> '' and line_no < first_rule then line_no end) over (partition by doc_id) as last_before from r)
        select doc_id, line_no, s as text from l where not coalesce(line_no < first_rule and s <> '' and ({always} or (line_no <> last_before and ({rest}))), false)"""


def x18_trailing_footers(d: Dialect) -> str:
    return f"""with s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        k as (select *, max(case when not {d.match('s', FOOTER)} then line_no end) over (partition by doc_id) as last_kept from s)
        select doc_id, line_no, s as text from k where line_no <= last_kept"""


def g04_split_merged(d: Dialect) -> str:
    """Items that follow each other on one line are split: before a letter's mark, a plus (not of key names or sums) and an equal sign after a sentence.

    Only lines that open as an item are touched; a mark that would stand alone keeps what follows it.
    """
    cut, kept = chr(1), chr(2)
    x = d.rep("s", "(?i)(ctrl|shift|alt|win|cmd)(\\s+)[+]", f"$1$2{kept}")
    for pattern in 2 * ("(\\S)\\s+([A-Fa-f][.)]\\s)", "(\\S)\\s+([+]\\s[^0-9])", "([.!?])\\s+(=\\s[^0-9])"):  # twice, as neighbours share a character
        x = d.rep(x, pattern, f"$1{cut}$2")
    x = f"replace({d.rep(x, f'^([+=?-])\\s*{cut}', '$1 ')}, '{kept}', '+')"
    return f"""with s as (select doc_id, line_no, text, {d.strip('text')} as s from @lines),
        m as (select doc_id, line_no, case when {d.match('s', '^([A-Fa-f][.)]|[0-9]+[.)]|[=+?])')} then {x} else text end as s from s),
        x as ({d.each('m', 'doc_id, line_no', d.words('s', cut), 'part', 'piece')})
        select doc_id, line_no, part, case when part > 1 then {d.strip('piece')} else piece end as text from x"""


# Tables: rows of (sheet, row_no, c0 .. c4).
CELLS = ("c0", "c1", "c2", "c3", "c4")
# Words of header rows.
HEADS = "(?i)\\b(?:savol|javob|to[\\W_]*g[\\W_]*ri|muqobil|question|answer|correct|wrong|option|variant)\\b|" + "|".join(map(_either, ("вопрос", "ответ", "правильн", "альтернатив"))) + "|^[№n]$|^t/r$|^no\\.?$"


def _filled() -> str:
    return "(" + " + ".join(f"case when {c} <> '' then 1 else 0 end" for c in CELLS) + ")"


def _is_header(d: Dialect) -> str:
    """Some cell filled, all shorter than 40, and two, or all if fewer, with words of headers."""
    hits = " + ".join(f"case when {c} <> '' and {d.match(c, HEADS)} then 1 else 0 end" for c in CELLS)
    return f"({_filled()} > 0 and {' and '.join(f'length({c}) < 40' for c in CELLS)} and {hits} >= least(2, {_filled()}))"


def t01_layout(d: Dialect) -> str:
    """B where the first column counts up, or is mostly empty and the second is not. Of the first 60 rows those that have two cells or more filled and are no headers count."""
    number = "^([0-9]{1,9})\\.?\\s*$"
    return f"""with r as (select * from @cells where row_no <= 60 and {_filled()} > 1 and not {_is_header(d)}),
        n as (select sheet, row_no, case when {d.match('c0', number)} then cast({d.ext('c0', number)} as bigint) end as n from r where {d.match('c0', number)}),
        s as (select *, lag(n) over (partition by sheet order by row_no) as before from n),
        q as (select sheet, count(*) as ints, count_if(n = before + 1) as steps from s group by sheet),
        f as (select sheet, round(avg(case when c0 <> '' then 1.0e0 else 0.0e0 end), 6) as fill0, round(avg(case when c1 <> '' then 1.0e0 else 0.0e0 end), 6) as fill1 from r group by sheet)
        select f.sheet, fill0, fill1, coalesce(ints, 0) as ints, coalesce(steps, 0) as steps, case when (ints >= 3 and steps >= ints - 1) or (fill0 < 0.5 and fill1 > 0.5) then 'B' else 'A' end as layout from f left join q on q.sheet = f.sheet"""


def t02_star_marker(d: Dialect) -> str:
    return "select sheet, count_if(row_no <= 30 and (c1 like '*%' or c2 like '*%' or c3 like '*%' or c4 like '*%')) > 0 as starred from @cells group by sheet"


def t03_header_rows(d: Dialect) -> str:
    return f"select sheet, row_no, {_is_header(d)} as header from @cells"


def t04_merged_header(d: Dialect) -> str:
    return "with m as (select sheet, min(row_no) as first_ from @cells where c0 = c1 and c1 = c2 group by sheet) select c.sheet, c.row_no from @cells c left join m on m.sheet = c.sheet and m.first_ = c.row_no where m.sheet is null"


def t05_to_lines(d: Dialect) -> str:
    """Rows as marked lines: starred cells are right and come first; without stars the first answer is right."""
    cells = " union all ".join(f"select sheet, row_no, {k} as col, {c} as txt from b" for k, c in enumerate(("a1", "a2", "a3", "a4")))
    return f"""with l as ({t01_layout(d)}), b as (select c.sheet, c.row_no, case when layout = 'B' then c1 else c0 end as q, case when layout = 'B' then '' else c1 end as a1, c2 as a2, c3 as a3, c4 as a4 from @cells c join l on l.sheet = c.sheet),
        a as (select * from ({cells}) x where txt <> ''), s as (select *, txt like '*%' as star, max(case when txt like '*%' then 1 else 0 end) over (partition by sheet, row_no) as any_, row_number() over (partition by sheet, row_no order by col) as nth from a),
        o as (select sheet, row_no, case when any_ = 1 then star else nth = 1 end as ok, col, {d.rep('txt', '^[*]\\s*', '')} as txt from s),
        x as (select sheet, row_no, cast(row_number() over (partition by sheet, row_no order by case when ok then 0 else 1 end, col) as bigint) as pos, concat(case when ok then '+ ' else '= ' end, txt) as text from o)
        select sheet, row_no, cast(0 as bigint) as pos, concat('? ', q) as text from b where q <> '' union all select sheet, row_no, pos, text from x"""


def t07_first_valid_row(d: Dialect) -> str:
    filled = " + ".join(f"case when {c} <> '' then 1 else 0 end" for c in ("c0", "c1", "c2", "c3", "c4"))
    return f"select sheet, coalesce(min(case when {filled} >= 3 then row_no end), -1) as first_row from @cells group by sheet"


def t08_trailing_trim(d: Dialect) -> str:
    return "select sheet, row_no, cast(case when c4 <> '' then 5 when c3 <> '' then 4 when c2 <> '' then 3 when c1 <> '' then 2 when c0 <> '' then 1 else 0 end as bigint) as width from @cells"


def t10_column_a(d: Dialect) -> str:
    """The first column is a code where it has few distinct values, or only short numbers."""
    return f"select sheet, count(distinct c0) as distinct_, count(*) as rows_, count(distinct c0) = 1 or count(distinct c0) < 0.30 * count(*) as repeats, count_if(not {d.match('c0', '^[0-9]+$')}) = 0 as numbers, max(length(c0)) <= 10 as short from @cells where c0 <> '' group by sheet"


def t12_projection(d: Dialect) -> str:
    return f"with m as ({t10_column_a(d)}), k as (select c.*, coalesce(repeats or numbers or short, true) as meta from @cells c left join m on m.sheet = c.sheet) select sheet, row_no, case when meta then c1 else c0 end as question, case when meta then c2 else c1 end as right_, case when meta then c3 else c2 end as wrong from k"


def t13_complete(d: Dialect) -> str:
    return f"select * from ({t12_projection(d)}) t where question <> '' and right_ <> '' and wrong <> ''"


def a14_ratios(d: Dialect) -> str:
    return "select sheet, round(avg(case when c0 <> '' then 1.0e0 else 0.0e0 end), 6) as fill0, round(count(distinct c0) * 1.0e0 / count(*), 6) as distinct0 from @cells group by sheet"
