"""Cleaning of document texts (scalar steps) and of their lines (window steps)."""

from __future__ import annotations

from ..plans.dialect import Dialect

# Glyphs that are made plain.
QUOTES = {0x2018: "\x27", 0x2019: "\x27", 0x201A: "\x27", 0x201B: "\x27", 0x02BB: "\x27", 0x02BC: "\x27", 0x0060: "\x27", 0x00B4: "\x27"}
DASHES = "[\\x{2013}\\x{2014}\\x{2015}\\x{2212}]"
ARABIC_MARKS = "[\\x{610}-\\x{61A}\\x{64B}-\\x{65F}\\x{670}]"
GREEK = "[\\x{3B1}-\\x{3C9}\\x{3D5}\\x{3C0}\\x{3C6}\\x{221A}\\x{1D6FC}-\\x{1D714}\\x{1D736}-\\x{1D74E}\\x{1D770}-\\x{1D788}]"


def quotes(d: Dialect, x: str = "text") -> str:
    return f"translate({x}, '{''.join(map(chr, QUOTES))}', '{chr(39) * 2 * len(QUOTES)}')"


def dashes(d: Dialect, x: str) -> str:
    return d.rep(x, DASHES, "-")


def normal_space(d: Dialect, x: str = "text") -> str:
    return d.strip(d.rep(x, "[ \\t]+", " "))


def c02_quotes(d: Dialect) -> str:
    return f"select doc_id, {quotes(d)} as text from @docs"


def c04_dashes(d: Dialect) -> str:
    """Dashes become hyphens, but an option that would equal an earlier one of its block keeps its own."""
    option = d.match("text", "^[+=]")
    return f"""with f as (select doc_id, line_no, text, {dashes(d, 'text')} as plain, {option} as option, {d.strip('text')} = '' as blank from @lines),
        b as (select *, sum(case when blank or option then 0 else 1 end) over (partition by doc_id order by line_no) as block from f)
        select doc_id, line_no, case when not option or row_number() over (partition by doc_id, block, option, case when option then {d.strip(d.rep('plain', '^[+=]', ''))} else cast(line_no as varchar(20)) end order by line_no) = 1 then plain else text end as text from b"""


def c05_whitespace(d: Dialect) -> str:
    return f"select doc_id, line_no, {normal_space(d)} as text from @lines"


def c06_arabic_marks(d: Dialect) -> str:
    return f"select doc_id, line_no, {d.rep('text', f'^{ARABIC_MARKS}+[ \\t]*([=+?#])', '$1')} as text from @lines"


def c07_super_subscripts(d: Dialect) -> str:
    return "select doc_id, text from @docs"


def c08_orphan_numerators(d: Dialect) -> str:
    """A short number between a line that ends open and one that starts with digits becomes a fraction, on the line before; empty lines in between go with it."""
    w = "partition by doc_id order by line_no rows between unbounded preceding and 1 preceding"
    back = "partition by doc_id order by line_no desc rows between unbounded preceding and 1 preceding"
    filled = "case when s <> '' then s end"
    number = d.match("s", "^[0-9]{1,3}$")
    ends = d.match("before", "([\\p{Ll}]|=)$")
    starts = d.match("after", "^[0-9]")
    digits, rest = d.ext("after", "^([0-9]{1,3})", 1), d.ext("after", "^[0-9]{1,3}(.*)$", 1)
    return f"""with l as (select doc_id, line_no, text, {d.strip('text')} as s from @lines),
        n as (select *, {d.last(filled, w)} as before, {d.last(filled, back)} as after from l),
        m as (select *, {number} and coalesce({ends}, false) and coalesce({starts}, false) as num from n),
        g as (select *, coalesce({d.last("case when s <> '' then num end", w)}, false) as taken from m),
        h as (select *, sum(case when s = '' or num or taken then 0 else 1 end) over (partition by doc_id order by line_no) as host from g),
        suffix as (select doc_id, host, {d.joined(f"concat(' ', s, '/', {digits}, case when {d.strip(rest)} = '' then '' else concat(' ', {d.strip(rest)}) end)", "''", 'line_no')} as more from h where num group by doc_id, host),
        kept as (select doc_id, line_no, text, case when s <> '' then host end as host from h where not num and not taken)
        select kept.doc_id, kept.line_no, concat(kept.text, coalesce(more, '')) as text from kept left join suffix on suffix.doc_id = kept.doc_id and suffix.host = kept.host"""


def c10_inline_fractions(d: Dialect) -> str:
    return f"select doc_id, {d.rep('text', f'({GREEK})\\s{{1,3}}([0-9]{{1,3}})([\\s,;.!?)\\x{{AB}}\\x{{BB}}\\x22\\x27]|$)', '$1/$2$3')} as text from @docs"


def c11_bom(d: Dialect) -> str:
    return f"select doc_id, {d.rep('text', '^\\x{FEFF}+', '')} as text from @docs"


def c12_page_numbers(d: Dialect) -> str:
    """Lines that hold only a page number go, unless the very next or last line opens with a mark or is a rule."""
    number = d.match("s", "^-?\\s*[0-9]{1,4}\\s*-?$")
    beside = lambda x: f"coalesce({d.match(x, '^[=+?]')}, false)"
    return f"""with s as (select doc_id, line_no, text, {d.strip('text')} as s from @lines),
        w as (select *, lag(s) over (partition by doc_id order by line_no) as a, lead(s) over (partition by doc_id order by line_no) as b from s)
        select doc_id, line_no, text from w where not ({number} and not {beside('a')} and not {beside('b')})"""


def c03_unmarked_correct(d: Dialect) -> str:
    """Where only wrong options are marked, bare lines of a question after its stem are its right options."""
    q, marked, other = d.match("s", "^\\?"), d.match("s", "^[-=]"), d.match("s", "^[+*#]")
    ends = d.match("s", "[?.\\x{FF1F}]$")
    return f"""with l as (select doc_id, line_no, text, {d.strip('text')} as s from @lines),
        f as (select *, {q} as q, {marked} as marked, sum(case when {q} then 1 else 0 end) over (partition by doc_id order by line_no) as block from l),
        per as (select doc_id, block, count_if(marked) as n from f where block > 0 group by doc_id, block),
        times as (select doc_id, n, count(*) as k from per group by doc_id, n),
        modal as (select doc_id, n from (select doc_id, n, row_number() over (partition by doc_id order by k desc, n) as r from times) x where r = 1),
        gate as (select f.doc_id from f join modal on modal.doc_id = f.doc_id group by f.doc_id having count_if(q) >= 3 and count_if({other}) = 0 and count_if(marked) >= count_if(q) and max(modal.n) < 4),
        w as (select f.*, min(case when marked then line_no end) over (partition by f.doc_id, block) as first_mark from f where s <> ''),
        x as (select *, max(case when {ends} and not marked and (first_mark is null or line_no < first_mark) then 1 else 0 end) over (partition by doc_id, block order by line_no rows between unbounded preceding and 1 preceding) as closed,
            max(case when not marked and (first_mark is null or line_no < first_mark) then line_no end) over (partition by doc_id, block) as last_pre from w)
        select f.doc_id, f.line_no, case when x.line_no is not null and x.block > 0 and gate.doc_id is not null and not x.q and not x.marked and x.first_mark is not null and (x.line_no > x.first_mark or x.closed = 1 or (x.line_no = x.last_pre and not {d.match('x.s', '[?\\x{FF1F}]$')}))
            then concat('+ ', x.s) else f.text end as text
        from f left join x on x.doc_id = f.doc_id and x.line_no = f.line_no left join gate on gate.doc_id = f.doc_id"""
