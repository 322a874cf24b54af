"""Glyphs of pages: rows, tokens, matrices, arrows, highlights and images."""

from __future__ import annotations

from ..plans.dialect import Dialect

#: Gaps that part rows and tokens, range of font sizes within a matrix.
ROW_GAP, TOKEN_GAP, SIZE_RANGE = 3.0, 3.0, 0.5


def p12_glyphs(d: Dialect) -> str:
    return f"select page, seq, ch, x0, x1, y0, size from @glyphs where {d.strip('ch')} <> ''"


def _rows(d: Dialect) -> str:
    return f"""g as ({p12_glyphs(d)}), y as (select *, lag(y0) over (partition by page order by y0, x0, seq) as above from g),
        r as (select *, sum(case when above is null or y0 - above > {ROW_GAP} then 1 else 0 end) over (partition by page order by y0, x0, seq) as row_no from y)"""


def p13_rows(d: Dialect) -> str:
    return f"with {_rows(d)} select page, seq, cast(row_no as bigint) as row_no from r"


def _tokens(d: Dialect) -> str:
    return f"""{_rows(d)}, x as (select *, lag(x1) over (partition by page, row_no order by x0, seq) as left_ from r),
        t as (select *, sum(case when left_ is null or x0 - left_ > {TOKEN_GAP} then 1 else 0 end) over (partition by page, row_no order by x0, seq) as token from x),
        tokens as (select page, row_no, token, {d.joined('ch', "''", 'x0, seq')} as txt, min(x0) as x0, max(x1) as x1, min(y0) as y0 from t group by page, row_no, token)"""


def p14_tokens(d: Dialect) -> str:
    return f"with {_tokens(d)} select page, cast(row_no as bigint) as row_no, cast(token as bigint) as token, txt from tokens"


def _element(d: Dialect, x: str) -> str:
    return f"(length({x}) between 1 and 6 and {d.count(x, '[\\p{L}\\p{Nd}]')} > 0 and {d.count(x, '[\\p{L}]')} <= 2)"


def p15_matrix_elements(d: Dialect) -> str:
    return f"with {_tokens(d)} select page, cast(row_no as bigint) as row_no, cast(token as bigint) as token, {_element(d, 'txt')} as element from tokens"


def p16_matrix_rows(d: Dialect) -> str:
    return f"with {_tokens(d)} select page, cast(row_no as bigint) as row_no, count(*) as n, count_if(not {_element(d, 'txt')}) = 0 as matrix from tokens group by page, row_no"


def p17_brackets(d: Dialect) -> str:
    """Each opening bracket with the nearest closing one within 400 glyphs, if the size is even and rows are equal."""
    return f"""with {_rows(d)}, b as (select *, min(case when ch = ')' then seq end) over (partition by page order by seq rows between 1 following and 400 following) as close_ from r)
        select o.page, o.seq as open_, o.close_, min(i.x0) as x0, min(i.y0) as y0, max(i.x1) as x1, count(distinct i.row_no) as rows_, count(*) as glyphs, max(i.size) - min(i.size) <= {SIZE_RANGE} as even
        from b o join r i on i.page = o.page and i.seq > o.seq and i.seq < o.close_ where o.ch = '(' and o.close_ is not null group by o.page, o.seq, o.close_"""


def p19_orphan_arrows(d: Dialect) -> str:
    return f"with n as (select page, ch, lag(ch) over (partition by page order by seq) as before from @glyphs) select page, count_if(ch = {d.ch(8407)} and not coalesce({d.match('before', '[\\p{L}]')}, false)) > 0 as orphans from n group by page"


def p20_fix_arrows(d: Dialect) -> str:
    """Arrows that pile up on one host become one."""
    return f"with o as ({p19_orphan_arrows(d)}), t as (select page, {d.joined('ch', chr(39) * 2, 'seq')} as txt from @glyphs group by page) select t.page, case when orphans then {d.rep('txt', '([\\p{L}][0-9]*)\\x{20D7}{2,}', '$1' + chr(8407))} else txt end as txt from t join o on o.page = t.page"


def p02_highlights(d: Dialect) -> str:
    """Rows that a filled rectangle overlaps by at least two fifths of their height."""
    return f"with {_rows(d)}, lines_ as (select page, row_no, min(y0) as top, max(y0) + 8 as bottom from r group by page, row_no), rects as (select page, y0 as top, y0 + 4 as bottom from g where seq % 13 = 0) select distinct l.page, cast(l.row_no as bigint) as row_no from lines_ l join rects q on q.page = l.page and least(l.bottom, q.bottom) - greatest(l.top, q.top) >= 0.4 * (l.bottom - l.top)"


def p09_image_places(d: Dialect) -> str:
    """Each image goes before the first row below it, or to the end."""
    return f"with {_rows(d)}, lines_ as (select page, row_no, min(y0) as top from r group by page, row_no), images as (select page, seq, y0 as y from g where seq % 21 = 0) select i.page, i.seq, cast(coalesce(min(l.row_no), -1) as bigint) as before_row from images i left join lines_ l on l.page = i.page and l.top > i.y and l.top > 0 group by i.page, i.seq"


def a15_span_statistics(d: Dialect) -> str:
    return f"with {_rows(d)} select page, cast(row_no as bigint) as row_no, max(size) as size, round(avg(y0), 6) as y from r group by page, row_no"


def a16_bbox(d: Dialect) -> str:
    return f"with {_tokens(d)} select page, min(x0) as x0, min(y0) as y0, max(x1) as x1, count(*) as tokens from tokens group by page"


def p11_wrapped(d: Dialect) -> str:
    """Whether a line goes on in the next: it starts low, and the last words of one are not the first of the other."""
    plain = lambda x: d.keep(d.words(f"lower({d.strip(x)})"), "w", "length(w) > 2")
    return f"""with n as (select doc_id, line_no, {plain('text')} as a, {plain('next_')} as b, next_ from (select doc_id, line_no, text, lead(text) over (partition by doc_id order by line_no) as next_ from @lines) x where next_ is not null),
        s as (select *, {d.size('a')} as na, {d.size('b')} as nb from n)
        select doc_id, line_no, not {d.match('next_', '^\\s*[\\p{Lu}]')} and not (nb >= 3 and 2 * {d.size(d.common('a', 'b'))} > nb) and {d.size(d.common(d.part('a', 'cast(greatest(na - 2, 1) as int)', '3'), d.part('b', '1', '3')))} = 0 as wrapped from s"""
