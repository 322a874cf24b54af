"""Whole pipelines, composed of the single operators: cleaning, routing to parsers, and validation with statistics."""

from __future__ import annotations

from collections.abc import Callable

from ..plans.dialect import Dialect
from . import clean, parse
from .validate import LEAST, MOST

Op = Callable[[Dialect], str]

#: Line steps of cleaning, in their order.
STEPS: list[Op] = [clean.c03_unmarked_correct, clean.c04_dashes, clean.c05_whitespace, clean.c06_arabic_marks, clean.c08_orphan_numerators, clean.c12_page_numbers]
PARSERS: dict[str, Op] = {"CLASSIC": parse.g02_classic, "ABC": parse.g07_abc, "BLOCKS": parse.g08_blocks, "GIFT": parse.g09_gift}


def over(d: Dialect, op: Op, source: str) -> str:
    """The operator's query with its lines taken from another query."""
    return op(d).replace("@lines", f"({source})")


def c00_clean(d: Dialect) -> str:
    """All line steps, one on the other."""
    source = "select doc_id, line_no, text from @lines"
    for step in STEPS:
        source = f"select doc_id, line_no, text from ({over(d, step, source)}) step_{step.__name__}"
    return source


def g00_route(d: Dialect) -> str:
    """Each document's lines go to the parser of their format."""
    parts = []
    for name, op in PARSERS.items():
        mine = f"select l.doc_id, l.line_no, l.text from @lines l join ({parse.g05_detect(d)}) f on f.doc_id = l.doc_id where f.format = '{name}'"
        parts.append(f"select '{name}' as format, doc_id, q, opt, text, ok from ({over(d, op, mine)}) x_{name}")
    return " union all ".join(parts)


def e1_documents(d: Dialect) -> str:
    """Statistics of each document's parsed questions."""
    return f"""with p as ({g00_route(d)}),
        o as (select format, doc_id, q, text, min(opt) as pos, max(case when ok then 1 else 0 end) as ok from p where opt > 0 and text <> '' group by format, doc_id, q, text),
        n as (select format, doc_id, q, count(*) as n, sum(ok) as right_ from o group by format, doc_id, q),
        q as (select distinct format, doc_id, q from p),
        j as (select q.format, q.doc_id, coalesce(n.n, 0) as n, coalesce(n.right_, 0) as right_ from q left join n on n.format = q.format and n.doc_id = q.doc_id and n.q = q.q)
        select doc_id, format, count(*) as raw, count_if(n >= 2) as valid, count_if(n >= 2 and right_ = 0) as unanswered, count_if(n >= 2 and right_ > 1) as many_right, round(count_if(n >= 2) * 100.0e0 / count(*), 1) as success_rate from j group by doc_id, format"""


def e1_flagship(d: Dialect) -> str:
    """Each document's lines parsed by their format, its questions validated, duplicates taken out (a valid one stays rather than one that isn't), and its statistics."""
    return f"""with p as ({g00_route(d)}),
        filled as (select format, doc_id, q, opt, text, ok, row_number() over (partition by format, doc_id, q order by opt) as nth from p where opt > 0 and text <> ''),
        kept as (select format, doc_id, q, count(distinct text) as n_options, max(case when ok then 1 else 0 end) as answered from filled where nth <= {MOST} group by format, doc_id, q),
        raw as (select format, doc_id, q, coalesce(max(case when opt = 0 then text end), '') as question, count_if(opt > 0 and text <> '') as n_filled, {d.joined("case when opt > 0 then lower(text) end", "'|'", 'opt')} as signature from p group by format, doc_id, q),
        j as (select raw.*, coalesce(answered, 0) as answered, question <> '' and n_filled >= {LEAST} and coalesce(n_options, 0) >= {LEAST} as valid from raw left join kept on kept.format = raw.format and kept.doc_id = raw.doc_id and kept.q = raw.q),
        u as (select *, row_number() over (partition by format, doc_id, lower(question), coalesce(signature, '') order by case when valid then 0 else 1 end, q) as best from j)
        select doc_id, format, count(*) as raw, count_if(best > 1) as duplicates, count_if(best = 1 and valid) as valid, count_if(best = 1 and not valid) as invalid, count_if(best = 1 and valid and answered = 0) as unanswered, round(count_if(best = 1 and valid) * 100.0e0 / count(*), 1) as success_rate from u group by doc_id, format"""
