"""Renderings of questions."""

from __future__ import annotations

from ..plans.dialect import Dialect
from .validate import _judged, _options


def k01_json(d: Dialect) -> str:
    return f"with {_judged(d)} select q_no, {d.json({'q': 'question', 'o': 'items', 'c': 'c', 'img': d.none()})} as json from q where is_valid"


def k08_classic_text(d: Dialect) -> str:
    """Each question as marked lines and an empty one."""
    return f"with {_judged(d)} , t as (select q_no, {d.joined('concat(case when ok then chr(43) else chr(61) end, chr(32), txt)', 'chr(10)', 'place')} as lines from placed group by q_no) select q.q_no, concat('? ', question, chr(10), lines, chr(10), chr(10)) as text from q join t on t.q_no = q.q_no where is_valid"


def k04_math_letters(d: Dialect) -> str:
    """Mathematical italic letters as plain ones."""
    source = "".join(chr(0x1D44E + k) for k in range(26) if k != 7)
    plain = "".join(chr(97 + k) for k in range(26) if k != 7)
    return f"with t as (select doc_id, translate(text, 'abc', '{chr(0x1D44E)}{chr(0x1D44F)}{chr(0x1D450)}') as x from @docs) select doc_id, translate(x, '{source}', '{plain}') as text from t"


def a13_mode(d: Dialect) -> str:
    return f"with n as (select {d.div('q_no', '64')} as doc_id, q_no, count_if(not ok) as k from @opt group by q_no), t as (select doc_id, k, count(*) as n from n group by doc_id, k) select doc_id, k as mode from (select doc_id, k, row_number() over (partition by doc_id order by n desc, k) as r from t) x where r = 1"


def w08_exactly_one(d: Dialect) -> str:
    return "select q_no, count_if(ok) = 1 as exactly_one from @opt group by q_no"


def w13_head(d: Dialect) -> str:
    return f"select q_no, pos, txt from (select *, row_number() over (partition by {d.div('q_no', '64')} order by q_no, pos) as n from @opt) x where n <= 30"


def a21_collect(d: Dialect) -> str:
    return f"with {_options(d)} select q_no, {d.joined('txt', 'chr(124)', 'place')} as options from placed group by q_no"
