"""Validation of questions: options (q_no, pos, txt, ok) into questions, issues, duplicates and statistics."""

from __future__ import annotations

from ..plans.dialect import Dialect

#: Least and most options kept; shortest question without a warning; usual number of options.
LEAST, MOST, SHORT, USUAL = 2, 6, 3, 4
#: Texts of the derived questions: some empty, some short.
QUESTION = "case when raw.q_no % 31 = 5 then '' when raw.q_no % 31 = 6 then 'ab' else concat('Which part of ', cast(raw.q_no % 97 as varchar(20)), '?') end"


def _options(d: Dialect) -> str:
    """CTEs up to `one`: distinct options of each question after truncation, in order (place from 0)."""
    return f"""o as (select q_no, pos, {d.strip('txt')} as txt, ok from @opt),
        kept as (select *, row_number() over (partition by q_no order by pos) as nth from o where txt <> ''),
        one as (select q_no, txt, min(pos) as pos, max(case when ok then 1 else 0 end) = 1 as ok from kept where nth <= {MOST} group by q_no, txt),
        placed as (select *, cast(row_number() over (partition by q_no order by pos) - 1 as bigint) as place from one)"""


def _judged(d: Dialect) -> str:
    return f"""{_options(d)},
        raw as (select q_no, count(*) as n_raw, count_if(txt <> '') as n_filled, count_if(ok) as n_right, {d.joined("lower(txt)", "'|'", 'pos')} as signature from o group by q_no),
        made as (select q_no, count(*) as n_options, coalesce(min(case when ok then place end), -1) as c, {d.joined('txt', "'|'", 'place')} as options, {d.listed('txt', 'place')} as items from placed group by q_no),
        q as (select raw.q_no, {QUESTION} as question, signature, items, n_raw, n_filled, n_right, coalesce(n_options, 0) as n_options, coalesce(c, -1) as c, coalesce(options, '') as options, {QUESTION} <> '' and n_filled >= {LEAST} and coalesce(n_options, 0) >= {LEAST} as is_valid from raw left join made on made.q_no = raw.q_no)"""


def v03_validate(d: Dialect) -> str:
    return f"with {_judged(d)} select q_no, question, n_raw, n_filled, n_right, n_options, c, options, is_valid from q"


def v03_issues(d: Dialect) -> str:
    issues = [f"select q_no, '{code}' as code, cast({n} as bigint) as n from q where {test}" for code, n, test in (
        ("E_QUESTION", "0", "question = ''"), ("E_OPTIONS", "n_filled", f"n_filled < {LEAST}"), ("E_AFTER_DEDUP", "n_options", f"n_filled >= {LEAST} and n_options < {LEAST}"), ("W_SHORT", "length(question)", f"question <> '' and length(question) < {SHORT}"), ("W_TOO_MANY", "n_filled", f"n_filled > {MOST}"), ("W_BLANK", "n_raw - n_filled", "n_raw > n_filled"),
        ("W_NO_RIGHT", "n_right", "n_right = 0"), ("W_MANY_RIGHT", "n_right", "n_right > 1"), ("W_DUPLICATE_OPTIONS", "n_options", f"n_options < least(n_filled, {MOST})"), ("W_OPTION_COUNT", "n_options", f"n_options <> {USUAL}"))]
    return f"with {_judged(d)} {' union all '.join(issues)}"


def v04_truncate(d: Dialect) -> str:
    return f"with {_options(d)} select q_no, pos, txt, ok from kept where nth <= {MOST}"


def v05_option_dedup(d: Dialect) -> str:
    return f"with {_options(d)} select q_no, place, txt, ok from placed"


def v06_correct_index(d: Dialect) -> str:
    return f"with {_options(d)} select q_no, coalesce(min(case when ok then place end), -1) as c from placed group by q_no"


def v07_post_dedup(d: Dialect) -> str:
    return f"with {_judged(d)} select q_no, n_options from q where n_filled >= {LEAST} and n_options < {LEAST}"


def v08_correct_count(d: Dialect) -> str:
    return "select q_no, count_if(ok) as n_right from @opt group by q_no"


def v09_valid(d: Dialect) -> str:
    return f"with {_judged(d)} select q_no, question, options, c from q where is_valid"


def v10_potentially_valid(d: Dialect) -> str:
    return f"select q_no, count(*) >= {LEAST} as potentially from @opt group by q_no"


def v11_split(d: Dialect) -> str:
    return "select q_no, case when count_if(ok) > 0 then 'resolved' else 'unresolved' end as side from @opt group by q_no"


def _keyed(d: Dialect) -> str:
    return f"""{_judged(d)},
        k as (select *, concat(lower({d.strip('question')}), '::', signature) as key from q),
        w as (select *, row_number() over (partition by key order by case when is_valid then 0 else 1 end, q_no) as best, row_number() over (partition by key order by q_no) as nth, min(q_no) over (partition by key) as first_no from k)"""


def v01_dedup(d: Dialect) -> str:
    """The best question of each key, valid before invalid, at the place of the first."""
    return f"with {_keyed(d)} select first_no as q_no, question, options, c, is_valid from w where best = 1"


def v02_removed(d: Dialect) -> str:
    return f"with {_keyed(d)} select q_no, substring(question, 1, 80) as shown from w where nth > 1"


def w09_best_per_key(d: Dialect) -> str:
    return f"with {_keyed(d)} select key, q_no as best_no from w where best = 1"


def a01_stats(d: Dialect) -> str:
    return f"""with {_keyed(d)}, u as (select * from w where best = 1)
        select (select count(*) from w) as total_raw, count_if(is_valid) as valid, count_if(not is_valid) as invalid, (select count_if(nth > 1) from w) as duplicates, count_if(n_right = 0) as no_right, count_if(n_options <> {USUAL}) as unusual from u"""


def a02_success_rate(d: Dialect) -> str:
    return f"with {_judged(d)} select {d.div('q_no', '64')} as doc_id, count(*) as raw, count_if(is_valid) as valid, case when count(*) = 0 then 0.0e0 else round(count_if(is_valid) * 100.0e0 / count(*), 1) end as success_rate from q group by {d.div('q_no', '64')}"


def a18_summary(d: Dialect) -> str:
    return f"with {_judged(d)} select {d.div('q_no', '64')} as doc_id, count_if(c >= 0) as answered, count_if(c < 0) as unanswered from q where is_valid group by {d.div('q_no', '64')}"
