"""Parsers of marked test documents, as gaps and islands over (doc_id, line_no, text)."""

from __future__ import annotations

from ..plans.dialect import Dialect

# Signs between a question's number and its text.
SEP = "[.)\\x27\\x22\\x{201C}\\x{201D}\\x{AB}\\x{BB}]"
UPPER = "[\\x{410}-\\x{42F}\\x{401}A-Z]"
NUMBERED = [f"^[0-9]+{SEP}{{1,2}}\\s*(.+)", f"^[0-9]{{2,3}}\\s+{SEP}+\\s*(.+)", f"^[0-9]{{2,3}}\\s+[0-9]+{SEP}\\s*(.+)", f"^[0-9]{{2,3}}({UPPER}.{{4,}})", f"^[0-9]{{2,3}}\\s+({UPPER}.{{4,}})"]
LETTERED = "^[a-fA-F][.)]\\s*(.*)"
#: Letters of options, Latin and Cyrillic, by their place; and all of them in a class of a pattern.
PLACES = "ABCDEF", "АБВГДЕ"
LETTERS = "A-Fa-f\\x{410}-\\x{415}\\x{430}-\\x{435}"


def _either(word: str) -> str:
    """A pattern of the word in upper or lower case, beyond ASCII too."""
    return "".join(f"[{c.lower()}{c.upper()}]" for c in word)


# Fixed value: headers of sections between questions.
SECTION = f"^{_either('част')}[а-яёА-ЯЁ]{{0,2}}\\s*[0-9]"


def _first(d: Dialect, x: str, patterns: list[str]) -> str:
    return "case " + " ".join(f"when {d.match(x, p)} then {d.ext(x, p)}" for p in patterns) + " end"


def _classic(d: Dialect) -> str:
    """CTEs up to `p`: rows of (doc_id, line_no, q, opt, piece, right): the pieces of questions (opt 0) and options."""
    w = "partition by doc_id order by line_no"
    hit = d.match("body", "^[#*]\\s*[a-fA-F][.)]\\s*.+")
    return f"""s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        k0 as (select doc_id, line_no, s, {d.strip(d.rep('s', '^\\?+', ''))} as body, {_first(d, 's', NUMBERED)} as numbered from s where s <> '' and not {d.match('s', '^!')} and not {d.match('s', '^\\?+\\s*$')}),
        k as (select doc_id, line_no, s,
            case when {d.match('s', '^\\?')} then case when {hit} then 'H' else 'Q' end when {d.match('s', '^[+#*=-]')} then case when {d.match(d.strip(d.rep('s', '^[+#*=-]+', '')), f'^1{SEP}\\s*\\S')} then 'L' else 'O' end
                when {d.match('s', LETTERED)} then 'A' when numbered is not null then 'N' else 'X' end as kind,
            case when {d.match('s', '^\\?')} then body when {d.match('s', '^[+#*=-]')} then {d.strip(d.rep('s', '^[+#*=-]+', ''))} when {d.match('s', LETTERED)} then {d.ext('s', LETTERED)} else s end as body,
            numbered, {d.match('s', '^[+#*]')} or {d.match('s', '^\\?\\s*[#*]\\s*[a-fA-F][.)]')} as marked from k0),
        act as (select *, sum(case when kind in ('Q', 'H', 'N', 'O', 'L') then 1 else 0 end) over ({w}) as active from k),
        r as (select *, sum(case when kind in ('Q', 'O', 'L', 'A') then 1 else 0 end) over ({w}) as run, row_number() over ({w}) as nth from act where active > 0),
        a as (select *, max(case when kind in ('Q', 'O', 'L', 'A') then kind end) over (partition by doc_id, run) as anchor, min(case when kind = 'H' then line_no end) over (partition by doc_id, run) as first_h from r),
        n as (select *, min(case when kind = 'N' and anchor in ('O', 'L', 'A') and (anchor <> 'L' or first_h < line_no) then line_no end) over (partition by doc_id, run) as n_start from a),
        e as (select *, anchor in ('O', 'L', 'A') and n_start is null as end_has, coalesce(anchor in ('O', 'L', 'A') and (n_start is null or line_no < n_start), false) as has from n),
        ends as (select doc_id, run + 1 as run, max(case when end_has then 1 else 0 end) as open from e group by doc_id, run),
        b as (select e.*, case when nth = 1 or line_no = n_start or (kind = 'Q' and coalesce(ends.open, 0) = 1) then 1 else 0 end as start_q, case when kind in ('O', 'L', 'A') or (kind = 'H' and has and nth > 1) then 1 else 0 end as is_opt from e left join ends on ends.doc_id = e.doc_id and ends.run = e.run),
        i as (select *, sum(start_q) over ({w}) as q from b),
        p as (select doc_id, line_no, q, sum(is_opt) over (partition by doc_id, q order by line_no) as opt, start_q, is_opt,
            case when kind = 'H' and is_opt = 1 then {d.strip(d.rep('body', '^[#*]\\s*[a-fA-F][.)]', ''))} when kind = 'N' and start_q = 1 then {d.strip('numbered')} else body end as piece, is_opt = 1 and marked as right_ from i)"""


def _pieces(d: Dialect, ctes: str) -> str:
    """Rows (doc_id, q, opt, text, ok, line_start) out of pieces p."""
    return f"with {ctes} select doc_id, cast(q as bigint) as q, cast(opt as bigint) as opt, {d.strip(d.joined('piece', chr(39) + ' ' + chr(39), 'line_no'))} as text, max(case when right_ then 1 else 0 end) = 1 as ok, min(line_no) as line_start from p group by doc_id, q, opt"


def g02_classic(d: Dialect) -> str:
    return _pieces(d, _classic(d))


def g10_quiz(d: Dialect) -> str:
    """The strict variety: every question sign starts a question, only + and = start options."""
    w = "partition by doc_id order by line_no"
    ctes = f"""s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        k as (select doc_id, line_no, s, case when {d.match('s', '^\\?')} then 'Q' when {d.match('s', '^[+=]')} then 'O' else 'X' end as kind from s where s <> '' and not {d.match('s', '^!')}),
        a as (select *, sum(case when kind in ('Q', 'O') then 1 else 0 end) over ({w}) as active from k),
        b as (select *, case when kind = 'Q' or (kind = 'O' and active = 1) then 1 else 0 end as start_q from a where active > 0),
        i as (select *, sum(start_q) over ({w}) as q from b),
        p as (select doc_id, line_no, q, sum(case when kind = 'O' then 1 else 0 end) over (partition by doc_id, q order by line_no) as opt, case when kind = 'X' then s else {d.strip(d.rep('s', '^[?+=]', ''))} end as piece, kind = 'O' and {d.match('s', '^[+]')} as right_ from i)"""
    return _pieces(d, ctes)


def g07_abc(d: Dialect) -> str:
    """Numbered questions with lettered options; the last answer line within range decides among the options before it.

    Section headers belong to nothing. An option before any question opens one without text; what stands before is dropped,
    as is a question with neither text nor options.
    """
    w = "partition by doc_id order by line_no"
    question, option = "^[0-9]+[.)\\s]\\s*(.*)", f"^([#*+=]?)\\s*([{LETTERS}])[.)]\\s*(.*)"
    plain = f"^[{LETTERS}][.)]"
    key = f"(?i)^(?:to\\x27?\\x{{2BB}}?g\\x27?\\x{{2BB}}?ri\\s+javob|correct\\s+answer|correct|answer|right\\s+answer|{_either('правильный')}\\s+{_either('ответ')}|{_either('ответ')})\\s*:\\s*([{LETTERS}])"
    place = f"greatest(instr('{PLACES[0]}', upper(letter)), instr('{PLACES[1]}', upper(letter)))"
    body = d.strip(d.rep(d.ext("s", option, 3), "^#", ""))
    ctes = f"""s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        k as (select doc_id, line_no, s, case when {d.match('s', question)} then 'Q' when {d.match('s', f'^[#*+=]\\s*[{LETTERS}][.)]')} or {d.match('s', plain)} then 'O' when {d.match('s', '^[+*=] ')} then 'P' when {d.match('s', key)} then 'K' else 'X' end as kind from s where s <> '' and not {d.match('s', SECTION)}),
        act as (select *, sum(case when kind in ('Q', 'O') then 1 else 0 end) over ({w}) as active from k),
        i as (select *, sum(case when kind = 'Q' or (kind = 'O' and active = 1) then 1 else 0 end) over ({w}) as q from act where active > 0),
        o as (select *, sum(case when kind in ('O', 'P') then 1 else 0 end) over (partition by doc_id, q order by line_no) as opt, case when kind = 'K' then {d.ext('s', key)} end as letter from i),
        j as (select *, case when kind = 'K' and {place} between 1 and opt then line_no end as key_line, case when kind = 'K' and {place} between 1 and opt then {place} end as key_place from o),
        y as (select *, max(key_line) over (partition by doc_id, q) as last_key, max(opt) over (partition by doc_id, q) as options from j),
        z as (select *, max(case when line_no = last_key then key_place end) over (partition by doc_id, q) as key_at from y),
        c as (select doc_id, line_no, q, opt, options, case when kind = 'Q' then {d.strip(d.ext('s', question))} when kind = 'O' and {d.match('s', plain)} then {d.strip(d.rep(body, '[*]$', ''))} when kind = 'O' then {d.strip(d.ext('s', option, 3))} when kind = 'P' then {d.strip("substring(s, 3)")} else s end as piece,
            kind in ('O', 'P') and case when last_key > line_no then opt = key_at when kind = 'P' then {d.match('s', '^[+*]')} when {d.match('s', plain)} then {d.match(d.ext('s', option, 3), '^#|[*]$')} else true end as right_ from z where kind <> 'K'),
        p as (select * from c where opt > 0 or piece <> '')"""
    return _pieces(d, ctes)


def g08_blocks(d: Dialect) -> str:
    """Segments between plus rules; options between equal rules; a marked line after the question's text opens the options early."""
    w = "partition by doc_id order by line_no"
    marker = "^[\\x22\\x{AB}]?\\s*[#+*]"
    ctes = f"""s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        k as (select doc_id, line_no, case when {d.match('s', '^[+]{3,}\\s*$')} then 'S' when {d.match('s', '^[+]{3,}\\s*\\S')} then 'F' when {d.match('s', '^={3,}\\s*$')} then 'P' else 'T' end as kind, {d.strip(d.rep('s', '^[+]{3,}', ''))} as s from s where s <> ''),
        g as (select *, sum(case when kind in ('S', 'F') then 1 else 0 end) over ({w}) as q from k),
        f as (select *, min(case when kind = 'P' then line_no end) over (partition by doc_id, q) as first_p, min(case when kind in ('T', 'F') then line_no end) over (partition by doc_id, q) as first_t from g),
        m as (select *, min(case when kind = 'T' and {d.match('s', marker)} and line_no > first_t and (first_p is null or line_no < first_p) then line_no end) over (partition by doc_id, q) as early from f),
        o as (select *, case when line_no >= least(coalesce(first_p, early), coalesce(early, first_p)) then 1 + sum(case when kind = 'P' then 1 else 0 end) over (partition by doc_id, q order by line_no) - case when early is null then 1 else 0 end else 0 end as opt from m),
        b as (select *, min(case when not {d.match('s', f'{marker}\\s*$')} then line_no end) over (partition by doc_id, q, opt) as first_n from o where kind in ('T', 'F')),
        p as (select doc_id, line_no, q, opt, case when opt > 0 and line_no = first_n then {d.strip(d.rep('s', marker, ''))} else s end as piece, opt > 0 and line_no <= first_n and {d.match('s', marker)} as right_ from b where opt = 0 or line_no >= first_n or {d.match('s', f'{marker}\\s*$')})"""
    return _pieces(d, ctes)


def g09_gift(d: Dialect) -> str:
    """Blocks in braces; a block's flag is the last opening or closing before the line."""
    w = "partition by doc_id order by line_no"
    ctes = f"""s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        k as (select doc_id, line_no, s, case when {d.match('s', '[}]$')} then 0 when {d.match('s', '^[{]')} then 1 end as after_ from s where s <> ''),
        i as (select *, coalesce({d.last('after_', f'{w} rows between unbounded preceding and 1 preceding')}, 0) as inside from k),
        j as (select *, case when after_ = 0 and (inside = 1 or {d.match('s', '^[{].*[}]$')}) then 1 else 0 end as closed from i),
        q as (select *, coalesce(sum(closed) over ({w} rows between unbounded preceding and 1 preceding), 0) + 1 as q, {d.strip(d.rep('s', '^[{]|[}]$', ''))} as body from j),
        o as (select *, case when (inside = 1 or after_ = 1) and {d.match('body', '^([+]?[=~]|[+]%)')} then 1 else 0 end as is_opt from q),
        p as (select doc_id, line_no, q, sum(is_opt) over (partition by doc_id, q order by line_no) as opt, case when is_opt = 1 then {d.strip(d.rep('body', '^[+]?[=~]?(%-?[0-9.]+%)?', ''))} else body end as piece, is_opt = 1 and {d.match('body', '^(=|[+]=|[+]%)')} as right_ from o where body <> '')"""
    return _pieces(d, ctes)


def g05_detect(d: Dialect) -> str:
    """Features of each document's lines, and the format that they speak for."""
    c = lambda p: f"count_if({d.match('text', p)})"
    return f"""with f as (select doc_id, {c('^[{]')} as braces, {c('^~\\s*\\S')} as tildes, {c('^[+]{3,}\\s*$')} as plus_rules, {c('^={3,}\\s*$')} as equal_rules, {c('^\\?\\s*\\S')} as questions, {c('^[+=]\\s*\\S')} as options, {c('^[0-9]+[.)]\\s*\\S')} as numbered, {c(f'^[#*+=]?\\s*[{LETTERS}][.)]\\s*\\S')} as lettered from @lines group by doc_id)
        select *, case when braces >= 3 and tildes >= 2 * braces then 'GIFT' when plus_rules >= 2 or equal_rules >= 2 then 'BLOCKS' when numbered > questions and lettered > options then 'ABC' else 'CLASSIC' end as format from f"""


def g03_no_markers(d: Dialect) -> str:
    """Documents of questions without option markers: the last four lines of each block become options."""
    q, marks = d.match("s", "^\\?\\s*\\S"), d.match("s", "^[=+*-]")
    start = f"({q} or {d.match('s', '^[0-9]+[.)\\x27\\x22\\x{201C}\\x{201D}\\x{AB}\\x{BB}]{1,2}[\\p{L}]')})"
    bold = "^([A-Fa-f\\x{410}-\\x{415}\\x{430}-\\x{435}]*[.)])?\\s*#\\s*"
    return f"""with s as (select doc_id, line_no, text, {d.strip('text')} as s from @lines),
        gate as (select doc_id from s group by doc_id having count_if({q}) >= 3 and count_if({marks}) < 2 * count_if({q})),
        b as (select s.*, {start} as start_, sum(case when {start} then 1 else 0 end) over (partition by s.doc_id order by line_no) as block from s join gate on gate.doc_id = s.doc_id),
        r as (select *, row_number() over (partition by doc_id, block, s <> '' and not start_ order by line_no desc) as back from b)
        select doc_id, line_no, case when block > 0 and s <> '' and not start_ and back <= 4 then case when {d.match('s', bold)} then concat('+ ', {d.rep('s', bold, '')}) else concat('= ', s) end else text end as text from r
        union all select s.doc_id, line_no, text from s left join gate on gate.doc_id = s.doc_id where gate.doc_id is null"""


def g01_spaced_rules(d: Dialect) -> str:
    """Documents ruled by spaced plus signs: the line after a rule is a question, marked lines are right, others wrong."""
    plus, equal = "^[+]( +[+]){2,}\\s*$", "^=( +=){2,}\\s*$"
    return f"""with s as (select doc_id, line_no, {d.strip('text')} as s from @lines),
        gate as (select doc_id, min(case when {d.match('s', plus)} then line_no end) as first_rule from s group by doc_id having count_if({d.match('s', plus)}) >= 5 and count_if({d.match('s', '^\\?')}) = 0),
        k as (select s.doc_id, line_no, s, {d.match('s', plus)} as rule, first_rule from s join gate on gate.doc_id = s.doc_id where s <> '' and not {d.match('s', equal)} and line_no >= first_rule),
        p as (select *, lag(rule) over (partition by doc_id order by line_no) as after_rule from k)
        select doc_id, line_no, case when after_rule then concat('? ', s) when {d.match('s', '^[#*]')} then concat('+ ', {d.strip(d.rep('s', '^[#*]', ''))}) else concat('= ', s) end as text from p where not rule"""


def g06_images(d: Dialect) -> str:
    """Image tokens move out of the text into the list of their paths, as JSON in order; what is only images has a name for it."""
    token = "\\[\\[img:([^\\]]+)\\]\\]"
    clean = d.strip(d.rep(d.rep("text", token, ""), "[ \\t]+", " "))
    return f"select doc_id, case when {clean} = '' and {d.match('text', token)} then '[rasm]' else {clean} end as text, {d.all('text', token)} as paths, {d.count('text', token)} as images from @docs"
