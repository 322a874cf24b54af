"""Requests to a resolver, their answers, reports, summaries and admission, over questions and options."""

from __future__ import annotations

from ..config import MODELS
from ..plans.dialect import Dialect
from .resolve import CHUNK, PRICES, _merged, _tier, numbered
from .validate import _judged

# The prompt around a chunk, the end of a multimodal one, limits of requests and admission.
ASK, END = "Find the correct answers for the following questions:", "Remember: Output ONLY raw JSON matching the response schema. No code fences. No explanations."
MOST_TOKENS, MOST_BYTES, SUFFIXES = 4000, 20 * 1024 * 1024, ("pdf", "docx", "doc", "xlsx", "txt")
# First bytes of images, in hexadecimal; any other counts as PNG.
MAGIC = (("image/png", "89504E47"), ("image/jpeg", "FFD8"), ("image/gif", "474946383761"), ("image/gif", "474946383961"))


def _text(x: str) -> str:
    return f"cast({x} as varchar(20))"


def _unanswered(d: Dialect) -> str:
    """Valid questions without an answer, with their number over all and their chunk."""
    return f"""{_judged(d)}, {numbered(d, "select q_no, question, items, n_options from q where is_valid and c < 0")},
        u as (select *, {d.div('id - 1', str(CHUNK))} + 1 as chunk_id from numbered)"""


def k15_prompt(d: Dialect) -> str:
    """The prompt of each chunk: its questions as JSON between what to do and how to answer."""
    one = d.json({"id": "id", "q": "question", "o": "items"})
    return f"""with {_unanswered(d)}, j as (select chunk_id, id, {one} as one from u), c as (select chunk_id, {d.joined('one', "','", 'id')} as items from j group by chunk_id)
        select chunk_id, concat('{ASK}', chr(10), chr(10), '{{"questions":[', items, ']}}', chr(10), chr(10), '{END}') as prompt from c"""


def k16_blocks(d: Dialect) -> str:
    """Content blocks of each chunk in order: a text for each question, an image after it where there is one, and the instruction."""
    each = d.each("u", "chunk_id, id, question, n_options", "items", "nth", "opt")
    image = "case id % 4 when 0 then 'iVBORw0KGgo=' when 1 then '/9j/4AAQ' when 2 then 'R0lGODlhAQ==' end"
    return f"""with {_unanswered(d)}, each_ as ({each}), t as (select chunk_id, id, max(question) as question, {d.joined("concat('  ', " + _text('nth - 1') + ", ': ', opt)", 'chr(10)', 'nth')} as opts from each_ group by chunk_id, id),
        b as (select chunk_id, 2 * id as place, 'text' as type, concat('[id=', {_text('id')}, '] ', question, chr(10), 'Options:', chr(10), opts) as body, cast(null as varchar(20)) as media from t
            union all select chunk_id, 2 * id + 1, 'image', {image}, {_media(d, image)} from t where {image} is not null
            union all select distinct chunk_id, cast(9000000000 as bigint), 'text', '{END}', cast(null as varchar(20)) from t)
        select chunk_id, cast(row_number() over (partition by chunk_id order by place) as bigint) as place, type, body, media from b"""


def _media(d: Dialect, x: str) -> str:
    """The kind of an image from the first bytes of its base64 text."""
    head = d.hexed(f"substring({x}, 1, 16)")
    return "case " + " ".join(f"when {head} like '{magic}%' then '{kind}'" for kind, magic in MAGIC) + " else 'image/png' end"


def v17_media(d: Dialect) -> str:
    data = "case q_no % 5 when 0 then 'iVBORw0KGgoAAAAN' when 1 then '/9j/4AAQSkZJRgAB' when 2 then 'R0lGODlhAQABAIAA' when 3 then 'R0lGODdhAQABAIAA' else 'UklGRiQAAABXRUJQ' end"
    return f"select distinct q_no, {_media(d, data)} as media from @opt"


def k17_envelope(d: Dialect) -> str:
    """A request for each chunk: old models get a temperature, others think with medium effort."""
    model = "case chunk_id % 2 when 0 then 'claude-opus-4-7' else 'claude-3-haiku' end"
    common = {"model": "model", "max_tokens": str(MOST_TOKENS)}
    return f"""with p as ({k15_prompt(d)}), m as (select chunk_id, prompt, concat('chunk-', {_text('chunk_id')}) as custom_id, {model} as model from p)
        select chunk_id, custom_id, case when model like '%claude-3%' then {d.json(common | {'temperature': '0.0e0', 'content': 'prompt'})} else {d.json(common | {'thinking': "'adaptive'", 'effort': "'medium'", 'content': 'prompt'})} end as params from m"""


def v16_answers(d: Dialect) -> str:
    """(chunk, id, c, cf, s) out of answers in JSON, within fences or other text; what can't be read gives nothing."""
    one = "concat('{\"id\": ', cast(id as varchar(20)), ', \"c\": ', cast(c as varchar(20)), case when id % 3 = 0 then '' else concat(', \"cf\": ', cast(cf as varchar(20)), ', \"s\": ', case when s then 'true' else 'false' end) end, '}')"
    whole = "concat(case when chunk % 2 = 0 then concat('```json', chr(10)) else 'So: ' end, '{\"answers\": [', items, case when chunk % 7 = 3 then '' else ']}' end, case when chunk % 2 = 0 then concat(chr(10), '```') else ' done' end)"
    return f"""with a as (select id, arrival, c, cf, s, {d.div('arrival - 1', '25')} as chunk from @answers), j as (select chunk, {d.joined(one, "', '", 'arrival')} as items from a group by chunk), t as (select chunk, {whole} as raw from j)
        select chunk, id, c, case when coalesce(cf, 0) < 0 then 0.0e0 when coalesce(cf, 0) > 1 then 1.0e0 else round(coalesce(cf, 0.0e0), 2) end as cf, coalesce(s, false) as s from ({d.answers('t', 'chunk', d.ext('raw', '([{](?:.|\\n)*[}])'))}) x where id is not null and c is not null"""


def v18_suffix(d: Dialect) -> str:
    name = "concat(case page_id % 6 when 0 then 'a.b.PDF' when 1 then 'x.docx' when 2 then 'none' when 3 then 'y.tar.Gz' when 4 then '.txt' else 'z.' end)"
    return f"select page_id, {name} as name, lower({d.ext(name, '[.]([^.]*)$')}) as suffix from @pages"


def v19_admitted(d: Dialect) -> str:
    """Files of known suffixes of at most 20 MiB; those of unknown size pass."""
    size = "case when page_id % 11 = 0 then null else page_id * 104729 % 41943040 end"
    kinds = ", ".join(f"'{x}'" for x in SUFFIXES)
    return f"select page_id, suffix, coalesce(size, -1) as size, suffix in ({kinds}) and coalesce(size, 0) <= {MOST_BYTES} as admitted from (select page_id, suffix, {size} as size from ({v18_suffix(d)}) a) b"


def v20_allowed(d: Dialect) -> str:
    """Whether a user is the admin or in the list of allowed ones."""
    return "with a as (select c_custkey as id from @customers where c_nationkey < 12) select e.user_id, e.user_id = 7 or max(case when a.id is not null then 1 else 0 end) = 1 as allowed from (select distinct user_id from @log) e left join a on a.id = e.user_id group by e.user_id"


def v21_unresolved(d: Dialect) -> str:
    return f"with {_judged(d)} select {d.div('q_no', '64')} as doc_id, count_if(c = -1) > 0 as unresolved from q where is_valid group by {d.div('q_no', '64')}"


def j09_bold_options(d: Dialect) -> str:
    """Options that a bold chunk covers: the same text, or the text after a bare letter's mark. Part of a longer chunk isn't enough."""
    chunk = "case q_no % 4 when 0 then txt when 1 then concat('B) ', txt) when 2 then concat('see ', txt) else 'other' end"
    bare = d.match("substring(chunk, 1, length(chunk) - length(txt))", "^[\\x{410}-\\x{42F}\\x{401}\\x{430}-\\x{44F}\\x{451}A-Za-z][.)]?\\s*$")
    ends = "substring(chunk, length(chunk) - length(txt) + 1, length(txt)) = txt and length(chunk) >= length(txt)"
    return f"""with c as (select q_no, {chunk} as chunk from @opt where ok), p as (select o.q_no, o.pos, o.txt, c.chunk from @opt o join c on c.q_no = o.q_no)
        select distinct q_no, pos, txt from p where txt <> '' and (chunk = txt or ({ends} and {bare}))"""


def j11_models(d: Dialect) -> str:
    """Models by the labels that users press, a tick before the chosen one; unknown labels give none."""
    rows = " union all ".join(f"select '{label}' as label, '{model}' as model" for label, model in MODELS.items())
    pressed = f"case user_id % 6 when 0 then 'Claude Opus 5' when 1 then concat({d.ch(9989)}, ' Claude Sonnet 5') when 2 then 'Claude Opus 4.8' when 3 then concat({d.ch(9989)}, ' Claude Opus 4.7') else 'else' end"
    return f"with m as ({rows}), p as (select distinct user_id, {pressed} as label from @log) select p.user_id, p.label, m.model from p left join m on m.label = {d.rep('p.label', '^\\x{2705} ', '')}"


def j12_image_parts(d: Dialect) -> str:
    """Image parts of the places that name them by relation; a relation without its part gives nothing."""
    return "with places as (select q_no, pos, concat('rId', cast(q_no % 13 as varchar(20))) as rel from @opt where pos = 1), parts as (select distinct concat('rId', cast(q_no % 13 as varchar(20))) as rel, concat('media/image', cast(q_no % 13 as varchar(20)), '.png') as part from @opt where q_no % 13 <> 5) select q_no, pos, part from places join parts on parts.rel = places.rel"


def r01_ended(d: Dialect) -> str:
    """The first state of each job that ends it, and whether well."""
    status = "case user_id % 8 when 0 then 'completed' when 1 then 'ended' when 2 then 'failed' when 3 then 'expired' when 4 then 'canceled' else 'in_progress' end"
    return f"""with e as (select batch_id, ts, {status} as status from @log), t as (select *, row_number() over (partition by batch_id order by ts, status) as n from e where status <> 'in_progress')
        select batch_id, ts, status, status in ('completed', 'ended') as ok from t where n = 1"""


def a10_progress(d: Dialect) -> str:
    """Ended requests of all, 0 where there are none, and what is shown of it."""
    return "with s as (select batch_id, count_if(kind <> 'refusal') as ended, count(*) as total from @log group by batch_id union all select cast(-1 as bigint), cast(0 as bigint), cast(0 as bigint)), f as (select batch_id, case when total > 0 then ended * 1.0e0 / total else 0.0e0 end as share from s) select batch_id, round(share, 6) as share, round(0.25e0 + 0.65e0 * share, 6) as shown from f"


def r11_model(d: Dialect) -> str:
    """The model chosen last, by whomever, else the default."""
    names = list(PRICES)
    chosen = " ".join(f"when {k} then '{m}'" for k, m in enumerate(names))
    return f"with c as (select ts, user_id, case user_id % {len(names)} {chosen} end as model from @log where kind = 'refusal'), l as (select max(ts) as ts from c), m as (select max(c.model) as model from c join l on l.ts = c.ts) select coalesce(model, 'claude-opus-4-7') as model from m"


def k13_duration(d: Dialect) -> str:
    """Hours, minutes and seconds, without leading units of zero."""
    h, m, s = (_text(x) for x in (d.div("n", "3600"), d.div("n % 3600", "60"), "n % 60"))
    return f"with t as (select batch_id, cast(count(*) * 37 % 9000 as bigint) as n from @log group by batch_id) select batch_id, n, concat(case when n >= 3600 then concat({h}, ' soat ') else '' end, case when n >= 60 then concat({m}, ' daqiqa ') else '' end, {s}, ' soniya') as shown from t"


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


def k14_summary(d: Dialect) -> str:
    """What is told after parsing: file, questions, answered and not, questions with images, duplicates taken out, and seconds."""
    name = "concat('a<b>&\"', chr(39), cast(doc_id as varchar(20)), '.docx')"
    return f"""with {_judged(d)}, k as (select {d.div('q_no', '64')} as doc_id, q_no, c, is_valid, q_no % 9 = 0 and q_no % 7 < 5 as image, row_number() over (partition by {d.div('q_no', '64')}, lower(question), signature order by q_no) as nth from q),
        s as (select doc_id, count_if(is_valid and nth = 1) as n, count_if(is_valid and nth = 1 and c >= 0) as answered, count_if(is_valid and nth = 1 and image) as images, count_if(nth > 1) as gone from k group by doc_id)
        select doc_id, concat('📝 <b>Tahlil yakunlandi</b>', chr(10), '📁 Fayl: <code>', {_escaped(name)}, '</code>', chr(10), '❓ Jami savollar: <b>', {_text('n')}, '</b>', chr(10), '✔️ Javobli: <b>', {_text('answered')}, '</b>  |  ❌ Javobsiz: <b>', {_text('n - answered')}, '</b>',
            case when images > 0 then concat(chr(10), '🖼 Rasmli savollar: <b>', {_text('images')}, '</b>') else '' end, case when gone > 0 then concat(chr(10), '♻️ Dublikatlar (olib tashlandi): <b>', {_text('gone')}, '</b>') else '' end,
            chr(10), '⏱ Davomiylik: <b>', {_text('cast(doc_id as int)')}, '.', {_text('n % 10')}, ' soniya</b>') as html from s"""


def _resolved(d: Dialect) -> str:
    return f"""{_merged(d)}, s as (select (select count(distinct q_no) from @opt) as total, count(*) as sent, count_if(c <> -1) as resolved, count_if(c = -1) as failed, count_if(searched) as searched, count_if(c <> -1 and {_tier('cf')} = 'TRUSTED') as trusted, count_if(c <> -1 and {_tier('cf')} = 'WARNING') as warning, count_if(c <> -1 and {_tier('cf')} = 'MANUAL_REVIEW') as manual,
        cast(round(coalesce(avg(case when c <> -1 then cf end), 0) * 1000) as bigint) as thousandths, {d.div('count(*) + ' + str(CHUNK - 1), str(CHUNK))} as chunks from m)"""


def a19_resolver_summary(d: Dialect) -> str:
    """What is told after resolving: questions, answered and not, and those that were searched for."""
    return f"""with {_resolved(d)} select total, total - failed as answered, failed, searched, concat('✅ <b>Javoblar aniqlandi</b>', chr(10), '❓ Jami savollar: <b>', {_text('total')}, '</b>', chr(10), '✔️ Javobli: <b>', {_text('total - failed')}, '</b>  |  ❌ Javobsiz: <b>', {_text('failed')}, '</b>',
        case when searched > 0 then concat(chr(10), '🌐 Internetdan tekshirilgan: <b>', {_text('searched')}, '</b>') else '' end) as html from s"""


def _grouped(d: Dialect, x: str) -> str:
    """A number with a comma before each three digits."""
    return f"reverse({d.rep(d.rep(f'reverse({_text(x)})', '([0-9]{3})', '$1,'), ',$', '')})"


def k10_report(d: Dialect) -> str:
    """The report of a resolver's run."""
    rule = "repeat('=', 55)"
    rows = [
        ("Model               ", "'claude-opus-4-7'"), ("Rejim               ", "'Batch API'"), ("Jami savollar       ", _text("total")), ("Avvaldan yechilgan  ", _text("total - sent")), ("AI ga yuborilgan    ", _text("sent")),
        ("AI yechgan          ", _text("resolved")), ("Muvaffaqiyatsiz     ", _text("failed")), None, "Ishonch darajasi", ("Ishonchli (≥0.90)   ", _text("trusted")), ("Ogohlantirish       ", _text("warning")), ("Qo''lda tekshirish   ", _text("manual")),
        ("O''rtacha ishonch    ", f"concat({_text(d.div('thousandths', '1000'))}, '.', lpad({_text('thousandths % 1000')}, 3, '0'))"), None, "Tokenlar", ("Kiritish tokenlar   ", _grouped(d, "in_tok")), ("Chiqish tokenlar    ", _grouped(d, "out_tok")), ("Jami tokenlar       ", _grouped(d, "in_tok + out_tok")),
        None, ("Chunk soni          ", _text("chunks")),
    ]
    body = ", chr(10), ".join("''" if r is None else f"'  — {r} —'" if isinstance(r, str) else f"concat('  {r[0]}: ', {r[1]})" for r in rows)
    return f"with {_resolved(d)}, t as (select s.*, sent * 1234 as in_tok, sent * 321 as out_tok from s) select concat({rule}, chr(10), '   AI JAVOB TOPUVCHI — STATISTIKA HISOBOTI', chr(10), {rule}, chr(10), {body}, chr(10), {rule}) as report from t"


def k05_compact(d: Dialect) -> str:
    """Resolved questions by their text, options, answer and confidence."""
    return f"with {_texts(d)} select q_no, {d.json({'q': 'q', 'o': 'o', 'c': 'c', 'cf': 'cf'})} as json from r"


def k06_full_json(d: Dialect) -> str:
    """All fields of resolved questions."""
    return f"with {_texts(d)} select q_no, {d.json({'q': 'q', 'o': 'o', 'c': 'c', 'cf': 'cf', 'source': 'source', 'tier': 'tier', 'searched': 'searched'})} as json from r"


def _texts(d: Dialect) -> str:
    """Questions with their options, answered by their own mark (manual) or the resolver's (ai)."""
    return f"""{_merged(d)}, t as (select q_no, {d.listed('txt', 'pos')} as o, min(case when ok then pos - 1 end) as own from @opt group by q_no),
        r as (select t.q_no, concat('Which part of order ', cast(t.q_no as varchar(20)), '?') as q, t.o, coalesce(t.own, m.c) as c, case when t.own is not null then 1.0e0 else m.cf end as cf, case when t.own is not null then 'manual' else 'ai' end as source, case when t.own is not null then 'TRUSTED' else {_tier('m.cf')} end as tier, coalesce(m.searched, false) as searched from t left join m on m.q_no = t.q_no)"""


def g03b_twice(d: Dialect) -> str:
    """Options found by position, once on the raw lines and once more on those."""
    from .parse import g03_no_markers

    return g03_no_markers(d).replace("@lines", f"({g03_no_markers(d)})")


def t06_table_questions(d: Dialect) -> str:
    """Rows of sheets as questions: their lines, parsed."""
    from .layout import t05_to_lines
    from .parse import g02_classic

    lines = f"select sheet as doc_id, cast(row_number() over (partition by sheet order by row_no, pos) as bigint) as line_no, text from ({t05_to_lines(d)}) t"
    return g02_classic(d).replace("@lines", f"({lines}) l")
