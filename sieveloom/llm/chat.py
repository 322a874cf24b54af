"""Chat formatting in budgeted windows. DataFrame functions only.

Turns are ordered by their number (ties by role, then text). A turn's tokens are given by a column of exact counts, or else
bounded by the UTF-8 bytes it takes in the template, which no byte-level vocabulary can exceed. The room of a window is the
budget less the system turn and the history. Prefix sums of turn tokens lay a conversation into cells of
that room: the turns inside a cell are a window; a turn across a border joins the turns of the cell that it ends in if
all fit the room, and else is a window by itself. So a window keeps its budget, system turn and history included, unless a
single turn doesn't fit the room; that one is whole, alone and without history. Turns within HISTORY tokens before a window's first new turn
are repeated from the window before, and the opening system turn is repeated in every window. Repeated turns carry no loss, so each
assistant text is a target once.

Template: <s>role, a line feed, the text, a line feed, </s>, a line feed. A control string inside a
text or role, with any backslashes before it, gets one more backslash, which reading takes away; a
role's line feeds and backslashes are written as escapes of their own.

Cases: a null text or role is empty; a conversation of null id is a conversation of its own; repeated
rows are turns of their own; extra columns are left out; an empty table gives no windows; a null count of tokens is the bound. A
conversation's prefix sums and its digest stay in one task, as its turns are read in order; the formatted text is one row for each window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Tokens of a window, and at most of the history repeated in it.
BUDGET, HISTORY = 2048, 512
#: Bytes that the template adds to a turn: <s>, a line feed after the role, a line feed, </s>, a line feed.
MARKS = 10

# The template's control strings, and those of common chat templates.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z_]+\|>"


def escaped(column: str) -> str:
    return rf"regexp_replace({column}, r'(\\*)({CONTROL})', r'\\$1$2')"


def unescaped(column: str) -> str:
    return rf"regexp_replace({column}, r'\\(\\*)({CONTROL})', '$1$2')"


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """(conv, window, n_turns, n_repeated, n_tokens, formatted, loss): loss is an array of (start, length) in code points of `formatted`."""
    t = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (F.col(tokens) if tokens else F.lit(None)).cast("bigint").alias("given")
    ).selectExpr("c", "turn", "role", "text", rf"""concat('<s>', {escaped(r"replace(replace(role, r'\', r'\\'), chr(10), r'\n')")}, chr(10)) as head""", f"{escaped('text')} as body", "given")
    t = t.selectExpr("*", f"greatest(coalesce(given, octet_length(head) + octet_length(body) + {MARKS} - 4), 1) as tokens")
    t = t.selectExpr("*", "row_number() over (partition by c order by turn nulls first, role, text) as at").selectExpr("*", "at = 1 and role = 'system' as opening")
    t = t.selectExpr("*", "if(opening, 0, tokens) as cost", f"greatest(1, {budget} - {history} - max(if(opening, tokens, 0)) over (partition by c)) as room", "max(at) over (partition by c) as turns")
    t = t.selectExpr("*", "sum(cost) over (partition by c order by at) - cost as before")
    t = t.selectExpr("*", "(before + greatest(cost, 1) - 1) div room as cell").selectExpr("*", "before div room < cell as across")
    t = t.selectExpr("*", "if(across or sum(cost) over (partition by c, cell) <= room, 0, 1) as sub")
    t = t.selectExpr("*", "min(if(opening, null, struct(cell, sub))) over (partition by c) as first")
    t = t.selectExpr("*", "dense_rank() over (partition by c order by if(opening, first, struct(cell, sub))) - 1 as w")
    t = t.selectExpr("*", "sum(cost) over (partition by c, w) as new")
    following = "over (partition by c order by w range between 1 following and 1 following)"
    t = t.selectExpr("*", "max(w) over (partition by c) as last_w", f"min(if(opening, null, before)) {following} as next_before", f"max(new) {following} as next_new")
    spread = t.selectExpr("*", f"""explode(if(opening, sequence(0, last_w),
        if(next_before - before <= {history} and next_new <= room, array(w, w + 1), array(w)))) as window""").selectExpr("*", "window <> w as repeated")
    spread = spread.selectExpr("c", "window", "turns", "tokens", "named_struct('at', at, 'repeated', repeated, 'target', role = 'assistant' and not repeated, 'head', head, 'body', body) as x")
    grouped = spread.groupBy("c", "window").agg(F.max("turns").alias("n_turns"), F.sum("tokens").alias("n_tokens"), F.expr("array_sort(collect_list(x))").alias("xs"))
    return grouped.selectExpr(
        f"c as `{conv}`", "window", "cast(n_turns as bigint) as n_turns", "size(filter(xs, x -> x.repeated)) as n_repeated", "n_tokens",
        "array_join(transform(xs, x -> concat(x.head, x.body, chr(10), '</s>', chr(10))), '') as formatted",
        """filter(aggregate(xs, named_struct('at', 1, 'spans', cast(array() as array<struct<start: int, length: int>>)),
            (a, x) -> named_struct('at', a.at + length(x.head) + length(x.body) + 6,
                'spans', if(x.target, array_append(a.spans, named_struct('start', a.at + length(x.head), 'length', length(x.body))), a.spans)),
            a -> a.spans), s -> s.start > 0) as loss""",
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns array of (role, text) without repeats, targets array of texts under the loss mask, formatted_chars), from the output alone."""
    one = formatted.selectExpr(
        f"`{conv}`", "window", "length(formatted) as chars",
        rf"""transform(slice(split(formatted, r'\n</s>\n'), n_repeated + 1, size(split(formatted, r'\n</s>\n')) - 1 - n_repeated), x -> named_struct(
            'role', {unescaped("substring(x, 4, locate(chr(10), x) - 4)")}, 'text', {unescaped("substring(x, locate(chr(10), x) + 1)")})) as turns""",
        f"transform(loss, s -> {unescaped('substring(formatted, s.start, s.length)')}) as targets",
    )
    whole = one.groupBy(conv).agg(F.expr("array_sort(collect_list(named_struct('window', window, 'turns', turns, 'targets', targets)))").alias("ws"), F.sum("chars").alias("formatted_chars"))
    return whole.selectExpr(f"`{conv}`", r"transform(flatten(transform(ws, w -> w.turns)), t -> named_struct('role', array_join(transform(split(t.role, r'\\\\'), x -> replace(x, r'\n', chr(10))), r'\'), 'text', t.text)) as turns", "flatten(transform(ws, w -> w.targets)) as targets", "formatted_chars")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = spark.range(2).selectExpr("cast(-7 as bigint) as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    back = read_back(windows(turns))
    return back.selectExpr(
        "conv_id", "cast(size(turns) as bigint) as n_turns",
        "sha2(cast(array_join(transform(turns, t -> concat(t.role, chr(10), t.text, chr(10))), '') as binary), 256) as turns_sha256",
        "cast(length(array_join(targets, '')) as bigint) as loss_chars", "sha2(cast(array_join(targets, '') as binary), 256) as loss_sha256", "formatted_chars",
    )


#: The same in DuckDB, from the rows alone.
ORACLE_OP4 = rf"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(i)),
t1 AS (SELECT *, strlen(role) + strlen(text) + {MARKS} + len(regexp_extract_all(text, '{CONTROL}')) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM t0),
t2 AS (SELECT *, rn = 1 AND role = 'system' AS opening, CASE WHEN rn = 1 AND role = 'system' THEN 0 ELSE tokens END AS cost FROM t1),
t3 AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY rn) - cost AS upto, greatest(1, {BUDGET} - {HISTORY} - max(CASE WHEN opening THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) AS room FROM t2),
t4 AS (SELECT *, (upto + greatest(cost, 1) - 1) // room AS cell FROM t3),
t5 AS (SELECT *, CASE WHEN upto // room < cell OR sum(cost) OVER (PARTITION BY conv_id, cell) <= room THEN 0 ELSE 1 END AS sub FROM t4),
t6 AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY cell, sub) AS w FROM t5 WHERE NOT opening),
g AS (SELECT conv_id, w, min(upto) AS start, sum(cost) AS new FROM t6 GROUP BY conv_id, w), lw AS (SELECT conv_id, max(w) AS n FROM g GROUP BY conv_id),
chars AS (SELECT t5.*, length(t5.role) + length(t5.text) + {MARKS} + len(regexp_extract_all(t5.text, '{CONTROL}')) AS chars, CASE WHEN t5.opening THEN coalesce(lw.n, 1) WHEN g.start - t5.upto <= {HISTORY} AND g.new <= t5.room THEN 2 ELSE 1 END AS copies
  FROM t5 LEFT JOIN t6 USING (conv_id, rn) LEFT JOIN g ON g.conv_id = t5.conv_id AND g.w = t6.w + 1 LEFT JOIN lw ON lw.conv_id = t5.conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars * copies) AS BIGINT) AS formatted_chars
FROM chars GROUP BY conv_id
"""
