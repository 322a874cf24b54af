"""Quality rules with thresholds that adapt to language and source. DataFrame functions only.

Each document's measures are taken from its whole text and written once. Their distributions are
summarised per language and source by log-linear histograms: an integer value keeps its leading
PRECISION bits, so a quantile's relative error is at most 2^-PRECISION, and histograms of parts add
up exactly. From the histograms come quartiles, from these the fences (a quartile plus REACH
interquartile ranges and a floor for each measure), and the fences are joined back to filter.

A group's quartiles are drawn towards those of all documents as if it had PRIOR documents more that are spread like all:
n documents weigh n : PRIOR, so that a small group's fences change smoothly as it grows. The join is salted, so that a
source with a third of the documents is dealt out.

Cases: a null text has no words; null languages and sources form groups of their own; texts with fewer words than
the base rule fail it; repeated rows are judged each; an empty table gives no rows. The words are runs of
other characters than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BLANK = "\\x20\\x09-\\x0D"
PRECISION, REACH, PRIOR, SALTS = 10, 3, 50, 32
#: Measures (in thousandths) with the floor added to their fences, and whether low values fail too.
MEASURES = {"symbols": ("1000 * n_symbols div n_words", 300, False), "lines": ("1000 * n_dup_lines div n_lines", 300, False), "repeats": ("1000 * n_repeat_words div n_words", 250, False), "mean_chars": ("1000 * word_chars div n_words", 2500, True)}


def _top_bits(value: str) -> str:
    """The value with all but its leading bits zero."""
    over = f"greatest(0, length(bin({value})) - {PRECISION + 1})"
    return f"shiftleft(shiftright({value}, {over}), {over})"


def measures(docs: DataFrame, text: str = "text", spare: int = 0) -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Repeated 3-word windows are found without comparing all: each window's hash shares a number with
    its position in the low bits, the numbers are sorted, and neighbours with the same hash are
    repeats if their words are equal. Where neighbours share a hash and not the words, that text's windows are sorted by their words
    instead. `spare` takes more bits off the hash, for tests of that case.
    """
    keep = [c for c in docs.columns if c not in (text, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
    d = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    d = d.withColumns({
        "_w": F.expr(f"array_remove(split(_t, r'[{BLANK}]+'), '')"),
        "_l": F.expr(f"filter(split(_t, r'\n'), x -> x rlike r'[^{BLANK}]')"),
        "n_symbols": F.expr("cast(regexp_count(_t, r'[#*$%&|<>]') as bigint)"),
    })
    d = d.select(*keep, "n_symbols", "_w", F.expr("cast(size(_w) as bigint)").alias("n_words"), F.expr("cast(length(array_join(_w, '')) as bigint)").alias("word_chars"), F.expr("cast(size(_l) as bigint)").alias("n_lines"), F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"), F.expr("transform(_w, x -> xxhash64(x))").alias("_h"))
    # _k: bits of a position. Few documents have equal windows at all, and only these take the second step.
    d = d.withColumn("_k", F.expr(f"length(bin(n_words)) + {spare}"))
    d = d.withColumn("_s", F.expr("if(n_words < 4, cast(array() as array<bigint>), sort_array(transform(slice(_h, 1, cast(n_words as int) - 2), (x, i) -> shiftleft(xxhash64(x, _h[i + 1], _h[i + 2]), _k) | i)))"))
    d = d.withColumn("_m", F.expr("shiftleft(1L, _k) - 1"))
    d = d.withColumn("_p", F.expr("""transform(filter(transform(_s, (x, i) -> named_struct('a', x, 'b', if(i = 0, null, _s[i - 1]), 'c', get(_s, i + 1))),
        z -> (z.b is not null and shiftright(z.a, _k) = shiftright(z.b, _k)) or (z.c is not null and shiftright(z.a, _k) = shiftright(z.c, _k))), z -> named_struct(
        'p', cast(z.a & _m as int),
        'b', if(z.b is not null and shiftright(z.a, _k) = shiftright(z.b, _k), cast(z.b & _m as int), -1),
        'c', if(z.c is not null and shiftright(z.a, _k) = shiftright(z.c, _k), cast(z.c & _m as int), -1)))"""))
    same = " and ".join(f"_w[q.p + {j}] = _w[q.{{0}} + {j}]" for j in range(3))
    fast = f"transform(filter(_p, q -> (q.b >= 0 and {same.format('b')}) or (q.c >= 0 and {same.format('c')})), q -> q.p)"
    odd = f"exists(_p, q -> (q.b >= 0 and not ({same.format('b')})) or (q.c >= 0 and not ({same.format('c')})))"
    sorted_ = "array_sort(transform(slice(_w, 1, cast(n_words as int) - 2), (x, i) -> named_struct('g', concat(x, ' ', _w[i + 1], ' ', _w[i + 2]), 'p', i)))"
    slow = f"aggregate(array({sorted_}), cast(array() as array<int>), (a, s) -> transform(filter(transform(s, (z, i) -> named_struct('p', z.p, 'again', (i > 0 and s[i - 1].g = z.g) or (i < size(s) - 1 and get(s, i + 1).g = z.g))), z -> z.again), z -> z.p))"
    places = f"case when {odd} then {slow} else {fast} end"
    d = d.withColumn("n_repeat_words", F.expr(f"cast(size(array_distinct(flatten(transform({places}, p -> array(p, p + 1, p + 2))))) as bigint)"))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def fences(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(by, is_all, one low_ and high_ column for each measure); the row with is_all holds those of all documents."""
    judged = measured.where("not base_failed")
    pairs = ", ".join(f"named_struct('m', '{name}', 'v', cast({_top_bits(f'(cast({expr} as bigint))')} as bigint))" for name, (expr, _, _) in MEASURES.items())
    cells = judged.select(*by, F.expr(f"inline(array({pairs}))")).groupBy(*by, "m", "v").agg(F.count("*").alias("n"))
    cells = cells.withColumn("is_all", F.lit(False))
    total = cells.groupBy("m", "v").agg(F.sum("n").alias("n")).select(*(F.lit(None).cast(measured.schema[c].dataType).alias(c) for c in by), "m", "v", "n", F.lit(True).alias("is_all"))
    cells = cells.unionByName(total)
    rank = f"partition by {', '.join(by)}, is_all, m"
    cells = cells.select("*", F.expr(f"sum(n) over ({rank} order by v)").alias("upto"), F.expr(f"sum(n) over ({rank})").alias("of"))
    quartiles = cells.groupBy(*by, "is_all", "m").agg(F.expr("min(v) filter (where 4 * upto >= of)").alias("q1"), F.expr("min(v) filter (where 4 * upto >= 3 * of)").alias("q3"), F.max("of").alias("n"))
    whole = quartiles.where("is_all").selectExpr("m", "q1 as all_q1", "q3 as all_q3")  # a row for each measure
    drawn = [f"(n * {q} + if(is_all, 0, {PRIOR}) * all_{q}) div (n + if(is_all, 0, {PRIOR})) as {q}" for q in ("q1", "q3")]
    quartiles = quartiles.join(F.broadcast(whole), "m").selectExpr(*by, "is_all", "m", *drawn)
    columns = []
    for name, (_, floor, low) in MEASURES.items():
        columns.append(F.expr(f"max(q3 + {REACH} * (q3 - q1) + {floor}) filter (where m = '{name}')").alias(f"high_{name}"))
        if low:
            columns.append(F.expr(f"max(q1 - {REACH} * (q3 - q1) - {floor}) filter (where m = '{name}')").alias(f"low_{name}"))
    return quartiles.groupBy(*by, "is_all").agg(*columns)


def judge(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, by, measures, base_failed, kept)."""
    measured = measures(docs.select(key, *by, text), text).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    measured = written(measured)
    limits = written(fences(measured, by))
    whole = F.broadcast(limits.where("is_all").drop("is_all", *by))  # one row at most
    for c in whole.columns:
        whole = whole.withColumnRenamed(c, f"all_{c}")
    own = limits.where("not is_all").drop("is_all")
    for c in by:
        own = own.withColumnRenamed(c, f"_{c}")
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    on = salted["_salt"] == own["_salt"]
    for c in by:
        on = on & salted[c].eqNullSafe(own[f"_{c}"])
    joined = salted.join(own, on, "left").join(whole, how="left")
    fails = ["base_failed"]
    for name, (expr, _, low) in MEASURES.items():
        fails.append(f"coalesce(({expr}) > coalesce(high_{name}, all_high_{name}), false)")
        if low:
            fails.append(f"coalesce(({expr}) < coalesce(low_{name}, all_low_{name}), false)")
    return joined.select(key, *by, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"not ({' or '.join(fails)})").alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _high(name: str) -> str:
    floor, low = MEASURES[name][1:]
    return f"q3 + {REACH} * (q3 - q1) + {floor}"


#: The same in DuckDB.
ORACLE_OP8 = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS wc0, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
m AS (SELECT *, coalesce(wc0, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
v AS (SELECT *, {', '.join(f"CASE WHEN n_words = 0 OR n_lines = 0 THEN NULL ELSE {expr.replace(' div ', ' // ')} END AS v_{name}" for name, (expr, _, _) in MEASURES.items())} FROM m),
u AS ({' UNION ALL '.join(f"SELECT lang, source, '{name}' AS m, (v_{name} >> greatest(0, length(bin(v_{name})) - {PRECISION + 1})) << greatest(0, length(bin(v_{name})) - {PRECISION + 1}) AS v FROM v WHERE NOT base_failed" for name in MEASURES)}),
c AS (SELECT lang, source, FALSE AS a, m, v, count(*) AS n FROM u GROUP BY ALL UNION ALL SELECT NULL, NULL, TRUE, m, v, count(*) FROM u GROUP BY m, v),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, a, m ORDER BY v) AS upto, sum(n) OVER (PARTITION BY lang, source, a, m) AS total FROM c),
q AS (SELECT lang, source, a, m, min(v) FILTER (WHERE 4 * upto >= total) AS q1, min(v) FILTER (WHERE 4 * upto >= 3 * total) AS q3, max(total) AS n FROM r GROUP BY ALL),
q2 AS (SELECT q.lang, q.source, q.a, q.m, CASE WHEN q.a THEN q.q1 ELSE (q.n * q.q1 + {PRIOR} * g.q1) // (q.n + {PRIOR}) END AS q1, CASE WHEN q.a THEN q.q3 ELSE (q.n * q.q3 + {PRIOR} * g.q3) // (q.n + {PRIOR}) END AS q3 FROM q JOIN q g ON g.a AND g.m = q.m),
f AS (SELECT lang, source, a, {', '.join(f"max({_high(name)}) FILTER (WHERE m = '{name}') AS high_{name}" + (f", max(q1 - {REACH} * (q3 - q1) - {MEASURES[name][1]}) FILTER (WHERE m = '{name}') AS low_{name}" if MEASURES[name][2] else "") for name in MEASURES)} FROM q2 GROUP BY ALL)
SELECT v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed,
  NOT (v.base_failed OR {' OR '.join(f"coalesce(v_{name} > coalesce(o.high_{name}, w.high_{name}), FALSE)" + (f" OR coalesce(v_{name} < coalesce(o.low_{name}, w.low_{name}), FALSE)" if MEASURES[name][2] else "") for name in MEASURES)}) AS kept
FROM v LEFT JOIN f o ON NOT o.a AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source LEFT JOIN f w ON w.a
"""
