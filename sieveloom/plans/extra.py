"""Queries that need more than relational plans: functions, containers and throttles; with SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined_lines, nfc
from ..sources.files import decoded, read_docx, route, write_docx
from ..sources.layouts import quiz_questions, read_docx_lines, read_xlsx_lines
from ..sources.olddoc import doc_bytes, read_doc_lines
from ..sources.pagelines import pdf_bytes, read_pdf_glyphs, read_pdf_images, read_pdf_lines
from ..sources.writers import EXAMPLES, documents, examples, workbooks
from ..streaming.jobs import throttled_batch
from . import views as v
from .dialect import apply


def c01_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", nfc(F.regexp_replace("text", "e", "é")).alias("text"))


def c09_line_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = v.DASH.spark(spark, sf_dir)
    texts = lines.groupBy("doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(line_no, text))), x -> x.text), '\\n')").alias("text"))
    return texts.select("doc_id", joined_lines("text").alias("text"))


def k03_docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as documents and read back, right options by their bold runs."""
    lines = v.CLASSIC.spark(spark, sf_dir)
    runs = read_docx(write_docx(lines))
    return runs.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), (F.col("para") + 1).cast("long").alias("line_no"), "text", "bold")


def s01_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ext = F.element_at(F.array(*map(F.lit, (".docx", ".doc", ".xlsx", ".txt", ".pdf", ""))), (F.col("page_id") % 6 + 1).cast("int"))
    return pages.select("page_id", route(ext).alias("reader"))


def r08_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttled_batch(spark.read.parquet(f"{sf_dir}/events.parquet"), 20.0)


def w21_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey")
    return apply(lambda d: "select c_custkey from @c where c_custkey % 3 = 0 union select c_custkey from @c where c_custkey % 5 = 0 except select c_custkey from @c where c_custkey % 7 = 0", spark, c=c)


def _example_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ten questions with four options, the first right, in each layout by turns."""
    layouts = F.element_at(F.array(*map(F.lit, EXAMPLES)), (F.col("doc_id") % len(EXAMPLES) + 1).cast("int"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey div 10 as doc_id", "p_partkey as q_no", "concat('Which part ', p_partkey, ' is it') as q", "transform(sequence(1, 4), k -> concat(p_name, ' ', k)) as o")
    grouped = parts.groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(q_no, q, o))), x -> named_struct('q', x.q, 'o', x.o))").alias("questions"))
    return grouped.where("size(questions) = 10").withColumn("layout", layouts)


def s06_docx_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every layout, written and read back as marked lines."""
    lines = read_docx_lines(examples(_example_questions(spark, sf_dir)))
    return lines.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "layout", "line_no", "text")


def s32_xlsx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks written and read back as marked lines: with a title, a header, and a first column that only counts in every other one."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey div 10 as doc_id", "p_partkey as q_no", "concat('Which part ', p_partkey, ' is it') as q", "p_name")
    counted = F.col("doc_id") % 2 == 0
    cells = F.when(counted, F.expr("array(cast(q_no as string), q, concat(p_name, ' 1'), concat(p_name, ' 2'), if(q_no % 4 = 0, null, ''), concat(p_name, ' 3'))")).otherwise(F.expr("array(q, concat(p_name, ' 1'), concat(p_name, ' 2'))"))
    heads = parts.select("doc_id").distinct().selectExpr("doc_id", "inline(array(named_struct('row_no', -2L, 'cells', array('Title')), named_struct('row_no', -1L, 'cells', if(doc_id % 2 = 0, array('T/r', 'Savol matni', 'To''g''ri javob', 'x'), array('Savol matni', 'To''g''ri javob', 'x')))))")
    rows = parts.select("doc_id", F.col("q_no").cast("long").alias("row_no"), cells.alias("cells")).unionByName(heads)
    lines = read_xlsx_lines(workbooks(rows))
    return lines.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "line_no", "text")


def k11_classic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written with their images as documents, and read back by the strict reader."""
    from pyspark.sql.functions import pandas_udf

    questions = _example_questions(spark, sf_dir).select("doc_id", F.posexplode("questions").alias("q_no", "x")).select("doc_id", "q_no", "x.q", "x.o", (F.col("q_no") % 5 - 1).cast("int").alias("c"), F.when(F.col("q_no") % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A"))).alias("image"))
    files = documents(questions)

    @pandas_udf("array<struct<question: string, options: array<string>, right: array<boolean>, image: binary>>")
    def read(content):
        return content.map(lambda data: [{k: x[k] for k in ("question", "options", "right", "image")} for x in quiz_questions(bytes(data))])

    rows = files.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.posexplode(read("content")).alias("q_no", "x"))
    return rows.select("doc_id", F.col("q_no").cast("long").alias("q_no"), F.col("x.question").alias("q"), F.array_join("x.options", "|").alias("o"), (F.array_position("x.right", True) - 1).cast("long").alias("c"), F.coalesce(F.length("x.image"), F.lit(0)).cast("long").alias("image_bytes"))


def k09_resolved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved questions as they are shown, read back by their runs."""
    questions = _example_questions(spark, sf_dir).select("doc_id", F.posexplode("questions").alias("q_no", "x")).select("doc_id", "q_no", "x.q", "x.o", (F.col("q_no") % 5 - 1).cast("int").alias("c"))
    runs = read_docx(documents(questions, resolved=True)).where("text <> '' and para > 1")
    return runs.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("para").cast("long").alias("para"), "text", "bold", "color")


def _example_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of page files: five questions a page, the right option in bold, highlighted by a note or by a fill, and images."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def packed(numbers, questions):
        def build(number: int, qs) -> bytes:
            pages, lettered = [], number % 3 == 0
            for start in range(0, len(qs), 5):
                items, y = [], 40
                for k, x in enumerate(qs[start : start + 5], start + 1):
                    items.append(("text", 50, y, 11, f"{k}. {x['q']}" if lettered else f"? {x['q']}"))
                    if k % 5 == 2:
                        items.append(("image", 50, y + 2, 90, y + 40))
                    for n, o in enumerate(x["o"]):
                        y += 14
                        items.append(("text", 50, y, 11, f"{'ABCD'[n]}) {o}" if lettered else f"= {o}", lettered and n == 0))
                        if n == 0 and not lettered:
                            items.append(("note", 45, y - 9, 400, y + 3) if number % 3 == 1 else ("fill", 45, y - 9, 400, y + 3, 1, 1, 0.2))
                    y += 20
                pages.append(items)
            return pdf_bytes(pages, packed=number % 2 == 0)

        return numbers.combine(questions, build)

    return _example_questions(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), packed("doc_id", "questions").alias("content"))


def s03_pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files written and read back as marked lines."""
    lines = read_pdf_lines(_example_pages(spark, sf_dir))
    return lines.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), "line_no", "text")


def p08_pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of page files, by the names that tokens have."""
    return read_pdf_images(_example_pages(spark, sf_dir)).select("image", (F.hex(F.substring("content", 1, 4)) == "89504E47").alias("png"))


def p12_pdf_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs of each page: how many, and the text of those of the first line."""
    g = read_pdf_glyphs(_example_pages(spark, sf_dir)).where("ch <> ' '")
    return g.groupBy(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("page").cast("long").alias("page")).agg(F.count("*").alias("glyphs"), F.expr("listagg(if(round(y0 + 0.8 * size, 3) = 40, ch, ''), '') within group (order by seq)").alias("first_line"))


def s27_doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old binary documents of both widths, written and read back."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def packed(numbers, texts):
        return numbers.combine(texts, lambda n, x: doc_bytes(x, wide=n % 2 == 0))

    texts = _example_questions(spark, sf_dir).select("doc_id", F.expr("array_join(transform(questions, x -> concat('? ', x.q, '\n', array_join(transform(x.o, (o, i) -> concat(if(i = 0, '+ ', '= '), o)), '\n'))), '\n')").alias("text"))
    files = texts.select(F.concat(F.col("doc_id").cast("string"), F.lit(".doc")).alias("path"), packed("doc_id", "text").alias("content"))
    return read_doc_lines(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "line_no", "text")


def s02_text_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in several encodings, and the first of the ladder that reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "concat('Савол ', doc_id, ' ёлка') as text")
    data = F.when(F.col("doc_id") % 3 == 0, F.expr("unhex('D1E0E2EEEB20') || cast(cast(doc_id as string) as binary)")).when(F.col("doc_id") % 3 == 1, F.expr("unhex('EFBBBF') || cast(text as binary)")).otherwise(F.col("text").cast("binary"))
    return docs.select("doc_id", decoded(data).alias("d")).select("doc_id", "d.*")


EXTRA = {f.__name__: f for f in (c01_nfc, c09_line_joins, k03_docx_round_trip, s01_route, r08_throttle, w21_set_changes, s06_docx_layouts, s32_xlsx_lines, k11_classic_documents, k09_resolved_documents, s02_text_ladder, s03_pdf_lines, p08_pdf_images, p12_pdf_glyphs, s27_doc_lines)}
_EXAMPLE_SQL = f"""d as (select *, p_partkey // 10 as doc_id, concat('Which part ', p_partkey, ' is it') as q from part where p_partkey // 10 in (select p_partkey // 10 from part group by 1 having count(*) = 10)),
l as (select *, {list(EXAMPLES)}[doc_id % {len(EXAMPLES)} + 1] as layout, row_number() over (partition by doc_id order by p_partkey) - 1 as nth from d)"""
ORACLE = {
    "s06_docx_layouts": f"""with {_EXAMPLE_SQL},
        t as (select doc_id, layout, p_partkey, case layout when 'table_blocks' then concat(q, chr(10), '====', chr(10), '#', p_name, ' 1', chr(10), '====', chr(10), p_name, ' 2', chr(10), '====', chr(10), p_name, ' 3', chr(10), '====', chr(10), p_name, ' 4', chr(10), '++++')
            else concat('? ', q, chr(10), case layout when 'inline' then '= ' else '+ ' end, p_name, ' 1', chr(10), '= ', p_name, ' 2', chr(10), '= ', p_name, ' 3', chr(10), '= ', p_name, ' 4') end as x from l),
        u as (select doc_id, layout, p_partkey, unnest(string_split(x, chr(10))) as text, generate_subscripts(string_split(x, chr(10)), 1) as k from t)
        select doc_id, layout, row_number() over (partition by doc_id order by p_partkey, k) as line_no, text from u""",
    "s32_xlsx_lines": """with t as (select p_partkey // 10 as doc_id, p_partkey, concat('? Which part ', p_partkey, ' is it', chr(10), '+ ', p_name, ' 1', chr(10), '= ', p_name, ' 2', case when (p_partkey // 10) % 2 = 0 then concat(chr(10), '= ', p_name, ' 3') else '' end, chr(10)) as x from part),
        u as (select doc_id, p_partkey, unnest(string_split(x, chr(10))) as text, generate_subscripts(string_split(x, chr(10)), 1) as k from t)
        select doc_id, row_number() over (partition by doc_id order by p_partkey, k) as line_no, text from u""",
    "k11_classic_documents": f"with {_EXAMPLE_SQL} select doc_id, nth as q_no, q, concat_ws('|', p_name || ' 1', p_name || ' 2', p_name || ' 3', p_name || ' 4') as o, nth % 5 - 1 as c, cast(case when nth % 3 = 0 then 8 else 0 end as bigint) as image_bytes from l",
    "k09_resolved_documents": f"""with {_EXAMPLE_SQL}, o as (select *, unnest(range(5)) as k from l)
        select doc_id, 2 + nth * 6 + k as para, case when k = 0 then '? ' || q else (case when k - 1 = nth % 5 - 1 then '+ ' else '= ' end) || p_name || ' ' || k end as text, k = 0 as bold, case when k = 0 then null when k - 1 = nth % 5 - 1 then '16A34A' else '475569' end as color from o""",
    "s03_pdf_lines": f"""with {_EXAMPLE_SQL}, o as (select *, unnest(range(6)) as k from l),
        t as (select doc_id, nth, k, nth // 5 + 1 as page, doc_id % 3 = 0 as lettered, q, p_name from o where k <> 1 or nth % 5 = 1),
        u as (select *, case when k = 0 then case when lettered then (nth + 1) || '. ' || q else '? ' || q end when k = 1 then '[[img:images/' || doc_id || '_p' || page || '_i0.png]]'
            when lettered then case when k = 2 then '#' else '' end || chr(cast(63 + k as int)) || ') ' || p_name || ' ' || (k - 1) else case when k = 2 then '+ ' else '= ' end || p_name || ' ' || (k - 1) end as text from t)
        select doc_id, page, row_number() over (partition by doc_id order by nth, k) as line_no, text from u""",
    "p08_pdf_images": f"with {_EXAMPLE_SQL} select 'images/' || doc_id || '_p' || (nth // 5 + 1) || '_i0.png' as image, true as png from l where nth % 5 = 1",
    "p12_pdf_glyphs": f"""with {_EXAMPLE_SQL}, t as (select doc_id, nth, case when doc_id % 3 = 0 then (nth + 1) || '. ' || q else '? ' || q end as head, p_name, doc_id % 3 = 0 as lettered from l)
        select doc_id, nth // 5 + 1 as page, cast(sum(length(replace(head, ' ', '')) + 4 * (length(replace(p_name, ' ', '')) + 1 + case when lettered then 2 else 1 end)) as bigint) as glyphs, max(case when nth % 5 = 0 then replace(head, ' ', '') end) as first_line from t group by doc_id, nth // 5""",
    "s27_doc_lines": f"""with {_EXAMPLE_SQL}, o as (select *, unnest(range(5)) as k from l)
        select doc_id, row_number() over (partition by doc_id order by nth, k) as line_no, case when k = 0 then '? ' || q else case when k = 1 then '+ ' else '= ' end || p_name || ' ' || k end as text from o""",
    "s02_text_ladder": "select doc_id, case when doc_id % 3 = 0 then concat('Савол ', doc_id) else concat('Савол ', doc_id, ' ёлка') end as text, case when doc_id % 3 = 0 then 'cp1251' else 'utf-8-sig' end as encoding from documents",
    "c01_nfc": "select doc_id, nfc_normalize(replace(text, 'e', 'é')) as text from documents",
    "k03_docx_round_trip": f"select doc_id, line_no, text, starts_with(text, '+') as bold from ({v.CLASSIC.duck()})",
    "s01_route": "select page_id, ['docx', 'doc', 'xlsx', 'txt', 'pdf', 'pdf'][page_id % 6 + 1] as reader from pages",
    "w21_set_changes": "select c_custkey from customer where c_custkey % 3 = 0 union select c_custkey from customer where c_custkey % 5 = 0 except select c_custkey from customer where c_custkey % 7 = 0",
}
