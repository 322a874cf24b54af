"""Operators as relational plans.

An operator is a function of a dialect that gives a query over named inputs, written @name. Spark runs
it on DataFrames (apply), where it is an ordinary lazy plan; the same text in DuckDB's dialect is what
results are held against.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: White space that a strip takes off.
SPACE = "".join(map(chr, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def counted(text: str) -> str:
    """count_if(x) as a count of bigint type in both dialects."""
    while (at := text.find("count_if(")) >= 0:
        depth, k = 1, at + len("count_if(")
        start = k
        while depth:
            depth += {"(": 1, ")": -1}.get(text[k], 0) if not _quoted(text, start, k) else 0
            k += 1
        text = f"{text[:at]}count(case when {text[start:k - 1]} then 1 end){text[k:]}"
    return text


def _quoted(text: str, start: int, k: int) -> bool:
    return text.count("'", start, k) % 2 == 1


class Dialect:
    @staticmethod
    def ch(code: int) -> str:
        """The character as a literal."""
        return f"'{chr(code)}'"


class Spark(Dialect):
    def strip(self, x: str) -> str:
        return f"btrim({x}, '{SPACE}')"

    def match(self, x: str, pattern: str) -> str:
        return f"({x} rlike r'{pattern}')"

    def rep(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', r'{to}')"

    def ext(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def all(self, x: str, pattern: str, group: int = 1) -> str:
        """All matches, as JSON."""
        return f"to_json(regexp_extract_all({x}, r'{pattern}', {group}))"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, r'{pattern}') as bigint)"

    def joined(self, x: str, by: str, order: str) -> str:
        return f"listagg({x}, {by}) within group (order by {order})"

    def listed(self, x: str, order: str) -> str:
        """The values of a group as a list in order."""
        return f"transform(array_sort(collect_list(named_struct('k', {order}, 'x', {x}))), z -> z.x)"

    def none(self) -> str:
        """An empty list of strings."""
        return "cast(array() as array<string>)"

    def last(self, x: str, over: str) -> str:
        return f"last_value({x}) ignore nulls over ({over})"

    def first(self, x: str, over: str) -> str:
        return f"first_value({x}) ignore nulls over ({over})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def lines(self, source: str, key: str, text: str) -> str:
        return f"select {key}, cast(i + 1 as bigint) as line_no, line as text from {source} lateral view posexplode(split({text}, r'\\n')) as i, line"

    def each(self, source: str, columns: str, items: str, at: str, item: str) -> str:
        return f"select {columns}, cast({at} + 1 as bigint) as {at}, {item} from {source} lateral view posexplode({items}) as {at}, {item}"

    def words(self, x: str, by: str = " ") -> str:
        """Parts between the single character `by`, which means nothing in patterns."""
        return f"split({x}, '{by}')"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def nfc(self, x: str) -> str:
        raise NotImplementedError("see functions.text.nfc")

    def size(self, x: str) -> str:
        return f"cast(size({x}) as bigint)"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def part(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, {start}, {n})"

    def keep(self, a: str, x: str, test: str) -> str:
        return f"filter({a}, {x} -> {test})"

    def upto(self, n: str) -> str:
        return f"sequence(1, {n})"

    def hexed(self, x: str) -> str:
        """Bytes of a base64 text, in hexadecimal."""
        return f"hex(unbase64({x}))"

    def answers(self, source: str, key: str, json: str) -> str:
        """(key, id, c, cf, s) of the list in a JSON text; none where it can't be read."""
        return f"select {key}, a.id, a.c, a.cf, a.s from {source} lateral view explode(from_json({json}, 'answers array<struct<id: bigint, c: bigint, cf: double, s: boolean>>').answers) as a"

    def json(self, fields: dict[str, str]) -> str:
        return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + "))"


class Duck(Dialect):
    def strip(self, x: str) -> str:
        return f"trim({x}, '{SPACE}')"

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def rep(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '" + re.sub(r"\$(\d)", r"\\\1", to) + "', 'g')"

    def ext(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"cast(to_json(regexp_extract_all({x}, '{pattern}', {group})) as varchar)"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(len(regexp_extract_all({x}, '{pattern}')) as bigint)"

    def joined(self, x: str, by: str, order: str) -> str:
        return f"string_agg({x}, {by} order by {order})"

    def listed(self, x: str, order: str) -> str:
        return f"list({x} order by {order})"

    def none(self) -> str:
        return "cast([] as varchar[])"

    def last(self, x: str, over: str) -> str:
        return f"last_value({x} ignore nulls) over ({over})"

    def first(self, x: str, over: str) -> str:
        return f"first_value({x} ignore nulls) over ({over})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def lines(self, source: str, key: str, text: str) -> str:
        return f"select {key}, cast(unnest(range(1, len(l) + 1)) as bigint) as line_no, unnest(l) as text from (select {key}, string_split({text}, chr(10)) as l from {source})"

    def each(self, source: str, columns: str, items: str, at: str, item: str) -> str:
        return f"select {columns}, cast(unnest(range(1, len(_items) + 1)) as bigint) as {at}, unnest(_items) as {item} from (select {columns}, {items} as _items from {source})"

    def words(self, x: str, by: str = " ") -> str:
        return f"string_split({x}, '{by}')"

    def array(self, *xs: str) -> str:
        return f"[{', '.join(xs)}]"

    def size(self, x: str) -> str:
        return f"cast(len({x}) as bigint)"

    def common(self, a: str, b: str) -> str:
        return f"list_distinct(list_intersect({a}, {b}))"

    def part(self, a: str, start: str, n: str) -> str:
        return f"list_slice({a}, {start}, ({start}) + ({n}) - 1)"

    def keep(self, a: str, x: str, test: str) -> str:
        return f"list_filter({a}, lambda {x}: {test})"

    def upto(self, n: str) -> str:
        return f"range(1, ({n}) + 1)"

    def hexed(self, x: str) -> str:
        return f"hex(from_base64({x}))"

    def answers(self, source: str, key: str, json: str) -> str:
        parsed = f"""from_json(case when json_valid({json}) then {json} else '{{"answers": []}}' end, '{{"answers": [{{"id": "BIGINT", "c": "BIGINT", "cf": "DOUBLE", "s": "BOOLEAN"}}]}}')"""
        return f"select {key}, a.id, a.c, a.cf, a.s from (select {key}, unnest({parsed}.answers) as a from {source}) y"

    def json(self, fields: dict[str, str]) -> str:
        return "cast(to_json(struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")) as varchar)"


SPARK, DUCK = Spark(), Duck()


def apply(op: Callable[[Dialect], str], spark: SparkSession, **frames: DataFrame) -> DataFrame:
    """The operator over DataFrames."""
    text, views = counted(op(SPARK)), []
    for name, frame in frames.items():
        view = f"_{name}_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(view)
        views.append(view)
        text = re.sub(rf"@{name}\b", view, text)
    out = spark.sql(text)
    for view in views:
        spark.catalog.dropTempView(view)
    return out


def stored(df: DataFrame) -> DataFrame:
    """df, computed once into the folder that the cluster shares, for plans that read it several times."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/sieveloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Plan:
    """An operator with its inputs: tables by name, or other plans. One that is `kept` is stored before others read it."""

    def __init__(self, op: Callable[[Dialect], str], kept: bool = False, **inputs: "str | Plan"):
        self.op, self.kept, self.inputs = op, kept, inputs

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = apply(self.op, spark, **{k: spark.read.parquet(f"{sf_dir}/{v}.parquet") if isinstance(v, str) else v.spark(spark, sf_dir) for k, v in self.inputs.items()})
        return stored(out) if self.kept else out

    def duck(self) -> str:
        text = counted(self.op(DUCK))
        for name, source in self.inputs.items():
            inner = source if isinstance(source, str) else f"({source.duck()})"
            text = re.sub(rf"@{name}\b", lambda _: inner, text)  # noqa: B023
        return text
