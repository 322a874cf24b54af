"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to Python code at once; keeps a worker's memory bounded.
BLOCK_CHARS = 4_000_000
#: Rows in a batch for Python code.
BATCH_ROWS = 1000
#: Pretokens remembered by a worker before its cache starts afresh.
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of this machine only where Spark runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/sieveloom/{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python code BATCH_ROWS rows at a time, unless the session has a number of its own: Arrow's buffers of whole texts stand outside the heap."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder and read from there: survives lost executors and cuts lineage."""
    small_batches(df.sparkSession)
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Drop the folder of a written() frame that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BLOCK_CHARS) -> Iterator[list[list]]:
    """Columns of the rows as lists, in runs of about `limit` characters of the column at `text`; a longer text is a run of its own."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start, held = 0, 0
        for k, value in enumerate(columns[text]):
            size = len(value) if value else 0
            if k > start and held + size > limit:
                yield [c[start:k] for c in columns]
                start, held = k, 0
            held += size
        if start < batch.num_rows:
            yield [c[start:] for c in columns]


class Remembered(dict):
    """word -> fn(word). Two generations: when the young one holds `most` words it becomes the old one, whose words come back when asked for."""

    def __init__(self, fn: Callable[[str], object], most: int = CACHE_WORDS):
        self.fn, self.most, self.old = fn, most, {}

    def __missing__(self, word):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.fn(word)
        self[word] = value
        return value


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.selectExpr("count(*)", "coalesce(sum(xxhash64(a, b) % 1000000007), 0)").first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over edges (a, b).

    Large-star and small-star rounds (Kiveris et al. 2014) over DataFrames; the links stay
    distributed, each round is written to the shared folder, stars of any size are only
    aggregated to their minimum and joined (skewed joins are split by adaptive execution).
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = _digest(e)
    done = not sign[0]
    while not done:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        small = written(small)
        before, sign = sign, _digest(small)
        done = before == sign
        forget(large)
        forget(e)
        e = small
    roots = e.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
