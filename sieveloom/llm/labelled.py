"""A bounded sample of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: dict[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label): of each label value at most `most[value]` labelled rows outside the held-out fold, those of least hash.

    The bound is on rows, so the ids chosen are few enough to broadcast at any corpus size. Rows with
    a null id or label are left out, and of repeated ids the least text counts.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (fold(key, folds) != held)).groupBy(key).agg(F.max(label).cast("int").alias(label))
    parts = [rows.where(F.col(label) == value).orderBy(F.xxhash64(key), key).limit(n) for value, n in most.items()]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.union(p)
    return docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).join(F.broadcast(ids), key).groupBy(key).agg(F.min(text).alias(text), F.max(label).alias(label))
