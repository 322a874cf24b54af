"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Features are hashed terms of the whole text (words, shapes of words, pairs of shapes, repetition),
weighted by inverse document frequency and projected to a few latent dimensions by a truncated
singular value decomposition of a bounded labelled sample. The sample's vectors are broadcast; each
document takes its exact cosine with all of them, block by block, and the nearest ones vote with
their labels, weighted by similarity.

Fitted on at most SAMPLE rows of each label. Cases: a null or empty text (or one of white space only) has no evidence and scores
0; without labelled rows of both labels every other text scores 0.5; texts of any length are read
whole; repeated rows score alike; neighbours as near as the last one vote too; further columns pass through. Of
labelled rows that share an id, the least text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Remembered, small_batches, table
from .labelled import fold, sample

#: Labelled rows of each label that the classifier is fitted on, at most.
SAMPLE = 2000
SHAPES, PAIRS, WORDS, EXTRA = 512, 512, 1024, 4
WIDTH, LATENT, NEIGHBOURS, BLOCK, SHARP = SHAPES + PAIRS + WORDS + EXTRA, 64, 15, 256, 4


def _mixed(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def shape(word: str) -> str:
    """Runs of upper case, lower case and digits as one letter each; other characters once a run."""
    out = []
    for c in word:
        kind = "U" if c.isupper() else "L" if c.isalpha() else "D" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def _coded(word: str) -> int:
    """Hash of the word above the bucket of its shape."""
    return (_mixed(word.lower().encode("utf-8", "replace")) >> 10) * SHAPES + _mixed(shape(word).encode("utf-8", "replace")) % SHAPES


_codes = Remembered(_coded)


def features(text: str | None) -> np.ndarray:
    """Square roots of the terms' shares of the whole text."""
    out = np.zeros(WIDTH, dtype=np.float32)
    words = (text or "").split()
    if not words:
        return out
    codes = np.fromiter(map(_codes.__getitem__, words), dtype=np.int64, count=len(words))
    shapes, hashes = codes % SHAPES, codes // SHAPES
    out[:SHAPES] = np.bincount(shapes, minlength=SHAPES)
    out[SHAPES : SHAPES + PAIRS] = np.bincount((shapes[:-1] * 31 + shapes[1:]) % PAIRS, minlength=PAIRS)
    out[SHAPES + PAIRS : SHAPES + PAIRS + WORDS] = np.bincount(hashes % WORDS, minlength=WORDS)
    lines = [x for x in text.split("\n") if x.strip()]
    out[-EXTRA:] = np.count_nonzero(hashes[1:] == hashes[:-1]), len(words) - len(np.unique(hashes)), len(lines) - len(set(lines)), len(words)
    return np.sqrt(out / len(words))


class Neighbours:
    """The fitted model: weights, projection, and the labelled vectors with their labels."""

    def __init__(self, weights: np.ndarray, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.weights, self.projection, self.vectors, self.labels = weights, projection, vectors, labels

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray) -> "Neighbours":
        seen = np.count_nonzero(rows, axis=0)
        weights = np.log((1 + len(rows)) / (1 + seen)) + 1
        weights[SHAPES + PAIRS : SHAPES + PAIRS + WORDS] *= 0.5  # a word's bucket says less than its shape
        weighed = _unit(rows * weights)
        rng = np.random.default_rng(7)
        k = min(LATENT, *weighed.shape)
        basis = np.linalg.qr(weighed @ rng.standard_normal((weighed.shape[1], min(k + 16, *weighed.shape))))[0]
        for _ in range(3):
            basis = np.linalg.qr(weighed @ (weighed.T @ basis))[0]
        right = np.linalg.svd(basis.T @ weighed, full_matrices=False)[2][:k].T
        projection = right.astype(np.float32)
        return cls(weights.astype(np.float32), projection, _unit(weighed @ projection).astype(np.float32), labels.astype(np.float32))

    def score(self, rows: np.ndarray) -> np.ndarray:
        latent = _unit(_unit(rows * self.weights) @ self.projection).astype(np.float32)
        cosines = latent @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        last = np.partition(cosines, -k, axis=1)[:, -k]
        votes = np.where(cosines >= last[:, None], np.maximum(cosines, 1e-6) ** SHARP, 0)
        return votes @ self.labels / votes.sum(1)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def fit_quality(labelled: DataFrame, label: str = "quality", text: str = "text") -> Neighbours | None:
    """None unless both labels are among the rows, which are bounded by the sample."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                rows = features(batch.column(0)[k].as_py()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), batch.column(1).slice(k, 1), batch.column(2).slice(k, 1)], ["f", "label", "id"])

    rows = labelled.select(text, F.col(label).cast("int"), F.col("doc_id").cast("long")).mapInArrow(run, "f binary, label int, id long").toPandas()
    if rows["label"].nunique() < 2:
        return None
    rows = rows.sort_values("id")
    return Neighbours.fit(np.stack([np.frombuffer(x, np.float16) for x in rows["f"]]).astype(np.float32), rows["label"].to_numpy())


def quality_score(model: Neighbours | None, spark: SparkSession, text: str | Column = "text") -> Column:
    """Column of scores from 0 to 1."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            out = np.zeros(len(texts))
            values = texts.to_numpy()
            for start in range(0, len(values), BLOCK):
                rows = np.stack([features(x) for x in values[start : start + BLOCK]])
                full = rows.any(axis=1)
                out[start : start + BLOCK] = np.where(full, 0.5 if model is None else model.score(rows), 0.0)
            yield pd.Series(out)

    return score(text)


def classify_quality(docs: DataFrame, labels: DataFrame, bar: float = 0.7) -> DataFrame:
    """docs with held_out, score and predicted."""
    model = fit_quality(sample(docs, labels, "quality", 4, 2, {0: SAMPLE, 1: SAMPLE}))
    out = docs.withColumns({"held_out": fold("doc_id", 4) == 2, "score": quality_score(model, docs.sparkSession)})
    return out.withColumn("predicted", (F.col("score") >= bar).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
