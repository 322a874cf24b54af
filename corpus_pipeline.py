"""The training-data pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a
DataFrame, which is written and read again as the next one's docs. All but the last return the
columns of documents.

Cases, of all stages: null and empty texts score 0 for quality, so the first stage drops them; later stages alone
keep them (they aren't toxic, and are groups of their own) and pack them as the single end id; rows that share an id
are documents each, and near-duplicates among them go like any others; rows alike in id and text stay or go together;
a null id is an id like others; extra columns pass through all stages but the last, whatever they are called; an empty table
gives an empty result at each stage; without labelled rows of both kinds the classifier accepts nothing (0.5 is below its bar) and the grammar knows only its given words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveloom.llm.common import table, written
from sieveloom.llm.labelled import sample
from sieveloom.llm.minhash import deduplicate
from sieveloom.llm.packing import pack
from sieveloom.llm.quality import SAMPLE, fit_quality, quality_score
from sieveloom.llm.toxicity import fit_toxicity, toxicity_score

#: Documents of less quality, and of this toxicity or more, go.
LEAST_QUALITY, MOST_TOXIC = 0.7, 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = fit_quality(sample(docs, table(spark, sf_dir, "labels"), "quality", 4, 2, {0: SAMPLE, 1: SAMPLE}))
    return docs.where(quality_score(model, spark) >= LEAST_QUALITY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject."""
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(machine, spark) < MOST_TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("packing", pack_sequences)]

#: SQL can't express the classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
