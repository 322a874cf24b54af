"""Stupid-backoff language-model scores of every document under the n-gram counts of all other documents.

The n-grams of a run of documents (a block) are exploded and counted within the block; the counts go
to parts of the n-gram count tables by hash, where the counts of all blocks are added up; the totals are
joined back to the exploded n-grams of each block; scores are summed per document. A word after its
history scores count(n-gram) / count(history) if the n-gram was seen, else 0.4 times its score after the
shorter history, down to count(word) / words, and 0.4 / words for a word that was not seen (Brants et al. 2007).
Histories have up to `order` - 1 words.

The documents scored are those counted, so each n-gram would be seen once at least and nothing would back off.
Hence counts leave out the document's own (`others`): a document is scored by what all others have.

A block sends each n-gram once, so an n-gram that holds a third of all places is in one row for each
block; the number of parts follows the number of blocks, and n-grams go packed, one row for a block and part, as
differences of sorted hashes. N-grams are told apart by hashes of 64 bits, or of fewer where so few n-grams there are that two of
them would hardly share the upper bits: twice the logarithm of the number of characters.

Cases: words are runs of characters other than space, tab, line feed, vertical tab, form feed and
carriage return; a null text or one without words has no words and a score of 0 and a null mean; a null id is an id like others;
repeated rows are documents each, all counted, and see each other; texts of any length are scored whole; extra columns are left out; an
empty table gives no rows; a document alone in its table backs off in every place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .words import mixed, word_hashes

ORDER, BACKOFF = 3, 0.4
#: Characters of a block.
BLOCK_SIZE = 6_000_000
#: Compression of a block's texts, which are stored once and read twice.
TEXT_LEVEL = 9


def _packed(array: np.ndarray) -> bytes:
    """Compressed by planes: all first bytes, all second bytes and so on."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(array.view(np.uint8).reshape(-1, array.itemsize).T.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _binary(*parts: bytes) -> list[pa.Array]:
    return [pa.array([x], pa.binary()) for x in parts]


_BLOCK = "block long, keys array<long>, lengths binary, texts binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of documents in runs of at most BLOCK_SIZE characters, over the ends of batches; a longer text is a run of its own."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if keys and held + len(text) > BLOCK_SIZE:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text)
    if keys:
        yield keys, texts


def exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks: the keys of their documents, and packed: the length of each text, and the texts. Their words are hashed where they are needed, as hashes don't compress."""

    def run(batches):
        import zstandard

        part = TaskContext.get().partitionId()
        for k, (keys, texts) in enumerate(_runs(batches)):
            whole = zstandard.ZstdCompressor(level=TEXT_LEVEL).compress("".join(texts).encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([keys], pa.list_(pa.int64())), *_binary(_packed(np.array([len(x) for x in texts])), whole)], ["block", "keys", "lengths", "texts"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, _BLOCK)


def _words(lengths: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and the number of words of each document."""
    import zstandard

    whole, ends = zstandard.ZstdDecompressor().decompress(texts).decode("utf-8", "surrogatepass"), np.cumsum(_unpacked(lengths, np.int64)).tolist()
    return word_hashes([whole[a:b] for a, b in zip([0, *ends], ends, strict=False)], "blanks")


class Block:
    """N-grams of a block: their hashes at each place (order n where n - 1 words of the document stand before)."""

    def __init__(self, lengths: bytes, texts: bytes, order: int, hashed: int):
        self.hashed = hashed
        word, self.sizes = _words(lengths, texts)
        self.ends = np.cumsum(self.sizes)
        self.document = np.repeat(np.arange(len(self.sizes), dtype=np.uint64), self.sizes)
        self.place = np.arange(len(word)) - np.repeat(self.ends - self.sizes, self.sizes)
        self.hashes = [word]
        for _ in range(order - 1):
            longer = np.zeros(len(word), dtype=np.uint64)
            longer[1:] = mixed(self.hashes[-1][:-1] * np.uint64(3) + word[1:])
            self.hashes.append(longer)

    def whole(self, n: int) -> np.ndarray:
        """Places that have an n-gram."""
        return np.flatnonzero(self.place >= n - 1)

    def grams(self, n: int) -> np.ndarray:
        """The n-gram at each of these places."""
        return self.hashes[n - 1][self.whole(n)] >> np.uint64(64 - self.hashed)

    def own(self, n: int) -> np.ndarray:
        """How often the document itself has the n-gram of each of these places."""
        at = self.whole(n)
        _, back, counts = np.unique(mixed(self.hashes[n - 1][at] + self.document[at] * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
        return counts[back]


def _requests(bits: int, order: int, hashed: int):
    """A row for a block and part: for each n the block's n-grams there, as differences in order, and their counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["lengths"], row["texts"], order, hashed)
                parts = np.arange(1 << bits, dtype=np.uint64)
                tables = []
                for n in range(1, order + 1):
                    found, counts = np.unique(b.grams(n), return_counts=True)
                    cuts = np.append(np.searchsorted(found, parts << np.uint64(hashed - bits)), len(found))
                    tables.append((found, counts.astype(np.uint32), cuts))
                rows = []
                for p in range(1 << bits):
                    cells = []
                    for found, counts, cuts in tables:
                        own = found[cuts[p] : cuts[p + 1]] - (np.uint64(p) << np.uint64(hashed - bits))
                        cells += [_packed(np.diff(own, prepend=np.uint64(0))), _packed(counts[cuts[p] : cuts[p + 1]])]
                    if any(cuts[p] < cuts[p + 1] for _, _, cuts in tables):
                        rows.append((p, cells))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([row["block"]] * len(rows), pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.binary()))], ["part", "block", "cells"])

    return run


def _joined(order: int):
    """A part of the count tables, built from the counts of all blocks and joined to their n-grams."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names, cells = [], [], []
        for batch in batches:
            parts += batch.column("part").to_pylist()
            names += batch.column("block").to_pylist()
            cells += batch.column("cells").to_pylist()
        replies = [[] for _ in names]
        for n in range(order):
            grams = [np.cumsum(_unpacked(c[2 * n], np.uint64)) for c in cells]
            found, at = np.unique(np.concatenate(grams), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([_unpacked(c[2 * n + 1], np.uint32) for c in cells]), minlength=len(found)).astype(np.uint32)[at]
            for reply, x in zip(replies, np.split(total, np.cumsum([len(g) for g in grams])[:-1]), strict=True):
                reply.append(_packed(x))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(names, pa.int64()), pa.array(replies, pa.list_(pa.binary()))], ["part", "block", "totals"])

    return run


_SCORES = "key long, n_words long, logs double, bases long"


def _scored(order: int, hashed: int, others: bool):
    """Of each document the sum of logarithms without those of the number of words, and in how many places that one is to be taken off."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "logs": pa.array([], pa.float64()), "bases": pa.array([], pa.int64())})
        row = left.to_pylist()[0]
        b = Block(row["lengths"], row["texts"], order, hashed)
        replies = sorted(zip(right["part"].to_pylist(), right["totals"].to_pylist(), strict=True))
        score, history, base = np.full(len(b.place), math.log(BACKOFF)), None, np.ones(len(b.place), dtype=np.int64)
        for n in range(1, order + 1):
            at = b.whole(n)
            counts = np.zeros(len(score), dtype=np.int64)
            if len(at):
                _, back = np.unique(b.grams(n), return_inverse=True)
                total = np.concatenate([_unpacked(t[n - 1], np.uint32) for _, t in replies]).astype(np.int64)
                counts[at] = total[back] - (b.own(n) if others else 0)
            seen = np.flatnonzero(counts)
            if n == 1:
                score[seen] = np.log(counts[seen])
            else:
                score[at] += math.log(BACKOFF)
                score[seen] = np.log(counts[seen]) - np.log(history[seen])
                base[seen] = 0
            history = np.concatenate([[1], counts[:-1]])
        logs, bases = np.zeros(len(b.sizes)), np.zeros(len(b.sizes), dtype=np.int64)
        some = b.sizes > 0
        if some.any():
            logs[some], bases[some] = (np.add.reduceat(x, (b.ends - b.sizes)[some]) for x in (score, base))
        return pa.table({"key": pa.array(row["keys"], pa.int64()), "n_words": pa.array(b.sizes), "logs": pa.array(logs), "bases": pa.array(bases)})

    return run


def backoff_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, others: bool = True) -> DataFrame:
    """(key, n_words, score): score is the sum of natural logarithms over the document's words, under n-grams of up to `order` words.

    With `others` a document's own n-grams are left out of the counts it is scored by.
    """
    chars = max(2, docs.select(F.sum(F.length(F.col(text).cast("string")))).first()[0] or 0)
    bits, hashed = max(4, math.ceil(math.log2(chars / BLOCK_SIZE))), min(64, 2 * math.ceil(math.log2(chars)) - 2)
    hashed = max(hashed, bits + 16)
    cut = exploded(docs, key, text).repartition("block")  # both uses below read the same exchange
    replies = cut.mapInArrow(_requests(bits, order, hashed), "part int, block long, cells array<binary>").groupBy("part").applyInArrow(_joined(order), "part int, block long, totals array<binary>")
    out = written(cut.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scored(order, hashed, others), _SCORES))
    words = out.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    rest = F.greatest(F.lit(words) - (F.col("n_words") if others else 0), F.lit(1))
    return out.select(F.col("key").alias(key), "n_words", (F.col("logs") - F.col("bases") * F.log(rest)).alias("score"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round(F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")), 6).alias("mean_score"))


#: The same in DuckDB.
ORACLE_OP1 = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a, greatest(n.n - len(w), 1) AS others FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w) CROSS JOIN (SELECT sum(len(w)) AS n FROM w) n),
k AS (SELECT r, i, a, b, others, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY r, c) AS one, count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY r, b, c) AS two, count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY r, a, b, c) AS three FROM p),
h AS (SELECT *, lag(one) OVER (PARTITION BY r ORDER BY i) AS one_before, lag(two) OVER (PARTITION BY r ORDER BY i) AS two_before FROM k),
s1 AS (SELECT *, CASE WHEN one > 0 THEN ln(one) - ln(others) ELSE ln({BACKOFF}) - ln(others) END AS x FROM h),
s2 AS (SELECT *, CASE WHEN b IS NULL THEN x WHEN two > 0 THEN ln(two) - ln(one_before) ELSE x + ln({BACKOFF}) END AS y FROM s1),
d AS (SELECT r, count(*) AS n, sum(CASE WHEN a IS NULL THEN y WHEN three > 0 THEN ln(three) - ln(two_before) ELSE y + ln({BACKOFF}) END) AS x FROM s2 GROUP BY r)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, round(coalesce(d.x, 0), 4) AS score, round(d.x / d.n, 6) AS mean_score FROM w LEFT JOIN d ON d.r = w.r
"""
