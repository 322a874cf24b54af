"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (lower case, letters and digits) of the whole text; a shingle weighs its
count in the text times its inverse document frequency, 1 + ln(1 / share) / ln(1 / COMMON), where share is
the share of all documents that have the shingle, COMMON at least: so weights go from 1 (in every document) to 2
for one occurrence, and a shingle counts as rare at the same share of documents at any size. Shares are read off counters
by shingle hash over all documents, less what other shingles add to a counter on average, the least of DEPTH
counters. What others add is a share of the documents too, (shingles of a document) / COUNTERS, so the
counters need not grow with the corpus; their parts add up exactly.

Texts with equal words are one class. Classes are signed by improved consistent weighted sampling
(Ioffe 2010): of each of BANDS x ROWS samples the shingle of least ln a = ln c - r (t - beta) - r with
t = floor(ln w / r + beta) is kept, where r, c and beta are drawn by hash out of a table of DRAWS draws and
weights are rounded to powers of STEP when signing, so that ln a is looked up; above the LEVELS first powers it is
calculated. Classes that agree in a band meet; pairs are verified exactly by weighted Jaccard similarity.

No bucket is expanded into all its pairs. In each of ROUNDS rounds the class of each bucket that meets most
others is compared with the bucket's other classes, and links are contracted to components. What then
remains are buckets whose other classes are in several components. Their classes are joined by rare shingles:
with shingles in one order, rarest first, two texts of similarity s or more share a first shingle b, and all
they share is from b on, so total + total' <= (1 + s) / s * least(rest, rest') with rest the weight from
b on (a prefix filter, exact). Only pairs across components are looked for, so however dense a group is, its members
meet the few that are not linked yet. All those pairs are verified. More rounds leave less to that join; the result stays the same.

Cases: rows are told apart by id and text, so texts that share an id are documents each, and rows that agree in both
stay or go together; a null id is an id like others (class_id is the least that isn't null); null and empty texts are groups of their own; texts without
words are copies where they are equal; texts of fewer than five words have one shingle of all their words;
extra columns pass through deduplicate(), whatever they are called; an empty table gives no rows; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, components, forget, small_batches, table, written
from .words import mixed, runs_of, word_hashes

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 14, 4
DRAWS, LEVELS, STEP = 16384, 32, 1.2
#: Shares of the documents at which a shingle has the greatest weight; counters of shares.
COMMON, DEPTH, COUNTERS, CHUNK, PARTS = 1 / 128, 2, 1 << 18, 1 << 13, 64
ROUNDS = 2
#: Partners that one task compares with a class at a time.
DEALT = 64


def shingled(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each text its distinct shingles in order, how often it has each, and its words' hashes (end to end)."""
    hashes, counts = word_hashes(texts)
    runs, sizes = runs_of(hashes, counts, SHINGLE)
    found, times, end = [], [], 0
    for n in sizes.tolist():
        x, k = np.unique(runs[end : end + n], return_counts=True)
        found.append(x)
        times.append(k)
        end += n
    return found, times, np.split(hashes, np.cumsum(counts)[:-1])


def _slots(found: np.ndarray) -> list[np.ndarray]:
    """Places of the counters of each row of the sketch."""
    return [((found >> np.uint64(20 * d)) % np.uint64(COUNTERS)).astype(np.int64) for d in range(DEPTH)]


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Counters (DEPTH x COUNTERS) of the documents that have a shingle, and the number of documents, over all rows."""

    def count(batches):
        from pyspark import TaskContext

        held, docs = np.zeros((DEPTH, COUNTERS), dtype=np.int64), 0
        for (texts,) in (x for batch in batches for x in blocks([batch], 0)):
            docs += len(texts)
            found = np.concatenate(shingled(texts)[0])
            for d, at in enumerate(_slots(found)):
                held[d] += np.bincount(at, minlength=COUNTERS)
        part = TaskContext.get().partitionId() % PARTS
        flat = held.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array([part] * (len(flat) + 1), pa.int32()), pa.array([*range(len(flat)), -1], pa.int32()), pa.array([*(x.tobytes() for x in flat), np.array([docs], dtype=np.int64).tobytes()], pa.binary())], ["part", "chunk", "held"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = 0, None
        for batch in batches:
            for c, x in zip(batch.column(1), batch.column(2), strict=True):
                total, chunk = total + np.frombuffer(x.as_py(), np.int64), c.as_py()
        if chunk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "chunk", "held"])

    schema = "part int, chunk int, held binary"
    parts = docs.select(F.col(text).cast("string")).mapInArrow(count, schema).groupBy("part", "chunk").applyInArrow(add, schema)
    out, n = np.zeros((DEPTH * COUNTERS // CHUNK, CHUNK), dtype=np.int64), 0
    for r in parts.groupBy("chunk").applyInArrow(add, schema).toLocalIterator():
        x = np.frombuffer(r["held"], np.int64)
        if r["chunk"] < 0:
            n = int(x[0])
        else:
            out[r["chunk"]] = x
    return out.reshape(DEPTH, COUNTERS), n


class Signer:
    """Weights and signatures under given document frequencies."""

    def __init__(self, counters: np.ndarray, n: int):
        others = counters.sum(axis=1, keepdims=True) / COUNTERS
        share = np.clip((counters - others) / max(1, n), COMMON, 1)
        self.idf = (1 + np.log(1 / share) / np.log(1 / COMMON)).astype(np.float32)
        rng = np.random.default_rng(5)
        self.r, self.log_c, self.beta = rng.gamma(2, 1, DRAWS), np.log(rng.gamma(2, 1, DRAWS)), rng.random(DRAWS)
        self.log_a, self.step = (x.ravel() for x in self._sampled(np.arange(LEVELS)[:, None], np.arange(DRAWS)))
        self.factors = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)

    def _sampled(self, level: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and the step t of weights STEP ** level under the draws."""
        r, beta = self.r[draw], self.beta[draw]
        t = np.floor(level * np.log(STEP) / r + beta)
        return (self.log_c[draw] - r * (t - beta) - r).astype(np.float32), (t.astype(np.int64) & 0xFFFF).astype(np.uint64)

    def weights(self, found: np.ndarray, times: np.ndarray) -> np.ndarray:
        """TF-IDF of a text's shingles."""
        return times.astype(np.float32) * np.max([self.idf[d][at] for d, at in enumerate(_slots(found))], axis=0)

    def weighted(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text its distinct shingles in order, and their weights."""
        found, times, _ = shingled(texts)
        return [(f, self.weights(f, k)) for f, k in zip(found, times, strict=True)]

    def bands(self, found: np.ndarray, weights: np.ndarray) -> list[int]:
        level = np.maximum(np.rint(np.log(weights) / np.log(STEP)), 0).astype(np.int64)
        row = np.minimum(level, LEVELS - 1) * DRAWS
        heavy = level >= LEVELS
        low = np.full(len(self.factors), np.inf, np.float32)
        kept = np.zeros(len(self.factors), dtype=np.uint64)
        shift = np.uint64(64 - (DRAWS.bit_length() - 1))
        for s in range(0, len(found), 2048):
            f = found[s : s + 2048]
            at = ((self.factors[:, None] * f[None, :]) >> shift).astype(np.int64)
            at += row[None, s : s + 2048]
            a = self.log_a[at]
            above = np.flatnonzero(heavy[s : s + 2048])
            if len(above):
                a[:, above] = self._sampled(level[s + above], at[:, above] % DRAWS)[0]
            k = np.argmin(a, axis=1)
            i = np.arange(len(k))
            step = self.step[at[i, k]]
            if len(above):
                step = np.where(heavy[s + k], self._sampled(level[s + k], at[i, k] % DRAWS)[1], step)
            better = a[i, k] < low
            low = np.where(better, a[i, k], low)
            kept = np.where(better, f[k] ^ (step * np.uint64(0xD6E8FEB86659FD93)), kept)
        grid, out = kept.reshape(BANDS, ROWS), np.zeros(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            out = mixed(out + grid[:, k])
        return out.astype(np.int64).tolist()


def _similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / total if total > 0 else 0.0


def _text_mark(text: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col(text).cast("string"))


def signatures(docs: DataFrame, signer, key: str, text: str) -> DataFrame:
    """(id, mark, copy, bands): copy is a 128-bit fingerprint of the words, null where there is nothing to compare."""

    def run(batches):
        import xxhash

        s = signer.value
        known: dict[bytes, list[int]] = {}  # of copies that stand near each other
        for keys, marks, texts in (x for batch in batches for x in blocks([batch], 2)):
            copies, bands = [], []
            for x, found, times, words in zip(texts, *shingled(texts), strict=True):
                if not len(words):
                    copies.append(xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) if x else None)
                    bands.append(None)
                    continue
                copies.append(mark := xxhash.xxh3_128_digest(words.tobytes()))
                if mark not in known:
                    if len(known) >= 2000:
                        known.clear()
                    known[mark] = s.bands(found, s.weights(found, times))
                bands.append(known[mark])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(marks, pa.int64()), pa.array(copies, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "mark", "copy", "bands"])

    rows = docs.select(F.col(key).cast("long").alias("id"), _text_mark(text).alias("mark"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, mark long, copy binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, signer, least: float) -> DataFrame:
    """Of pairs (a, b, n) those with a weighted Jaccard similarity of at least `least`; n is about the number of a's pairs.

    The texts of b go to their a; an a of many pairs is dealt out over groups of about DEALT, to each of which its text is sent.
    """
    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / DEALT)).cast("int").alias("g"), "b")
    wanted = dealt.select("a", "g", F.col("b").alias("cls"), F.lit(False).alias("lead")).unionByName(dealt.select("a", "g").distinct().select("a", "g", F.col("a").alias("cls"), F.lit(True).alias("lead")))
    ordered = wanted.join(texts, "cls").select("a", "lead", "cls", "text", "g").repartition("a", "g").sortWithinPartitions("a", "g", F.desc("lead"))

    def run(batches):
        s, lead, own = signer.value, None, None
        for a_s, leads, ids, texts in (x for batch in batches for x in blocks([batch], 3)):
            rows = []
            for a, is_lead, b, x in zip(a_s, leads, ids, s.weighted(texts), strict=True):
                if is_lead:
                    lead, own = a, x
                elif lead == a and _similarity(own, x) >= least:
                    rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])

    return ordered.select("a", "lead", "cls", "text").mapInArrow(run, "a long, b long")


def shingle_rows(texts: DataFrame, signer) -> DataFrame:
    """(cls, total, shingle, weight): a row for each distinct shingle of each text; total is the text's weight."""

    def run(batches):
        s = signer.value
        for ids, xs in (x for batch in batches for x in blocks([batch], 1, 500_000)):
            for k, (found, weights) in zip(ids, s.weighted(xs), strict=True):
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(np.full(n, weights.sum(dtype=np.float64))), pa.array(found.astype(np.int64)), pa.array(weights)], ["cls", "total", "shingle", "weight"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, total double, shingle long, weight float")


def across(open_classes: DataFrame, texts: DataFrame, signer, least: float) -> DataFrame:
    """Pairs (x, y, n) of classes (cls, root) of unlike roots that may reach a similarity of `least`: all that do, and few others."""
    rows = written(shingle_rows(texts.join(open_classes, "cls", "left_semi"), signer))
    often = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    # The weight from here on is all shared weight less what stands before; a frame that ends with the group would be summed anew for each row.
    before = "partition by cls order by n, shingle rows between unbounded preceding and current row"
    rest = rows.join(often, "shingle").withColumn("weight", F.col("weight").cast("double")).selectExpr("cls", "total", "shingle", f"sum(weight) over (partition by cls) - sum(weight) over ({before}) + weight as rest")
    rest = rest.where(F.col("rest") >= (least - 1e-6) * F.col("total")).join(open_classes, "cls")
    first = written(rest)
    # Within a shingle, those outside its largest component meet all others.
    sides = first.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("size"))
    sides = sides.where("roots > 1")
    few = first.join(sides, "shingle").where("root <> main").select("shingle", "cls", "root", "total", "rest", "main", "size")
    bound = f"p.total + q.total <= {(1 + least) / least + 1e-5} * least(p.rest, q.rest)"
    pairs = few.alias("p").join(first.alias("q"), F.expr(f"p.shingle = q.shingle and p.root <> q.root and (q.root = p.main or p.cls < q.cls) and {bound}"))
    out = written(pairs.select(F.col("p.cls").alias("x"), F.col("q.cls").alias("y"), F.col("p.size").alias("n")))
    forget(rows)
    forget(first)
    return out


def _paired(pairs: DataFrame) -> DataFrame:
    """(lo, hi, a, b, n): each pair (x, y, n) once, a the side that it was compared for."""
    pairs = pairs.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.max(F.struct("n", "x")).alias("m"))
    return pairs.select("lo", "hi", F.col("m.x").alias("a"), F.when(F.col("m.x") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"), F.col("m.n").alias("n"))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """(id, mark, class_id, kept) of every row of docs; mark tells texts of one id apart. Written; all else that was written on the way is dropped."""
    spark, parts = docs.sparkSession, []
    small_batches(spark)

    def held(df: DataFrame) -> DataFrame:
        parts.append(written(df))
        return parts[-1]

    signer = spark.sparkContext.broadcast(Signer(*frequencies(docs, text)))
    signed = held(signatures(docs, signer, key, text))
    member = signed.where("copy is not null").select("id", "mark", F.xxhash64("copy").alias("cls"), "copy", "bands")
    classes = held(member.groupBy("copy", "cls").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"), F.first("bands").alias("bands")))
    cells = classes.where("bands is not null").select("cls", F.posexplode("bands").alias("band", "hash"))
    busy = cells.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    cells = held(cells.join(busy, ["band", "hash"]).select(F.xxhash64("band", "hash").alias("bucket"), "cls", "n"))
    # How many classes a class meets over all bands: the text that copies were made from meets most of them.
    met = cells.groupBy("cls").agg(F.sum("n").alias("met"))
    live = held(cells.join(met, "cls").select("bucket", "cls", F.struct("met", (-F.col("cls")).alias("tie")).alias("rank")))
    wanted = classes.join(met.select("cls"), "cls", "left_semi").select("cls", F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    rows = docs.select(F.col(key).cast("long").alias("id"), _text_mark(text).alias("mark"), F.col(text).cast("string").alias("text"))
    texts = held(rows.alias("d").join(wanted.alias("w"), F.expr("d.id <=> w.id and d.mark = w.mark")).select("w.cls", "d.text"))
    roots, links, tried = None, spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "lo long, hi long")

    def compare(pairs: DataFrame) -> None:
        nonlocal links, tried, roots
        new = held(pairs.join(tried, ["lo", "hi"], "left_anti"))
        tried = tried.union(new.select("lo", "hi"))
        links = links.union(held(verified(new, texts, signer, least)))
        roots = held(components(links))

    def placed(cells: DataFrame) -> DataFrame:
        """Cells with the component of each class, of buckets with several."""
        if roots is None:
            return cells.withColumn("root", F.col("cls"))
        cells = cells.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", "rank", F.coalesce("component", "cls").alias("root"))
        split = cells.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("bucket")
        return held(cells.join(split, "bucket"))

    for _ in range(rounds):
        here = placed(live)
        if here.isEmpty():
            break
        centre = held(here.groupBy("bucket").agg(F.max_by(F.struct("cls", "root"), "rank").alias("c"), F.count("*").alias("n")))
        near = here.join(centre, "bucket").where("cls <> c.cls")
        compare(_paired(near.where("root <> c.root").select(F.col("c.cls").alias("x"), F.col("cls").alias("y"), "n")))
        live = held(near.select("bucket", "cls", "rank"))
    last = placed(live).select("cls", "root").distinct()
    if not (last := held(last)).isEmpty():
        pairs = across(last, texts, signer, least)
        compare(_paired(pairs))
        forget(pairs)
    ends = classes.select("cls", "first")
    ends = ends.withColumn("component", F.col("cls")) if roots is None else ends.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = ends.groupBy("component").agg(F.min("first").alias("first"))
    ends = ends.select("cls", "component").join(first, "component").select("cls", F.col("first.id").alias("class_id"), F.col("first.mark").alias("class_mark"))
    out = member.join(ends, "cls").select("id", "mark", "class_id", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))).alias("kept"))
    out = written(out.unionByName(signed.where("copy is null").select("id", "mark", F.col("id").alias("class_id"), F.lit(True).alias("kept"))))
    for part in parts:
        forget(part)
    signer.destroy()
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """(key, class_id, kept): class_id is the smallest key of the document's group."""
    return grouped(docs, key, text, least, rounds).select(F.col("id").alias(key), "class_id", "kept")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs without all but the smallest key of each group."""
    gone = grouped(docs, key, text, least).where("not kept").select("id", "mark").distinct()
    return docs.alias("d").join(gone.alias("g"), F.expr(f"cast(d.`{key}` as long) <=> g.id and xxhash64(cast(d.`{text}` as string)) = g.mark"), "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
