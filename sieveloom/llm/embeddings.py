"""Near-duplicate vectors by a subspace pigeonhole join.

For vectors of length one, cosine >= c means a squared distance of at most 2 - 2c. A fixed random
rotation spreads that distance over the axes; the rotated vector is split into blocks of BLOCK axes,
and by the pigeonhole principle two near vectors are near in at least one block: within the block's
share of the squared distance, in proportion to its axes. Pairs within a block's share are its candidates;
the union of the blocks' candidates is verified exactly, in double precision, each pair once.

Equal vectors of a label are one class that carries its number of members, so a group of copies of
any size is one row. The classes of a label are cut into tiles of at most TILE rows and TILE_BYTES, along the axes on
which they spread most, and a tile is one packed row with its box. Each pair of a label's tiles is range-joined block by block:
a block in which the boxes lie further apart than its share is passed over, else one product of matrices gives its candidates.

No vector is copied for the pairs it takes part in: tiles are written once, and Spark's Cartesian product of that table with itself
reads them from there, a task for each pair of its partitions, without an exchange. So disk follows the input, whatever the number of pairs.
Labels of no more than TILE classes go to tasks whole, many of them to one. What leaves a task are counts of links and a spanning forest of them; components come from the forests.

What the boxes keep apart depends on the vectors: those spread evenly over all axes are near one another in two axes or ten, so
each tile is compared with all others of its label, and only the block's whole distance tells vectors apart. candidates() counts what is left to verify.

Cases: vectors with a null label, null, empty, zero or with null or non-finite components link with
nothing; vectors of different lengths link with nothing; repeated rows are vectors of their own and
link with each other, as do those that share an id; a null id is an id like others, but component_id is the least that isn't null; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forget, table, written

BLOCK, TILE, SEED = 16, 2048, 11
#: Bytes of a tile in double precision, and rows from which a task cuts its tiles.
TILE_BYTES, RUN = 1 << 20, 32768
#: Pairs of tiles in a batch for Python code, and small labels' classes in a task.
PAIRS, GROUP = 8, 20_000
#: Slack on distances, against rounding in the rotation; candidates are verified exactly.
SLACK = 1e-6
#: Links held by a task before they are summed, and candidates verified at once.
HELD, AT_ONCE = 1_000_000, 32768


@lru_cache(4)
def rotation(n: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def _blocks(n: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]


def _budget(n: int, a: int, b: int, least: float) -> float:
    return (2 - 2 * least) * (b - a) / n + SLACK


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1: exact, but for what is 2^-500 of it and less."""
    shift = -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1]
    return np.ldexp(np.ldexp(rows, shift // 2), shift - shift // 2)


class Tile:
    """Classes of one label and length: their keys, numbers of members, scaled vectors, lengths and rotated axes."""

    def __init__(self, cls: np.ndarray, n: np.ndarray, vectors: np.ndarray):
        self.cls, self.n = cls, n
        self.raw = scaled(vectors.astype(np.float64))
        self.size = np.linalg.norm(self.raw, axis=1)
        self.axes = (self.raw / self.size[:, None]) @ rotation(vectors.shape[1]).T


def proposals(x: Tile, y: Tile, same: bool, blocks: list[tuple[int, int]], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), run by run, of vectors whose distance may be within the share of one of the blocks.

    One product tells: |x - y|^2 <= budget is x.y - |x|^2 / 2 - |y|^2 / 2 >= -budget / 2. Single precision with slack; the caller decides.
    """
    m, sides = x.axes.shape[1], []
    half = lambda v: (v.astype(np.float64) ** 2).sum(1, keepdims=True).astype(np.float32) / 2
    for a, b in blocks:
        p, q = x.axes[:, a:b].astype(np.float32), y.axes[:, a:b].astype(np.float32)
        sides.append((np.hstack([p, -half(p), np.ones((len(p), 1), np.float32)]), np.hstack([q, np.ones((len(q), 1), np.float32), -half(q)]), -_budget(m, a, b, least) / 2 - 1e-5))
    step = max(1, (1 << 18) // len(y.axes))
    for s in range(0, len(x.axes), step):
        first = s if same else 0
        near = [p[s : s + step] @ q[first:].T >= limit for p, q, limit in sides]
        near = [np.flatnonzero(found) for found in near if found.any()]
        if near:
            i, j = np.divmod(near[0] if len(near) == 1 else np.unique(np.concatenate(near)), len(y.axes) - first)
            if same:
                i, j = i[i < j], j[i < j]
            yield i + s, j + first


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): each node but the least of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = parent[i], parent[j]
        apart = p != q
        if not apart.any():
            break
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent != (above := parent[parent])).any():
            parent = above
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


class Found:
    """What a task has found: links of each class, a forest of the links, and how many pairs were verified."""

    def __init__(self, least: float):
        self.least, self.tried, self.held = least, 0, 0
        self.links, self.edges = [], []

    def compare(self, x: Tile, y: Tile, same: bool, boxes: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        m = x.axes.shape[1]
        blocks = _blocks(m)
        if boxes is not None:
            gap = np.maximum(0, np.maximum(boxes[0][0] - boxes[1][1], boxes[1][0] - boxes[0][1])) ** 2
            blocks = [(a, b) for a, b in blocks if gap[a:b].sum() <= _budget(m, a, b, self.least)]
        for left, right in proposals(x, y, same, blocks, self.least):
            for s in range(0, len(left), AT_ONCE):
                i, j = left[s : s + AT_ONCE], right[s : s + AT_ONCE]
                self.tried += len(i)
                exact = np.einsum("ij,ij->i", x.raw[i], y.raw[j]) / (x.size[i] * y.size[j]) >= self.least
                i, j = i[exact], j[exact]
                if len(i):
                    self.links += [(x.cls[i], y.n[j]), (y.cls[j], x.n[i])]
                    self.edges.append((x.cls[i], y.cls[j]))
                    self.held += len(i)
                    if self.held >= HELD:
                        self.settle()

    def settle(self) -> None:
        if self.links:
            cls, at = np.unique(np.concatenate([c for c, _ in self.links]), return_inverse=True)
            links = np.zeros(len(cls), dtype=np.int64)
            np.add.at(links, at, np.concatenate([n for _, n in self.links]))
            self.links = [(cls, links)]
            self.edges = [forest(*(np.concatenate(x) for x in zip(*self.edges, strict=True)))]
            self.held = 0

    def rows(self) -> pa.RecordBatch:
        """(a, null, links of a), links of the forest (a, b, null), and (null, null, pairs verified)."""
        self.settle()
        cls, links = self.links[0] if self.links else ([], [])
        a, b = self.edges[0] if self.edges else ([], [])
        return pa.RecordBatch.from_arrays([pa.array([*cls, *a, None], pa.int64()), pa.array([*[None] * len(cls), *b, None], pa.int64()), pa.array([*links, *[None] * len(a), self.tried], pa.int64())], ["a", "b", "links"])


_FOUND = "a long, b long, links long"


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _by_label(t: pa.Table) -> Iterator[tuple[str, int, pa.Table]]:
    """The rows of each label and length."""
    t = t.combine_chunks().sort_by([("label", "ascending"), ("size", "ascending")])
    codes, size = t["label"].combine_chunks().dictionary_encode().indices.to_numpy(), t["size"].to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(size) != 0)) + 1).tolist(), t.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield t["label"][a].as_py(), int(size[a]), t.slice(a, b - a)


def _tiled(rows: pa.Table, size: int) -> Tile:
    return Tile(rows["cls"].to_numpy(), rows["n"].to_numpy(), _matrix(rows["vector"].combine_chunks(), size))


def _within(least: float):
    """Labels of few classes, each with itself."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, parts = Found(least), [b for b in batches if b.num_rows]
        for _, size, rows in _by_label(pa.Table.from_batches(parts)) if parts else ():
            t = _tiled(rows, size)
            found.compare(t, t, True)
        yield found.rows()

    return run


def _halves(axes: np.ndarray, at: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The places `at` in runs of at most `most`, cut in the middle of the axis on which they spread most."""
    if len(at) <= most:
        yield at
        return
    widest = axes[at, np.argmax(axes[at].var(axis=0))]
    order, middle = at[np.argsort(widest, kind="stable")], len(at) // 2
    yield from _halves(axes, order[:middle], most)
    yield from _halves(axes, order[middle:], most)


_TILES = "label string, size int, tile long, cls binary, n binary, vectors binary, box binary"


def _tiles(tile: int):
    """A row for a tile; labels come one after another, and tiles are cut from runs of RUN rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, TaskContext.get().partitionId() << 32

        def cut():
            nonlocal number
            for label, size, rows in _by_label(pa.Table.from_batches(held)):
                t, vectors = _tiled(rows, size), _matrix(rows["vector"].combine_chunks(), size)
                for at in _halves(t.axes, np.arange(len(t.cls)), max(1, min(tile, TILE_BYTES // (8 * size)))):
                    box = np.stack([t.axes[at].min(axis=0), t.axes[at].max(axis=0)])
                    cells = [pa.array([x.tobytes()], pa.binary()) for x in (t.cls[at], t.n[at], vectors[at], box)]
                    yield pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([size], pa.int32()), pa.array([number], pa.int64()), *cells], ["label", "size", "tile", "cls", "n", "vectors", "box"])
                    number += 1

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= RUN:
                yield from cut()
                held, count = [], 0
        if count:
            yield from cut()

    return run


def _joined(least: float, kind: str):
    """Pairs of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = Found(least), (None, None)
        for batch in batches:
            for r in batch.to_pylist():
                read = lambda side: Tile(np.frombuffer(r[f"{side}cls"], np.int64), np.frombuffer(r[f"{side}n"], np.int64), np.frombuffer(r[f"{side}vectors"], kind).reshape(-1, r["size"]))  # noqa: B023, E731
                boxes = tuple(np.frombuffer(r[f"{side}box"], np.float64).reshape(2, -1) for side in ("", "o_"))
                if r["tile"] != last[0]:
                    last = r["tile"], read("")
                found.compare(last[1], last[1] if r["tile"] == r["o_tile"] else read("o_"), r["tile"] == r["o_tile"], boxes)
        yield found.rows()

    return run


def _rows(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, vector, fine, cls, check): cls and check are 64-bit keys of label and vector. Vectors in single precision stay so until they are compared."""
    kind = "array<float>" if df.select(F.col(vector)).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(kind).alias("vector"))
    sound = F.col("label").isNotNull() & F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) <> double('infinity')) and exists(vector, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(sound, F.lit(False)))
    zero = F.lit(0.0).cast(kind[6:-1])
    rows = rows.withColumn("vector", F.when(F.col("fine"), F.transform("vector", lambda x: F.when(x == 0, zero).otherwise(x))))  # -0.0 equals 0.0
    return rows.withColumn("cls", F.xxhash64("label", "vector")).withColumn("check", F.xxhash64(F.lit(SEED), "vector", "label"))


def _classes(rows: DataFrame) -> DataFrame:
    """Copies: rows of one label and vector. Vectors group as they are."""
    return rows.where("fine").groupBy("label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min("cls").alias("cls"), F.min("check").alias("check"))


def _found(classes: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """Rows (a, null, links of a), links of the forest (a, b, null), and (null, null, pairs verified); written."""
    spark = classes.sparkSession
    vectors = classes.select("label", F.size("vector").alias("size"), "cls", "n", "vector")
    large = written(vectors.groupBy("label", "size").count().where(F.col("count") > tile).select("label", "size"))
    small = vectors.join(large, ["label", "size"], "left_anti")
    tasks = max(64, small.count() // GROUP)
    small = written(small.groupBy(F.pmod(F.xxhash64("label", "size"), F.lit(tasks)).alias("task")).applyInArrow(_within(least), _FOUND))
    if large.isEmpty():
        return small
    tiles = vectors.join(large, ["label", "size"], "left_semi").repartitionByRange("label", "size", "cls").mapInArrow(_tiles(tile), _TILES)
    tiles = written(tiles)
    kind = "f4" if "float" in vectors.schema["vector"].dataType.simpleString() else "f8"
    others = tiles.select(*(F.col(c).alias(f"o_{c}") for c in tiles.columns))
    # Of the two orders of a pair of tiles one is taken, by turns.
    cond = "label = o_label and size = o_size and (tile = o_tile or (tile < o_tile) = ((tile + o_tile) % 2 = 0))"
    pairs = tiles.hint("shuffle_replicate_nl").join(others, F.expr(cond)).drop("o_label", "o_size")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, PAIRS)  # each row is two tiles
    try:
        large = written(pairs.mapInArrow(_joined(least, kind), _FOUND))
    finally:
        spark.conf.set(name, before)
    forget(tiles)
    return small.unionByName(large)


def candidates(df: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> int:
    """The number of pairs of unlike vectors that are verified."""
    found = _found(written(_classes(_rows(df, key, vector, label))), least)
    return found.where("a is null").agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]


def near_vectors(df: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = _rows(df, key, vector, label)
    classes = written(_classes(rows))
    found = _found(classes, least, tile)
    links = found.where("a is not null and links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b is not null").select("a", "b"))
    joined = classes.select("cls", "check", "first", "n").join(links, "cls", "left").join(parts, F.col("cls") == F.col("node"), "left")
    joined = written(joined.select("cls", "check", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")))
    forget(classes)
    least_id = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    ends = joined.join(least_id, "component").select("cls", "check", "n_links", "component_id")
    out = rows.where("fine").select("id", "cls", "check").join(ends, ["cls", "check"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: The same in DuckDB, by comparing all pairs.
ORACLE_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
