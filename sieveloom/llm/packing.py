"""Packing into fixed-length sequences by vector bin packing.

Every example has three demands: tokens, segments, and loss-bearing tokens; a sequence has a limit on
each. A sequence is filled by the dot-product heuristic: of the waiting examples that fit, the one
whose demand vector has the largest product with what is left of the sequence. Where none fits whole,
the best one is cut at the gap and its tail waits on, so a sequence closes full. Full-length stretches
of long documents are sequences by themselves. What waits when a task ends is laid into sequences
whose lengths are powers of two, which need no padding.

Tasks pack their own rows with a bounded number of waiting examples, so nothing is shuffled;
sequence ids carry the task's number. Which tokens bear loss comes as spans of the text (as windows() of chat
gives them); without spans all tokens do. Cases: a null or empty text is the single end id; texts of any
length are tokenised whole; repeated rows and rows of null ids are packed each; of equal products the example that has waited longest
is taken; extra columns are left out, so none clashes; an empty table gives no pieces.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPACED, byte_letters
from .common import blocks, small_batches, table

#: Examples that wait in a task before sequences are filled, and after.
WAITING, LEFT = 1024, 256


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


def loss_marks(coder, ids: np.ndarray, text: str, spans: list[dict] | None) -> np.ndarray:
    """For each id of the text whether it has a byte in one of the spans: (start, length) in code points, from 1. Null spans: all have."""
    if spans is None:
        return np.ones(len(ids), dtype=bool)
    ends = np.cumsum([0, *map(len, coder.decode_tokens_bytes(ids.tolist()))])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.cumsum([0, *(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).tolist()])
    covered = np.zeros(ends[-1], dtype=bool)
    for span in spans:
        first = max(0, span["start"] - 1)
        last = max(first, span["start"] - 1 + span["length"])
        covered[at[min(first, len(points))] : at[min(last, len(points))]] = True
    upto = np.cumsum([0, *covered.tolist()])
    return upto[ends[1:]] > upto[ends[:-1]]


class Packer:
    """Waiting examples are rows (key, start, ids, loss): `loss` holds prefix sums of loss-bearing tokens, or None where all bear loss."""

    def __init__(self, limits: Limits, first: int):
        self.limits, self.next = limits, first
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.items: list[tuple] = []
        self.demand = np.empty((0, 3))
        self.out: list[tuple] = []

    def add(self, item: tuple) -> None:
        self.items.append(item)

    @staticmethod
    def _loss(item: tuple, n: int) -> int:
        return n if item[3] is None else int(item[3][n] - item[3][0])

    def _vector(self, item: tuple) -> tuple[int, int, int]:
        n = len(item[2])
        return n, 1, self._loss(item, n)

    def _cut(self, item: tuple, n: int) -> tuple[tuple, tuple]:
        key, start, ids, loss = item
        return (key, start, ids[:n], None if loss is None else loss[: n + 1]), (key, start + n, ids[n:], None if loss is None else loss[n:])

    def _emit(self, members: list[tuple]) -> None:
        offset = 0
        for key, start, ids, _ in members:
            self.out.append((key, start, ids, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _fill(self) -> list[tuple]:
        """One sequence out of the waiting examples."""
        demand, alive = self.demand, self.alive
        left, members = self.capacity.copy(), []
        while left[0] > 0 and left[1] > 0 and left[2] >= 0 and alive.any():
            product = demand @ (left / self.capacity**2)
            fits = alive & (demand <= left).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, product, -1)))
                members.append(self.items[k])
                left -= demand[k]
                alive[k] = False
                continue
            k = int(np.argmax(np.where(alive, product, -1)))
            item = self.items[k]
            n = min(int(left[0]), len(item[2]) - 1)
            while n > 0 and self._loss(item, n) > left[2]:
                n = int(np.searchsorted(item[3], item[3][0] + left[2], side="right")) - 1 if item[3] is not None else int(left[2])
            if n <= 0:
                break
            head, self.items[k] = self._cut(item, n)
            demand[k] = self._vector(self.items[k])
            members.append(head)
            left -= self._vector(head)
        return members

    def _back(self, members: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
        """The first n tokens of the members, and what is over."""
        kept, over, held = [], [], 0
        for item in members:
            size = len(item[2])
            if held + size <= n:
                kept.append(item)
            elif held >= n:
                over.append(item)
            else:
                head, tail = self._cut(item, n - held)
                kept.append(head)
                over.append(tail)
            held += size
        return kept, over

    def drain(self, left: int) -> None:
        """Fill sequences until at most `left` examples wait; with 0, until none does."""
        if len(self.items) <= left:
            return
        self.demand = np.array([self._vector(x) for x in self.items], dtype=np.float64).reshape(-1, 3)
        self.alive = np.ones(len(self.items), dtype=bool)
        while self.alive.sum() > left:
            members = self._fill()
            while members:
                size = sum(len(x[2]) for x in members)
                n = size if size == self.limits.tokens else 1 << size.bit_length() - 1
                kept, members = self._back(members, n)
                self._emit(kept)
                if members and left:  # what a limit other than tokens kept out waits on
                    self.items += members
                    self.demand = np.concatenate([self.demand, [self._vector(x) for x in members]])
                    self.alive = np.concatenate([self.alive, np.ones(len(members), dtype=bool)])
                    members = []
        self.items = [x for x, a in zip(self.items, self.alive, strict=True) if a]


def encoding(path: str):
    """The byte-level vocabulary of a tokenizers file, with its merges done by a faster engine.

    Such a file lists its merges in the order of the ids that they make, so ids are ranks. Special strings in a text are their ids, as
    the file's library does by default.
    """
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    made = [a + b for a, b in (x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])]
    ids, special = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
    order = [ids[x] for x in made]
    if spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"] or order != sorted(order):
        raise ValueError("not a byte-level vocabulary whose ids follow its merges")
    letters = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(map(letters.__getitem__, x)): k for x, k in ids.items() if x not in special}
    return tiktoken.Encoding("packing", pat_str=SPACED, mergeable_ranks=ranks, special_tokens=special)


def pack(df: DataFrame, path: str, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", end: int | None = 0, loss: str | None = None) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids are unsigned 32-bit little-endian numbers.

    With `loss`, a column of spans that bear loss, array<struct<start, length>> in code points of the text from 1, also
    loss_mask (a byte for each id) and loss_tokens. The end id bears loss where the text's last token does.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"), *([F.col(loss).cast("array<struct<start: long, length: long>>").alias("spans")] if loss else []))
    schema = f"{key} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long" + (", loss_mask binary, loss_tokens long" if loss else "")

    def run(batches):
        coder = encoding(path)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)

        def done():
            rows, packer.out = packer.out, []
            masks = [r[0][2][r[1] : r[1] + len(r[2])] for r in rows] if loss else []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), *([pa.array([m.tobytes() for m in masks], pa.binary()), pa.array([int(m.sum()) for m in masks], pa.int64())] if loss else [])],
                [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", *(["loss_mask", "loss_tokens"] if loss else [])],
            )

        for keys, texts, *spans in (x for batch in batches for x in blocks([batch], 1)):
            for k, x, marked in zip(keys, texts, spans[0] if loss else [None] * len(keys), strict=True):
                ids = coder.encode_to_numpy(x, allowed_special="all") if x else np.empty(0, np.uint32)
                mask = loss_marks(coder, ids, x or "", marked) if loss else None
                if loss and end is not None:
                    mask = np.append(mask, mask[-1] if len(mask) else marked is None)
                upto = np.concatenate([[0], np.cumsum(mask)]) if loss else None
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                ids = ids.astype("<u4", copy=False)
                whole = len(ids) - len(ids) % limits.tokens if limits.loss >= limits.tokens else 0
                for start in range(0, whole, limits.tokens):
                    packer._emit([((k, len(ids), mask), start, ids[start : start + limits.tokens], None)])
                if whole < len(ids):
                    packer.add(((k, len(ids), mask), whole, ids[whole:], upto[whole:] if loss else None))
                if len(packer.items) >= WAITING:
                    packer.drain(LEFT)
            yield done()
        packer.drain(0)
        yield done()

    return source.mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
