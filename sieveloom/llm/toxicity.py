"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads words as symbols: insult, threat, target, negation, reported speech or
other; its insults are stems and words learned from labels, beside a few given ones. Transducers for
reported speech, negation and target mark those insults and threats that stand in their scope, and a
weighing transducer gives each marked symbol its factor. They are composed once into one machine that
reads a clause from left to right; a clause counts by the heaviest match in it, so repeated words in
one clause count once. A document's evidence is the sum over its clauses. A clause of one insult and nothing
else that the grammar knows matches too, with factor 1: the toxic rows that it learns from hold insults among words of no meaning,
where no other mark of a clause is left.

Fitted on at most TOXIC and CLEAN labelled rows. Cases: null and empty texts score 0; without
labelled rows of both kinds only the given words count; texts of any length are read whole; repeated
rows score alike; clauses of equal weight count each; further columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Remembered, small_batches, table, written
from .labelled import fold, sample

#: Labelled rows that the lexicon is learned from, at most.
TOXIC, CLEAN = 4000, 8000
#: Lengths of stems.
STEMS = range(4, 8)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: The lexicon to start from, chosen here: function words of the four languages that open or aim a clause, and a few insults and threats beside the learned ones.
GIVEN = {
    INSULT: "idiot idiots moron morons stupid imbecile scum scumbag bastard bastards asshole assholes bitch idiota imbécil estúpido estúpida pendejo cabrón idiotin dummkopf trottel arschloch abschaum connard connasse salaud abruti crétin",
    THREAT: "kill murder strangle shoot stab mataré matarte töten umbringen tuer tuerai égorger",
    TARGET: "you your yours yourself he she him her they them people du dich dir dein deine sie ihr ihn euch tu te toi vous ton ta votre eux tú usted ustedes vosotros ellos ellas",
    NEGATION: "not no never isn't aren't wasn't don't nobody nicht kein keine nie ne pas jamais aucun nunca ningún ninguna jamás",
    REPORT: "said says claimed called reported quoted wrote alleged according sagte behauptete schrieb laut dit écrit selon affirmé dijo según escribió",
}
#: Evidence of a given insult or threat. A learned one has its logarithm of odds.
GIVEN_WEIGHT = 2.0
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?").findall
_PART = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]+").findall


class Transducer:
    """Deterministic: step(state, symbol) gives the next state and the symbol passed on. Symbols are (kind, marks)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, other: "Transducer") -> "Transducer":
        """Composition: the other machine reads what this one passes on."""

        def step(state, symbol):
            mine, passed = self.step(state[0], symbol)
            theirs, out = other.step(state[1], passed)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)


def scope(opener: int, reach: int, mark: str) -> Transducer:
    """Marks insults and threats that follow `opener` within `reach` words of a clause."""

    def step(left, symbol):
        kind, marks = symbol
        if kind == opener:
            return reach, symbol
        if kind in (INSULT, THREAT) and left:
            marks = marks | {mark}
        return max(0, left - 1), (kind, marks)

    return Transducer(0, step)


def weighing() -> Transducer:
    """Passes on a factor: a threat needs a target; negated and reported matches count less, aimed ones more."""

    def step(_, symbol):
        kind, marks = symbol
        if kind not in (INSULT, THREAT) or kind == THREAT and "aimed" not in marks:
            return 0, 0.0
        return 0, (1.25 if "aimed" in marks else 1.0) * (0.4 if "negated" in marks else 1.0) * (0.6 if "reported" in marks else 1.0)

    return Transducer(0, step)


def grammar() -> Transducer:
    return scope(REPORT, 8, "reported") @ scope(NEGATION, 3, "negated") @ scope(TARGET, 5, "aimed") @ weighing()


class Grammar:
    """The composed machine with a lexicon: words and stems with their evidence."""

    def __init__(self, learned: dict[str, float], bar: float = 1.0):
        self.learned, self.bar = learned, bar
        self.given = {w: kind for kind, words in GIVEN.items() for w in words.split()}
        self.machine, self.arcs = grammar(), {}
        self.read = Remembered(self._read)

    def __reduce__(self):
        return Grammar, (self.learned, self.bar)

    def _read(self, word: str) -> tuple[int, float]:
        best = max([0.0, *(self.learned.get(word[:n] + "*", 0.0) for n in STEMS), self.learned.get(word, 0.0)])
        kind = self.given.get(word, OTHER)
        if best and kind in (OTHER, INSULT):
            return INSULT, max(best, GIVEN_WEIGHT * (kind == INSULT))
        return kind, GIVEN_WEIGHT if kind in (INSULT, THREAT) else 0.0

    def clause(self, read: list[tuple[int, float]]) -> float:
        state, best = self.machine.start, 0.0
        for kind, weight in read:
            arc = self.arcs.get((state, kind))
            if arc is None:
                arc = self.arcs[state, kind] = self.machine.step(state, (kind, frozenset()))
            state, factor = arc
            best = max(best, factor * weight)
        return best

    def evidence(self, text: str | None) -> float:
        low = (text or "").lower()
        if not any(w for _, w in map(self.read.__getitem__, set(_WORD(low)))):
            return 0.0
        total, clause = 0.0, []
        for part in _PART(low):
            if part[0] in ".!?;:\n":
                total += self.clause(clause)
                clause = []
            else:
                clause.append(self.read[part])
        return total + self.clause(clause)

    def score(self, text: str | None) -> float:
        """0.5 where the evidence reaches the bar."""
        return 1 - 2 ** (-self.evidence(text) / self.bar)


def _stems(text: str | None) -> set[str]:
    words = set(_WORD((text or "").lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def learn(labelled: DataFrame, label: str = "toxic", text: str = "text") -> Grammar:
    """Entries are the words and stems whose presence speaks for the label: in enough toxic rows, and nearly only there."""

    def count(batches):
        seen, rows = Counter(), Counter()
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                y = y.as_py()
                rows[y] += 1
                seen.update((s, y) for s in _stems(x.as_py()))
        items = [*seen.items(), *((("", y), n) for y, n in rows.items())]
        yield pa.RecordBatch.from_arrays([pa.array([s for (s, _), _ in items], pa.string()), pa.array([y for (_, y), _ in items], pa.int32()), pa.array([n for _, n in items], pa.int64())], ["stem", "y", "n"])

    counts = labelled.select(text, F.col(label).cast("int")).mapInArrow(count, "stem string, y int, n long").groupBy("stem").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    counts = written(counts)
    totals = counts.where("stem = ''").first()
    if totals is None or not totals["a"] or not totals["b"]:
        return Grammar({})
    toxic, clean = totals["a"], totals["b"]
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    # Each entry is in 0.015 of the toxic rows at least, so there are at most 67 times as many as a toxic row has stems.
    support = max(2, math.ceil(0.015 * toxic))
    rows = counts.where((F.col("stem") != "") & (F.col("a") >= support) & (F.col("a") / toxic >= 10 * F.col("b") / clean) & (odds >= 2.5)).select("stem", odds.alias("w")).collect()
    weights = {r["stem"]: r["w"] for r in rows}
    return Grammar(_cover(labelled.where(F.col(label) == 1), weights, text))


def _cover(toxic: DataFrame, weights: dict[str, float], text: str) -> dict[str, float]:
    """Entries that explain the toxic rows, two for a row: the one that explains most first, while it explains enough rows that the chosen ones don't.

    Rows with the same entries are copies and count once, so that the rare words of a copied text explain nothing.
    """
    names = sorted(weights, key=lambda s: (s.endswith("*"), -len(s), s))  # of equal gain, the first
    index = {s: k for k, s in enumerate(names)}

    def present(batches):
        for batch in batches:
            sets = [np.array(sorted(index[s] for s in _stems(x.as_py()) if s in index), dtype="<u4").tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary())], ["present"])

    sets = [np.frombuffer(r["present"], "<u4") for r in toxic.select(text).mapInArrow(present, "present binary").distinct().collect()]
    has = np.zeros((len(sets), len(names)), dtype=bool)
    for k, found in enumerate(sets):
        has[k, found] = True
    want, weight = np.full(len(sets), 2), np.array([weights[s] for s in names])
    least, chosen = max(2, math.ceil(0.01 * len(sets))), {}
    while len(names):
        gain = has[want > 0].sum(axis=0)
        best = int(np.argmax(gain * weight))
        if gain[best] < least:
            break
        chosen[names[best]] = float(weight[best])
        want -= has[:, best]
        word = names[best].rstrip("*")
        for k, s in enumerate(names):  # the same words in other forms explain nothing more
            if s.rstrip("*").startswith(word) or word.startswith(s.rstrip("*")) and (has[:, k] == has[:, best]).mean() > 0.98:
                has[:, k] = False
    return chosen


def calibrated(machine: Grammar, labelled: DataFrame, label: str = "toxic", text: str = "text") -> Grammar:
    """The bar that best tells the labelled rows apart, each label weighing the same."""
    shared = labelled.sparkSession.sparkContext.broadcast(machine)

    @pandas_udf("double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.evidence(x) for x in texts], dtype="float64")

    rows = labelled.select(evidence(text).alias("e"), F.col(label).cast("int").alias("y")).toPandas()
    if rows["y"].nunique() < 2:
        return Grammar(machine.learned, GIVEN_WEIGHT)
    e, y = rows["e"].to_numpy(), rows["y"].to_numpy()
    steps = np.unique(np.concatenate([[0.0], e]))
    bars = (steps[1:] + steps[:-1]) / 2
    if not len(bars):
        return Grammar(machine.learned, GIVEN_WEIGHT)
    pos, neg = np.sort(e[y == 1]), np.sort(e[y == 0])
    right = (len(pos) - np.searchsorted(pos, bars)) / len(pos) + np.searchsorted(neg, bars) / len(neg)
    return Grammar(machine.learned, float(bars[int(np.argmax(right))]))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Grammar:
    labelled = written(sample(docs, labels, "toxic", 5, 0, {1: TOXIC, 0: CLEAN}).repartition(12))
    return calibrated(learn(labelled), labelled)


def toxicity_score(machine: Grammar, spark: SparkSession, text: str | Column = "text") -> Column:
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(x) for x in texts], dtype="float64")

    return score(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame, bar: float = 0.5) -> DataFrame:
    """docs with held_out, score and predicted."""
    machine = fit_toxicity(docs, labels)
    out = docs.withColumns({"held_out": fold("doc_id", 5) == 0, "score": toxicity_score(machine, docs.sparkSession)})
    return out.withColumn("predicted", (F.col("score") >= bar).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
