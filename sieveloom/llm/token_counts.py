"""Token counts by prefix dynamic programming.

For a vocabulary of merged byte pairs with word ends, the encoding of a word's prefix is the encoding
of a shorter prefix plus one token, and which token is decided by the pair alone: a pair of tokens can
stand side by side when merging its joined symbols gives that pair back. So one pass over a word's
prefixes gives the exact count at every prefix; sums over words give it at every prefix of a text (table()).
Each document's counts at the ends of its pretokens are kept as an array, in which budgets and truncation points are
looked up without encoding anything again.

Cases: a null text counts as empty; an empty text has no tokens; special tokens written in a text
count as one each, as the library does by default; further columns stay as they are (a clash with an
output column is resolved in favour of the output); repeated rows are counted each; a text of any
length is handled whole, on its own if it is longer than a block.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PLAIN, Neighbouring, byte_letters, splitter
from .common import Remembered, blocks, small_batches, table

_END = "</w>"
_loaded: dict[str, "PrefixCounter"] = {}


class PrefixCounter:
    """Exact token counts at every prefix, for a lower-casing byte-pair vocabulary with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.vocabulary = spec["model"]["vocab"]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"])}
        self.longest = max(map(len, self.vocabulary))
        special = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(special) + ")") if special else None
        self.letters = byte_letters()
        self.narrow = splitter(PLAIN)
        self.parts = {a + b: (r, a, b) for (a, b), r in self.ranks.items()}
        self.pairs = Neighbouring(lambda a, b: self.ranks.get((a, b)), self.parts.get)
        self.count = Remembered(self._count)

    def prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of a pretoken, by bytes: the prefix of i bytes, taken as a whole word, has the count at i."""
        w = "".join(self.letters[b] for b in word.encode("utf-8"))
        last, inner = self._inner(w)
        return [0, *(self._ended(w, i, last, inner) for i in range(1, len(w) + 1))]

    def _inner(self, w: str) -> tuple[list[str], list[int]]:
        """Of each prefix without word end: its encoding's last token, and count."""
        n, vocabulary, together, longest = len(w), self.vocabulary, self.pairs.together, self.longest
        last, inner = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for k in range(i - longest if i > longest else 0, i):
                token = w[k:i]
                if token in vocabulary and (not k or together(last[k], token)):
                    last[i], inner[i] = token, inner[k] + 1
                    break
        return last, inner

    def _ended(self, w: str, i: int, last: list[str], inner: list[int]) -> int:
        """Count at i as a word's end: the one token with word end that can stand after a shorter prefix."""
        for k in range(max(0, i - self.longest), i):
            token = w[k:i] + _END
            if token in self.vocabulary and (not k or self.pairs.together(last[k], token)):
                return inner[k] + 1
        raise ValueError(f"no encoding of {w[:i]!r}")

    def _count(self, word: str) -> int:
        w = word if word.isascii() and word.isprintable() and " " not in word else "".join(self.letters[b] for b in word.encode("utf-8"))
        if w + _END in self.vocabulary:
            return 1
        last, inner = self._inner(w[:-1])
        return self._ended(w, len(w), last, inner)

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(is special, text) in order."""
        if self.special is None or "<|" not in text:
            return [(False, text)] if text else []
        return [(bool(k % 2), x) for k, x in enumerate(self.special.split(text)) if x]

    def words(self, text: str) -> list[str]:
        """Pretokens after normalisation. Texts beyond ISO 8859-1 take their classes and case from the library, whose Unicode tables are newer."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)] if normal else []
        return self.narrow(text.lower())

    def counts(self, text: str) -> list[int]:
        """Tokens of each pretoken and special token in turn."""
        if self.special is None or "<|" not in text:
            return list(map(self.count.__getitem__, self.words(text))) if text else []
        return [c for special, x in self.segments(text) for c in ([1] if special else map(self.count.__getitem__, self.words(x)))]

    def total(self, text: str) -> int:
        return sum(self.counts(text))

    def table(self, text: str) -> list[int]:
        """Tokens of every prefix of the normalised text, by characters, for texts without special tokens."""
        normal = self.library.normalizer.normalize_str(text) if text else ""
        out, before, at = [0] * (len(normal) + 1), 0, 0
        for word in self.words(normal):
            start = normal.index(word, at)
            out[at : start + 1] = [before] * (start + 1 - at)
            whole, ends = self.prefixes(word), [*accumulate((len(c.encode("utf-8")) for c in word), initial=0)]
            for k in range(1, len(word) + 1):
                parts = self.words(word[:k])
                out[start + k] = before + (whole[ends[k]] if len(parts) == 1 else sum(map(self.count.__getitem__, parts)))
            at = start + len(word)
            before += self.count[word]
        out[at:] = [before] * (len(normal) + 1 - at)
        return out


def counter(path: str) -> PrefixCounter:
    """One for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", budget: int = 2048) -> DataFrame:
    """df with n_bytes, prefix_tokens, and by look-up there: n_tokens, over_limit, kept_words, kept_tokens.

    prefix_tokens has the exact count of tokens at the end of each pretoken of the text, so it answers
    any budget: see kept(). kept_words (null where all are kept) and kept_tokens are the longest prefix of whole pretokens within `budget`.
    """
    own = ("n_bytes", "n_tokens", "over_limit", "kept_words", "kept_tokens", "prefix_tokens")
    rest = [c for c in df.columns if c not in own and c != text]
    small_batches(df.sparkSession)
    source = df.select(F.struct(*rest).alias("row") if rest else F.lit(None).cast("string").alias("row"), F.col(text).cast("string").alias("text"))
    schema = source.select("row").schema.add("n_bytes", "long").add("prefix_tokens", T.ArrayType(T.LongType()))

    def run(batches):
        c = counter(path)
        for batch in batches:
            at = 0
            for (texts,) in blocks([batch.select([1])], 0):
                sizes = [len(x.encode("utf-8")) if x else 0 for x in texts]
                counts = [c.counts(x or "") for x in texts]
                ends = np.cumsum([0, *map(len, counts)])
                sums = np.cumsum(np.fromiter(chain.from_iterable(counts), np.int64, int(ends[-1])))
                before = np.concatenate([[0], sums])[ends[:-1]]
                tables = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums - np.repeat(before, np.diff(ends))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), tables], ["row", "n_bytes", "prefix_tokens"])
                at += len(texts)

    out = source.mapInArrow(run, schema).withColumn("n_tokens", F.coalesce(F.get("prefix_tokens", F.size("prefix_tokens") - 1), F.lit(0)))
    over = F.col("n_tokens") > budget
    words = kept("prefix_tokens", budget)
    out = out.withColumns({"over_limit": over, "kept_words": F.when(over, words), "kept_tokens": F.when(over, F.coalesce(F.get("prefix_tokens", words - 1), F.lit(0))).otherwise(F.col("n_tokens"))})
    return out.select(*(["row.*"] if rest else []), *own)


def kept(prefix_tokens: str, budget: int) -> Column:
    """How many whole pretokens a budget of tokens keeps."""
    return F.size(F.filter(prefix_tokens, lambda x: x <= budget)).cast("long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("prefix_tokens")
