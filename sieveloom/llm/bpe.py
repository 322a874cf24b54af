"""Byte-pair merging of single pretokens, and the pretoken patterns of the public vocabularies."""

from __future__ import annotations

import heapq
import re
from functools import cache

import regex

# Patterns that the vocabulary files state.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
# The same classes for texts of ISO 8859-1 only, where the standard library's engine is faster.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\x09-\\x0d \\x85\\xa0"

WIDE_SPACES = SPACES + "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@cache
def splitter(pattern: str):
    """text -> pretokens."""
    wide = regex.compile(pattern.replace(r"[^\s", f"[^{WIDE_SPACES}").replace(r"\s", f"[{WIDE_SPACES}]").replace(r"\S", f"[^{WIDE_SPACES}]"))
    narrow = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return wide.findall(text)
        return narrow.findall(text)

    return split


@cache
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merge(symbols: list[str], rank) -> list[str]:
    """Join neighbours, the pair of least rank first and of equal ranks the leftmost, until rank(left, right) is None for all."""
    n = len(symbols)
    if n < 2:
        return symbols
    text, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, text[i], text[i + 1]) for i in range(n - 1) if (r := rank(text[i], text[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if text[i] is not None else -1
        if j < 0 or text[i] != left or text[j] != right:
            continue
        text[i], text[j], after[i] = left + right, None, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if (r := rank(text[i], text[after[i]])) is not None:
                heapq.heappush(heap, (r, i, text[i], text[after[i]]))
        if (h := before[i]) >= 0 and (r := rank(text[h], text[i])) is not None:
            heapq.heappush(heap, (r, h, text[h], text[i]))
    return [x for x in text if x is not None]


class Neighbouring:
    """Which two tokens can stand side by side in an encoding, and by that the encodings of all prefixes.

    Two tokens stand together when no merge across their border comes before the merges that made
    them. That is seen by undoing the later of the two tokens' last merges, again and again: a merge
    across the border that ranks before the one undone would have come first (of equal ranks, the
    left one comes first).
    """

    def __init__(self, rank, parts, most: int = 1_000_000):
        """rank(left, right): rank of their merge or None. parts(token): (rank of its last merge, left part, right part), or None for a single symbol."""
        self.rank, self.parts = rank, parts
        self.stands = {}
        self.most = most

    def together(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.stands.get(pair)
        if known is None:
            if len(self.stands) >= self.most:
                self.stands.clear()
            known = self.stands[pair] = self._together(left, right)
        return known

    def _together(self, left: str, right: str) -> bool:
        limit = float("inf")
        rank, parts = self.rank, self.parts
        while True:
            across = rank(left, right)
            if across is not None and across < limit:
                return False
            a, b = parts(left), parts(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 0.5, b[1]
