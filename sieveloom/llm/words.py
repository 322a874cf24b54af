"""Words of many texts at once, as hashes."""

from __future__ import annotations

import numpy as np

#: Code points hashed at once; keeps a worker's memory low.
RUN = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(name: str) -> np.ndarray:
    """For each code point whether it belongs to a word: letters and digits, or whatever isn't white space of ASCII."""
    if name not in _tables:
        if name == "letters":
            _tables[name] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
        else:
            table = np.ones(0x110000, dtype=bool)
            table[[0x20, *range(0x09, 0x0E)]] = False
            _tables[name] = table
    return _tables[name]


def _powers(n: int) -> np.ndarray:
    held = _tables.get("powers")
    if held is None or len(held) < n:
        n = 1 << max(10, n - 1).bit_length()
        held = _tables["powers"] = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    return held


def _hashed(codes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a run of code points, and where they begin."""
    inside = _table(kind)[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return np.empty(0, np.uint64), first
    sizes = last - first
    starts = np.cumsum(sizes) - sizes
    letters = codes[inside].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(letters)) - np.repeat(starts, sizes)
    sums = np.add.reduceat(letters * _powers(int(sizes.max()))[place], starts)
    return mixed(sums ^ (sizes.astype(np.uint64) << np.uint64(56))), first


def _runs(codes: np.ndarray, kind: str):
    """Cuts a long run of code points between words."""
    start, table = 0, _table(kind)
    while start < len(codes):
        end = min(len(codes), start + RUN)
        while end < len(codes) and table[codes[end]]:
            gap = np.flatnonzero(~table[codes[end : end + RUN]])
            end += int(gap[0]) if len(gap) else min(RUN, len(codes) - end)
        yield start, codes[start:end]
        start = end


def word_hashes(texts: list[str | None], kind: str = "letters") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in turn, and the number of words of each text.

    Words are runs of letters and digits ("letters", of texts made lower case) or of anything but
    space, tab, line feed, vertical tab, form feed and carriage return ("blanks"). Hashing goes over
    arrays of code points, not word by word.
    """
    texts = [x or "" for x in texts]
    if kind == "letters":
        texts = [x.lower() for x in texts]
    ends = np.cumsum([len(x) + 1 for x in texts])
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = [(h, at + first) for first, run in _runs(codes, kind) for h, at in [_hashed(run, kind)]]
    if not parts:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(texts)).astype(np.int64)


def runs_of(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text in turn (a shorter text is one run), and their number in each text."""
    last = np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(hashes))
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(n):
        inside = place + k < last
        out = np.where(inside, mixed(out + np.take(hashes, place + k, mode="clip")), out)
    numbers = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    return out[place - np.repeat(np.cumsum(counts) - counts, counts) < np.repeat(numbers, counts)], numbers
