"""Text functions that have no built-in counterpart."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


# Signs of formulas.
SIGNS = "+\\-×÷*/=√∞∑∏∫^πφαβγδεηθλμνξρστχψω"
MATH = re.compile(f"[{SIGNS}\U0001d6fc-\U0001d714]")
ONLY_MATH = re.compile(f"^[{SIGNS}\U0001d6fc-\U0001d714]+$")
DIGITS, LEADING = re.compile(r"^\d{1,3}$"), re.compile(r"^(\d{1,3})\s+(\S.{0,119})$")
MARKED = re.compile(r"^[?+=#]")
RULE = re.compile(r"^[=+]{3,}$")
ITEM = re.compile(r"^(?:[#*+=]?\s*[a-fA-F][.)]|\d{1,4}[.)]\s*\S)")
OPEN_END = re.compile(r"[+\-×÷*/=≤≥±]\s*$")

Join = tuple[str, int]


def _question_sign(a: str, b: str, c: str | None) -> Join | None:
    return (f"{a} ?", 1) if b == "?" and not MARKED.match(a) and a[-1].isalpha() else None


def _signs_over_number(a: str, b: str, c: str | None) -> Join | None:
    return (f"{a}/{b}", 1) if ONLY_MATH.match(a) and not RULE.match(a) and DIGITS.match(b) else None


def _option_over_number(a: str, b: str, c: str | None) -> Join | None:
    short = len(b) <= 12 and (DIGITS.match(b) or ONLY_MATH.match(b))
    return (f"{a}/{b}", 1) if re.match(r"^[=+]\s*(?:√\d+|-\d+)$", a) and short else None


def _signs_over_text(a: str, b: str, c: str | None) -> Join | None:
    rest = LEADING.match(b)
    return (f"{a}/{rest[1]} {rest[2]}", 1) if ONLY_MATH.match(a) and not MARKED.match(a) and rest else None


def _question_in_three(a: str, b: str, c: str | None) -> Join | None:
    if a != "?" or not MATH.search(b) or MARKED.match(b) or c is None:
        return None
    if rest := LEADING.match(c):
        return f"? {b}/{rest[1]} {rest[2]}", 2
    return (f"? {b}{c}", 2) if re.match(r"^_\{\d+\}\s+\S", c) else None


def _option_in_three(a: str, b: str, c: str | None) -> Join | None:
    if a not in ("=", "+") or c is None or MARKED.match(b):
        return None
    return (f"{a} {b}/{c}", 2) if (DIGITS.match(b) or MATH.search(b)) and ONLY_MATH.match(c) and not RULE.match(c) else None


def _negative_option(a: str, b: str, c: str | None) -> Join | None:
    if not re.match(r"^[=+]\s*-$", a) or not DIGITS.match(b):
        return None
    return (f"{a}{b}/{c}", 2) if c is not None and DIGITS.match(c) else (f"{a}{b}", 1)


def _number_over_number(a: str, b: str, c: str | None) -> Join | None:
    return (f"{a}/{b}", 1) if DIGITS.match(a) and DIGITS.match(b) else None


def _formula_over_number(a: str, b: str, c: str | None) -> Join | None:
    return (f"{a}/{b}", 1) if len(a) <= 25 and MATH.search(a) and not RULE.match(a) and not OPEN_END.search(a) and DIGITS.match(b) else None


def _root_over_text(a: str, b: str, c: str | None) -> Join | None:
    rest = LEADING.match(b)
    return (f"{a}/{rest[1]} {rest[2]}", 1) if re.search(r"√\d+$", a) and rest else None


def _equation_in_three(a: str, b: str, c: str | None) -> Join | None:
    if not a.endswith("=") or RULE.match(a) or not DIGITS.match(b) or c is None or MARKED.match(c):
        return None
    rest = LEADING.match(c)
    return (f"{a} {b}/{rest[1]} {rest[2]}", 2) if rest else (f"{a} {b}/{c}", 2) if DIGITS.match(c) else None


def _open_end(a: str, b: str, c: str | None) -> Join | None:
    return (f"{a} {b}", 1) if OPEN_END.search(a) and not RULE.match(a) and not MARKED.match(b) and not ITEM.match(b) else None


def _degrees(a: str, b: str, c: str | None) -> Join | None:
    return (f"{a}/{b}", 1) if a.endswith("°") and re.match(r"^1\s*[-+].*°$", b) else None


def _wrapped(a: str, b: str, c: str | None) -> Join | None:
    return (f"{a} {b}", 1) if a[-1].islower() and b[0].islower() and not ITEM.match(b) and not RULE.match(a) else None


#: In the order in which they are tried.
CASES: list[Callable[[str, str, str | None], Join | None]] = [_question_sign, _signs_over_number, _option_over_number, _signs_over_text, _question_in_three, _option_in_three, _negative_option, _number_over_number, _formula_over_number, _root_over_text, _equation_in_three, _open_end, _degrees, _wrapped]


def join_lines(text: str | None) -> str | None:
    """Broken lines joined: each line that is reached takes the first case that holds with the next non-blank one or two, and what it takes is skipped."""
    if text is None:
        return None
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.strip()]
    out, nth, at = [], 0, 0
    while at < len(lines):
        if nth >= len(full) or at < full[nth]:
            out.append(lines[at])
            at += 1
            continue
        a, b, c = (lines[full[nth + j]].strip() if nth + j < len(full) else None for j in range(3))
        hit = next((x for case in CASES if b is not None and (x := case(a, b, c))), None)
        joined, taken = hit or (lines[at], 0)
        out.append(joined)
        nth += taken + 1
        at = full[nth - 1] + 1
    return "\n".join(out)


@pandas_udf(StringType())
def joined_lines(texts: pd.Series) -> pd.Series:
    return texts.map(join_lines)
