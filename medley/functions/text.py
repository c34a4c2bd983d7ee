"""Text normalisation and the token-sort similarity."""

from __future__ import annotations

import sys
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Characters whose full case folding is one other character, those, and the foldings of several characters."""
    changed = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c != c.casefold()}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in changed.items() if len(f) > 1}


def fold(c: Column | str) -> Column:
    """Case-insensitive form of a text: full Unicode case folding, which for ASCII texts is lower case."""
    c = F.col(c) if isinstance(c, str) else c
    one, other, several = _foldings()
    longer = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(f).alias("f")) for x, f in several.items()])
    full = F.aggregate(longer, F.translate(c, one, other), lambda s, p: F.replace(s, p["x"], p["f"]))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(full)


def norm_text(c: Column | str) -> Column:
    """Lower case with every run of Unicode blanks turned into one blank, ends trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[\s\x1c-\x1f]+", " "))


def token_sort(c: Column | str) -> Column:
    """Words of a normalised text in code-point order, joined by one blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word style step per character of b."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def _similarity(a: str, b: str) -> float:
    """One minus the share of inserted and deleted characters, taken through percent as it is published."""
    if a == b:
        return 1.0
    total = len(a) + len(b)
    return (1.0 - (total - 2 * _common_subsequence(a, b)) / total) * 100.0 / 100.0


@F.pandas_udf(DoubleType())
def lcs_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Normalised similarity 2 * LCS / (len a + len b); two empty texts are equal."""
    return pd.Series([None if x is None or y is None else _similarity(x, y) for x, y in zip(a, b)], dtype="float64")


def token_sort_similarity(a: Column | str, b: Column | str) -> Column:
    """Similarity 0..1 of two texts, blind to case, blanks and word order."""
    return lcs_similarity(token_sort(norm_text(a)), token_sort(norm_text(b)))


def round_half_even(x: str, digits: int = 3) -> Column:
    """A value in 0..1 rounded by its exact binary value, ties to even, as SQL over the expression `x`.

    Rounding by the printed decimals would send 0.8875, which is stored slightly below, upwards.
    """
    scale = 10**digits

    def at(bits: int) -> str:
        # x * 2**bits is a whole number of at most 61 bits for the values this branch gets.
        unit = 1 << bits
        scaled = f"cast(cast(({x}) * {float(unit)!r}D as bigint) as decimal(20,0)) * {scale}"
        whole, rest = f"({scaled}) div {unit}BD", f"2 * (({scaled}) % {unit}BD)"
        up = f"if({rest} > {unit}BD or ({rest} = {unit}BD and ({whole}) % 2 = 1), 1, 0)"
        return f"cast({whole} + {up} as double) / {scale}D"

    return F.expr(f"if(({x}) < 0.0078125D, {at(67)}, {at(60)})")
