"""Array helpers that keep order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _strings() -> Column:
    return F.array().cast("array<string>")


def or_empty(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, _strings())


def ordered_union(existing: Column | str, incoming: Column | str) -> Column:
    """`existing` as it is, then the unseen values of `incoming` in their order, each once."""
    return F.concat(or_empty(existing), F.array_except(or_empty(incoming), or_empty(existing)))


def non_empty_parts(c: Column | str, sep: str = ";") -> Column:
    """Cells of a joined list; empty parts are dropped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.coalesce(c, F.lit("")), sep), lambda x: x != "")
