"""Keyed lookup tables: which keys to ask for, and how answers replace each other.

A lookup row is (service, key, payload, version). The payload '{}' means "asked, not found"; an
absent row means "never asked".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from medley.functions.text import fold

# Service names and key prefixes of the stored answers.
FEATURE_SERVICE = "reccobeats"
GENRE_SERVICE = "getgenre"
FEATURE_KEY_PREFIX = "spotify"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lookup_key(prefix: str, *parts: Column) -> Column:
    """prefix and the stripped, case-folded non-blank parts, joined by ':'; null when all parts are empty."""
    texts = [F.nullif(fold(_stripped(p)), F.lit("")) for p in parts]
    given = F.lit(False)
    for p in parts:
        given = given | (F.coalesce(p, F.lit("")) != "")
    return F.when(given, F.concat_ws(":", F.lit(prefix), *texts))


def feature_key(item_id: Column) -> Column:
    return F.concat(F.lit(FEATURE_KEY_PREFIX + ":"), item_id)


def _empty(payload: Column) -> Column:
    return payload.isNull() | F.trim(payload).isin("{}", "null", "[]")


def newest_answers(answers: DataFrame) -> DataFrame:
    """One row per key: the answer with the highest version. Frames without versions hold one already."""
    if "version" not in answers.columns:
        return answers
    return answers.groupBy("key").agg(F.max_by("payload", "version").alias("payload"))


def pending_lookups(
    wanted: DataFrame, stored: DataFrame, recheck: bool = False, force: bool = False, exhausted: bool = False
) -> DataFrame:
    """Distinct keys that need a query.

    Always the absent ones; with `recheck` also those stored as not found and, when `exhausted` is
    set (genre answers), those marked exhausted = false; with `force` all.
    """
    keys = wanted.where(F.col("key").isNotNull()).select("key").distinct()
    if force:
        return keys
    missing = keys.join(stored.select("key"), "key", "left_anti")
    if not recheck:
        return missing
    stale = _empty(F.col("payload"))
    if exhausted:
        stale = stale | (F.get_json_object("payload", "$.exhausted") == "false")
    return missing.unionByName(keys.join(stored.where(F.coalesce(stale, F.lit(False))).select("key"), "key", "left_semi"))


def upsert_lookup(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert or replace by (service, key): the row with the highest version wins."""
    rows = stored.unionByName(updates)
    return rows.groupBy("service", "key").agg(
        F.max_by("payload", "version").alias("payload"), F.max("version").alias("version")
    )
