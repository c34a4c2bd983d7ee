"""Row-level work on the group memberships of an item (two parallel lists of ids and names)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from medley.functions.arrays import or_empty
from medley.functions.text import fold
from medley.plans.skew import running_number
from medley.schema import ID


def _zipped(ids: Column, names: Column) -> Column:
    """Pairs up to the shorter of both lists."""
    n = F.least(F.size(ids), F.size(names))
    return F.arrays_zip(F.slice(ids, 1, n).alias("id"), F.slice(names, 1, n).alias("name"))


def _pairs() -> Column:
    return _zipped(or_empty("playlist_ids"), or_empty("playlist_names"))


def _any_match(subs: Sequence[str], *texts: Column) -> Column:
    """Whether any of the texts contains any of the substrings, case-folded."""
    hit = F.lit(False)
    for sub in sorted(set(subs)):
        for text in texts:
            hit = hit | F.contains(fold(text), fold(F.lit(sub)))
    return hit


def _matching_pairs(subs: Sequence[str]) -> Column:
    return F.filter(_pairs(), lambda p: _any_match(subs, p["id"], p["name"]))


def filter_membership(tracks: DataFrame, playlists: Sequence[str] | None) -> DataFrame:
    """Keep the memberships whose id or name contains any substring; drop rows left without one."""
    if not playlists:
        return tracks
    return (
        tracks.withColumn("_kept", _matching_pairs(playlists))
        .where(F.size("_kept") > 0)
        .withColumn("playlist_ids", F.transform("_kept", lambda p: p["id"]))
        .withColumn("playlist_names", F.transform("_kept", lambda p: p["name"]))
        .drop("_kept")
    )


def is_selected(playlists: Sequence[str] | None) -> Column:
    """Row predicate of the same form; rows that fail it are passed through by the caller."""
    if not playlists:
        return F.lit(True)
    return F.exists(_pairs(), lambda p: _any_match(playlists, p["id"], p["name"]))


def filter_groups(playlists: DataFrame, subs: Sequence[str] | None) -> DataFrame:
    """Groups whose name or id contains any substring, chosen before their items are read."""
    if not subs:
        return playlists
    return playlists.where(_any_match(subs, F.col("name"), F.col(ID)))


def group_name_of(playlist_id: Column | str, ids: str = "playlist_ids", names: str = "playlist_names") -> Column:
    """Name of the first matching id, or the id itself when absent or the names are short."""
    pid = F.col(playlist_id) if isinstance(playlist_id, str) else playlist_id
    index = F.nullif(F.array_position(F.col(ids), pid), F.lit(0)).cast("int")
    return F.when(index <= F.size(names), F.coalesce(F.try_element_at(F.col(names), index), pid)).otherwise(pid)


def membership_pairs(ids: str = "playlist_ids", names: str = "playlist_names") -> Column:
    """(id, name) of every membership of a row, named by the first occurrence of the id."""
    return F.transform(or_empty(ids), lambda p: F.struct(p.alias("id"), group_name_of(p, ids, names).alias("name")))


def membership_integrity(tracks: DataFrame) -> DataFrame:
    """Fail on the first row whose id and name lists differ in length."""
    n_ids, n_names = F.size(or_empty("playlist_ids")), F.size(or_empty("playlist_names"))
    message = F.concat(
        F.lit("Track "),
        F.col(ID),
        F.lit(" has mismatched playlist metadata: "),
        n_ids.cast("string"),
        F.lit(" playlist_ids vs "),
        n_names.cast("string"),
        F.lit(" playlist_names."),
    )
    return tracks.where(F.when(n_ids == n_names, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def membership_mismatches(tracks: DataFrame) -> DataFrame:
    """The rows that membership_integrity would fail on, with both lengths."""
    return tracks.select(
        ID, F.size(or_empty("playlist_ids")).alias("n_ids"), F.size(or_empty("playlist_names")).alias("n_names")
    ).where(F.col("n_ids") != F.col("n_names"))


def explode_memberships(tracks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per membership: pos, m_idx, id, group_id, group_name and the columns to keep."""
    return membership_integrity(tracks).select(
        "pos",
        ID,
        *keep,
        F.posexplode(F.arrays_zip(F.col("playlist_ids").alias("id"), F.col("playlist_names").alias("name"))).alias(
            "m_idx", "_m"
        ),
    ).select(
        "pos", "m_idx", ID, *keep, F.col("_m.id").alias("group_id"), F.col("_m.name").alias("group_name")
    )


def implode_memberships(members: DataFrame, chunk: int | None = None) -> DataFrame:
    """Membership rows back to list columns, one row per item.

    With `chunk` an item gives one row per so many memberships, numbered by `part`, so that the rows of items
    in very many groups stay small. Needs (spotify_id, m_idx) unique, m_idx counted from 0.
    """
    part = [] if chunk is None else [F.floor(F.col("m_idx") / chunk).alias("part")]
    return (
        members.groupBy(ID, *part)
        .agg(F.array_sort(F.collect_list(F.struct("m_idx", "group_id", "group_name"))).alias("_m"))
        .select(
            ID,
            *(["part"] if part else []),
            F.transform("_m", lambda m: m["group_id"]).alias("playlist_ids"),
            F.transform("_m", lambda m: m["group_name"]).alias("playlist_names"),
        )
    )


def number_memberships(members: DataFrame, order: Sequence[str]) -> DataFrame:
    """Give every membership row its 0-based place inside its item."""
    return running_number(members, [ID], "m_idx", order).withColumn("m_idx", F.col("m_idx") - 1)
